"""Toxicity: weighted lexicon, Aho-Corasick over folded text, length normalisation.

*Folding* puts look-alike letters, full-width forms and digits or signs that
stand for letters onto plain letters (lexicon and texts alike), lower-cases,
and turns everything that is no letter into single blanks.

*Lexicon*: terms are whole words and word beginnings of 4 to 6 letters.  Their
weights are smoothed log-odds of document frequencies in toxic and other
training rows.  *Exception phrases* (a lexicon word with the word before or
after it) are given by the caller or learnt: phrases that training rows
without the label use at least as often per row.  A hit inside one counts
nothing.

*Score*: the hits' weights are summed and set against the length; a logistic
curve over (sum, sum per hundred words), fitted on the training rows, gives a
probability.

The fit reads at most ``max_rows`` labelled rows (those with the smallest hash
of doc_id): a documented bound.  Scores read whole texts and nothing but them.

Nulls and edge cases: null and empty texts score like texts without a hit;
rows without a label or a doc_id are not learnt from; if no row is labelled
toxic the lexicon is empty and every score is the smoothed base rate; repeated
rows score alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import staged as stage
from pairwright.llm.common import from_text, texts

MAX_ROWS, MAX_TERMS, MIN_SUPPORT, MIN_WEIGHT, THRESHOLD = 20_000, 2_000, 3, 2.0, 0.3

#: Look-alikes (Cyrillic, Greek, digits and signs) and the letters they stand for.
_ALIKE = dict(zip("авеһіјкмнорсѕтухԁԛԝ" "αβεικνορτυχω" "0134578@$€ı",
                  "abehijkmhopcstyxdqw" "abeikvoptuxw" "oieastbasei", strict=True))
#: l goes to i, as 1 stands for either; invisible characters go.
_FOLD = str.maketrans({**_ALIKE, "l": "i", **{chr(c): None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}})
_NOT_LETTER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """`` word word `` in folded form; a blank at both ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return " " + _NOT_LETTER.sub(" ", text.lower().translate(_FOLD)).strip() + " "


def _terms(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        if len(w) >= 3:
            out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in (4, 5, 6) if len(w) > n)
    return out


@dataclass
class ToxicityModel:
    """terms: term -> weight; exceptions: folded phrases; curve: bias and two slopes."""

    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (w, len(t)))
        for p in self.exceptions:
            a.add_word(f" {p} ", (None, len(p) + 2))
        if len(a):
            a.make_automaton()
        return a

    @staticmethod
    def weigh(a, folded: str) -> tuple[float, int]:
        """Sum of weights and number of hits outside exception phrases."""
        hits, spared = [], []
        for end, (w, n) in a.iter(folded) if len(a) else ():
            (spared if w is None else hits).append((end - n + 1, end, w))
        if spared:  # a hit is inside a phrase if, of those that begin no later, one ends no earlier
            counted, phrases, reach = [], iter([*sorted(s[:2] for s in spared), (math.inf, 0)]), -1
            begin, stop = next(phrases)
            for h in sorted(hits, key=lambda h: h[0]):
                while begin <= h[0]:
                    reach = max(reach, stop)
                    begin, stop = next(phrases)
                if h[1] > reach:
                    counted.append(h)
            hits = counted
        return math.fsum(h[2] for h in hits), len(hits)

    @staticmethod
    def features(total: float, folded: str) -> tuple[float, float]:
        n = max(1, folded.count(" ") - 1)
        return math.log1p(total), math.log1p(100 * total / n)

    def probability(self, x: tuple[float, float]) -> float:
        z = self.curve[0] + self.curve[1] * x[0] + self.curve[2] * x[1]
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _count(rows: DataFrame, finder) -> DataFrame:
    """term, toxic, other: the numbers of rows that hold a term, summed per task before the shuffle.

    ``finder()`` is called once per task and gives the function from a folded text to its terms.
    """
    def run(batches):
        terms_of = finder()
        for b in batches:
            for i in range(0, len(b), 500):
                part, by = b.iloc[i:i + 500], (Counter(), Counter())
                for text, toxic in zip(part["text"], part["toxic"], strict=True):
                    by[int(toxic)].update(terms_of(fold(text)))
                keys = list(by[0] | by[1])
                if keys:
                    yield pd.DataFrame({"term": keys, "toxic": [by[1][k] for k in keys], "other": [by[0][k] for k in keys]})
    return rows.mapInPandas(run, "term string, toxic long, other long") \
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic fit by Newton steps, with a small ridge on the slopes."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pen = np.zeros(3), np.diag([1e-3, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pen, x.T @ (y - p) - pen @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), max_rows: int = MAX_ROWS,
        max_terms: int = MAX_TERMS, min_support: int = MIN_SUPPORT, min_weight: float = MIN_WEIGHT) -> ToxicityModel:
    """Learns from ``labels`` (doc_id, toxic; the caller leaves held-out rows away)."""
    lab = labels.select(F.col("doc_id").cast("long").alias("lab_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    lab = lab.groupBy("lab_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("lab_id"), "lab_id").limit(max_rows)
    rows = texts(docs).join(F.broadcast(lab), F.col("doc_id") == F.col("lab_id"))  # at most max_rows ids
    rows = stage(rows.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).repartition(16), "toxicity-rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, t = size["n"], size["t"] or 0
    if not t or t == n:
        p = (t + 0.5) / (n + 1)
        return ToxicityModel({}, [], (math.log(p / (1 - p)), 0.0, 0.0))
    weight = F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("other") + 0.5) / (n - t + 1))
    found = _count(rows, lambda: _terms).filter(F.col("toxic") >= min_support).withColumn("w", weight) \
        .filter(F.col("w") >= min_weight).orderBy(F.desc(F.col("w") * F.col("toxic")), F.length("term"), "term") \
        .limit(4 * max_terms).collect()  # bounded by the model's size
    terms: dict[str, float] = {}
    for r in found:
        word = r["term"].strip()
        longer = any(k.startswith(r["term"].rstrip()) for k in terms)
        if len(terms) < max_terms and not longer and not any(f" {word[:i]}" in terms for i in (4, 5, 6)):
            terms[r["term"]] = float(r["w"])
    model = ToxicityModel(terms, sorted({fold(e).strip() for e in exceptions} - {""}))
    model.exceptions += _learnt(rows, model, n, t, min_support)
    feats = rows.mapInPandas(_features(model), "total double, a double, b double, toxic int").toPandas()  # bounded by max_rows
    model.curve = _curve(feats[["a", "b"]].to_numpy(), feats["toxic"].to_numpy(float))
    return model


def _learnt(rows: DataFrame, model: ToxicityModel, n: int, t: int, min_support: int) -> list[str]:
    def phrases(a, folded: str) -> set[str]:
        out = set()
        for end, (_, size) in a.iter(folded) if len(a) else ():
            start = end - size + 2
            stop = folded.index(" ", start)
            before = folded[:start - 1].rsplit(" ", 1)[-1]
            after = folded[stop + 1:folded.find(" ", stop + 1)] if stop + 1 < len(folded) else ""
            own = folded[start:stop]
            out.update(p for p, x in ((f"{before} {own}", before), (f"{own} {after}", after)) if x)
        return out
    often = _count(rows, lambda: partial(phrases, model.automaton())).filter((F.col("other") >= min_support)
                                         & (F.col("other") / (n - t) >= F.col("toxic") / t))
    return [r["term"] for r in often.orderBy(F.desc("other"), "term").limit(MAX_TERMS).collect()]


def _features(model: ToxicityModel):
    def run(batches):
        a = model.automaton()
        for b in batches:
            got = []
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                folded = fold(text)
                total, _ = model.weigh(a, folded)
                got.append((total, *model.features(total, folded), toxic))
            yield pd.DataFrame(got, columns=["total", "a", "b", "toxic"])
    return run


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, n_hits."""
    def make():
        a = model.automaton()

        def judge(batch: list[str]):
            got = []
            for text in batch:
                folded = fold(text)
                total, hits = model.weigh(a, folded)
                p = model.probability(model.features(total, folded))
                got.append((p, int(p >= threshold), hits))
            return list(zip(*got, strict=True)) or [()] * 3
        return judge
    return from_text(texts(docs, id_col, text_col), make, {"score": "double", "predicted": "int", "n_hits": "int"})


def predicted(model: ToxicityModel, text: Column, threshold: float = THRESHOLD) -> Column:
    """The prediction (0 or 1) for a text column; null counts as empty."""
    @F.pandas_udf("int")
    def judge(texts: pd.Series) -> pd.Series:
        a, out = model.automaton(), []
        for t in texts:
            folded = fold(t)
            out.append(int(model.probability(model.features(model.weigh(a, folded)[0], folded)) >= threshold))
        return pd.Series(out, dtype="int32")
    return judge(F.coalesce(text.cast("string"), F.lit("")))


def held_out(id_col: str = "doc_id"):
    """The fold that is never learnt from: crc32 of the id's text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits: learnt on the training fold, for all rows."""
    model = fit(docs, labels.filter(~held_out()))
    return score(docs, model).withColumn("held_out", held_out())
