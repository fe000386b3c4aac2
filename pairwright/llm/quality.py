"""Quality rules as a short-circuit cascade, with built-in functions only.

Base measures of the whole text: n_words, word_chars, n_symbols, n_dup_lines,
n_repeat_words; ``base_failed`` is a fixed rule over them.  The remaining
rules are independent rejections.  On a sample (the ``sample_rows`` ids with
the smallest hash: a documented bound) each rule's running time and share of
rejected rows are measured; rules are then evaluated in descending rejection
per cost, and a row that one rule rejects is not shown to the later ones
(nested CASE).  The order changes the cost only: a row is kept exactly if no
rule rejects it.

Repeated windows are found inside a row: the 5-word windows' 64-bit hashes are
sorted with their positions, equal neighbours mark repeats, and the covered
words are the sum of the gaps between marked positions, five at most.  No
window leaves its row, so nothing is shuffled.

Nulls and edge cases: a null or empty text has no words and fails the base
rule; repeated rows are judged alike; ids are passed through (null too); extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import SPACE, SPACE_CHARS, texts
from pairwright.llm.common import staged as stage

SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PCT, SAMPLE_ROWS = 5, 10, 20, 1000


def _count(text: Column, chars: str) -> Column:
    """Number of code points of the character class body ``chars``; what lies between goes run by run."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed."""
    t = F.col("text")
    d = texts(docs, id_col, text_col)
    d = d.withColumns({
        "words": F.array_remove(F.split(t, SPACE + "+", -1), ""),
        "lines": F.array_remove(F.transform(F.split(t, "\n", -1), lambda x: F.when(F.ltrim(x, F.lit(SPACE_CHARS)) != "", x).otherwise("")), ""),
    })
    d = d.select("doc_id", "text", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
                 F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                 _count(t, SYMBOLS).cast("long").alias("n_symbols"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.transform("words", lambda w: F.xxhash64(w)).alias("hs"))
    starts = F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW)
    d = d.withColumn("grams", F.when(F.col("n_words") > WINDOW, F.transform(
        starts, lambda i: F.xxhash64(*[F.get("hs", i + j) for j in range(WINDOW)]))))
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(
        F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))

    def marked(s, j):
        def same(k):
            return F.coalesce(F.get("sorted", k)["g"] == s["g"], F.lit(False))
        return F.when(same(j - 1) | same(j + 1), s["i"])

    d = d.withColumn("at", F.sort_array(F.array_compact(F.transform("sorted", marked))))
    gaps = F.transform("at", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("at", j + 1) - x, F.lit(WINDOW))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return d.select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
                    failed.alias("base_failed"))


def rules() -> dict[str, Column]:
    """Rejections by name; each is never null."""
    t, n = F.col("text"), F.greatest(F.col("n_words"), F.lit(1))
    letters = _count(t, r"\p{L}")
    return {
        "symbols": F.col("n_symbols") > 0.1 * n,
        "exclamations": _count(t, "!") > 0.1 * n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n),
        "same_lines": F.col("n_dup_lines") > 0.3 * F.greatest(F.col("n_lines"), F.lit(1)),
        "capitals": _count(t, r"\p{Lu}") > 0.4 * letters,
        "few_letters": letters < 0.6 * F.col("word_chars"),
        "open_lines": F.size(F.filter(F.split(t, "\n", -1), lambda x: x.endswith("...") | x.endswith("…")))
        > 0.3 * F.greatest(F.col("n_lines"), F.lit(1)),
    }


def order_by_sample(docs: DataFrame, named: dict[str, Column], sample_rows: int = SAMPLE_ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Rule names by rejected share per second on the sample, best first; base measures are made for the sample only."""
    rows = texts(docs, id_col, text_col)
    ids = rows.select(F.col("doc_id").alias("sample_id")).distinct().orderBy(F.xxhash64("sample_id")).limit(sample_rows)
    picked = stage(rows.join(F.broadcast(ids), F.col("doc_id") == F.col("sample_id")).drop("sample_id"), "quality-sample-texts")
    sample = stage(base(picked).coalesce(2), "quality-sample")
    worth = {}
    for name, reject in named.items():
        query = sample.agg(F.avg(reject.cast("double")))
        took = []
        for _ in range(2):
            began = time.perf_counter()
            share = query.first()[0] or 0.0
            took.append(time.perf_counter() - began)
        worth[name] = share / min(took)
    return sorted(named, key=lambda x: (-worth[x], x))


def cascade(rows: DataFrame, named: dict[str, Column], order: list[str]) -> Column:
    """True where no rule rejects; later rules are evaluated only where earlier ones pass."""
    verdict = F.lit(True)
    for name in reversed(order):
        verdict = F.when(named[name], F.lit(False)).otherwise(verdict)
    return F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict)


def judge(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base measures, base_failed, kept."""
    rows, named = base(docs, id_col, text_col), rules()
    kept = cascade(rows, named, order_by_sample(docs, named, sample_rows, id_col, text_col))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
