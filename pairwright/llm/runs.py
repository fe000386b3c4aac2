"""Periodic run detection by internal pattern matching.

A *run* is a stretch of consecutive words whose smallest period q (words q
apart are identical) fits at least ``MIN_EXPONENT`` times, that has at least
``MIN_LENGTH`` words, and that no neighbouring word extends keeping period q.

Documents are worked on in batches of about ``BATCH_WORDS`` words (a longer
document is a batch of its own).  A symbol stands for a word of one document,
so nothing matches across documents.

* Prefix doubling sorts the suffixes; after step k the rank of a suffix names
  its *dyadic block*, the next 2**k words, and the block's occurrences are one
  interval of the suffix array.  Only suffixes whose block recurs are sorted on.
* For each block of m = 2**k words that starts at a multiple of m, a wavelet
  matrix over the suffix array (range successor and predecessor) gives the
  nearest occurrences in the windows of m positions after and before it.  As
  the occurrences in such a window form a progression, its first difference d
  is the block's period there, and a candidate if m/2 < d <= m.
* Ranks also give longest common extensions, by which every candidate is
  extended to both sides; stretches long enough are the runs.

Complete: a run with period q and at least 4q words holds a block of the
smallest m >= q that starts at a multiple of m, together with its copy q words
before or after.  Exact: the copy is the nearest occurrence, so no smaller
period fits the stretch.

A word is dropped if any run contains it after that run's first q words.

Nulls and edge cases: a null or empty text has no words, no run and the empty
collapsed text; a null doc_id is passed on; repeated rows get the same result;
a text's white space becomes single blanks; extra columns are ignored; an empty
table gives no rows.  One document is the unit of memory (some 250 bytes a word
in the worst case).
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import SPACE, from_text, texts
from pairwright.llm.wavelet import WaveletMatrix

MIN_EXPONENT, MIN_LENGTH, BATCH_WORDS = 4, 6, 250_000


def blocks_of(sym: np.ndarray, longest: int) -> tuple[list[np.ndarray], np.ndarray, list[tuple]]:
    """Ranks by level, the suffix array, and (level, starts, lo, hi) of the aligned blocks that recur.

    Levels go on while blocks recur and are shorter than half the ``longest`` document.
    """
    n = len(sym)
    sa = np.argsort(sym, kind="stable")
    slots = np.arange(n)
    act, keys, ranks, found = sa, sym[sa].astype(np.int64), [], []
    rank = np.empty(n, np.int32)
    level = 0
    while True:
        m = 1 << level
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        begin = np.flatnonzero(first)
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(act))))
        sizes = np.diff(np.append(begin, len(act)))[group]
        heads = slots[begin][group]
        rank = rank.copy()
        rank[act] = heads
        ranks.append(rank)
        again = sizes > 1
        own = again & (act % m == 0)
        found.append((level, act[own], heads[own], heads[own] + sizes[own]))
        if 2 * m > longest or not again.any():
            return ranks, sa, found
        act, slots = act[again], slots[again]
        behind = act + m
        keys = rank[act].astype(np.int64) * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)], -1) + 1
        order = np.argsort(keys, kind="stable")
        act, keys = act[order], keys[order]
        sa[slots] = act
        level += 1


def _candidates(ranks, sa, found) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (start, distance) of a block and its nearest copy."""
    n, starts, gaps = len(sa), [], []
    matrix = None
    for level, at, lo, hi in found:
        m = 1 << level
        if level == 0:  # a window of one position: the neighbour itself
            own = np.flatnonzero(ranks[0][:-1] == ranks[0][1:])
            starts.append(own)
            gaps.append(np.ones(len(own), np.int64))
            continue
        if not len(at):
            continue
        matrix = matrix or WaveletMatrix(sa)
        prev, after = matrix.neighbours(lo.astype(np.int64), hi.astype(np.int64), at)
        ok = (after >= 0) & (after - at <= m) & (2 * (after - at) > m)
        starts.append(at[ok])
        gaps.append((after - at)[ok])
        ok = (prev >= 0) & (at - prev <= m) & (2 * (at - prev) > m)
        starts.append(prev[ok])
        gaps.append((at - prev)[ok])
    if not n or not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts).astype(np.int64), np.concatenate(gaps).astype(np.int64)


def _extend(ranks, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """Longest common extension of positions i < j: of what starts there (step 1) or ends before them (-1)."""
    n, total = len(ranks[0]), np.zeros(len(i), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        m, rank = 1 << level, ranks[level]
        live = np.arange(len(i))
        while len(live):
            a, b = i[live] + step * total[live], j[live] + step * total[live]
            if step < 0:
                a, b = a - m, b - m
                ok = a >= 0
            else:
                ok = b < n
            ok[ok] = rank[a[ok]] == rank[b[ok]]
            live = live[ok]
            total[live] += m
            if level < len(ranks) - 1:
                break
    return total


def find_runs(sym: np.ndarray, longest: int, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH):
    """start, length, period of all runs, by start, then period.  ``min_exponent`` is at least 4."""
    if min_exponent < 4:
        raise ValueError("candidates are complete for runs of four periods and more")
    none = np.empty(0, np.int64)
    if not len(sym):
        return none, none, none
    ranks, sa, found = blocks_of(sym, longest)
    at, gap = _candidates(ranks, sa, found)
    if not len(at):
        return none, none, none
    left, right = _extend(ranks, at, at + gap, -1), _extend(ranks, at, at + gap, 1)
    start, length = at - left, left + gap + right
    ok = length >= np.maximum(min_length, min_exponent * gap)
    got = np.unique(np.stack([start[ok], gap[ok], length[ok]], 1), axis=0)
    return got[:, 0], got[:, 2], got[:, 1]


def _batch(docs: list[list[bytes]], min_exponent: int, min_length: int):
    """Per document: starts, lengths, periods (relative to it) and the collapsed text."""
    sizes = np.array([len(ws) for ws in docs], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    number, ids = count(), []
    for ws in docs:
        ids.extend(map(defaultdict(number.__next__).__getitem__, ws))
    start, length, period = find_runs(np.array(ids, np.int64), int(sizes.max(initial=0)), min_exponent, min_length)
    cover = np.zeros(first[-1] + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    keep = np.cumsum(cover[:-1]) == 0
    owner = np.searchsorted(first, start, "right") - 1
    lo, hi = np.searchsorted(owner, np.arange(len(docs))), np.searchsorted(owner, np.arange(len(docs)), "right")
    for d, ws in enumerate(docs):
        a, b = lo[d], hi[d]
        if a == b:
            yield (), (), (), b" ".join(ws).decode("utf-8")
        else:
            kept = keep[first[d]:first[d + 1]]
            yield start[a:b] - first[d], length[a:b], period[a:b], b" ".join([w for w, k in zip(ws, kept.tolist(), strict=True) if k]).decode("utf-8")


def collapse(docs: DataFrame, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH, batch_words: int = BATCH_WORDS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (array of start, length, period, in this order) and text (the kept words, joined by single blanks)."""
    def make():
        def work(batch: list[str]):
            out, held, size = [], [], 0
            for text in batch:
                ws = text.encode("utf-8").split()
                if held and size + len(ws) > batch_words:
                    out.extend(_batch(held, min_exponent, min_length))
                    held, size = [], 0
                held.append(ws)
                size += len(ws)
            out.extend(_batch(held, min_exponent, min_length))
            return [*zip(*out, strict=True)] if out else [()] * 4
        return work

    own = texts(docs, id_col, text_col)
    got = from_text(own, make, {"starts": "array<long>", "lengths": "array<long>", "periods": "array<long>", "collapsed": "string"})
    runs = F.zip_with(F.arrays_zip("starts", "lengths"), "periods",
                      lambda a, q: F.struct(a["starts"].alias("start"), a["lengths"].alias("length"), q.alias("period")))
    return got.select("doc_id", runs.alias("runs"), F.col("collapsed").alias("text"))


def longest_run(runs: Column) -> Column:
    """The run with the greatest length (ties: smallest start, then period); null where there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    return F.when(F.size(runs) > 0, F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["q"]).alias("period")))


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text: in a tenth of the documents the words from some place on repeat the first p of them.

    h = crc32 of the decimal doc_id, g = h div 10; where h % 10 = 0 and there
    are n > 0 words, word i >= a becomes word a + (i - a) % p with a = g % n,
    p = 1 + (n - a) div (3 + g % 8).  Other texts, and those of null ids, stay.
    """
    t = texts(docs, id_col, text_col).withColumn("g", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    ws = F.filter(F.split("text", SPACE + "+"), lambda w: w != "")
    chosen = F.coalesce(F.col("g") % 10 == 0, F.lit(False)) & F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    t = t.withColumn("ws", F.when(chosen, ws)).withColumn("g", F.floor(F.col("g") / 10)).withColumn("n", F.size("ws").cast("long"))
    t = t.withColumn("a", F.when(F.col("ws").isNotNull(), F.col("g") % F.col("n")))
    t = t.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    turned = F.concat(F.slice("ws", F.lit(1), F.col("a").cast("int")), F.transform(
        F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.element_at("ws", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    return t.select("doc_id", F.when(F.col("ws").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))
