"""Substring dedup: repeated-phrase automata.

A window is ``window`` consecutive words of one document.  A word is removed
if a window that covers it has a word sequence that also starts earlier
(smaller doc_id, or earlier in the same document); windows are judged on the
input.

1. *Candidates.*  In every window the smallest ``gram``-word hash is its
   anchor, so equal windows have equal anchors.  Neighbouring windows with the
   anchor at the same place form a stretch.  Anchors are counted over all
   documents; stretches whose anchor occurs once cannot recur.
2. *Equal stretches are one.*  The rest are grouped by anchor and content
   hash, with their number and first place; copies, however many, are one row
   from here on.  The words of each are taken from the first place.
3. *Confirm and compile.*  Distinct stretches go to shards by anchor, a few
   thousand to a shard.  In a shard, windows are compared word by word: those
   that occur at least twice are the recurring passages, and are compiled into
   Aho-Corasick automata over words (a letter each), with their first place; as
   equal windows have equal anchors, there is one for each few dozen stretches.  An
   anchor with more contexts than a shard holds goes to none: its windows are
   aggregated by their words, so a window is one row however many contexts
   hold it, and the recurring ones are joined back to the stretches.
4. *Locate.*  The automaton of its anchor reads every stretch of the shard and reports each
   recurring window in it (as runs: windows, as bits, whose first places lie
   side by side too).  Each document's stretches then look up their
   result by the content key, which locates every occurrence in every
   document, and the places that are not the window's first are marked.

Windows are compared by their words.  Stretches count as equal by 128 bits (64
of the anchor, 64 of the content, over 64-bit word hashes).

Nulls and edge cases: null and empty texts have no words; texts shorter than a
window stay as they are; rows that repeat a doc_id with the same text are the
same document (they do not remove each other's words), with different texts
they are documents in the order of the text's hash; a null doc_id sorts first;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from itertools import chain, count

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import staged, tagged

WINDOW, GRAM = 20, 8
SHARD_ROWS = 4000
#: Stretches an automaton is compiled for, or a few more: it looks through the first words of all its windows one by one.
PART = 64
LONG_WORD = 64
_NO_DOC = -(1 << 63)
_U = np.uint64
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _BASE_W, _BASE_S = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n at least."""
    got = _POWERS.get(int(base))
    if got is None or len(got[0]) < n:
        size = 1 << max(12, int(n).bit_length())
        inverse = _U(pow(int(base), -1, 1 << 64))
        got = tuple(np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, b, _U)]), dtype=_U) for b in (base, inverse))
        _POWERS[int(base)] = got
    return got


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _spans(values: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[starts:ends], the same wherever the span lies."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def word_hashes(raw: bytes, piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash for each word of the text, from its bytes."""
    out, at = [], 0
    while at < len(raw):
        stop = at + piece
        if stop < len(raw):  # end the piece between words
            tail = np.frombuffer(raw, np.uint8, offset=stop)
            stop += int(np.argmax(_SPACE[tail])) if _SPACE[tail].any() else len(tail)
        b = np.frombuffer(raw[at:stop], np.uint8)
        ink = np.concatenate([[False], ~_SPACE[b], [False]])
        edge = np.flatnonzero(ink[1:] != ink[:-1])
        starts, ends = edge[::2], edge[1::2]
        h = _spans(_BYTES[b], _BASE, starts, ends)
        for i in np.flatnonzero(ends - starts > LONG_WORD):  # polynomials modulo 2**64 collide on long regular words
            h[i] = xxhash.xxh64_intdigest(raw[at + starts[i]:at + ends[i]])
        out.append(h)
        at = stop
    return np.concatenate(out) if out else np.empty(0, _U)


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value in every stretch of ``width`` values, the first of equal ones."""
    at, have = np.arange(len(values)), 1
    while have < width:  # stretches twice as long, or overlapping ones, from two shorter ones
        k = min(have, width - have)
        left, right = values[:-k], values[k:]
        at, values = np.where(right < left, at[k:], at[:-k]), np.minimum(left, right)
        have += k
    return at


def _anchored(raw: bytes, window: int, gram: int):
    """Word hashes, and anchor, start and windows (arrays) of the stretches; None for short texts."""
    h = word_hashes(raw)
    if len(h) < window:
        return None
    at = np.arange(len(h) - gram + 1)
    grams = _spans(h, _BASE_W, at, at + gram)
    best = leftmost_least(grams, window - gram + 1)
    start = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    return h, grams[best[start]].view(np.int64), start, np.diff(np.append(start, len(best)))


def stretches(raw: bytes, window: int = WINDOW, gram: int = GRAM):
    """Arrays anchor, content, start (of the first window), n (windows), or None for short texts."""
    got = _anchored(raw, window, gram)
    if got is None:
        return None
    h, anchor, start, n = got
    return anchor, _spans(h, _BASE_S, start, start + n + window - 1).view(np.int64), start, n


def _anchors(window, gram):
    def run(batches):
        for b in batches:
            got = [s[1] for s in (_anchored(t.encode("utf-8"), window, gram) for t in b["text"]) if s is not None]
            if got:
                yield pd.DataFrame({"a": np.concatenate(got)})
    return run


def _places(window, gram):
    def run(batches):
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at:at + 1000]
                got = [stretches(t.encode("utf-8"), window, gram) for t in part["text"]]
                sizes = [0 if s is None else len(s[0]) for s in got]
                a, s, start, n = ([np.concatenate(x) for x in zip(*(g for g in got if g is not None), strict=True)] or [[]] * 4)
                if len(a):
                    yield pd.DataFrame({"a": a, "s": s, "n": n.astype(np.int32), "doc_id": np.repeat(part["doc_id"].to_numpy(), sizes),
                                        "h": np.repeat(part["h"].to_numpy(), sizes), "start": start.astype(np.int32)})
    return run


def _words_of(window):
    """The words of each first place (one row of places for each document)."""
    def run(batches):
        for b in batches:
            rows = []
            for d, h, text, firsts in zip(b["doc_id"], b["h"], b["text"], b["firsts"], strict=True):
                ws = text.encode("utf-8").split()
                rows += [(f["a"], f["s"], f["n"], f["c"], d, h, f["start"], b" ".join(ws[f["start"]:f["start"] + f["n"] + window - 1]).decode("utf-8")) for f in firsts]
            if rows:
                yield pd.DataFrame(rows, columns=["a", "s", "n", "c", "doc_id", "h", "start", "words"])
    return run


def _windows(window):
    """A row for each window of a stretch."""
    def run(batches):
        for b in batches:
            for at in range(0, len(b), 1000):
                rows = []
                for r in b.iloc[at:at + 1000].itertuples(index=False):
                    ws = r.words.split(" ")
                    rows += [(r.a, r.s, r.n, r.c, r.doc_id, r.h, r.start + o, o, " ".join(ws[o:o + window])) for o in range(r.n)]
                if rows:
                    yield pd.DataFrame(rows, columns=["a", "s", "n", "c", "doc_id", "h", "start", "o", "w"])
    return run


def _crowd_hits(crowd: DataFrame, window: int) -> DataFrame:
    """a, s, n, hits like ``_locate``'s, for stretches of crowded anchors; no group of them is ever in one place."""
    windows = crowd.mapInPandas(_windows(window), "a long, s long, n int, c long, doc_id long, h long, start int, o int, w string")
    recurring = staged(windows.groupBy("w").agg(F.sum("c").alias("times"), F.min(F.struct("doc_id", "h", "start")).alias("first"))
                       .filter("times > 1").select(F.col("w").alias("w2"), "first"), "substring-windows")
    run = F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h"), (F.col("first.start") - F.col("o")).alias("start"),
                   F.expr("shiftleft(1L, o)").alias("bits"))
    met = windows.select("a", "s", "n", "o", "w").join(recurring, F.col("w") == F.col("w2"))
    return met.groupBy("a", "s", "n").agg(F.collect_list(run).alias("hits"))


def _letters():
    """A letter for each different word of a shard (a shard of ``SHARD_ROWS`` stretches has far fewer than there are letters)."""
    yield from map(chr, range(1, 0xD800))
    yield from map(chr, range(0xE000, 0x110000))
    raise ValueError("a shard has more different words than there are letters; take smaller shards")


def _first_places(rows: list[str], n: np.ndarray, window: int):
    """Every window of the rows in order: the different ones, each window's number among them, its row and its place there."""
    row = np.repeat(np.arange(len(rows)), n)
    o = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    number = defaultdict(count().__next__)
    own = np.fromiter(map(number.__getitem__, [ids[i:i + window] for ids, k in zip(rows, n.tolist(), strict=True) for i in range(k)]), np.int64, len(row))
    return list(number), own, row, o


def _locate(window):
    """Confirmed windows of a shard, compiled; every stretch of the shard read by the automaton of its anchor."""
    def run(g: pa.Table) -> pa.Table:
        collected = gc.isenabled()
        gc.disable()  # hundreds of thousands of small tuples and no cycles
        try:
            return locate(g)
        finally:
            if collected:
                gc.enable()

    def locate(g: pa.Table) -> pa.Table:
        g = g.sort_by([(x, "ascending") for x in ("a", "doc_id", "h", "start")])  # the first window of its words has the first place
        a, s, n, c, d, h, start = (g.column(x).to_numpy() for x in ("a", "s", "n", "c", "doc_id", "h", "start"))
        letter = defaultdict(_letters().__next__)
        rows = ["".join(map(letter.__getitem__, x.split(" "))) for x in g.column("words").to_pylist()]
        keys, own, row, o = _first_places(rows, n, window)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, own, c[row])
        first = np.unique(own, return_index=True)[1]
        often = np.flatnonzero(times > 1)
        ends = np.cumsum(n + window) - 1  # of the rows behind one another, with a sign after each that is no letter
        cuts = np.append(np.flatnonzero(np.diff(np.searchsorted(a, a) // PART, prepend=-1)), len(a))
        met = [np.empty((0, 2), np.int64)]  # (end, window's number) of every hit
        for i, j, p, q in zip(cuts, cuts[1:], *(np.searchsorted(row[first[often]], x).tolist() for x in (cuts[:-1], cuts[1:])), strict=False):
            if p == q:
                continue
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_STRING)
            for k in often[p:q].tolist():
                automaton.add_word(keys[k], k)
            automaton.make_automaton()
            got = np.fromiter(chain.from_iterable(automaton.iter("\0".join(rows[i:j]))), np.int64).reshape(-1, 2)
            got[:, 0] += ends[i - 1] + 1 if i else 0
            met.append(got)
        met = np.concatenate(met)
        at, place = np.searchsorted(ends, met[:, 0]), first[met[:, 1]]
        o_met = met[:, 0] - (ends[at] - (n[at] + window - 1)) - window + 1
        of, begin = row[place], start[row[place]] + o[place] - o_met
        order = np.lexsort((begin, of, at))
        at, of, begin, bits = at[order], of[order], begin[order], np.int64(1) << o_met[order].astype(np.int64)
        new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0) | (np.diff(begin, prepend=0) != 0))
        runs = pa.StructArray.from_arrays([pa.array(d[of[new]], pa.int64()), pa.array(h[of[new]], pa.int64()), pa.array(begin[new], pa.int32()),
                                           pa.array(np.bitwise_or.reduceat(bits, new) if len(new) else bits, pa.int64())], names=["doc_id", "h", "start", "bits"])
        hit, begins = np.unique(at[new], return_index=True)
        hits = pa.ListArray.from_arrays(pa.array(np.append(begins, len(new)), pa.int32()), runs)
        return pa.table({"a": pa.array(a[hit], pa.int64()), "s": pa.array(s[hit], pa.int64()), "n": pa.array(n[hit], pa.int32()), "hits": hits})
    return run


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, h, marks: places (start, bits) whose set bits are windows to remove.  ``docs``: doc_id, h, text, no null."""
    places = docs.mapInPandas(_places(window, gram), "a long, s long, n int, doc_id long, h long, start int")
    recurring = staged(docs.mapInPandas(_anchors(window, gram), "a long").groupBy("a").agg(F.count(F.lit(1)).alias("c"))
                       .filter("c > 1").select("a"), "substring-anchors")
    places = staged(places.join(recurring, "a"), "substring-places")
    firsts = places.groupBy("a", "s", "n").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "h", "start")).alias("first"))
    firsts = firsts.groupBy(F.col("first.doc_id").alias("d2"), F.col("first.h").alias("h2")).agg(
        F.collect_list(F.struct("a", "s", "n", "c", F.col("first.start").alias("start"))).alias("firsts"))
    distinct = docs.join(firsts, (F.col("doc_id") == F.col("d2")) & (F.col("h") == F.col("h2"))).select("doc_id", "h", "text", "firsts")
    distinct = staged(distinct.mapInPandas(_words_of(window), "a long, s long, n int, c long, doc_id long, h long, start int, words string"), "substring-distinct")
    crowded = staged(distinct.groupBy(F.col("a").alias("a2")).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > shard_rows)
                     .select("a2"), "substring-crowded")
    some = crowded.first() is not None
    rows = distinct.join(crowded, F.col("a") == F.col("a2"), "left_anti") if some else distinct
    shards = max(1, -(-distinct.count() // shard_rows))
    found = rows.groupBy(F.pmod(F.xxhash64("a"), F.lit(shards)).alias("shard")) \
        .applyInArrow(_locate(window), "a long, s long, n int, hits array<struct<doc_id:long,h:long,start:int,bits:long>>")
    if some:
        found = found.unionByName(_crowd_hits(distinct.join(crowded, F.col("a") == F.col("a2"), "left_semi"), window))
    found = staged(found, "substring-found").select(F.col("a").alias("a2"), F.col("s").alias("s2"), F.col("n").alias("n2"), "hits")
    met = places.join(found, (F.col("a") == F.col("a2")) & (F.col("s") == F.col("s2")) & (F.col("n") == F.col("n2")))

    def add(acc, x):
        first = (x["doc_id"] == F.col("doc_id")) & (x["h"] == F.col("h")) & (x["start"] == F.col("start"))
        return acc.bitwiseOR(F.when(first, F.lit(0).cast("long")).otherwise(x["bits"]))

    marks = met.select("doc_id", "h", "start", F.aggregate("hits", F.lit(0).cast("long"), add).alias("bits")).filter("bits <> 0")
    return marks.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "bits")).alias("marks"))


def _kept(docs: DataFrame, window: int, gram: int, shard_rows: int) -> DataFrame:
    """``docs`` (with __id, __h, __text) and __kept: kept, n_words, n_removed."""
    docs = docs.withColumn("__id", F.coalesce("__id", F.lit(_NO_DOC)))
    own = docs.select(F.col("__id").alias("doc_id"), F.col("__h").alias("h"), F.col("__text").alias("text"))
    marks = removals(own, window, gram, shard_rows).select(F.col("doc_id").alias("__i2"), F.col("h").alias("__h2"), F.col("marks").alias("__marks"))

    @F.pandas_udf("kept string, n_words long, n_removed long")
    def keep(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts, marks, strict=True):
            ws = text.encode("utf-8").split()
            edge = np.zeros(len(ws) + 1, np.int64)
            for m in () if own is None else own:
                bits, at = int(m["bits"]), int(m["start"])
                while bits:
                    low = bits & -bits
                    o = at + low.bit_length() - 1
                    edge[o] += 1
                    edge[o + window] -= 1
                    bits ^= low
            gone = edge.cumsum()[:-1] > 0
            n = int(gone.sum())
            kept = b" ".join([w for w, g in zip(ws, gone.tolist(), strict=True) if not g] if n else ws)
            rows.append((kept.decode("utf-8"), len(ws), n))
        return pd.DataFrame(rows, columns=["kept", "n_words", "n_removed"])

    both = docs.join(marks, (F.col("__id") == F.col("__i2")) & (F.col("__h") == F.col("__h2")), "left")
    return both.withColumn("__kept", keep("__text", "__marks"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_rows: int = SHARD_ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), kept (kept words joined by one space), n_words, n_removed."""
    if not 0 < gram <= window or window - gram + 1 > 62:
        raise ValueError("gram must lie between window - 61 and window")
    own = tagged(docs, id_col, text_col).select("__id", "__h", "__text")
    return _kept(own, window, gram, shard_rows).select(F.nullif("__id", F.lit(_NO_DOC)).alias("doc_id"), F.col("__h").alias("h"), "__kept.*")


def rewrite(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_rows: int = SHARD_ROWS,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns; texts that lose words become their kept words joined by one space."""
    kept = _kept(tagged(docs, id_col, text_col), window, gram, shard_rows)
    text = F.when(F.col("__kept.n_removed") > 0, F.col("__kept.kept")).otherwise(F.col(f"`{text_col}`"))
    return kept.withColumn(text_col, text).select(*[f"`{c}`" for c in docs.columns])
