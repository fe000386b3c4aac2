"""SimHash near-dedup: byte-position inverted index with count filtering.

Each document's fingerprint is the bitwise majority of the XXH64 hashes of its
word shingles.  Fingerprints with at most ``max_bits`` differing bits are
linked; a document's class is its connected component.

Search, on *distinct* fingerprints (a group of exact copies is one row):

* A pair within ``max_bits`` = 2 differs in at most two of the eight bytes, so
  it shares at least six positional bytes (the guaranteed minimum) and, of
  the four two-byte blocks, at least two whole ones.  The inverted index
  holds one posting list per (two blocks, their four bytes): six entries per
  fingerprint, and every pair to be found meets in a list.
* In a list, shared positional bytes are tallied per pair; pairs that reach
  the minimum are verified by their differing bits.  A list emits a spanning
  forest of its links, never all pairs.
* A list longer than ``list_limit`` is dealt anew by two more positional bytes
  (six bytes fixed, two free), which bounds it by 65,536 fingerprints without
  losing a link.

Nulls and edge cases: a null or empty text has fingerprint 0 and is linked like
any other; fewer words than a shingle: the whole word sequence is the one
shingle; repeated rows share a fingerprint and hence a class; a null doc_id
is returned with its class but never names one (all-null class: null); extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import staged as stage
from pairwright.llm.common import from_text, keyed, tagged, texts
from pairwright.llm.graph import components

SHINGLE, MAX_BITS, SEED, MIN_BYTES, LIST_LIMIT = 3, 2, 42, 6, 2048
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSET = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    ws = text.encode("utf-8").lower().split()  # bytes.lower changes A-Z only
    if not ws:
        return 0
    if len(ws) < shingle:
        grams = [b" ".join(ws)]
    else:
        grams = map(b" ".join, zip(*(ws[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, SEED) for g in grams], dtype=np.uint64)
    b = h.view(np.uint8).reshape(-1, 8)  # little-endian: column j holds bits 8j..8j+7
    counts = np.bincount((b + _OFFSET).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(sum(1 << i for i in np.flatnonzero(counts.ravel() * 2 > len(h)).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); ``hashed``: doc_id, h (hash of the text), fp."""
    def make():
        return lambda batch: [np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64).view(np.int64)]
    return from_text((keyed if hashed else texts)(docs, id_col, text_col), make, {"fp": "long"})


def _forest(fps: np.ndarray, max_bits: int, min_bytes: int) -> list[tuple[int, int]]:
    """Spanning forest of the links inside one posting list."""
    fps = fps.astype(np.int64).view(np.uint64)
    rows = fps.view(np.uint8).reshape(-1, 8)
    left = np.arange(len(fps))
    out, front = [], []
    while len(left):
        if not front:
            front, left = [left[0]], left[1:]
            continue
        u = front.pop()
        tally = (rows[left] == rows[u]).sum(1)
        near = tally >= min_bytes
        near[near] = np.bitwise_count(fps[left[near]] ^ fps[u]) <= max_bits
        for v in left[near]:
            out.append((u, v))
            front.append(v)
        left = left[~near]
    signed = fps.view(np.int64)
    return [(int(max(signed[u], signed[v])), int(min(signed[u], signed[v]))) for u, v in out]


def links(fps: DataFrame, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Links (u > v) among distinct fingerprints ``fp``; connectivity is complete."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the index is built for at most two differing bits")
    min_bytes = 8 - max_bits
    byte = [F.shiftrightunsigned(F.col("fp"), 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]

    def packed(which):
        return sum((byte[p] * F.lit(256 ** i) for i, p in enumerate(which)), F.lit(0).cast("long"))

    blocks = [(0, 1), (2, 3), (4, 5), (6, 7)]
    pairs = list(combinations(range(4), 2))
    index = fps.select("fp", F.posexplode(F.array(*[packed(blocks[a] + blocks[b]) for a, b in pairs]))
                       .alias("slot", "bytes"))
    sizes = index.groupBy("slot", "bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = stage(index.join(sizes, ["slot", "bytes"]), "simhash-postings")

    def scan(batches):
        for b in batches:
            got = [e for l in b["fps"] for e in _forest(np.array(l), max_bits, min_bytes)]
            if got:
                yield pd.DataFrame(got, columns=["u", "v"])

    def scanned(df, keys):
        return df.groupBy(*keys).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1) \
            .select("fps").mapInPandas(scan, "u long, v long")

    more = []  # two further positional bytes for each slot
    for a, b in pairs:
        free = [p for i, bl in enumerate(blocks) if i not in (a, b) for p in bl]
        more.append(F.array(*[packed(c) for c in combinations(free, 2)]))
    by_slot = F.coalesce(*[F.when(F.col("slot") == i, m) for i, m in enumerate(more)])
    long = joined.filter(F.col("n") > list_limit).select("slot", "bytes", "fp", F.posexplode(by_slot).alias("sub", "b2"))
    return scanned(joined.filter(F.col("n") <= list_limit), ["slot", "bytes"]) \
        .unionByName(scanned(long, ["slot", "bytes", "sub", "b2"])).distinct()


def _rooted(prints: DataFrame, first, max_bits: int, list_limit: int) -> DataFrame:
    """fp, first (the least of its rows), root (the same for all of a class)."""
    distinct = stage(prints.groupBy("fp").agg(F.min(first).alias("first")), "simhash-distinct")
    roots = components(links(distinct, max_bits, list_limit))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = stage(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    rooted = _rooted(prints, F.col("doc_id"), max_bits, list_limit)
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(firsts, "root").select(F.col("fp").alias("fp2"), "component_id")
    return prints.join(named, F.col("fp") == F.col("fp2")) \
        .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (that of the smallest doc_id, then text hash) of each class, with all columns; rows without a doc_id all stay."""
    named = tagged(docs.filter(F.col(f"`{id_col}`").isNotNull()), id_col, text_col)
    prints = stage(fingerprints(named, shingle, id_col, text_col, hashed=True), "simhash-prints")
    firsts = _rooted(prints, F.struct("doc_id", "h"), max_bits, LIST_LIMIT).groupBy("root").agg(F.min("first").alias("first")) \
        .select(F.col("first.doc_id").alias("__i2"), F.col("first.h").alias("__h2"))
    kept = named.join(firsts, (F.col("__id") == F.col("__i2")) & (F.col("__h") == F.col("__h2")), "left_semi").dropDuplicates(["__id", "__h"])
    return kept.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))
