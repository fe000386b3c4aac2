"""Best-fit packing: documents into as few sequences of ``capacity`` ids as it can, with certified bounds.

A document's ids (with its end id) stay together unless there are more than
``capacity``; then they are cut into pieces of ``capacity``, of which only the
first may be shorter.  Full pieces are sequences of their own.  The rest, a few
numbers a piece and no text, is dealt at random into partitions of about
``part_rows`` pieces.

* Each partition is packed by best-fit decreasing.
* Dual-feasible functions give lower bounds on its number of sequences; a
  partition that meets its bound is *certified*.
* Partitions with a gap give up the pieces of all sequences that are not full;
  certified partitions lend those of their emptiest sequence, where the
  fractions that each partition rounds up collect.  What they gave is dealt
  anew, over fewer partitions, and packed again.  A round counts only if it
  needs fewer sequences than what it took up; the rounds end when one does
  not, or when one partition has packed all that was exchanged.

Nulls and edge cases: a null or empty text is one piece of the end id alone; a
null doc_id is passed on; rows that repeat are packed each on its own; extra
columns are ignored; an empty table gives no rows.  Texts are tokenized whole;
a text that spells an added token gets that token's id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import staged as stage
from pairwright.llm.common import texts
from pairwright.llm.tokenbin import _encoder, read_tokenizer

CAPACITY, END_ID, PART_ROWS, ROUNDS = 1024, 2, 8192, 8
_PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_PIECES}, part long, bin int, offset long, fill long, bins long, bound long"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a document of n ids."""
    head = (n - 1) % capacity + 1
    return [(0, head), *((i, i + capacity) for i in range(head, n, capacity))]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_file))
    end = np.array([end_id], "<u4")

    def run(batches):
        encoder = _encoder(shared.value)
        for b in batches:
            owner, rows, i = [], [], 0
            for all_ids, sizes in encoder.encode_column(b.column("text")):
                all_ids, upto = all_ids.astype("<u4"), np.cumsum(sizes)
                for lo, hi in zip((upto - sizes).tolist(), upto.tolist(), strict=True):
                    ids = np.concatenate([all_ids[lo:hi], end])
                    for k, (s, e) in enumerate(cuts(len(ids), capacity)):
                        owner.append(i)
                        rows.append((k, s, e - s, zlib.crc32(ids[s:e].tobytes())))
                    i += 1
            cols = [b.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), _PIECE[1:], strict=True))] \
                if rows else [pa.array([], kind) for _, kind in _PIECE]
            yield pa.RecordBatch.from_arrays(cols, names=[c for c, _ in _PIECE])
    return texts(docs, id_col, text_col).mapInArrow(run, _PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and every bin's fill.  Items of equal length keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by what is free in them
    has, free = 0, []  # has: bit r is set if a bin has r free
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = has >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                has &= ~(1 << r)
        else:
            b, r = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i], free[b] = b, capacity - r, r - size
        if r > size:
            room[r - size].append(b)
            has |= 1 << (r - size)
    return bins, offsets, capacity - np.array(free, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Greatest bound that the dual-feasible functions below give on the number of bins.

    A function f is dual-feasible if sizes that fit a bin have values of at
    most 1 together, so the values of all items, summed and rounded up, bound
    the number of bins.  In whole numbers: the identity; rounding steps of k + 1
    parts; large items to 1 and small ones to 0 by a threshold, alone and under
    rounding steps; and shares of a bin by how many pieces of a threshold's size fit.
    """
    if not len(lengths):
        return 0
    x = np.arange(capacity + 1)
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)

    def steps(values, k):
        """Values of 0..capacity, rounded to k-ths of a bin (in units of 1 / (k * capacity))."""
        t = (k + 1) * values
        return np.where(t % capacity == 0, values * k, t // capacity * capacity)

    best = -(-int(count @ x) // capacity)
    low = np.arange(1, capacity // 2 + 1)[:, None]
    cut = np.where(x > capacity - low, capacity, np.where(x < low, 0, x))
    best = max(best, -(-int((cut @ count).max()) // capacity))
    for k in range(1, 33):
        best = max(best, -(-int(steps(x, k) @ count) // (k * capacity)))
        if k <= 8:
            best = max(best, -(-int((steps(cut, k) @ count).max()) // (k * capacity)))
    share = capacity // low
    part = np.where(2 * x > capacity, share - (capacity - x) // low, np.where(x < low, 0, 1))
    return max(best, int((-(-(part @ count) // share[:, 0])).max()))


def _pack(capacity: int):
    def run(key, table):
        lengths = table.column("length").to_numpy().astype(np.int64)
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        n, bound = len(fills), lower_bound(lengths, capacity)
        own = {"part": np.full(len(lengths), key[0].as_py(), np.int64), "bin": bins.astype(np.int32), "offset": offsets,
               "fill": fills[bins], "bins": np.full(len(lengths), n, np.int64), "bound": np.full(len(lengths), bound, np.int64)}
        return pa.table({**{c: table.column(c).combine_chunks() for c, _ in _PIECE}, **own})
    return run


def _packed(rows: DataFrame, n: int, turn: int, capacity: int, part_rows: int) -> DataFrame:
    """``rows`` (written pieces, ``n`` of them) dealt into partitions and packed."""
    parts = -(-n // part_rows)
    dealt = rows.withColumn("part", F.floor(F.rand(1000 + turn) * parts).cast("long"))
    return stage(dealt.groupBy("part").applyInArrow(_pack(capacity), _PACKED), "binpack-packed")


def _sequences(df: DataFrame) -> int:
    return df.select("part", "bins").distinct().agg(F.coalesce(F.sum("bins"), F.lit(0)).alias("n")).first()["n"]


def pack(rows: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (doc_id, piece, start, length, ids_crc32; lengths 1 to capacity) with sequence_id and offset."""
    rows = stage(rows, "binpack-pieces")
    columns = [c for c, _ in _PIECE]
    full = rows.filter(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pool = rows.filter(F.col("length") < capacity)
    n, out = pool.count(), [full]

    def settled(df, turn):
        number = F.lit(turn << 58).bitwiseOR(F.shiftleft(F.col("part"), 20)).bitwiseOR(F.col("bin").cast("long"))
        return df.select(*columns, number.alias("sequence_id"), "offset")

    if not n:
        return full
    now = _packed(pool, n, 0, capacity, part_rows)
    for turn in range(rounds):
        if n <= part_rows:
            break
        emptiest = now.groupBy("part").agg(F.min(F.struct("fill", "bin")).alias("e")).select("part", F.col("e.bin").alias("last"))
        marked = now.join(emptiest, "part").withColumn("given", (F.col("fill") < capacity) & ((F.col("bins") > F.col("bound")) | (F.col("bin") == F.col("last")))).drop("last")
        marked = stage(marked, "binpack-marked")
        given = stage(marked.filter("given").select(*columns, "part", "bin"), "binpack-given")
        size = given.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part", "bin").alias("bins")).first()
        if not size["n"]:
            break
        again = _packed(given.select(*columns), size["n"], turn + 1, capacity, part_rows)
        if _sequences(again) >= size["bins"]:
            break
        out.append(settled(marked.filter(~F.col("given")), turn))
        now, n = again, size["n"]
    else:
        turn = rounds
    out.append(settled(now, turn))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def certificate(sequences: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences used, and the bound that the sizes of all pieces set together (n_sequences, bound)."""
    return sequences.agg(F.count_distinct("sequence_id").alias("n_sequences"),
                         F.ceil(F.sum("length") / capacity).alias("bound"))


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, part_rows: int = PART_ROWS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col), capacity, part_rows)
