"""Conversation prefix trie: every distinct beginning of a conversation with what it shares.

Turns are dictionary-encoded (one number per distinct role and text).  Equal
conversations count as one sequence with its number of members; the sequences
are range-partitioned in their lexicographic order, so a shard holds a stretch
of the trie:

* A shard inserts its sequences into a *ternary search tree*, median first and
  then the medians of both halves, which keeps the sibling trees balanced.
* One iterative traversal (nodes are numbered parents first, so backwards is
  children first) accumulates members, smallest member, leaves and savings.
* Only the nodes on a shard's first and last path can continue in another
  shard.  How far they do follows from the neighbours' last and first
  sequence.  These *boundary nodes* leave the shard as partial sums and are
  merged by key; a node counts as a child, and once less in the savings, in
  the first shard that holds it, so that sums over shards are right.

A sequence goes through the tree in blocks of ``block`` turns, whatever its
length.  Blocks behind a beginning that several sequences share form tries of
their own, built from the deepest block up, and their roots' totals enter the
end node of the block before.  Behind a beginning that only one sequence has
there is just a chain, which needs no tree.  So no task holds a conversation
whole, however long, and no group holds all copies of one.

Nulls and edge cases: turns without a conv_id take no part; a null turn comes
first; null role and text are empty; rows with equal turn numbers are ordered
by role, then text; repeated rows count each; extra columns are ignored; an
empty table has no node, not even a root.  Turns and sequences are compared by
128 hash bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.common import hash128
from pairwright.llm.common import staged as stage
from pairwright.operators.rank import global_row_number
from pairwright.session import shuffle_partitions

BLOCK, SHARD_SEQS, SHARD_TURNS, CHUNK, SMALL = 1024, 4096, 200_000, 4096, 20_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_RAW = "depth long, conv_id long, pconv long, n_convs long, n_children long, n_leaves long, saved_tokens long, sha string, key string, pkey string, p1 long, p2 long"


def encode_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), tid (number of the distinct role and text), size (UTF-8 bytes of the text)."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv_id is not null")
    order = ["conv_id", "turn", "role", "text"]
    n = shuffle_partitions(turns.sparkSession)
    t = stage(t.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
        "conv_id", *hash128("role", "text"), F.octet_length("text").cast("long").alias("size"),
        F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")), "trie-turns")
    before = Window.partitionBy("conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range partition at most
    parts = t.groupBy("conv_id", "p").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("i0")) \
        .select("conv_id", "p", "i0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    numbers = global_row_number(t.select("k1", "k2").distinct(), ["k1", "k2"], "tid")
    placed = t.join(parts, ["conv_id", "p"]).withColumn("pos", F.col("i") - F.col("i0") + F.col("at"))
    return stage(placed.join(numbers, ["k1", "k2"]).select("conv_id", "pos", "tid", "size"), "trie-coded")


def rebuild(coded: DataFrame, heads: int = 9, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from another one: (turns, conv_ids).

    With h = crc32(decimal conv_id) % ``heads``, conversation c starts with the
    first h turns of conversation c - c % ``family`` (fewer if it has fewer,
    none if it is not there); its own turns after the first h follow.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % family
    first = coded.filter(F.col("pos") < heads - 1).groupBy(F.col("conv_id").alias("base")) \
        .agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "size"))).alias("head"))  # at most heads - 1 turns
    own = coded.select("conv_id").distinct().select("conv_id", base.alias("base"), h.cast("int").alias("h")).join(first, "base", "left")
    taken = F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.col("h")))
    own = stage(own.select("conv_id", "h", taken.alias("taken"), F.coalesce(F.size(taken), F.lit(0)).alias("n")).withColumn("n", F.greatest("n", F.lit(0))), "trie-heads")
    rest = coded.join(own.select("conv_id", "h", "n"), "conv_id").filter(F.col("pos") >= F.col("h")) \
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "tid", "size")
    return own.select("conv_id", F.explode("taken").alias("x")).select("conv_id", "x.*").unionByName(rest), own.select("conv_id")


def _chunks(chunk: int):
    """Decimal ids of a run of equal keys, joined by commas, ``chunk`` at a time."""
    columns = ["s1", "s2", "len", "first", "n", "ids"]

    def run(batches):
        key, ids, out = None, [], []

        def put():
            if ids:
                out.append((*key, ids[0], len(ids), ",".join(map(str, ids))))

        for b in batches:
            for s1, s2, n, conv in zip(b["s1"].tolist(), b["s2"].tolist(), b["len"].tolist(), b["conv_id"].tolist(), strict=True):
                if (s1, s2, n) != key or len(ids) == chunk:
                    put()
                    key, ids = (s1, s2, n), []
                ids.append(conv)
            yield pd.DataFrame(out, columns=columns)
            out.clear()
        put()
        yield pd.DataFrame(out, columns=columns)
    return run


def _digests(batches):
    """One row for each run of equal keys: members, smallest, hash of all chunks in order."""
    key, first, n, sha, out = None, 0, 0, None, []
    for b in batches:
        for s1, s2, size, low, k, ids in b.itertuples(index=False):
            if (s1, s2, size) != key:
                if key is not None:
                    out.append((*key, n, first, sha.hexdigest()))
                key, first, n, sha = (s1, s2, size), low, 0, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
            n += k
        yield pd.DataFrame(out, columns=["s1", "s2", "len", "n", "conv", "sha"])
        out.clear()
    if key is not None:
        yield pd.DataFrame([(*key, n, first, sha.hexdigest())], columns=["s1", "s2", "len", "n", "conv", "sha"])


def _sequences(members: DataFrame, chunk: int) -> DataFrame:
    """s1, s2, len, n, conv (smallest), sha of the members of each distinct sequence.

    The ids of a sequence are sorted across tasks; what one task reads of it
    for the hash is their text in chunks, a row for every ``chunk`` members.
    """
    n = shuffle_partitions(members.sparkSession)
    key = ["s1", "s2", "len"]
    chunks = members.select(*key, "conv_id").repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id") \
        .mapInPandas(_chunks(chunk), "s1 long, s2 long, len long, first long, n long, ids string")
    return chunks.repartition(n, *key).sortWithinPartitions(*key, "first") \
        .mapInPandas(_digests, "s1 long, s2 long, len long, n long, conv long, sha string")


def _blocks(turns: DataFrame, convs: DataFrame, block: int, chunk: int) -> DataFrame:
    """Blocks of each distinct sequence (as its smallest member has it): conv, b, tids, sizes, keys of the
    turns before (p1, p2) and through the block (c1, c2), len, n, sha.  A sequence that ends with a block
    has an empty one after it."""
    parts = stage(turns.withColumn("b", F.floor(F.col("pos") / block)).groupBy("conv_id", "b").agg(
        F.sort_array(F.collect_list(F.struct("pos", "tid", "size"))).alias("x"),
        F.bit_xor(F.xxhash64("pos", "tid")).alias("k1"), F.bit_xor(F.xxhash64(F.lit("k2"), "pos", "tid")).alias("k2")), "trie-parts")
    totals = parts.groupBy("conv_id").agg(F.bit_xor("k1").alias("s1"), F.bit_xor("k2").alias("s2"), F.sum(F.size("x")).alias("len"))
    zero = F.lit(0).cast("long")
    members = convs.join(totals, "conv_id", "left").select("conv_id", *(F.coalesce(c, zero).alias(c) for c in ("s1", "s2", "len")))
    seqs = stage(_sequences(members, chunk), "trie-sequences")
    before = Window.partitionBy("conv").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    own = parts.join(seqs, parts["conv_id"] == seqs["conv"])
    own = own.select("conv", "b", F.col("x.tid").alias("tids"), F.col("x.size").alias("sizes"), "k1", "k2", "len", "n", "sha",
                     *(F.coalesce(F.bit_xor(k).over(before), zero).alias(p) for k, p in (("k1", "p1"), ("k2", "p2"))))
    own = own.select("conv", "b", "tids", "sizes", "p1", "p2", F.col("p1").bitwiseXOR(F.col("k1")).alias("c1"),
                     F.col("p2").bitwiseXOR(F.col("k2")).alias("c2"), "len", "n", "sha")
    nothing = F.array().cast("array<long>")
    ended = seqs.filter(F.col("len") % block == 0).select(
        "conv", F.floor(F.col("len") / block).alias("b"), nothing.alias("tids"), nothing.alias("sizes"),
        F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("s1").alias("c1"), F.col("s2").alias("c2"), "len", "n", "sha")
    return stage(own.unionByName(ended), "trie-blocks")


class TernaryTree:
    """Sequences of whole numbers; nodes are numbered in the order of their making, so parents first."""

    def __init__(self):
        self.sym, self.lo, self.hi, self.eq, self.up, self.depth = [], [], [], [], [], []

    def _node(self, sym: int, up: int, depth: int) -> int:
        for arr, x in ((self.sym, sym), (self.lo, -1), (self.hi, -1), (self.eq, -1), (self.up, up), (self.depth, depth)):
            arr.append(x)
        return len(self.sym) - 1

    def insert(self, path) -> list[int]:
        """The nodes of the path, made where they are missing."""
        sym, lo, hi, eq, up, out = self.sym, self.lo, self.hi, self.eq, -1, []
        for depth, s in enumerate(path):
            at = (0 if sym else -1) if up < 0 else eq[up]
            if at < 0:
                at = self._node(s, up, depth)
                if up >= 0:
                    eq[up] = at
            else:
                while sym[at] != s:
                    side = lo if s < sym[at] else hi
                    if side[at] < 0:
                        side[at] = self._node(s, up, depth)
                    at = side[at]
            up = at
            out.append(at)
        return out


def medians(n: int):
    """0..n-1, the median first, then those of both halves, and so on."""
    todo = [(0, n)]
    for lo, hi in todo:
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            todo += [(lo, mid), (mid + 1, hi)]


def _common(a, b) -> int:
    if a is None or b is None:
        return 0
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.asarray(a[:n]) != np.asarray(b[:n]))
    return int(differ[0]) if len(differ) else n


def _keys(path, n: int) -> list[str]:
    h, out = xxhash.xxh128(), []
    for s in path[:n]:
        h.update(int(s).to_bytes(8, "little", signed=True))
        out.append(h.hexdigest())
    return out


def _shard(top: int):
    """``top``: depth of the tries' roots.  Paths begin with the two halves of the root's key."""
    def run(items: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        items = items.assign(path=[p.tolist() for p in items["path"]]).sort_values("path", key=lambda c: c.map(tuple))
        paths, sizes = items["path"].tolist(), [s.tolist() for s in items["sizes"]]
        tree, ends, spans = TernaryTree(), {}, {}
        weight: list[int] = []
        for i in medians(len(paths)):
            nodes = tree.insert(paths[i])
            for v, size in zip(nodes, [0, 0, *sizes[i]], strict=True):
                if v == len(weight):
                    weight.append(size)
            ends[nodes[-1]] = i
            if i in (0, len(paths) - 1):
                spans[i] = nodes
        count = len(weight)
        early, later, key = [False] * count, [False] * count, [None] * count
        for i, other, flags in ((0, edge["before"].iloc[0], early), (len(paths) - 1, edge["after"].iloc[0], later)):
            n = _common(paths[i], other)
            for v, k in zip(spans[i][:n], _keys(paths[i], n), strict=True):
                flags[v], key[v] = True, k
        n_convs, conv = [0] * count, [None] * count
        kids, has, leaves, saved, sha = [0] * count, [False] * count, [0] * count, [0] * count, [None] * count
        for v, own in zip(ends, items.iloc[list(ends.values())].itertuples(index=False), strict=True):
            n_convs[v], conv[v], sha[v] = own.n, own.conv, own.sha
            kids[v], has[v], leaves[v], saved[v] = own.children, own.children > 0, own.leaves, own.saved
        for v in range(count - 1, -1, -1):
            if not has[v] and not later[v]:
                leaves[v] += 1
            saved[v] += (n_convs[v] - (not early[v])) * weight[v]
            u = tree.up[v]
            if u >= 0:
                n_convs[u] += n_convs[v]
                conv[u] = conv[v] if conv[u] is None else min(conv[u], conv[v])
                kids[u] += not early[v]
                has[u] = True
                leaves[u] += leaves[v]
                saved[u] += saved[v]
        rows = []
        for v in range(count):
            d, u = tree.depth[v], tree.up[v]
            if d:
                pkey = key[u] if d > 1 else None
                p1 = p2 = 0
                if d == 1:
                    p1, p2 = tree.sym[u], tree.sym[v]
                rows.append((top + d - 1, conv[v], conv[u] if d > 1 else 0, n_convs[v], kids[v], leaves[v], saved[v], sha[v], key[v], pkey, p1, p2))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _RAW.split(", ")])
    return run


def _level(items: DataFrame, top: int) -> DataFrame:
    """Nodes of the tries of one block level: the columns of ``COLUMNS`` and p1, p2 (a root's key).

    ``items``: path, sizes, n, conv, sha, children, leaves, saved; paths are distinct.
    """
    items = stage(items, "trie-items")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("path")).alias("t")).first()
    shards = max(1, -(-size["n"] // SHARD_SEQS), -(-(size["t"] or 0) // SHARD_TURNS))
    dealt = stage(items.repartitionByRange(shards, "path").withColumn("shard", F.spark_partition_id()), "trie-shards")
    by_shard = Window.orderBy("shard")  # a row a shard
    edges = dealt.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high")) \
        .select("shard", F.lag("high").over(by_shard).alias("before"), F.lead("low").over(by_shard).alias("after"))
    raw = stage(dealt.groupBy("shard").cogroup(edges.groupBy("shard")).applyInPandas(_shard(top), _RAW), "trie-nodes")
    merged = stage(raw.filter("key is not null").groupBy("key").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.first("pconv").alias("pconv"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("sha").alias("sha"),
        F.first("pkey").alias("pkey"), F.max("p1").alias("p1"), F.max("p2").alias("p2")), "trie-boundary")
    nodes = raw.filter("key is null").unionByName(merged)
    names = merged.select(F.col("key").alias("k"), F.col("conv_id").alias("kconv"))
    if merged.count() <= SMALL:  # otherwise Spark joins by key, splitting what is skewed
        names = F.broadcast(names)
    known = nodes.filter("pkey is null").withColumn("kconv", F.when(F.col("depth") > top, F.col("pconv")))
    joined = nodes.filter("pkey is not null").join(names, F.col("pkey") == F.col("k")).drop("k")
    return known.unionByName(joined).select("conv_id", "depth", F.col("kconv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                                            "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"), "p1", "p2")


def _chain_rows(block: int):
    def run(batches):
        for b in batches:
            for conv, at, sizes, n, size, after, sha in b.itertuples(index=False):
                depth = at * block + 1 + np.arange(len(sizes))
                below = after + np.cumsum(sizes[::-1])[::-1]
                last = depth == size
                yield pd.DataFrame({"conv_id": conv, "depth": depth, "parent_conv_id": conv, "n_convs": n, "n_children": np.where(last, 0, 1),
                                    "n_leaves": 1, "saved_tokens": (n - 1) * below, "ends_sha256": np.where(last, sha, EMPTY_SHA)})
    return run


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """A row for every node, the root (depth 0) included: ``COLUMNS``.

    ``turns``: conv_id, pos (0, 1, .. in each conversation), tid, size;
    ``convs``: conv_id of all members, of those without turns, too.
    """
    blocks = _blocks(turns, convs, block, chunk)
    spans = blocks.agg(F.max("b").alias("b")).first()["b"]
    if spans is None:
        return blocks.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in COLUMNS))
    out, totals, deepest = [], None, 0
    if spans:
        groups = blocks.filter("b > 0").groupBy("b", "p1", "p2").agg((F.count(F.lit(1)) > 1).alias("shared"))
        blocks = stage(blocks.join(groups, ["b", "p1", "p2"], "left"), "trie-shared")
        deepest = blocks.filter("shared").agg(F.max("b").alias("b")).first()["b"] or 0
        by_block = Window.partitionBy("conv").orderBy(F.desc("b"))  # a row for each block
        size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
        chain = blocks.filter("b > 0 and not shared").withColumn("bytes", size) \
            .withColumn("after", F.sum("bytes").over(by_block) - F.col("bytes")) \
            .withColumn("b0", F.min("b").over(Window.partitionBy("conv"))).filter(F.size("tids") > 0)
        chain = stage(chain, "trie-chains")
        kinds = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in COLUMNS)
        out.append(chain.select("conv", "b", "sizes", "n", "len", "after", "sha").mapInPandas(_chain_rows(block), kinds))
        totals = chain.filter("b = b0").select("b", "p1", "p2", F.lit(1).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"),
                                               ((F.col("n") - 1) * (F.col("after") + F.col("bytes"))).alias("saved"))
    zero = F.lit(0).cast("long")
    for level in range(deepest, -1, -1):
        own = blocks.filter((F.col("b") == level) & (F.col("shared") if level else F.lit(True)))
        ends = F.col("len") == level * block + F.size("tids")
        items = own.groupBy("p1", "p2", "c1", "c2", F.size("tids").alias("m")).agg(
            F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max(F.when(ends, F.col("sha"))).alias("sha"),
            F.first("tids").alias("tids"), F.first("sizes").alias("sizes"))
        extra = ("children", "leaves", "saved")
        if totals is None:
            items = items.withColumns({c: zero for c in extra})
        else:
            below = totals.filter(F.col("b") == level + 1).select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), *extra)
            items = items.join(below, (F.col("m") == block) & (F.col("c1") == F.col("q1")) & (F.col("c2") == F.col("q2")), "left") \
                .withColumns({c: F.coalesce(c, zero) for c in extra})
        path = F.concat(F.array("p1", "p2"), F.col("tids"))
        nodes = _level(items.select(path.alias("path"), "sizes", "n", "conv", "sha", *extra), level * block)
        if level:
            nodes = stage(nodes, "trie-level")
            roots = nodes.filter(F.col("depth") == level * block).select(
                F.lit(level).cast("long").alias("b"), "p1", "p2", F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
            totals = roots if totals is None else totals.unionByName(roots)
            nodes = nodes.filter(F.col("depth") > level * block)
        out.append(nodes.select(*COLUMNS))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole
