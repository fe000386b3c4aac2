"""Line dedup: sharded cuckoo filters over exact reference counts.

A line's key is the line without white space at its ends, A-Z in lower case.
A key of at least ``min_chars`` code points that is held by at least
``min_docs`` documents is *active*: all its lines go, except in the largest
doc_id that holds it.

``LineIndex`` keeps this reversible under insertions and document deletions:

* ``refs``: one row per (key, document) and change, +1 for an insertion, -1
  for a deletion: the exact reference counts.
* ``counts``: live documents and the largest of them for each key.  An
  insertion adds its own counts; a deletion counts again only the keys that
  it touches.
* ``active``: the exact table of active keys (key, n_docs, max_doc).
* ``filters``: one cuckoo filter per shard over the active keys (16-bit
  fingerprints, four to a bucket).  A change inserts the keys that become
  active and deletes those that stop being so; a full filter is rebuilt at
  twice the size from the exact table.  A shard holds about ``SHARD_KEYS``
  keys at any size: shards double, and all filters are built anew, when the
  active keys outgrow them.
* ``manifest``: one row for each change, written last, names the tables that
  are valid.  A new object on the same ``path`` continues from the newest row;
  a change that was cut off leaves only files that no row names.  One writer
  at a time.

To apply the index, lines (hashes only, no text) go to their shard behind its
filter and stream past it in sorted order, so a task holds one filter and one
batch; only those that may hit are joined to the exact active keys.  A shard
of many lines (a hot key) is dealt over salts of ``SALT_LINES`` lines, each
with its copy of the filter.

Keys are compared by 128 hash bits.  Null or empty text: one empty line, kept.
Rows that repeat a doc_id count as one document for the counts and are
filtered each on its own.  A null doc_id takes part as the smallest long (and
counts as one document with rows of that id).
Extra columns are ignored; an empty table gives no rows.  An index without
documents drops nothing.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import LOWER, SPACE_CHARS, UPPER, hash128, keyed, staged, tagged
from pairwright.session import staging_root

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS, SALT_LINES = 4096, 1 << 16
_NO_DOC = -(1 << 63)


class CuckooFilter:
    """Partial-key cuckoo filter; keys are pairs of 64-bit hashes, each stored once."""

    def __init__(self, buckets: int = 16, slots: np.ndarray | None = None):
        self.slots = np.zeros((buckets, 4), np.uint16) if slots is None else slots

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(slots=np.frombuffer(raw, np.uint16).reshape(-1, 4).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def _at(self, k1, k2):
        mask = np.uint64(len(self.slots) - 1)
        k1, k2 = (np.asarray(k, np.int64).view(np.uint64) for k in (k1, k2))
        tag = np.maximum(k2 & np.uint64(0xFFFF), np.uint64(1))  # 0 marks a free slot
        first = k1 & mask
        return tag.astype(np.uint16), first.astype(np.int64), self._other(first.astype(np.int64), tag)

    def _other(self, at, tag):
        turn = (np.asarray(tag).astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(3)
        return np.bitwise_xor(at, (turn & np.uint64(len(self.slots) - 1)).astype(np.int64))

    def contains(self, k1, k2) -> np.ndarray:
        tag, a, b = self._at(k1, k2)
        return (self.slots[a] == tag[:, None]).any(1) | (self.slots[b] == tag[:, None]).any(1)

    def _place(self, at, tag) -> np.ndarray:
        """Puts tags into free slots of their buckets; positions of those left without one."""
        order = np.argsort(at, kind="stable")
        at, tag = at[order], tag[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
        taken = self.slots != 0
        fits = rank < 4 - taken.sum(1)[at]
        free_first = np.argsort(taken, axis=1, kind="stable")
        self.slots[at[fits], free_first[at[fits], rank[fits]]] = tag[fits]
        return order[~fits]

    def _kick(self, tag, at: int, kicks: int = 200) -> bool:
        for i in range(kicks):
            j = i & 3
            tag, self.slots[at, j] = self.slots[at, j], tag
            at = int(self._other(at, tag))
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = tag
                return True
        return False

    def insert_all(self, k1, k2) -> bool:
        """False if the filter is full (then it must be rebuilt: one tag is without a slot)."""
        tag, a, b = self._at(k1, k2)
        left = self._place(a, tag)
        left = left[self._place(b[left], tag[left])]
        return all(self._kick(tag[i], int(b[i])) for i in left)

    def insert(self, k1: int, k2: int) -> bool:
        return self.insert_all([k1], [k2])

    def delete(self, k1: int, k2: int) -> bool:
        tag, a, b = (x[0] for x in self._at([k1], [k2]))
        for at in (a, b):
            own = np.flatnonzero(self.slots[at] == tag)
            if len(own):
                self.slots[at, own[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, k1, k2) -> CuckooFilter:
        buckets = 16
        while buckets * 4 * 0.8 < len(k1):
            buckets *= 2
        while True:
            f = cls(buckets)
            if f.insert_all(k1, k2):
                return f
            buckets *= 2


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, h, line_no, k1, k2 of every line whose key has at least ``min_chars`` code points."""
    d = docs.select("doc_id", "h", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    key = F.translate(F.btrim("line", F.lit(SPACE_CHARS)), UPPER, LOWER)
    d = d.select("doc_id", "h", "line_no", key.alias("key")).filter(F.length("key") >= min_chars)
    return d.select("doc_id", "h", "line_no", *hash128("key"))


def _filters_of(keys: pd.DataFrame) -> pd.DataFrame:
    f = CuckooFilter.of(keys["k1"].to_numpy(), keys["k2"].to_numpy())
    return pd.DataFrame({"shard": keys["shard"].iloc[:1], "filter": [f.dump()]})


def _updated(keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after a change; kind 1: all active keys, 2: new ones, 3: those that go."""
    now, fresh, gone = (keys[keys["kind"] == k] for k in (1, 2, 3))
    shard = (keys if len(keys) else old)["shard"].iloc[:1]
    if not len(now):
        return pd.DataFrame({"shard": shard, "filter": [CuckooFilter().dump()]})
    if len(old):
        f = CuckooFilter.load(old["filter"].iloc[0])
        done = [f.delete(a, b) for a, b in zip(gone["k1"], gone["k2"], strict=True)]
        if all(done) and f.insert_all(fresh["k1"].to_numpy(), fresh["k2"].to_numpy()):
            return pd.DataFrame({"shard": shard, "filter": [f.dump()]})
    return _filters_of(now)


def _maybe(batches):
    """Lines that their shard's filter may hold; rows come sorted, each (shard, salt) led by its filter."""
    at, f = None, None
    for b in batches:
        shard, salt, k1, k2 = (b.column(c).to_numpy() for c in ("shard", "salt", "k1", "k2"))
        led, keep = b.column("filter"), np.zeros(len(b), bool)
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(b)], strict=True):
            if lo == hi:
                continue
            if at != (shard[lo], salt[lo]):
                at, f = (shard[lo], salt[lo]), None
            if led[lo].is_valid:
                f = CuckooFilter.load(led[lo].as_py())
                lo += 1
            if f is not None and lo < hi:
                keep[lo:hi] = f.contains(k1[lo:hi], k2[lo:hi])
        yield b.select(["doc_id", "h", "line_no", "k1", "k2"]).filter(pa.array(keep))


class LineIndex:
    """Incremental index under ``path`` (a shared folder), continued if it is there;
    without one, a new folder in the session's checkpoint folder.

    ``shards`` is the least number of shards, ``shard_keys`` what one is to hold.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS, shards: int = 1, shard_keys: int = SHARD_KEYS):
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        self.shards, self.shard_keys = shards, shard_keys
        self.path = path or f"{staging_root(spark)}/lines-{uuid.uuid4().hex}"
        self.refs: list[str] = []
        self.version: str | None = None
        self.step = 0
        if path:
            self._open()

    def _open(self) -> None:
        try:
            last = self.spark.read.parquet(f"{self.path}/manifest").orderBy(F.desc("step")).first()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return
            raise
        if (last["min_chars"], last["min_docs"]) != (self.min_chars, self.min_docs):
            raise ValueError(f"the index was made with min_chars {last['min_chars']} and min_docs {last['min_docs']}")
        self.step, self.version, self.shards = last["step"], last["version"], last["shards"]
        self.refs = [f"{self.path}/{x}" for x in last["refs"]]

    def _commit(self, version: str) -> None:
        self.step, self.version = self.step + 1, version
        names = F.array(*[F.lit(x.rsplit("/", 1)[1]) for x in self.refs])
        row = self.spark.range(1, numPartitions=1).select(
            F.lit(version).alias("version"), F.lit(self.shards).alias("shards"), names.alias("refs"),
            F.lit(self.min_chars).alias("min_chars"), F.lit(self.min_docs).alias("min_docs"))
        row.write.parquet(f"{self.path}/manifest/step={self.step}")

    def _shard(self, df: DataFrame) -> DataFrame:
        """Shards go by the upper half of k1; a filter's buckets go by its low bits."""
        return df.withColumn("shard", F.pmod(F.shiftrightunsigned("k1", 32), F.lit(self.shards)).cast("int"))

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _table(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}-{self.version}")

    def _refs(self, only: DataFrame, by: list[str]) -> DataFrame:
        """The live references that share ``by`` with ``only``."""
        rows = self.spark.read.parquet(*self.refs).join(only, by, "left_semi")
        return rows.groupBy("k1", "k2", "doc_id").agg(F.sum("sign").alias("n")).filter("n > 0").drop("n")

    def _change(self, changes: DataFrame, added: bool) -> None:
        version = uuid.uuid4().hex
        changes = self._write(changes, f"refs-{version}")
        self.refs.append(f"{self.path}/refs-{version}")
        per_key = [F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc")]
        if added:
            counts = changes.groupBy("k1", "k2").agg(*per_key)
            if self.version:
                counts = counts.unionByName(self._table("counts")).groupBy("k1", "k2").agg(
                    F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        else:
            touched = changes.select("k1", "k2").distinct()
            again = self._refs(touched, ["k1", "k2"]).groupBy("k1", "k2").agg(*per_key)
            counts = self._table("counts").join(touched, ["k1", "k2"], "left_anti").unionByName(again)
        counts = self._write(counts, f"counts-{version}")
        active = self._write(counts.filter(F.col("n_docs") >= self.min_docs), f"active-{version}")
        n, before = active.count(), self.shards
        while self.shards * self.shard_keys < n:
            self.shards *= 2
        keys = self._shard(active).select("shard", "k1", "k2")
        kind = "shard int, filter binary"
        if self.version and self.shards == before:
            old = self._shard(self._table("active")).select("shard", "k1", "k2")
            rows = keys.withColumn("kind", F.lit(1)) \
                .unionByName(keys.join(old, ["shard", "k1", "k2"], "left_anti").withColumn("kind", F.lit(2))) \
                .unionByName(old.join(keys, ["shard", "k1", "k2"], "left_anti").withColumn("kind", F.lit(3)))
            filters = rows.groupBy("shard").cogroup(self._table("filters").groupBy("shard")).applyInPandas(_updated, kind)
        else:
            filters = keys.groupBy("shard").applyInPandas(_filters_of, kind)
        self._write(filters, f"filters-{version}")
        self._commit(version)

    def lines(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The documents' line hashes, written once, for an insertion and an application of the same documents."""
        own = F.coalesce("doc_id", F.lit(_NO_DOC)).alias("doc_id")  # no null reaches Python, so ids keep all bits
        return staged(lines_of(keyed(docs, id_col, text_col).select(own, "h", "text"), self.min_chars), "line-hashes")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: DataFrame | None = None) -> None:
        """Adds the documents; a (key, document) that is there already is not counted twice."""
        new = (self.lines(docs, id_col, text_col) if lines is None else lines).select("k1", "k2", "doc_id").distinct()
        if self.refs:
            new = new.join(self._refs(new.select("doc_id").distinct(), ["doc_id"]), ["k1", "k2", "doc_id"], "left_anti")
        self._change(new.withColumn("sign", F.lit(1)), True)

    def delete(self, doc_ids: DataFrame, id_col: str = "doc_id") -> None:
        """Takes the documents' references out again."""
        if not self.refs:
            return
        gone = doc_ids.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_DOC)).alias("doc_id")).distinct()
        self._change(self._refs(gone, ["doc_id"]).select("k1", "k2", "doc_id", F.lit(-1).alias("sign")), False)

    def active(self) -> DataFrame:
        """k1, k2, n_docs, max_doc of the keys whose lines go."""
        return self._table("active")

    def drops(self, lines: DataFrame) -> DataFrame:
        """doc_id (the smallest long for null), h, line_no of those of ``lines`` that go."""
        out = ["doc_id", "h", "line_no"]
        if not self.version:
            return lines.select(*out).limit(0)
        filters, lines = self._table("filters"), self._shard(lines)
        # One small row a shard that holds lines and active keys; Spark broadcasts it by the size of its files.
        salts = staged(lines.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SALT_LINES).cast("int").alias("n_salts"))
                       .join(filters.select("shard"), "shard", "left_semi"), "line-salts")
        lines = lines.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64(*out), "n_salts").cast("int"))
        led = filters.join(salts, "shard").select(
            "shard", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"), "filter",
            F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("h"), F.lit(0).alias("line_no"),
            F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))
        rows = lines.select("shard", "salt", F.lit(None).cast("binary").alias("filter"), *out, "k1", "k2").unionByName(led)
        rows = rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
        maybe = rows.mapInArrow(_maybe, "doc_id long, h long, line_no int, k1 long, k2 long")
        return maybe.join(self.active(), ["k1", "k2"]).filter("doc_id <> max_doc").select(*out)

    def _kept(self, docs: DataFrame, lines: DataFrame | None) -> DataFrame:
        """``docs`` (with __id, __h, __text) and __kept: text, n_lines, n_dropped."""
        if lines is None:
            lines = self.lines(docs, "__id", "__text")
        gone = self.drops(lines).groupBy(F.col("doc_id").alias("__i2"), F.col("h").alias("__h2")).agg(F.collect_set("line_no").alias("__gone"))
        both = docs.join(gone, (F.coalesce("__id", F.lit(_NO_DOC)) == F.col("__i2")) & (F.col("__h") == F.col("__h2")), "left")

        @F.pandas_udf("text string, n_lines long, n_dropped long")
        def keep(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
            rows = []
            for text, drop in zip(texts, gone, strict=True):
                lines, drop = text.split("\n"), () if drop is None else set(drop)
                rows.append(("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text, len(lines), len(drop)))
            return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

        return both.withColumn("__kept", keep("__text", "__gone"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: DataFrame | None = None) -> DataFrame:
        """doc_id, h, text (kept lines), n_lines, n_dropped."""
        kept = self._kept(tagged(docs, id_col, text_col).select("__id", "__h", "__text"), lines)
        return kept.select(F.col("__id").alias("doc_id"), F.col("__h").alias("h"), "__kept.*")

    def rewrite(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: DataFrame | None = None) -> DataFrame:
        """``docs`` with all its columns and only the kept lines (an untouched text, null too, as it was)."""
        kept = self._kept(tagged(docs, id_col, text_col), lines)
        return kept.withColumn(text_col, F.when(F.col("__kept.n_dropped") > 0, F.col("__kept.text")).otherwise(F.col(f"`{text_col}`"))) \
            .select(*[f"`{c}`" for c in docs.columns])


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int = 1,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One batch: insert all documents, apply.  doc_id, h, text, n_lines, n_dropped."""
    index = LineIndex(docs.sparkSession, None, min_chars, min_docs, shards)
    lines = index.lines(docs, id_col, text_col)
    index.insert(docs, id_col, text_col, lines)
    return index.apply(docs, id_col, text_col, lines)
