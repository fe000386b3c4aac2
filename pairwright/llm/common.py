"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words (RE2 and Java alike).
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text (null text: empty), whatever other columns there are."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``texts`` plus ``h``, a hash of the text, so that rows that share a doc_id stay apart."""
    return texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))


def tagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and __id, __text (null: empty) and __h (hash of the text)."""
    return docs.withColumns({"__id": F.col(f"`{id_col}`").cast("long"),
                             "__text": F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))}) \
        .withColumn("__h", F.xxhash64("__text"))


def words(text: str) -> list[bytes]:
    """Words as UTF-8: ``bytes.split`` cuts at exactly the six characters of ``SPACE``."""
    return text.encode("utf-8").split()


def frames(batches: Iterator[pd.DataFrame], make, columns: list[str], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """Output frames of at most about ``rows`` rows of what ``make(row)`` yields for each input row."""
    out: list = []
    for b in batches:
        for row in b.itertuples(index=False):
            out.extend(make(row))
            if len(out) >= rows:
                yield pd.DataFrame(out, columns=columns)
                out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


def hash128(*cols: Column | str) -> list[Column]:
    """Two 64-bit hashes with different seeds, as key columns k1 and k2."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("k2"), *cols).alias("k2")]


def same_id(a: str, b: str) -> Column:
    """Null-safe equality of two id columns."""
    return F.col(a).eqNullSafe(F.col(b))


def scalar_row(df: DataFrame, *aggs: Column):
    """One row of global aggregates (a few numbers, whatever the input size)."""
    return df.agg(*aggs).first()


def chunks(seq: Iterable, n: int):
    seq = list(seq)
    for i in range(0, len(seq), n):
        yield seq[i:i + n]


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``session.stage`` whose shuffle files go as soon as the table is written.

    Nothing reads them again: later plans start from the written table.
    """
    from pairwright.session import stage
    conf = df.sparkSession.conf
    before = conf.get(TIDY, "false")
    conf.set(TIDY, "true")
    try:
        return stage(df, label)
    finally:
        conf.set(TIDY, before)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()),
          "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}


def from_text(df: DataFrame, make, columns: dict[str, str]) -> DataFrame:
    """``df`` with its text replaced by ``columns`` (name -> type).

    ``make()`` is called once per task and gives the function from a list of
    texts to one sequence a column.  All other columns pass as Arrow arrays:
    a long beside a null keeps all its bits (in pandas it would be a double).
    """
    keep = [c for c in df.columns if c != "text"]
    kinds = [_ARROW[t] for t in columns.values()]

    def run(batches):
        fn = make()
        for b in batches:
            got = fn(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x, k) for x, k in zip(got, kinds, strict=True))],
                                             names=[*keep, *columns])
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text"]
    return df.mapInArrow(run, ", ".join([*kept, *(f"{c} {t}" for c, t in columns.items())]))
