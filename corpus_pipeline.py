"""Cleaning a corpus, stage by stage: (name, function) pairs over ``documents``.

Each function takes (spark, docs, sf_dir); ``run`` writes what it returns as
Parquet in the shared checkpoint folder and reads that as the next one's docs.
All but the last return the columns of ``documents``.

1. toxicity: learnt on the labelled training fold; rejected documents go.
2. line dedup: lines shared by many documents go from all but one of them.
3. SimHash near-dedup: one document (the smallest doc_id) of each group stays.
4. substring dedup: repeated passages go; a document that lost words has its
   other words joined by single spaces, the others keep their text unchanged.
5. packing: length buckets and token-budget batches.

``n_chars`` follows the text.  A null text counts as empty and stays null
unless it changes; documents without a doc_id pass stage 3 untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import linededup, packing, simhash, substring, toxicity
from pairwright.llm.common import staged, table

#: SQL cannot express the learnt score, the bit counts or the optimal buckets.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    return docs.filter(toxicity.predicted(model, F.col("text")) == 0)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = linededup.LineIndex(spark)
    lines = index.lines(docs)
    index.insert(docs, lines=lines)
    return _counted(index.rewrite(docs, lines=lines))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(substring.rewrite(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash", drop_near_copies),
          ("substring_dedup", drop_passages), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
