"""Queries for pair readers and layout checks (S1-S4, P1-P5, P8, P9) on text
lines derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.operators import quality
from pairwright.plans.registry import query
from pairwright.schema import PAIR8, PAIR_COLS
from pairwright.sources import csv_pairs as C
from pairwright.sources import fixtures as fx

P9 = ", ".join(PAIR_COLS)
FIELDS_SQL = ", ".join(f"cells[{i + 1}] AS {c}" for i, c in enumerate(PAIR_COLS))
# Every 2,500 rows = the first rows the reference's evaluation script reads.
HEAD_ROWS = 2500


@query("layout_strict_report", fx.sql_with("""
SELECT src, row_pos, len(cells) AS n_fields, line FROM raw_lines WHERE len(cells) NOT IN (0, 9)""", "raw_lines"))
def q_layout_strict(spark, d):
    return C.layout_report(fx.spark_raw_lines(spark, d))


@query("layout_lenient", fx.sql_with(f"""
SELECT src, row_pos, {', '.join(f"cells[{i + 1}] AS {c}" for i, c in enumerate(PAIR8))}, cells[-1] AS label
FROM raw_lines WHERE len(cells) >= 9""", "raw_lines"))
def q_layout_lenient(spark, d):
    return C.parse_lenient(fx.spark_raw_lines(spark, d))


@query("read_labeled", fx.sql_with(f"SELECT src, row_pos, {FIELDS_SQL} FROM raw_lines WHERE line <> ''",
                                   "raw_lines"))
def q_read_labeled(spark, d):
    return C.parse_positional(fx.spark_raw_lines(spark, d))


# P3 as the duplicate tools have it: a blank line is a row like any other.
@query("dedup_blank_rows", fx.sql_with(f"""
SELECT src, min(row_pos) AS row_pos, {FIELDS_SQL}, CASE WHEN len(cells) <> 9 THEN min(line) END AS raw
FROM blank_lines GROUP BY src, cells""", "blank_lines"))
def q_dedup_blank(spark, d):
    rows = quality.dedup_keep_first(C.rows_of(fx.spark_blank_lines(spark, d)), by=["src"])
    return rows.withColumnRenamed(C.CORRUPT, "raw")


@query("duplicates_blank_rows", fx.sql_with("""
SELECT src, count(*) AS duplicate_rows, CAST(sum(n - 1) AS BIGINT) AS surplus_copies
FROM (SELECT src, cells, count(*) AS n FROM blank_lines GROUP BY src, cells HAVING count(*) > 1) GROUP BY src""", "blank_lines"))
def q_duplicates_blank(spark, d):
    return quality.duplicate_report(C.rows_of(fx.spark_blank_lines(spark, d)))


@query("read_fused", fx.sql_with(f"""
SELECT src, row_pos, substring(c0, 1, 1) AS label, substring(c0, 2) AS folder1,
       {', '.join(f"string_split(line, ',')[{i + 1}] AS {c}" for i, c in enumerate(PAIR8) if i > 0)}
FROM (SELECT src, row_pos, line, string_split(line, ',')[1] AS c0 FROM (
  SELECT src, row_pos, concat_ws(',', label || folder1, file1, begin1, end1, folder2, file2, begin2, end2) AS line
  FROM pairs))""", "pairs"))
def q_read_fused(spark, d):
    p = fx.spark_pairs(spark, d)
    line = F.concat_ws(",", F.concat("label", "folder1"), *PAIR8[1:])
    return C.parse_positional(p.select("src", "row_pos", line.alias("line")), layout="fused8")


@query("head_rows", fx.sql_with(f"SELECT row_pos, {P9} FROM line_pairs WHERE row_pos < {HEAD_ROWS}",
                                "line_pairs"))
def q_head_rows(spark, d):
    return C.head_rows(fx.spark_line_pairs(spark, d), HEAD_ROWS).select("row_pos", *PAIR_COLS)


@query("label_int", fx.sql_with("""
SELECT row_pos, TRY_CAST(label AS INTEGER) AS label_int, CAST(begin1 AS INTEGER) AS begin1_int FROM noisy_pairs""",
                                "noisy_pairs"))
def q_label_int(spark, d):
    # The label as int (" 1" parses, "2" stays 2); lenient parse, strict for lines.
    p = fx.spark_noisy_pairs(spark, d)
    return p.select("row_pos", F.col("label").try_cast("int").alias("label_int"),
                    F.col("begin1").cast("int").alias("begin1_int"))
