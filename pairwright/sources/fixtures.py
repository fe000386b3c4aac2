"""Pair tables and other inputs derived from the test tables (FIXTURES.md §2).

Every fixture exists twice: as Spark DataFrame code (``spark_*``) and as a
DuckDB common table expression (``SQL_CTES``) used by the oracles.  The two
must agree row for row; each oracle check re-tests that.

Nothing here is sampled or capped: a fixture always covers its whole source
table, so its size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.rank import global_row_number
from pairwright.schema import PAIR_COLS

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_STORED: dict[tuple, DataFrame] = {}


def _stored(fn):
    """Write a derived pair table once per session and test folder, as a stored
    pair table would be, and let every query read it (filters on row_pos then
    reach the parquet scan)."""
    def wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pairwright.session import app_id, stage
        key = (app_id(spark), fn.__name__, sf_dir.rstrip("/"))
        if key not in _STORED:
            _STORED[key] = stage(fn(spark, sf_dir), fn.__name__)
        return _STORED[key]
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --------------------------------------------------------------------------- pairs
@_stored
def spark_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small unbalanced pair table with duplicate rows (``row_pos``, 9 cols, ``src``).

    Left function = the labelled document, right = document
    ``(doc_id*7+3) % floor(n/5)``; every tenth document's row occurs twice.
    ``src`` is the left document's language, giving four "files".
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    n5 = docs.agg(F.floor(F.count(F.lit(1)) / 5).cast("bigint")).scalar()
    right = docs.select(F.col("doc_id").alias("rdoc"), F.col("source").alias("folder2"))
    base = (table(spark, sf_dir, "labels").select("doc_id", "quality")
            .join(docs, "doc_id")
            .withColumn("rdoc", (F.col("doc_id") * 7 + 3) % n5)
            .join(right, "rdoc")
            .select("doc_id",
                    F.col("source").alias("folder1"),
                    F.concat(F.lit("doc_"), _s("doc_id")).alias("file1"),
                    _s(F.col("doc_id") % 3).alias("begin1"),
                    _s(F.col("doc_id") % 3 + 2).alias("end1"),
                    "folder2",
                    F.concat(F.lit("doc_"), _s("rdoc")).alias("file2"),
                    _s(F.col("rdoc") % 3).alias("begin2"),
                    _s(F.col("rdoc") % 3 + 2).alias("end2"),
                    _s("quality").alias("label"),
                    F.col("lang").alias("src")))
    cols = [*PAIR_COLS, "src"]
    once = base.select((F.col("doc_id") * 2).alias("row_pos"), *cols)
    twice = base.filter(F.col("doc_id") % 10 == 0).select((F.col("doc_id") * 2 + 1).alias("row_pos"), *cols)
    return once.unionByName(twice)


LINE_ORDER = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_shipdate")


@_stored
def spark_line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large pair table, one row per lineitem (``row_pos`` = rank in LINE_ORDER - 1)."""
    li = table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_returnflag", "l_linestatus")
    ranked = global_row_number(li, LINE_ORDER, out="rn")
    return ranked.select(
        (F.col("rn") - 1).alias("row_pos"),
        F.lit("p").alias("folder1"), _s("l_partkey").alias("file1"),
        _s("l_linenumber").alias("begin1"), _s(F.col("l_linenumber") + 5).alias("end1"),
        F.lit("s").alias("folder2"), _s("l_suppkey").alias("file2"),
        _s("l_linenumber").alias("begin2"), _s(F.col("l_linenumber") + 5).alias("end2"),
        F.when(F.col("l_returnflag") == "R", "1").otherwise("0").alias("label"),
        F.concat(F.lit("status_"), F.col("l_linestatus")).alias("src"))


def spark_noisy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pairs`` with labels that are neither class: '2' or ' 1' on every 17th position."""
    p = spark_pairs(spark, sf_dir)
    return p.withColumn("label", F.when(F.col("row_pos") % 34 == 0, "2")
                        .when(F.col("row_pos") % 34 == 17, " 1").otherwise(F.col("label")))


def spark_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV text lines of ``pairs``: end2 dropped when doc % 11 = 0, a field added when doc % 13 = 0.

    folder1 has quotes that close early (with a comma inside) when doc % 17 = 0
    and well-formed ones around quotes when doc % 19 = 0; the last cell has a quote that never closes when doc % 23 = 0.
    """
    p = spark_pairs(spark, sf_dir)
    d = F.floor(F.col("row_pos") / 2)
    first = (F.when(d % 17 == 0, F.concat(F.lit('"'), F.col("folder1"), F.lit(',x"y')))
             .when(d % 19 == 0, F.concat(F.lit('"""'), F.col("folder1"), F.lit('"", z"'))).otherwise(F.col("folder1")))
    last = F.when(d % 23 == 0, F.concat(F.lit('"'), F.col("label"))).otherwise(F.col("label"))
    nine = [first, *[F.col(c) for c in PAIR_COLS[1:-1]], last]
    short = nine[:7] + nine[8:]
    long_ = nine[:8] + [F.lit("extra")] + nine[8:]
    line = (F.when(d % 11 == 0, F.concat_ws(",", *short))
            .when(d % 13 == 0, F.concat_ws(",", *long_))
            .otherwise(F.concat_ws(",", *nine)))
    return p.select("row_pos", line.alias("line"), "src")


def spark_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_lines`` with a blank line on every 29th position."""
    return spark_raw_lines(spark, sf_dir).withColumn("line", F.when(F.col("row_pos") % 29 == 0, "").otherwise(F.col("line")))


def spark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code files ``(path, text)``: each document at ``source/doc_<id>``."""
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", F.col("source"), F.concat(F.lit("doc_"), _s("doc_id"))).alias("path"),
        F.col("text"))


# Code-like text built from table columns (documents hold prose only).
CR, LF, TAB = "\r", "\n", "\t"


def spark_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Java-like class per part row, with tabs, CRLF, comments and literals."""
    p = table(spark, sf_dir, "part")
    code = F.concat(
        F.lit("class P"), _s("p_partkey"), F.lit(" {" + CR + LF + TAB + "/* "), F.col("p_type"),
        F.lit(" */" + CR + LF + TAB + "int v"), _s("p_size"), F.lit(" = "), _s("p_partkey"),
        F.lit("; // "), F.col("p_name"), F.lit(CR + LF + TAB + 'String b = "'), F.col("p_brand"),
        F.lit('";' + TAB + " " + LF + LF + LF + LF + TAB + "long m = 0x"), _s("p_size"),
        F.lit("L; char c = '/'; double d = 1.5e"), _s(F.col("p_size") % 7),
        F.lit("f;" + LF + "}" + LF + LF))
    return p.select(F.col("p_partkey").alias("snippet_id"), code.alias("code"))


def spark_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label = quality, predicted = toxic, for labelled documents."""
    return (table(spark, sf_dir, "labels")
            .join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
            .select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("predicted"),
                    "n_chars"))


def spark_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logit per embedding element; label in {0,1}."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id",
                    F.col("embedding").cast("array<double>").alias("logits"),
                    (F.col("label") % 2).alias("label"))


def spark_metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long metric log ``(step, metric, value)`` from events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("step"), F.col("event_type").alias("metric"), "value")


# --------------------------------------------------------------------------- SQL
# The same fixtures as DuckDB CTEs.  Each entry: (sql, dependencies).
SQL_CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "pairs_base": ("""
  SELECT b.doc_id,
         l.source AS folder1, concat('doc_', CAST(l.doc_id AS VARCHAR)) AS file1,
         CAST(l.doc_id % 3 AS VARCHAR) AS begin1, CAST(l.doc_id % 3 + 2 AS VARCHAR) AS end1,
         r.source AS folder2, concat('doc_', CAST(r.doc_id AS VARCHAR)) AS file2,
         CAST(r.doc_id % 3 AS VARCHAR) AS begin2, CAST(r.doc_id % 3 + 2 AS VARCHAR) AS end2,
         CAST(b.quality AS VARCHAR) AS label, l.lang AS src
  FROM labels b
  JOIN documents l ON l.doc_id = b.doc_id
  JOIN documents r ON r.doc_id = (b.doc_id * 7 + 3) % (SELECT CAST(floor(count(*) / 5) AS BIGINT) FROM documents)
""", ()),
    "pairs": ("""
  SELECT doc_id * 2 AS row_pos, folder1, file1, begin1, end1, folder2, file2, begin2, end2, label, src
  FROM pairs_base
  UNION ALL
  SELECT doc_id * 2 + 1, folder1, file1, begin1, end1, folder2, file2, begin2, end2, label, src
  FROM pairs_base WHERE doc_id % 10 = 0
""", ("pairs_base",)),
    "line_pairs": ("""
  SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
                                     l_extendedprice, l_shipdate) - 1 AS row_pos,
         'p' AS folder1, CAST(l_partkey AS VARCHAR) AS file1,
         CAST(l_linenumber AS VARCHAR) AS begin1, CAST(l_linenumber + 5 AS VARCHAR) AS end1,
         's' AS folder2, CAST(l_suppkey AS VARCHAR) AS file2,
         CAST(l_linenumber AS VARCHAR) AS begin2, CAST(l_linenumber + 5 AS VARCHAR) AS end2,
         CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS label,
         concat('status_', l_linestatus) AS src
  FROM lineitem
""", ()),
    "noisy_pairs": ("""
  SELECT row_pos, folder1, file1, begin1, end1, folder2, file2, begin2, end2,
         CASE WHEN row_pos % 34 = 0 THEN '2' WHEN row_pos % 34 = 17 THEN ' 1' ELSE label END AS label,
         src
  FROM pairs
""", ("pairs",)),
    "raw_lines": ("""
  SELECT row_pos, src,
         CASE WHEN d % 11 = 0 THEN concat_ws(',', f, file1, begin1, end1, folder2, file2, begin2, l)
              WHEN d % 13 = 0 THEN concat_ws(',', f, file1, begin1, end1, folder2, file2, begin2, end2, 'extra', l)
              ELSE concat_ws(',', f, file1, begin1, end1, folder2, file2, begin2, end2, l) END AS line,
         CASE WHEN d % 11 = 0 THEN [v, file1, begin1, end1, folder2, file2, begin2, label]
              WHEN d % 13 = 0 THEN [v, file1, begin1, end1, folder2, file2, begin2, end2, 'extra', label]
              ELSE [v, file1, begin1, end1, folder2, file2, begin2, end2, label] END AS cells
  FROM (SELECT *, row_pos // 2 AS d,
               CASE WHEN (row_pos // 2) % 17 = 0 THEN '"' || folder1 || ',x"y'
                    WHEN (row_pos // 2) % 19 = 0 THEN '\"\"\"' || folder1 || '"", z"' ELSE folder1 END AS f,
               CASE WHEN (row_pos // 2) % 17 = 0 THEN folder1 || ',xy'
                    WHEN (row_pos // 2) % 19 = 0 THEN '"' || folder1 || '", z' ELSE folder1 END AS v,
               CASE WHEN (row_pos // 2) % 23 = 0 THEN '"' || label ELSE label END AS l
        FROM pairs)
""", ("pairs",)),
    "blank_lines": ("""
  SELECT row_pos, src, CASE WHEN row_pos % 29 = 0 THEN '' ELSE line END AS line,
         CASE WHEN row_pos % 29 = 0 THEN CAST([] AS VARCHAR[]) ELSE cells END AS cells
  FROM raw_lines
""", ("raw_lines",)),
    "files": ("""
  SELECT concat_ws('/', source, concat('doc_', CAST(doc_id AS VARCHAR))) AS path, text FROM documents
""", ()),
    "snippets": ("""
  SELECT p_partkey AS snippet_id,
         concat('class P', CAST(p_partkey AS VARCHAR), ' {', chr(13), chr(10), chr(9), '/* ', p_type,
                ' */', chr(13), chr(10), chr(9), 'int v', CAST(p_size AS VARCHAR), ' = ',
                CAST(p_partkey AS VARCHAR), '; // ', p_name, chr(13), chr(10), chr(9), 'String b = "',
                p_brand, '";', chr(9), ' ', chr(10), chr(10), chr(10), chr(10), chr(9), 'long m = 0x',
                CAST(p_size AS VARCHAR), 'L; char c = ''/''; double d = 1.5e', CAST(p_size % 7 AS VARCHAR),
                'f;', chr(10), '}', chr(10), chr(10)) AS code
  FROM part
""", ()),
    "predictions": ("""
  SELECT b.doc_id, b.quality AS label, b.toxic AS predicted, d.n_chars
  FROM labels b JOIN documents d ON d.doc_id = b.doc_id
""", ()),
    "logits": ("""
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS logits, label % 2 AS label
  FROM embeddings
""", ()),
    "metric_log": ("""
  SELECT event_id AS step, event_type AS metric, value FROM events
""", ()),
}


def sql_with(body: str, *names: str) -> str:
    """``WITH`` the named fixture CTEs (and their dependencies) + ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in SQL_CTES[n][1]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({SQL_CTES[n][0]})" for n in order)
    head = body.lstrip()
    if head[:5].upper() == "WITH ":  # the body's own CTEs follow the fixtures
        return f"WITH {ctes},\n{head[5:]}"
    return f"WITH {ctes}\n{body}"
