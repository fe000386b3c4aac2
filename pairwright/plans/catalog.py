"""Named queries over the test tables: Spark plan + DuckDB oracle.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole derived table; the matching SQL (if the operator is expressible in
SQL) computes the same rows in DuckDB for the correctness check.  Computed
columns carry the same alias on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.operators import identity, quality, rank, split
from pairwright.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from pairwright.schema import FUNC_COLS, PAIR_COLS
from pairwright.session import stage
from pairwright.sources import fixtures as fx


P9 = "folder1, file1, begin1, end1, folder2, file2, begin2, end2, label"
F4 = 'folder, file, "begin", "end"'

# Leakage-safe split parameters used by the catalogue (fractions as in FIXTURES.md).
TRAIN, VAL, SEED = 0.8, 0.1, 0

# ----------------------------------------------------------------- A1-A4, P4, P11
BALANCE_SQL = """
SELECT src,
       count(*) FILTER (WHERE label IN ('0', '1')) AS total,
       count(*) FILTER (WHERE label = '1') AS clones,
       count(*) FILTER (WHERE label = '0') AS non_clones,
       CASE WHEN count(*) FILTER (WHERE label IN ('0', '1')) > 0
            THEN count(*) FILTER (WHERE label = '1') / count(*) FILTER (WHERE label IN ('0', '1')) END
         AS clone_ratio
FROM {t} GROUP BY src"""


@query("class_balance", fx.sql_with(BALANCE_SQL.format(t="noisy_pairs"), "noisy_pairs"))
def q_class_balance(spark, d):
    return quality.class_balance(fx.spark_noisy_pairs(spark, d))


@query("class_balance_lines", fx.sql_with(BALANCE_SQL.format(t="line_pairs"), "line_pairs"))
def q_class_balance_lines(spark, d):
    return quality.class_balance(fx.spark_line_pairs(spark, d))


@query("class_filter", fx.sql_with(f"SELECT row_pos, {P9} FROM noisy_pairs WHERE label IN ('0', '1')",
                                   "noisy_pairs"))
def q_class_filter(spark, d):
    return quality.class_rows(fx.spark_noisy_pairs(spark, d)).select("row_pos", *PAIR_COLS)


@query("detect_duplicates", fx.sql_with(
    f"SELECT {P9}, count(*) AS copies FROM line_pairs GROUP BY {P9} HAVING count(*) > 1", "line_pairs"))
def q_detect_duplicates(spark, d):
    return quality.detect_duplicates(fx.spark_line_pairs(spark, d))


@query("duplicate_report", fx.sql_with(f"""
SELECT src, count(*) AS duplicate_rows, CAST(sum(copies - 1) AS BIGINT) AS surplus_copies
FROM (SELECT src, {P9}, count(*) AS copies FROM line_pairs GROUP BY src, {P9} HAVING count(*) > 1)
GROUP BY src""", "line_pairs"))
def q_duplicate_report(spark, d):
    return quality.duplicate_report(fx.spark_line_pairs(spark, d))


@query("dedup_keep_first", fx.sql_with(
    f"SELECT min(row_pos) AS row_pos, {P9} FROM line_pairs GROUP BY {P9}", "line_pairs"))
def q_dedup_keep_first(spark, d):
    return quality.dedup_keep_first(fx.spark_line_pairs(spark, d))


@query("dedup_report", fx.sql_with(f"""
SELECT src, count(*) AS kept, CAST(sum(n) - count(*) AS BIGINT) AS removed
FROM (SELECT src, {P9}, count(*) AS n FROM pairs GROUP BY src, {P9}) GROUP BY src""", "pairs"))
def q_dedup_report(spark, d):
    return quality.dedup_report(fx.spark_pairs(spark, d))


# ----------------------------------------------------------------- P6, P7, A5-A7, U1-U3
FIDS_SQL = """
SELECT row_pos, folder1 AS folder, file1 AS file, begin1 AS "begin", end1 AS "end" FROM {t}
UNION ALL
SELECT row_pos, folder2, file2, begin2, end2 FROM {t}"""

UNIVERSE_SQL = """
SELECT folder1 AS folder, file1 AS file, begin1 AS "begin", end1 AS "end" FROM {t}
UNION
SELECT folder2, file2, begin2, end2 FROM {t}"""

TYPED_SQL = """
SELECT file1 AS file, CAST(begin1 AS INTEGER) AS start, CAST(end1 AS INTEGER) AS "end" FROM {t} WHERE {w}
UNION
SELECT file2, CAST(begin2 AS INTEGER), CAST(end2 AS INTEGER) FROM {t} WHERE {w}"""


@query("function_ids", fx.sql_with(FIDS_SQL.format(t="pairs"), "pairs"))
def q_function_ids(spark, d):
    return identity.function_ids(fx.spark_pairs(spark, d), keep=["row_pos"])


@query("function_universe", fx.sql_with(UNIVERSE_SQL.format(t="line_pairs"), "line_pairs"))
def q_function_universe(spark, d):
    return identity.function_universe(fx.spark_line_pairs(spark, d))


@query("overlap_nway", fx.sql_with("""
SELECT folder, file, "begin", "end", list_sort(list(DISTINCT src)) AS files, count(DISTINCT src) AS n_files
FROM (SELECT src, folder1 AS folder, file1 AS file, begin1 AS "begin", end1 AS "end" FROM pairs
      UNION ALL SELECT src, folder2, file2, begin2, end2 FROM pairs)
GROUP BY folder, file, "begin", "end" HAVING count(DISTINCT src) > 1""", "pairs"))
def q_overlap_nway(spark, d):
    return identity.overlap_nway(fx.spark_pairs(spark, d))


@query("overlap_pairwise", fx.sql_with(
    f"({TYPED_SQL.format(t='line_pairs', w=chr(39) + 'status_O' + chr(39) + ' = src')}) INTERSECT "
    f"({TYPED_SQL.format(t='line_pairs', w=chr(39) + 'status_F' + chr(39) + ' = src')})", "line_pairs"))
def q_overlap_pairwise(spark, d):
    lp = fx.spark_line_pairs(spark, d)
    return identity.overlap_pairwise(lp.filter(F.col("src") == "status_O"),
                                     lp.filter(F.col("src") == "status_F"))


def _one(t: str) -> str:
    return "SELECT DISTINCT * FROM (" + TYPED_SQL.format(t="line_pairs", w=f"src = 'status_{t}'") + ")"


@query("overlap_sizes", fx.sql_with(
    f"SELECT (SELECT count(*) FROM ({_one('O')})) AS n_first, (SELECT count(*) FROM ({_one('F')})) AS n_second, "
    f"(SELECT count(*) FROM ({_one('O')} INTERSECT {_one('F')})) AS n_both", "line_pairs"))
def q_overlap_sizes(spark, d):
    lp = fx.spark_line_pairs(spark, d)
    return identity.overlap_sizes(lp.filter(F.col("src") == "status_O"), lp.filter(F.col("src") == "status_F"))


@query("overlap_list", fx.sql_with(f"{_one('O')} INTERSECT {_one('F')}", "line_pairs"))
def q_overlap_list(spark, d):
    lp = fx.spark_line_pairs(spark, d)
    return identity.overlap_list(lp.filter(F.col("src") == "status_O"), lp.filter(F.col("src") == "status_F"))


@query("positions_across_files", fx.sql_with("""
SELECT l.src, l.row_pos + coalesce((SELECT CAST(sum(e.n) AS BIGINT) FROM (SELECT src, max(row_pos) + 1 AS n
       FROM line_pairs GROUP BY src) e WHERE e.src < l.src), 0) AS row_pos, l.file1, l.file2
FROM line_pairs l""", "line_pairs"))
def q_positions_across(spark, d):
    return rank.positions_across(fx.spark_line_pairs(spark, d)).select("src", "row_pos", "file1", "file2")


@query("unique_functions", fx.sql_with("""
SELECT src, count(*) AS unique_functions FROM (
  SELECT src, file1 AS file, CAST(begin1 AS INTEGER) AS s, CAST(end1 AS INTEGER) AS e FROM line_pairs
  UNION SELECT src, file2, CAST(begin2 AS INTEGER), CAST(end2 AS INTEGER) FROM line_pairs)
GROUP BY src""", "line_pairs"))
def q_unique_functions(spark, d):
    return identity.unique_functions(fx.spark_line_pairs(spark, d))


# ----------------------------------------------------------------- K1-K6, J2, J3
def _rank_sql(src: str, seed: int = SEED) -> str:
    return f"""
SELECT {F4}, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', {F4})), {F4}) AS rank
FROM ({src})"""


def _assign_sql(src: str) -> str:
    return f"""
SELECT {F4}, rank,
       CASE WHEN rank <= floor(CAST({TRAIN} AS DOUBLE) * (SELECT count(*) FROM ({src}))) THEN 'train'
            WHEN rank <= floor(CAST({TRAIN} AS DOUBLE) * (SELECT count(*) FROM ({src})))
                       + floor(CAST({VAL} AS DOUBLE) * (SELECT count(*) FROM ({src}))) THEN 'val'
            ELSE 'test' END AS split
FROM ({_rank_sql(src)})"""


VALID_LP = f"SELECT row_pos, {P9} FROM line_pairs WHERE label IN ('0', '1')"

# The split oracle as named steps (DuckDB plans repeated inline subqueries badly).
SPLIT_CTES = f"""WITH valid AS ({VALID_LP}),
universe AS ({UNIVERSE_SQL.format(t='valid')}),
ranked AS ({_rank_sql('SELECT * FROM universe')}),
assign AS MATERIALIZED (
  SELECT {F4}, rank,
         CASE WHEN rank <= floor(CAST({TRAIN} AS DOUBLE) * (SELECT count(*) FROM universe)) THEN 'train'
              WHEN rank <= floor(CAST({TRAIN} AS DOUBLE) * (SELECT count(*) FROM universe))
                         + floor(CAST({VAL} AS DOUBLE) * (SELECT count(*) FROM universe)) THEN 'val'
              ELSE 'test' END AS split
  FROM ranked),
tagged AS MATERIALIZED (
  SELECT v.*, a1.split FROM valid v
  JOIN assign a1 ON v.folder1 = a1.folder AND v.file1 = a1.file AND v.begin1 = a1."begin" AND v.end1 = a1."end"
  JOIN assign a2 ON v.folder2 = a2.folder AND v.file2 = a2.file AND v.begin2 = a2."begin" AND v.end2 = a2."end"
  WHERE a1.split = a2.split)
"""


@query("seeded_order", fx.sql_with(
    f"SELECT {F4}, rank - 1 AS pos FROM ({_rank_sql(UNIVERSE_SQL.format(t='line_pairs'))})", "line_pairs"))
def q_seeded_order(spark, d):
    u = identity.function_universe(fx.spark_line_pairs(spark, d))
    u = u.withColumn("_h", rank.seeded_hash(SEED, *FUNC_COLS))
    r = rank.hash_row_number(u, "_h", FUNC_COLS, out="_r")
    return r.select(*FUNC_COLS, (F.col("_r") - 1).alias("pos"))


@query("global_rank", fx.sql_with("""
SELECT row_pos, row_number() OVER (ORDER BY label, file1, begin1, row_pos) AS rank FROM line_pairs""",
                                  "line_pairs"))
def q_global_rank(spark, d):
    lp = fx.spark_line_pairs(spark, d).select("row_pos", "label", "file1", "begin1")
    return rank.global_row_number(lp, ["label", "file1", "begin1", "row_pos"], out="rank").select(
        "row_pos", "rank")


@query("function_partition", fx.sql_with(SPLIT_CTES + "SELECT * FROM assign", "line_pairs"))
def q_function_partition(spark, d):
    valid = quality.class_rows(fx.spark_line_pairs(spark, d))
    return split.assign_functions(identity.function_universe(valid), TRAIN, VAL, SEED)


def _interleave_sql(src: str, by: str) -> str:
    return f"""
SELECT r.{by}, 2 * (r.rn - 1) + CASE WHEN r.label = '0' THEN 1 ELSE 0 END AS out_pos, r.row_pos,
       {', '.join('r.' + c for c in PAIR_COLS)}
FROM (SELECT t.*, row_number() OVER (PARTITION BY {by}, label ORDER BY row_pos DESC) AS rn FROM ({src}) t) r
JOIN (SELECT {by}, least(count(*) FILTER (WHERE label = '1'), count(*) FILTER (WHERE label = '0')) AS m
      FROM ({src}) GROUP BY {by}) s ON s.{by} = r.{by}
WHERE r.rn <= s.m"""


@query("split_pairs", fx.sql_with(SPLIT_CTES + _interleave_sql("SELECT * FROM tagged", "split"), "line_pairs"))
def q_split_pairs(spark, d):
    return split.split_pairs(fx.spark_line_pairs(spark, d), TRAIN, VAL, SEED)


@query("split_sizes", fx.sql_with(
    SPLIT_CTES + "SELECT split, label, count(*) AS pairs FROM tagged GROUP BY split, label", "line_pairs"))
def q_split_sizes(spark, d):
    valid = quality.class_rows(fx.spark_line_pairs(spark, d))
    a = stage(split.assign_functions(identity.function_universe(valid), TRAIN, VAL, SEED), "assignment")
    return split.in_split_pairs(valid, a).groupBy("split", "label").agg(F.count(F.lit(1)).alias("pairs"))


@query("semi_in_split", fx.sql_with(SPLIT_CTES + """
SELECT v.* FROM valid v
WHERE EXISTS (SELECT 1 FROM assign a WHERE a.split = 'train' AND
              v.folder1 = a.folder AND v.file1 = a.file AND v.begin1 = a."begin" AND v.end1 = a."end")
  AND EXISTS (SELECT 1 FROM assign a WHERE a.split = 'train' AND
              v.folder2 = a.folder AND v.file2 = a.file AND v.begin2 = a."begin" AND v.end2 = a."end")
""", "line_pairs"))
def q_semi_in_split(spark, d):
    valid = quality.class_rows(fx.spark_line_pairs(spark, d)).select("row_pos", *PAIR_COLS)
    a = split.assign_functions(identity.function_universe(valid), TRAIN, VAL, SEED)
    return split.semi_in_set(valid, a.filter(F.col("split") == "train"))


@query("interleave", fx.sql_with(_interleave_sql(
    f"SELECT row_pos, {P9}, src FROM line_pairs WHERE label IN ('0', '1')", "src"), "line_pairs"))
def q_interleave(spark, d):
    valid = quality.class_rows(fx.spark_line_pairs(spark, d))
    return split.interleave_classes(valid, by=["src"]).select("src", "out_pos", "row_pos", *PAIR_COLS)


@query("rebalance", fx.sql_with(f"""
WITH v AS (SELECT *, md5(concat_ws('|', '{SEED}', row_pos)) AS h FROM line_pairs WHERE label IN ('0', '1')),
k AS (SELECT src, least(count(*) FILTER (WHERE label = '1'), count(*) FILTER (WHERE label = '0')) AS k
      FROM v GROUP BY src),
kept AS (SELECT r.* FROM (SELECT v.*, row_number() OVER (PARTITION BY src, label ORDER BY h, row_pos) AS rn FROM v) r
         JOIN k ON k.src = r.src WHERE r.rn <= k.k)
SELECT src, row_number() OVER (PARTITION BY src ORDER BY md5(concat_ws('|', '{SEED}', 'order', row_pos)), row_pos) - 1
         AS out_pos, row_pos, {P9}
FROM kept""", "line_pairs"))
def q_rebalance(spark, d):
    return split.rebalance(fx.spark_line_pairs(spark, d), SEED)


@query("read_two_files", fx.sql_with(f"""
SELECT row_pos, folder1, file1, begin1, end1, folder2, file2, begin2, end2, '1' AS label FROM pairs WHERE label = '1'
UNION ALL
SELECT row_pos, folder1, file1, begin1, end1, folder2, file2, begin2, end2, '0' FROM pairs WHERE label = '0'""",
                                     "pairs"))
def q_read_two_files(spark, d):
    p = fx.spark_pairs(spark, d)
    cols = ["row_pos", *PAIR_COLS[:-1]]
    return split.two_file_pairs(p.filter(F.col("label") == "1").select(*cols),
                                p.filter(F.col("label") == "0").select(*cols))


# The other plan modules register themselves on import.
from pairwright.plans import text_plans  # noqa: E402,F401
from pairwright.plans import score_plans  # noqa: E402,F401
from pairwright.plans import source_plans  # noqa: E402,F401
from pairwright.plans import rename_plans  # noqa: E402,F401
from pairwright.plans import classify_plans  # noqa: E402,F401
