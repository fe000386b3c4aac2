"""Queries for classification and plug-ins."""

from __future__ import annotations


from pyspark.sql import functions as F

from pairwright.operators import classify, compare, fetch, identity, metrics, quality, split, udf
from pairwright.operators.history import long_log
from pairwright.plans.registry import query, sql_lit
from pairwright.plans.text_plans import FETCH_SQL, _strict_sql, lines_sql
from pairwright.session import shuffle_partitions, stage
from pairwright.sources import fixtures as fx

TOKEN_RE2 = r"[\pL\pN_]+|[^\t\n\x0b\f\r \pL\pN_]"
BUDGET = classify.MAX_LENGTH - classify.SPECIAL_TOKENS

FETCHED_SQL = FETCH_SQL.format(c1=_strict_sql("f1.lines", "p.begin1", "p.end1"),
                               c2=_strict_sql("f2.lines", "p.begin2", "p.end2"), lines=lines_sql("text"))


def _fetched(spark, d):
    return fetch.fetch_pairs(fx.spark_pairs(spark, d), fx.spark_files(spark, d)).select(
        "row_pos", "code1", "code2", "label", *[c for c in ("folder1", "file1", "begin1", "end1", "folder2",
                                                            "file2", "begin2", "end2")])


def _kept_sql(n1: str, n2: str) -> tuple[str, str]:
    ex, diff = f"({n1} + {n2} - {BUDGET})", f"abs({n1} - {n2})"
    r, short = f"({ex} - {diff})", f"least({n1}, {n2})"
    k1 = (f"CAST(CASE WHEN {ex} <= 0 THEN {n1} WHEN {n1} > {n2} AND {ex} <= {diff} THEN {n1} - {ex} "
          f"WHEN {n1} <= {n2} AND {ex} <= {diff} AND {diff} > 0 THEN {n1} "
          f"ELSE {short} - floor({r} / 2) END AS INTEGER)")
    k2 = (f"CAST(CASE WHEN {ex} <= 0 THEN {n2} WHEN {n1} > {n2} AND {ex} <= {diff} THEN {n2} "
          f"WHEN {n1} <= {n2} AND {ex} <= {diff} AND {diff} > 0 THEN {n2} - {ex} "
          f"ELSE {short} - ceil({r} / 2) END AS INTEGER)")
    return k1, k2


_K1, _K2 = _kept_sql("n_tokens1", "n_tokens2")
BUDGET_SQL = f"""
SELECT row_pos, n_tokens1, n_tokens2, {_K1} AS kept1, {_K2} AS kept2, n_tokens1 + n_tokens2 > {BUDGET} AS over_budget,
       code1, code2, t1, t2
FROM (SELECT row_pos, code1, code2,
             regexp_extract_all(code1, {sql_lit(TOKEN_RE2)}) AS t1, regexp_extract_all(code2, {sql_lit(TOKEN_RE2)}) AS t2,
             CAST(len(regexp_extract_all(code1, {sql_lit(TOKEN_RE2)})) AS INTEGER) AS n_tokens1,
             CAST(len(regexp_extract_all(code2, {sql_lit(TOKEN_RE2)})) AS INTEGER) AS n_tokens2
      FROM ({FETCHED_SQL}))"""


@query("token_budget", fx.sql_with(
    f"SELECT row_pos, n_tokens1, n_tokens2, kept1, kept2, over_budget FROM ({BUDGET_SQL})", "pairs", "files"))
def q_token_budget(spark, d):
    return classify.token_budget(_fetched(spark, d)).select("row_pos", "n_tokens1", "n_tokens2", "kept1", "kept2",
                                                            "over_budget")


@query("pair_features", fx.sql_with(f"""
SELECT row_pos,
       CASE WHEN len(list_distinct(list_concat(a, b))) > 0
            THEN len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b)))
            ELSE 0.0 END AS jaccard,
       CASE WHEN greatest(len(a), len(b)) > 0 THEN least(len(a), len(b)) / greatest(len(a), len(b)) ELSE 1.0 END
         AS length_ratio,
       CASE WHEN code1 = code2 THEN 1.0 ELSE 0.0 END AS exact_equal
FROM (SELECT row_pos, code1, code2, t1 AS a, t2 AS b FROM ({BUDGET_SQL}))""", "pairs", "files"))
def q_pair_features(spark, d):
    f = classify.pair_features(classify.token_budget(_fetched(spark, d)))
    return f.select("row_pos", "jaccard", "length_ratio", "exact_equal")


def _prints_sql(t: str) -> str:
    runs = (f"list_transform(range(1, greatest(len({t}) - {compare.GRAM - 1}, 1) + 1), "
            f"lambda i: CAST('0x' || substr(md5(array_to_string({t}[i:i + {compare.GRAM - 1}], ' ')), 1, 15) AS BIGINT))")
    return f"CASE WHEN len({t}) > 0 THEN {runs} ELSE CAST([] AS BIGINT[]) END"


def _winnow_sql(h: str) -> str:
    return (f"CASE WHEN len({h}) > 0 THEN list_sort(list_distinct(list_transform(range(1, greatest(len({h}) - {compare.WINDOW - 1}, 1) + 1), "
            f"lambda i: list_min({h}[i:i + {compare.WINDOW - 1}])))) ELSE {h} END")


@query("pair_fingerprints", fx.sql_with(f"""
SELECT row_pos, len(p1) AS n_prints1, len(p2) AS n_prints2, len(list_intersect(p1, p2)) AS n_shared,
       array_to_string(p1, ',') AS prints1,
       CASE WHEN len(p1) + len(p2) > 0 THEN len(list_intersect(p1, p2)) / (len(p1) + len(p2) - len(list_intersect(p1, p2))) ELSE 0.0 END AS prints_jaccard,
       CASE WHEN least(len(p1), len(p2)) > 0 THEN len(list_intersect(p1, p2)) / least(len(p1), len(p2)) ELSE 0.0 END AS prints_held
FROM (SELECT row_pos, {_winnow_sql('h1')} AS p1, {_winnow_sql('h2')} AS p2
      FROM (SELECT row_pos, {_prints_sql('t1')} AS h1, {_prints_sql('t2')} AS h2 FROM ({BUDGET_SQL})))""", "pairs", "files"))
def q_pair_fingerprints(spark, d):
    f = compare.fingerprint_features(classify.token_budget(_fetched(spark, d)))
    return f.select("row_pos", F.size("prints1").cast("long").alias("n_prints1"), F.size("prints2").cast("long").alias("n_prints2"),
                    F.col("prints_shared").cast("long").alias("n_shared"), F.array_join("prints1", ",").alias("prints1"), "prints_jaccard", "prints_held")


def _model_splits(spark, d):
    """Pairs with texts, tagged with their leakage-safe split (train / val / test)."""
    pairs = quality.class_rows(fx.spark_pairs(spark, d)).select("row_pos", *classify_cols())
    a = split.assign_functions(identity.function_universe(pairs), 0.8, 0.1, 0)
    tagged = split.in_split_pairs(pairs, a)
    return fetch.fetch_pairs(tagged, fx.spark_files(spark, d))


def _model_input(spark, d):
    """``_model_splits``, written once for all that reads it, in the session's number of parts: the texts are small
    beside the work on them, so parts cut by size would leave most cores idle."""
    return stage(_model_splits(spark, d).repartition(shuffle_partitions(spark), "row_pos"), "model_input")


def classify_cols():
    return ("folder1", "file1", "begin1", "end1", "folder2", "file2", "begin2", "end2", "label")


@query("fit_predict")
def q_fit_predict(spark, d):
    data = _model_input(spark, d)  # read by fit and by predict
    model = classify.fit(data.filter(F.col("split") == "train"))
    out = classify.predict(model, data.filter(F.col("split") != "train"))
    return out.select("row_pos", "split", F.col("label").cast("int").alias("label"), "predicted", "confidence",
                      "class_name")


@query("select_model")
def q_select_model(spark, d):
    # C3 + A10: the candidates' metrics on the validation split, and which one is kept
    data = _model_input(spark, d)
    _, log = classify.select(data.filter(F.col("split") == "train"), data.filter(F.col("split") == "val"))
    best = metrics.best_record(long_log(log.select("step", "accuracy"))).select(F.col("best_step").alias("step"), F.lit(True).alias("kept"))
    return log.join(best, "step", "left").select("step", "regParam", "elasticNetParam", "accuracy", "f1", "precision", "recall", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("evaluate_model")
def q_evaluate_model(spark, d):
    # Validation and test rows are reported apart (val_*, test_*).
    per_split = metrics.binary_metrics(q_fit_predict(spark, d), by=["split"])
    return metrics.metric_report(per_split, F.col("split"), by=["split"]).select("metric", "value")


# a plain Python normaliser (single blanks only) run through the
# pandas-UDF wrapper; the oracle is the SQL form of the rule.
def single_blanks(text: str) -> str:
    return " ".join(part for part in text.split(" ") if part)


@query("pluggable_normalizer", fx.sql_with(
    "SELECT snippet_id, trim(regexp_replace(code, ' +', ' ', 'g'), ' ') AS code FROM snippets", "snippets"))
def q_pluggable(spark, d):
    fn = udf.normalizer(single_blanks)
    return fx.spark_snippets(spark, d).select("snippet_id", fn(F.col("code")).alias("code"))


@query("pluggable_metrics", fx.sql_with("""
SELECT count(*) FILTER (WHERE label = predicted) / count(*) AS accuracy,
       CASE WHEN count(*) FILTER (WHERE predicted = 1) > 0
            THEN count(*) FILTER (WHERE label = 1 AND predicted = 1) / count(*) FILTER (WHERE predicted = 1)
            ELSE 0.0 END AS precision,
       count(*) AS n
FROM (SELECT label, CASE WHEN n_chars > 4000 THEN 1 ELSE 0 END AS predicted FROM predictions)""", "predictions"))
def q_pluggable_metrics(spark, d):
    # F3 with a rule on n_chars as the predictor and a custom metric function.
    def my_metrics(df, label, pred):
        c = metrics.confusion(df, label, pred)
        return c.select(((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"),
                        F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
                        .otherwise(F.lit(0.0)).alias("precision"), "n")
    p = fx.spark_predictions(spark, d).withColumn("predicted", (F.col("n_chars") > 4000).cast("int"))
    return udf.evaluate(p, my_metrics)

