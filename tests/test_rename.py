"""Renaming cases and the fallback."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter
from rename_cases import BROKEN_CASES, EXTRA_CASES, RENAME_CASES, RENAME_COUNTS

from pairwright.operators import rename
from pairwright.operators.normalize import normalize_code
from pairwright.operators.rename import (TEXT_BYTES, declarations, rename_identifiers, replacements, scope_mappings, scope_spans,
                                         snippet_tokens, token_partitions, token_table)
from pairwright.plans.catalog import QUERIES
from pairwright.plans.rename_plans import SHAPES


@pytest.fixture(scope="module")
def outputs(spark):
    cases = RENAME_CASES + EXTRA_CASES
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(cases)], "snippet_id long, code string")
    res = {}
    for i, (name, _src, flags, _want, _absent) in enumerate(cases):
        res[name] = normalize_code(df.filter(f"snippet_id = {i}"), **flags).first().code
    return res


@pytest.mark.parametrize("case", RENAME_CASES + EXTRA_CASES, ids=[c[0] for c in RENAME_CASES + EXTRA_CASES])
def test_rename_case(outputs, case):
    name, _src, _flags, want, absent = case
    for w in want:
        assert w in outputs[name], (w, outputs[name])
    for a in absent:
        assert a not in outputs[name]


@pytest.mark.parametrize("name,frag,n", RENAME_COUNTS)
def test_rename_counts(outputs, name, frag, n):
    assert outputs[name].count(frag) == n


def test_tokens_are_lossless(spark):
    src = 'class A { String s = "x\\"y"; int n = 0x1F; /* c */ }\n\tend'
    df = spark.createDataFrame([(1, src)], "snippet_id long, code string")
    toks = [r.tok for r in token_table(df).orderBy("pos").collect()]
    assert "".join(toks) == src


def test_broken_texts(spark):
    df = spark.createDataFrame([(i, c[1]) for i, c in enumerate(BROKEN_CASES)], "snippet_id long, code string")
    got = {r.snippet_id: r for r in rename_identifiers(df).collect()}
    for i, (name, src, want) in enumerate(BROKEN_CASES):
        assert got[i].code == want, name
        assert got[i].renamed == (want != src)


def test_long_text_block_and_literal(spark):
    """Literal patterns do not recurse: long ones leave the stack alone."""
    long = "x\\n" * 60_000
    src = f'class A {{ void f(int p) {{ String a = "{long}"; String b = """{long}"q" """; use(p); }} }}'
    df = spark.createDataFrame([(1, src)], "snippet_id long, code string")
    assert rename_identifiers(df).first().code == src.replace("int p", "int num1").replace("use(p)", "use(num1)") \
        .replace("String a", "String str1").replace("String b", "String str2")


def test_partitions_grow_with_the_text(spark):
    """A task's token windows hold a bounded stretch of text, whatever the session's shuffle partitions are."""
    n, size = 64, TEXT_BYTES // 4
    df = spark.range(n).select(F.col("id").alias("snippet_id"), F.repeat(F.lit("x"), size).alias("code"))
    assert token_partitions(df) == n * size // TEXT_BYTES > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert token_partitions(df.limit(0)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_uses_are_shuffled_once(spark):
    """Uses are dealt by snippet before they are multiplied by their levels; every later step keeps that layout."""
    df = spark.createDataFrame([(1, "class A { void f(int p) { use(p); } }")], "snippet_id long, code string")
    sig = snippet_tokens(df, partitions=3).localCheckpoint()
    scopes = scope_spans(sig, 3)
    maps = spark.createDataFrame([(1, scopes.first().scope, "p", "num1")], "sid long, scope int, name string, new_name string")
    reps = replacements(sig, scopes, maps, 3).groupBy("sid").count()
    plan = reps._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Union")[0].count("Exchange") == 1
    assert reps.first()["count"] == 2


def test_token_facts_sort_and_shuffle_texts_only(spark):
    """The facts take one shuffle and one sort, both of the texts; no window holds the tokens."""
    df = spark.createDataFrame([(1, "class A { void f(int p) { use(p); } }")], "snippet_id long, code string")
    plan = snippet_tokens(df, partitions=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1
    assert "Window" not in plan


def test_token_facts_over_batch_ends(spark):
    """Snippets that span batches, repeat their id or have none get the facts of their whole texts."""
    codes = [c[1] for c in RENAME_CASES + BROKEN_CASES]
    df = spark.createDataFrame([(None if i == 3 else i, c) for i, c in enumerate(codes)] + [(1, codes[1])], "snippet_id long, code string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    got = []
    try:
        for rows in ("7", "100000"):
            spark.conf.set(key, rows)
            got.append(sorted(map(repr, snippet_tokens(df, partitions=2).collect())))
    finally:
        spark.conf.set(key, before)
    assert got[0] == got[1] and len(got[0]) > 500


@pytest.mark.parametrize("name", ["rename_identifiers", "rename_shapes", "normalize_renamed"])
def test_texts_pass_once(spark, sf, name, monkeypatch):
    """One shuffle, of the texts as they come; no join, no window and nothing stored on the way."""
    stored = []
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *args, **kwargs: stored.append(path))
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not stored
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
    assert "regexp" not in plan.split("Exchange")[1]  # the rules run in the parts, not in the scan's few tasks


def spliced(spark, df, **kinds):
    """(id, code, renamed) by the steps one by one, each over its stored tables."""
    n = token_partitions(df)
    sig = snippet_tokens(df, partitions=n, **kinds).localCheckpoint()
    scopes = scope_spans(sig, n).localCheckpoint()
    maps = scope_mappings(declarations(sig, scopes, n), n).localCheckpoint()
    reps: dict = {}
    for r in replacements(sig, scopes, maps, n).collect():
        reps.setdefault(r.sid, {})[r.pos] = r.new_name
    rows = df.select("snippet_id", F.regexp_extract_all("code", F.lit(rename.TOKEN_RX), 0).alias("toks")).collect()
    return sorted((repr(r.snippet_id), "".join(reps.get(r.snippet_id, {}).get(i, t) for i, t in enumerate(r.toks)), r.snippet_id in reps) for r in rows)


@pytest.mark.parametrize("kinds", [{}, {"declared": True}], ids=["all tokens", "declared names"])
def test_one_pass_gives_what_the_steps_give(spark, kinds):
    """Also for ids that repeat or are missing and for letters beyond ASCII."""
    codes = [c[1] for c in RENAME_CASES + EXTRA_CASES + BROKEN_CASES]
    codes.append("class A { void f(int \u00e9, int \u65e5\u672c, int x) { use(\u00e9 + \u65e5\u672c + \u2167 + x); } }")
    rows = [*enumerate(codes), *list(enumerate(codes))[:12], (None, codes[0]), (None, "abstract class B { abstract void g(int p); }"), (999, ""), (998, "a { b (")]
    df = spark.createDataFrame(rows, "snippet_id long, code string").repartition(3)
    got = {r.snippet_id: r for r in rename_identifiers(df).collect()}
    assert got[len(codes) - 1].code == "class A { void f(int num1, int num2, int num3) { use(num1 + num2 + \u2167 + num3); } }"
    assert not got[None].renamed
    assert sorted((repr(r.snippet_id), r.code, r.renamed) for r in rename_identifiers(df).collect()) == spliced(spark, df, **kinds)


def test_other_columns_pass(spark):
    df = spark.createDataFrame([("x", "void f(int p) { use(p); }", 1), (None, None, None), ("z", "text", 3)], "a string, code string, snippet_id long")
    got = rename_identifiers(df)
    assert got.columns == ["snippet_id", "a", "code", "renamed"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(1, "x", "void f(int num1) { use(num1); }", True), (None, None, None, False), (3, "z", "text", False)], key=repr)


def test_spans_and_declarations_deal_no_tokens(spark):
    """Spans are read off the tokens; declarations deal declared names and spans only, once."""
    df = spark.createDataFrame([(1, "class A { void f(int p) { int q = p; use(p, q); } int x; }")], "snippet_id long, code string")
    sig = snippet_tokens(df, partitions=3, declared=True).localCheckpoint()
    assert sorted(r.tok for r in sig.collect()) == ["(", "p", "p", "p", "q", "q"]
    scopes = scope_spans(sig, 3)
    assert "Exchange" not in scopes._jdf.queryExecution().executedPlan().toString()
    decls = declarations(sig, scopes.localCheckpoint(), 3)
    assert decls._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.name, r.bucket, r.is_local) for r in decls.collect()) == [("p", "num", 0), ("q", "num", 1)]


def test_batches_are_cut_between_ids(monkeypatch):
    monkeypatch.setattr(rename, "_CHUNK", 4)
    ids = [1, 1, 2, 3, 3, 3, 4, None, None, 5]
    b = pa.RecordBatch.from_pydict({"sid": ids, "toks": [["t"] * n for n in (1, 1, 1, 9, 1, 1, 2, 1, 1, 0)]})
    for parts in ([b], [b.slice(i, 1) for i in range(len(ids))], [b.slice(0, 5), b.slice(5)]):
        got = [x.column("sid").to_pylist() for x in rename._whole_snippets(parts, "sid", "toks")]
        assert [i for x in got for i in x] == ids
        assert all(x[-1] != y[0] for x, y in zip(got, got[1:]))
    assert [x.column("sid").to_pylist() for x in rename._whole_snippets([b], "sid", "toks")] == [[1, 1, 2], [3, 3, 3], [4, None, None], [5]]


def test_orders_without_a_customer_name_no_shape(spark, tmpdir_path):
    rows = [(k, None if k % 3 == 0 else k, "F") for k in range(36)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmpdir_path}/orders.parquet")
    got = {r.snippet_id: r for r in QUERIES["rename_shapes"](spark, tmpdir_path).collect()}
    assert len(got) == 36
    for k, cust, _ in rows:
        assert got[k].renamed == (cust is not None)
        assert cust is None or got[k].code == SHAPES[cust % len(SHAPES)][1].replace("#K", str(k))
