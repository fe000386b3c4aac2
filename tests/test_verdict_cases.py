"""Cases beside the fixtures: comparisons and shifts in renaming, odd CSV cells, long blank runs, qualified paths."""

import time

import pytest
from pyspark.sql import functions as F

from pairwright.functions.text import normalize_whitespace
from pairwright.operators.identity import overlap_list, overlap_sizes
from pairwright.operators.metrics import binary_metrics, metric_report
from pairwright.operators.normalize import normalize_code
from pairwright.operators.rank import positions_across
from pairwright.operators.rename import rename_identifiers
from pairwright.operators.split import in_split_pairs, split_pairs
from pairwright.schema import PAIR_COLS
from pairwright.sources.csv_pairs import layout_report, parse_lenient, parse_positional, read_pairs, write_pairs


@pytest.mark.parametrize("code, wanted", [
    ("int f(int a, int b) { boolean c = false; c = a > b; return 1; }", "num2"),
    ("int f(int lo, int hi) { for (int i = hi; i > lo; i--) { g(i); } return 1; }", "num1"),
    ("int f(int h, int k) { h = h >>> k; return h; }", "num2"),
    ("int f(int i, int m) { boolean ok; ok = i > m; return 1; }", "num2"),
])
def test_comparisons_declare_nothing(spark, code, wanted):
    df = spark.createDataFrame([(1, code)], "sid long, code string")
    out = rename_identifiers(df, "sid", "code").collect()[0]["code"]
    assert wanted in out and "obj" not in out


def test_generic_local_is_still_declared(spark):
    code = "int f(int a) { Map<String, List<Foo>> m = make(); return m.size() + a; }"
    out = rename_identifiers(spark.createDataFrame([(1, code)], "sid long, code string"), "sid", "code").collect()[0]["code"]
    assert "obj1 = make()" in out and "num1" in out


def test_record_is_no_method(spark):
    code = "record R(int a, int b) { }"
    assert rename_identifiers(spark.createDataFrame([(1, code)], "sid long, code string"), "sid", "code").collect()[0]["code"] == code


def test_kept_comments_stay_as_they_are(spark):
    code = "class A {\n  // a is { big\n  int f(int a) { /* \" a */ return a; }\n}\n"
    out = normalize_code(spark.createDataFrame([(1, code)], "snippet_id long, code string"), strip_comments=False).first().code
    assert out == code.replace("int a", "int num1").replace("return a", "return num1")


def test_one_large_text_is_renamed_in_linear_time(spark):
    body = "x = x + 1;\n" * 100_000
    df = spark.createDataFrame([(1, "class A { int f(int x) {\n" + body + "return x; } }")], "sid long, code string")
    began = time.perf_counter()
    out = rename_identifiers(df, "sid", "code").first().code
    assert out.count("num1 = num1 + 1;\n") == 100_000 and time.perf_counter() - began < 90


CELLS = [("", "b", "1", "2", "c", "d", "3", "4", "1"), ('q"uote', "co,mma", " 1", "2 ", "\\", "", "3", "4", ""),
         ("a", " ", "1", "2", '"', '""', "3", "4", " 1")]


def test_cells_come_back(spark, tmpdir_path):
    rows = spark.createDataFrame([(*c, i) for i, c in enumerate(CELLS)], ", ".join(f"{c} string" for c in PAIR_COLS) + ", row_pos long")
    write_pairs(rows, f"file://{tmpdir_path}/out")
    back = read_pairs(spark, f"file://{tmpdir_path}/out").orderBy("row_pos").select(*PAIR_COLS).collect()
    assert sorted(map(tuple, back)) == sorted(CELLS)


def test_empty_first_cell_is_a_cell(spark):
    lines = spark.createDataFrame([("f", 0, ",b,1,2,c,d,3,4,1"), ("f", 1, '"a""x",b,1,2,c,,3,4,0')], "src string, row_pos long, line string")
    assert layout_report(lines).count() == 0 and parse_lenient(lines).count() == 2
    got = [tuple(r) for r in parse_positional(lines).orderBy("row_pos").select(*PAIR_COLS).collect()]
    assert got == [("", "b", "1", "2", "c", "d", "3", "4", "1"), ('a"x', "b", "1", "2", "c", "", "3", "4", "0")]


def test_null_cells_stay_in_their_split(spark):
    pairs = spark.createDataFrame([("x", None, "1", "2", "y", "g", "3", "4", "1")], ", ".join(f"{c} string" for c in PAIR_COLS))
    own = spark.createDataFrame([("x", None, "1", "2", "train"), ("y", "g", "3", "4", "train")], "folder string, file string, begin string, end string, split string")
    assert in_split_pairs(pairs, own).count() == 1


def test_long_blank_runs_are_linear(spark):
    run = "a" + " " * 1_000_000 + "b\n" + "c" + " " * 200_000 + "\n"
    df = spark.createDataFrame([(run,)], "t string").select(normalize_whitespace("t").alias("t"))
    df.limit(0).collect()
    began = time.perf_counter()
    assert df.collect()[0]["t"] == "a" + " " * 1_000_000 + "b\nc\n"
    assert time.perf_counter() - began < 10


def test_whitespace_edges(spark):
    df = spark.createDataFrame([("",), (" \n ",), (None,), ("x",), ("x\n\n\n\ny \r\n",)], "t string")
    assert [r[0] for r in df.select(normalize_whitespace("t")).collect()] == ["", "", None, "x\n", "x\n\ny\n"]


def test_qualified_paths():
    import re

    from pairwright.sources.files import _STORE
    for p in ("hdfs://nn:8020/data/code/f1/A.java", "file:/data/code/f1/A.java", "file:///data/code/f1/A.java", "s3a://bucket/data/code/f1/A.java", "/data/code/f1/A.java"):
        assert re.sub(_STORE + "/*data/code/", "", p) == "f1/A.java"


def test_split_of_many_files_numbers_rows_over_all_of_them(spark):
    rows = [(i, f"f{k:02d}", "a", f"x{i % 40}", "1", "9", "b", f"y{(i + k) % 40}", "1", "9", str((i + k) % 2))
            for k in range(20) for i in range(50)]
    df = spark.createDataFrame(rows, "row_pos long, src string, " + ", ".join(f"{c} string" for c in PAIR_COLS))
    across = positions_across(df)
    assert [r[0] for r in across.select("row_pos").orderBy("row_pos").collect()] == list(range(1000))
    assert all(r.row_pos // 50 == int(r.src[1:]) for r in across.collect())
    whole = df.withColumn("row_pos", F.col("row_pos") + 50 * F.substring("src", 2, 2).cast("long"))
    assert sorted(split_pairs(df, src="src").collect()) == sorted(split_pairs(whole).collect())


def test_overlap_list_sorts_lines_as_numbers(spark):
    cells = [("p", "f", b, "99", "q", "f", "3", "4", "1") for b in ("10", "9", "100")]
    df = spark.createDataFrame(cells, ", ".join(f"{c} string" for c in PAIR_COLS))
    assert [r.start for r in overlap_list(df, df).collect()] == [3, 9, 10, 100]
    assert tuple(overlap_sizes(df, df.limit(1)).first()) == (4, 2, 2)


def test_report_is_ordered_and_named_by_split(spark):
    df = spark.createDataFrame([("val", 1, 1), ("val", 0, 1), ("test", 1, 1)], "split string, label int, predicted int")
    rows = metric_report(binary_metrics(df, by=["split"]), F.col("split"), by=["split"]).collect()
    assert [r.metric for r in rows] == [f"{s}_{m}" for s in ("test", "val") for m in ("accuracy", "f1", "precision", "recall")]
    assert rows[0].value == 1.0 and rows[4].value == 0.5


def test_positions_across_few_files_move_no_rows(spark):
    """With two files a join that shuffles by file gives each task a file; the rows stay where they are."""
    df = spark.range(100).selectExpr("id AS row_pos", "if(id % 2 = 0, 'a', 'b') AS src")
    with_offsets = positions_across(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in with_offsets and "SortMergeJoin" not in with_offsets
