"""CSV sources and sinks round trip; streaming balance."""

import glob
import os

from pyspark.sql import functions as F

from pairwright.functions.lines import decode_utf8_lenient, parse_int_lenient
from pairwright.operators import quality, split
from pairwright.schema import PAIR_COLS
from pairwright.sources import csv_pairs as C
from pairwright.sources import fixtures as fx
from pairwright.streaming.balance import start_balance


def test_csv_round_trip_positions(spark, sf, tmpdir_path):
    lp = fx.spark_line_pairs(spark, sf)
    out = os.path.join(tmpdir_path, "pairs")
    C.write_pairs(lp.withColumn("part", (F.col("row_pos") % 3).cast("string")), out, header=True, by="part")
    back = C.read_pairs(spark, out + "/part=*", header=True)
    # positions restart per file and follow the written order
    got = back.groupBy("src").agg(F.min("row_pos").alias("lo"), F.max("row_pos").alias("hi"),
                                  F.count(F.lit(1)).alias("n")).collect()
    assert all(r.lo == 0 and r.hi == r.n - 1 for r in got)
    assert back.select(*PAIR_COLS).exceptAll(lp.select(*PAIR_COLS)).count() == 0
    assert C.layout_errors(back).count() == 0


def test_ragged_rows_flagged(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "ragged.csv")
    with open(p, "w") as f:
        f.write("h1,h2,h3,h4,h5,h6,h7,h8,h9\n")
        f.write("a,,1,2,c,d,3,4,1\n")
        f.write("a,b,1,2,c,d,3,1\n\n")
        f.write("a,b,1,2,c,d,3,4,x,0\n")
    df = C.read_pairs(spark, p, header=True)
    rows = sorted((r.row_pos, r._corrupt_record is not None) for r in df.collect())
    assert rows == [(0, False), (1, True), (2, True)]
    assert df.filter("row_pos = 0").first().file1 == ""  # an empty cell is a value, not NULL
    assert sorted(r.row_pos for r in C.lenient_rows(df).collect()) == [0, 2]
    lines = spark.read.text(p).withColumnRenamed("value", "line").withColumn("src", F.lit(p)).withColumn("row_pos", F.lit(0))
    rep = C.layout_report(lines.filter("line not like 'h1%'"))
    assert sorted(r.n_fields for r in rep.collect()) == [8, 10]
    len9 = C.parse_lenient(lines.filter("line not like 'h1%'"))
    assert sorted(r.label for r in len9.collect()) == ["0", "1"]


def test_dedup_compares_whole_rows(spark, tmpdir_path):
    import csv
    from collections import Counter
    p = os.path.join(tmpdir_path, "wide.csv")
    nine = "a,b,1,2,c,d,3,4,1"
    lines = [nine, nine, nine + ",x", nine + ",y", nine + ",x", nine + ',"x"', nine + ",", "a,b,1,2", "a,b,1,2,", "a,b,1,2", "a",
             nine + ',"p,q"', nine + ",p,q", nine + ',"p""q"', "a,b,1,2,c,d,3,4,0"]
    with open(p, "w") as f:
        f.write("h1,h2,h3,h4,h5,h6,h7,h8,h9\n" + "\n".join(lines) + "\n")
    rows = [tuple(r) for r in csv.reader(lines)]
    first = {r: i for i, r in reversed(list(enumerate(rows)))}
    df = C.read_pairs(spark, p, header=True)
    kept = quality.dedup_keep_first(df, by=["src"])
    assert sorted(r.row_pos for r in kept.collect()) == sorted(first.values())
    assert sorted(r.row_pos for r in quality.dedup_keep_first(kept).collect()) == sorted(first.values())
    copies = sorted(n for n in Counter(rows).values() if n > 1)
    assert sorted(r.copies for r in quality.detect_duplicates(df).collect()) == copies
    rep = quality.dedup_report(df).first()
    assert (rep.kept, rep.removed) == (len(first), len(rows) - len(first))
    rep = quality.duplicate_report(df).first()
    assert (rep.duplicate_rows, rep.surplus_copies) == (len(copies), sum(copies) - len(copies))


def test_cells_are_those_of_the_csv_module(spark):
    import csv
    import random
    rng = random.Random(1)
    texts = ['"abc,d,1', '"a"b,c', 'a"b,c', '"a""b",c', 'a,"b"x,c', '"a,x"b,c', '"a"b"c",d', '"","b"', '""', '"', 'a,"', 'a,"b', '"a""', "a,b,", " ", ",",
             '"""a,b', '""a,b', "", "x," * 30 + "y", ",".join("abcdefgh" * 40), '"q,' * 30]
    texts += ["".join(rng.choice('ab,"",') for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in [*dict.fromkeys(texts), None]], "t string")
    got = {r.t: r.cells for r in df.select("t", C.csv_cells("t").alias("cells")).collect()}
    want = {t: next(csv.reader([t]), []) for t in texts}
    assert got.pop(None) is None
    differ = {t for t in want if got[t] != want[t]}
    # Spark's parser unescapes "" in a cell whose quotes close early before it gives the cell up
    assert all('""' in t for t in differ) and len(differ) < len(want) / 20


def test_blank_rows_are_rows(spark, tmpdir_path):
    """De-duplication and the duplicate report keep blank lines, as a row without cells."""
    import csv
    from collections import Counter
    p = os.path.join(tmpdir_path, "blank.csv")
    lines = ["a,b,1,2,c,d,3,4,1", "", "a,b,1,2,c,d,3,4,1", "", '"a"x,b,1,2,c,d,3,4,1', "ax,b,1,2,c,d,3,4,1", "", "a,b", '"a",b', " "]
    with open(p, "w") as f:
        f.write("h1,h2,h3,h4,h5,h6,h7,h8,h9\n" + "\n".join(lines) + "\n")
    rows = [tuple(r) for r in csv.reader(lines)]
    df = C.read_rows(spark, p)
    first = {r: i for i, r in reversed(list(enumerate(rows)))}
    assert sorted(r.row_pos for r in quality.dedup_keep_first(df, by=["src"]).collect()) == sorted(first.values())
    copies = [n for n in Counter(rows).values() if n > 1]
    rep = quality.duplicate_report(df).first()
    assert (rep.duplicate_rows, rep.surplus_copies) == (len(copies), sum(copies) - len(copies))
    assert C.read_rows(spark, p, header=False).count() == len(lines) + 1


def test_fetch_opens_only_named_files(spark, tmpdir_path):
    """Files over the source's length limit fail when opened: nobody opens those that no pair names."""
    from pairwright.operators.fetch import fetch_from_tree, fetch_pairs
    from pairwright.sources.files import read_code_files, read_named_files
    root = os.path.join(tmpdir_path, "tree")
    for name, text in (("f1/A.java", "a0\na1\na2\n"), ("f1/B [1].java", "b0\r\nb1\n"), ("f2/C.java", "c0\nc1"), ("f2/huge.java", "x" * 5000), ("huge2.java", "y" * 5000)):
        os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
        with open(os.path.join(root, name), "w", newline="") as f:
            f.write(text)
    pairs = spark.createDataFrame([("f1", "A.java", "0", "2", "f1", "B [1].java", "1", "2", "1"), ("f2", "C.java", "1_0", "11", "f2", "none.java", "0", "1", "0"),
                                   ("f2", "C.java", "0", "2", "f1", "A.java", "2", "3", "0")], ", ".join(f"{c} string" for c in PAIR_COLS))
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, "1000")
    try:
        got = {(r.code1, r.code2) for r in fetch_from_tree(pairs, root).collect()}
        assert got == {("a0\na1\n", "b1\n"), ("", ""), ("c0\nc1", "a2\n")}
        needed = spark.createDataFrame([("f1/A.java",), ("f1/B [1].java",), ("f2/C.java",), ("f3/none",)], "path string")
        assert read_named_files(spark, root, needed, batch=1).count() == read_named_files(spark, root, needed).count() == 3
        assert read_named_files(spark, root, needed.filter("path like 'f3%'")).count() == 0
        try:
            read_code_files(spark, root).collect()
            raise AssertionError("the large files were not read")
        except Exception as e:
            assert "huge" in str(e)
    finally:
        spark.conf.unset(key)
    assert {(r.code1, r.code2) for r in fetch_pairs(pairs, read_code_files(spark, root)).collect()} == got


def test_decode_keeps_genuine_marks(spark):
    raws = [b"a\xef\xbf\xbdb", b"a\xffb\xef\xbf\xbd\xe2\xef\xbf\xbd\xc3(", "\ufdd0 \ufdd0\ufdd1\ufdd2 \ufffd\ufdd2".encode(), b"\xe4\xbd\xa0\xe4\xbd", b"\xf0\x9f\x98", b"", b"\xc0\x80x\xed\xa0\x80y"]
    df = spark.createDataFrame([(r,) for r in raws], "b binary")
    assert [r[0] for r in df.select(decode_utf8_lenient("b")).collect()] == [r.decode("utf-8", "ignore") for r in raws]


def test_int_cells(spark):
    cells = ["12", " 7 ", "+5", "-3", "1_2", "1_000_0", "_1", "1__2", "1_", "x", "", "1.0"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(parse_int_lenient("c")).collect()]

    def py(c):
        try:
            return int(c)
        except ValueError:
            return None
    assert got == [py(c) for c in cells]


def test_write_splits_headerless(spark, sf, tmpdir_path):
    out = split.split_pairs(fx.spark_line_pairs(spark, sf))
    path = os.path.join(tmpdir_path, "splits")
    C.write_splits(out, path)
    assert sorted(os.path.basename(d) for d in glob.glob(path + "/split=*")) == ["split=test", "split=train", "split=val"]
    back = spark.read.schema(C._schema(PAIR_COLS, corrupt=False)).csv(path + "/split=train")
    assert back.count() == out.filter("split = 'train'").count()


def test_streaming_balance(spark, sf, tmpdir_path):
    src = os.path.join(tmpdir_path, "incoming")
    p = fx.spark_noisy_pairs(spark, sf)
    C.write_pairs(p, src, header=True, by=None)
    q = start_balance(spark, src, os.path.join(tmpdir_path, "ckpt"), query_name="bal_test")
    q.processAllAvailable()
    got = spark.sql("select sum(total) t, sum(clones) c from bal_test").first()
    q.stop()
    want = quality.class_balance(p.withColumn("src", F.lit("x"))).first()
    assert (got.t, got.c) == (want.total, want.clones)


def test_code_files_source(spark, tmpdir_path):
    from pairwright.operators import fetch
    from pairwright.sources.files import derived_path, read_code_files
    root = os.path.join(tmpdir_path, "code")
    os.makedirs(os.path.join(root, "f1"))
    with open(os.path.join(root, "f1", "A.java"), "wb") as f:
        f.write(b"line0\r\nline1 \xff\xfe bad\rline2\n")
    files = read_code_files(spark, root)
    row = files.first()
    assert row.path == "f1/A.java" and row.text == "line0\nline1  bad\nline2\n"
    pairs = spark.createDataFrame([(0, "f1", "A.java", "1", "3", "f1", "missing.java", "0", "0", "1")],
                                  "row_pos long, " + ", ".join(f"{c} string" for c in PAIR_COLS))
    r = fetch.fetch_pairs(pairs, files).first()
    assert (r.code1, r.code2) == ("line1  bad\nline2\n", "")
    assert derived_path("/x/data/train.csv", "_dedup") == "/x/data/train_dedup"
    assert derived_path("/x/data/train.csv", "_balanced", "/out") == "/out/train_balanced"


def test_metric_log_to_csv_and_series(spark, tmpdir_path):
    from pairwright.operators import history
    # records carry different keys (NULL = key absent), as a trainer's log does
    rec = spark.createDataFrame(
        [(0, 0.70, None, None, 2e-6), (1, None, 0.61, 0.55, None), (2, 0.67, None, None, 4e-6), (3, None, 0.58, 0.60, None)],
        "step long, loss double, eval_loss double, eval_accuracy double, learning_rate double")
    path = os.path.join(tmpdir_path, "log")
    C.write_table(rec, path, fmt="csv")
    assert spark.read.option("header", True).csv(path).count() == 4
    s = history.metric_series(history.long_log(rec), history.REFERENCE_SELECTION, history.REFERENCE_X_OF)
    got = sorted((r.metric, r.k, r.x, r.y) for r in s.collect())
    assert got == [("eval_accuracy", 1, 1, 0.55), ("eval_accuracy", 2, 3, 0.60),
                   ("eval_loss", 1, 1, 0.61), ("eval_loss", 2, 3, 0.58),
                   ("learning_rate", 1, 0, 2e-6), ("learning_rate", 2, 2, 4e-6),
                   ("loss", 1, 0, 0.70), ("loss", 2, 2, 0.67)]


def test_model_fit_save_predict(spark, tmpdir_path):
    from pairwright.operators import classify
    rows = [(i, "int a = 1; return a;" * (1 + i % 3), "int b = 1; return b;" * (1 + i % 3), "1") for i in range(20)]
    rows += [(100 + i, "class X { void f() {} }", "select * from t where k = %d" % i, "0") for i in range(20)]
    df = spark.createDataFrame(rows, "row_pos long, code1 string, code2 string, label string")
    model = classify.fit(df)
    path = os.path.join(tmpdir_path, "model")
    classify.save(model, path)
    out = classify.predict(classify.load(path), df)
    acc = out.filter(F.col("predicted") == F.col("label").cast("int")).count() / out.count()
    assert acc >= 0.9
    assert set(r.class_name for r in out.select("class_name").distinct().collect()) <= {"CLONE", "NOT CLONE"}


def test_fetch_with_full_normaliser(spark, tmpdir_path):
    from pairwright.operators import fetch
    from pairwright.sources.files import read_code_files
    root = os.path.join(tmpdir_path, "src")
    os.makedirs(os.path.join(root, "f"))
    with open(os.path.join(root, "f", "A.java"), "w") as f:
        f.write("class A {\n  int add(int a, int b) {\n    int s = a + b; // sum\n    return s;\n  }\n}\n")
    pairs = spark.createDataFrame([(0, "f", "A.java", "1", "5", "f", "A.java", "0", "6", "1")],
                                  "row_pos long, " + ", ".join(f"{c} string" for c in PAIR_COLS))
    r = fetch.fetch_pairs(pairs, read_code_files(spark, root), normalize={}).first()
    assert r.code1 == "int add(int num1, int num2) {\n    int num3 = num1 + num2;\n    return num3;\n  }\n"
    assert "int add(int num1, int num2)" in r.code2 and "class A {" in r.code2


def test_staged_tables_released(spark, monkeypatch):
    import tempfile

    from pairwright import session
    fresh = tempfile.mkdtemp(prefix="pairwright-release-")  # a new folder only this test uses
    monkeypatch.setattr(session, "checkpoint_dir", lambda _s: fresh)
    assert session.stage(spark.range(5), "probe").count() == 5
    root = session.staging_root(spark)
    assert os.path.isdir(root) and root.startswith(fresh)
    assert session.release_staged(spark)
    assert not os.path.exists(root)


def test_checkpoint_dir_fallback_never_sets_static_conf():
    from pairwright import session

    class Conf:
        def get(self, k, d=None):
            return None

        def set(self, k, v):
            raise AssertionError("spark.checkpoint.dir is static")

    class SC:
        applicationId = "app-fallback-test"
        calls = []

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, d):
            self.calls.append(d)

    class FakeSpark:
        conf, sparkContext = Conf(), SC()

    fake = FakeSpark()
    d1 = session.checkpoint_dir(fake)
    d2 = session.checkpoint_dir(fake)
    assert d1 == d2 and os.path.isdir(d1) and SC.calls == [d1]


def test_derived_tables_are_named_after_their_inputs(spark, tmpdir_path):
    for name, n in (("a.csv", 3), ("b.csv", 5)):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write("h1,h2,h3,h4,h5,h6,h7,h8,h9\n" + "".join(f"x,{name},{i // 2},2,y,g,3,4,1\n" for i in range(n)))
    df = C.read_pairs(spark, tmpdir_path + "/*.csv")
    for _ in range(2):  # a second run replaces the first one's tables
        out = C.write_derived(quality.dedup_keep_first(df, by=["src"]), "_dedup")
        assert sorted(os.path.basename(t) for t in out.values()) == ["a_dedup", "b_dedup"]
        assert [C.read_pairs(spark, os.path.join(tmpdir_path, t)).count() for t in ("a_dedup", "b_dedup")] == [2, 3]
    assert not [d for d in os.listdir(tmpdir_path) if d.startswith("_derived")]
    other = os.path.join(tmpdir_path, "out")
    assert sorted(C.write_derived(df, "_balanced", other).values()) == [f"{other}/a_balanced", f"{other}/b_balanced"]


def test_null_groups_are_groups(spark):
    rows = [(i, None if i < 4 else "f", *("a", "b", "1", "2", "c", "d", "3", "4"), str(i % 2)) for i in range(10)]
    df = spark.createDataFrame(rows, "row_pos long, src string, " + ", ".join(f"{c} string" for c in PAIR_COLS))
    assert sorted((r.src or "", r.out_pos) for r in split.rebalance(df).collect()) == [("", i) for i in range(4)] + [("f", i) for i in range(6)]
    got = split.interleave_classes(df.withColumn("split", F.col("src"))).collect()
    assert sorted((r.split or "", r.out_pos, r.label) for r in got) == [(s, i, str(1 - i % 2)) for s, n in (("", 4), ("f", 6)) for i in range(n)]
