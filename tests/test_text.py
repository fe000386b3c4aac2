"""Normaliser rules, one by one and together, with whole expected texts."""

import pytest
from pyspark.sql import functions as F

from pairwright.functions import lines as L
from pairwright.functions import text as T
from pairwright.operators.normalize import normalize_code


def norm(spark, src, **flags):
    df = spark.createDataFrame([(0, src)], "snippet_id long, code string")
    return normalize_code(df, **flags).collect()[0].code


OFF = dict(strip_comments=False, mask_strings=False, mask_numbers=False, rename=False)


SOURCE = """int go(String p) {\t// entry
  String u = "ftp:host.txt"; /* why
  not */ char sep = '/';
  return p.length() * 0x1F + 2.5e3f;
}
"""


@pytest.mark.parametrize("src,want", [
    ("if (ok)\t{\r\n\treturn;  \r\n}", "if (ok)    {\n    return;\n}\n"),
    ("a;\n\n\n\n\nb;\n\nc;\n\n\n", "a;\n\nb;\n\nc;\n"),
    ("a;   \n \t\nb;", "a;\n\nb;\n"),
    ("\t\n\n \r\n", ""),
])
def test_whitespace(spark, src, want):
    assert norm(spark, src, **OFF) == want


@pytest.mark.parametrize("flags,want", [
    ({}, "int go(String p) {\n  String u = <STR>;                 char sep = <STR>;\n"
         "  return p.length() * <NUM> + <NUM>;\n}\n"),
    ({"mask_strings": False, "mask_numbers": False},
     "int go(String p) {\n  String u = \"ftp:host.txt\";                 char sep = '/';\n"
     "  return p.length() * 0x1F + 2.5e3f;\n}\n"),
    ({"strip_comments": False, "mask_strings": False},
     "int go(String p) {    // entry\n  String u = \"ftp:host.txt\"; /* why\n  not */ char sep = '/';\n"
     "  return p.length() * <NUM> + <NUM>;\n}\n"),
    ({"strip_comments": False, "mask_numbers": False},
     "int go(String p) {    // entry\n  String u = <STR>; /* why\n  not */ char sep = <STR>;\n"
     "  return p.length() * 0x1F + 2.5e3f;\n}\n"),
])
def test_flags(spark, flags, want):
    assert norm(spark, SOURCE, rename=False, **flags) == want


def test_comment_signs_inside_a_string_cut_the_line(spark):
    # Comments go before literals are known: a // inside a string ends its line.
    assert norm(spark, 's = "http://x"; int y;\nz();\n', rename=False) == 's = "http:\nz();\n'


def test_number_forms(spark):
    got = norm(spark, "f(7, 1_000L, 0b11, 0xCAFE, .5, 3.0e-2d, 0x1.8p3, a1, x2y);\n", **{**OFF, "mask_numbers": True})
    assert got.endswith("a1, x2y);\n") and got.count("<NUM>") == 7


def test_normal_form_is_a_fixed_point(spark):
    once = norm(spark, SOURCE, rename=False)
    assert norm(spark, once, rename=False) == once


def test_block_comment_keeps_length(spark):
    df = spark.createDataFrame([("a/*xy\nz*/b",)], "t string")
    assert df.select(T.blank_block_comments("t")).first()[0] == "a" + " " * 8 + "b"


def test_long_string_literal_no_stack_overflow(spark):
    big = '"' + "ab\\\"c" * 40000 + '"'
    df = spark.createDataFrame([(f"x = {big};",)], "t string")
    assert df.select(T.mask_strings("t")).first()[0] == "x = <STR>;"


def test_type_buckets(spark):
    df = spark.createDataFrame([(t,) for t in ["int", "java.lang.String", "char[]", "boolean", "Foo", "long[][]"]],
                               "t string")
    assert [r[0] for r in df.select(T.type_bucket("t")).collect()] == ["num", "str", "chr_arr", "bool", "obj",
                                                                      "num_arr"]


def test_slices(spark):
    df = spark.createDataFrame([("a\nb\nc\n", "1", "3", "-2", "9")], "t string, b string, e string, lb string, le string")
    r = df.select(L.slice_strict(L.split_lines("t"), "b", "e").alias("s"),
                  L.slice_strict(L.split_lines("t"), F.lit("x"), "e").alias("bad"),
                  L.slice_strict(L.split_lines("t"), "b", F.lit("4")).alias("past"),
                  L.slice_lenient(L.split_lines("t"), "lb", "le").alias("l"),
                  L.slice_strict(L.split_lines("t"), F.lit("2"), F.lit("1")).alias("rev"),
                  L.slice_lenient(L.split_lines("t"), F.lit("2"), F.lit("1")).alias("lrev"),
                  L.slice_strict(L.split_lines("t"), F.lit("-1"), F.lit("2")).alias("neg")).first()
    assert (r.s, r.bad, r.past, r.l) == ("b\nc\n", "", "", "b\nc\n")
    assert (r.rev, r.lrev, r.neg) == ("", "", "")  # begin > end, and a negative strict bound


def test_python_normalizer_failure_keeps_text(spark):
    from pairwright.operators.udf import normalizer

    def fragile(t):
        if "boom" in t:
            raise ValueError("cannot normalise")
        return t.upper()

    fn = normalizer(fragile)
    df = spark.createDataFrame([(1, "ok text"), (2, "boom here"), (3, ""), (4, None)], "id int, t string")
    got = {r.id: r.o for r in df.select("id", fn(F.col("t")).alias("o")).collect()}
    assert got == {1: "OK TEXT", 2: "boom here", 3: "", 4: None}


def test_empty_snippet_untouched(spark):
    df = spark.createDataFrame([(1, ""), (2, "  int x = 1; // c\n")], "snippet_id long, code string")
    got = {r.snippet_id: r.code for r in normalize_code(df).collect()}
    assert got == {1: "", 2: "int x = <NUM>;\n"}


def test_bucket_of_one_text(spark):
    types = ["int", "int[]", "java.lang.String", "a.b.CharSequence[][]", "List<String>", "double...", "x.", "char]", "boolean[", "[]", "", "void", "Map<K,V>[]"]
    rows = spark.createDataFrame([(t,) for t in types], "t string").select("t", T.type_bucket("t").alias("b")).collect()
    assert [(r.t, T.bucket_of(r.t)) for r in rows] == [(r.t, r.b) for r in rows]
