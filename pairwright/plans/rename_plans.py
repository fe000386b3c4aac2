"""Queries for identifier renaming (I1-I8, T7 with renaming on).

The input is one Java-like method per order, typed by the order status; the
oracle builds the expected renamed text with the same template and the
numbering rule written out per type bucket.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.operators import rename
from pairwright.operators.normalize import normalize_code
from pairwright.plans.registry import query, sql_lit
from pairwright.session import stage
from pairwright.sources import fixtures as fx

# Template pieces (fixed test input); {T} type, {p} parameter, {n} count, {t} local, {i} loop variable.
TEMPLATE = ["class O", "K", " {\n  ", "T", " m", "K", "(", "T", " ", "p", ", long ", "n", ") {\n    ",
            "T", " ", "t", " = ", "p", ";\n    for (int ", "i", " = 0; ", "i", " < ", "n", "; ", "i",
            "++) {\n      System.out.println(", "t", ");\n    }\n    return ", "t", ";\n  }\n}\n"]
TYPE_OF_STATUS = {"F": "String", "O": "int", "P": "double[]"}


def _spark_parts(renamed: bool):
    k = F.col("o_orderkey").cast("string")
    t = F.when(F.col("o_orderstatus") == "F", "String").when(F.col("o_orderstatus") == "O", "int").otherwise("double[]")
    b = F.when(F.col("o_orderstatus") == "F", "str").when(F.col("o_orderstatus") == "O", "num").otherwise("num_arr")
    num = F.col("o_orderstatus") == "O"
    names = {"p": F.concat(F.lit("p"), F.col("o_custkey").cast("string")), "n": F.concat(F.lit("n"), k),
             "t": F.concat(F.lit("t"), k), "i": F.lit("i")}
    if renamed:
        names = {"p": F.concat(b, F.lit("1")), "n": F.when(num, "num2").otherwise("num1"),
                 "t": F.concat(b, F.when(num, "3").otherwise("2")), "i": F.when(num, "num4").otherwise("num2")}
    sub = {"K": k, "T": t, **names}
    return F.concat(*[sub.get(x, F.lit(x)) for x in TEMPLATE])


def _sql_parts(renamed: bool) -> str:
    k = "CAST(o_orderkey AS VARCHAR)"
    t = "CASE o_orderstatus WHEN 'F' THEN 'String' WHEN 'O' THEN 'int' ELSE 'double[]' END"
    b = "CASE o_orderstatus WHEN 'F' THEN 'str' WHEN 'O' THEN 'num' ELSE 'num_arr' END"
    names = {"p": "('p' || CAST(o_custkey AS VARCHAR))", "n": f"('n' || {k})", "t": f"('t' || {k})", "i": "'i'"}
    if renamed:
        names = {"p": f"({b} || '1')",
                 "n": "CASE WHEN o_orderstatus = 'O' THEN 'num2' ELSE 'num1' END",
                 "t": f"({b} || CASE WHEN o_orderstatus = 'O' THEN '3' ELSE '2' END)",
                 "i": "CASE WHEN o_orderstatus = 'O' THEN 'num4' ELSE 'num2' END"}
    sub = {"K": k, "T": t, **names}
    return "concat(" + ", ".join(sub.get(x, sql_lit(x)) for x in TEMPLATE) + ")"


def method_snippets(spark, d, cut: str | None = None):
    code = _spark_parts(False)
    if cut:
        code = F.regexp_replace(code, cut, "")
    return fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("snippet_id"), code.alias("code"))


@query("rename_identifiers", f"SELECT o_orderkey AS snippet_id, {_sql_parts(True)} AS code, true AS renamed FROM orders")
def q_rename(spark, d):
    return rename.rename_identifiers(method_snippets(spark, d))


@query("rename_fallback", f"""
SELECT o_orderkey AS snippet_id, regexp_replace({_sql_parts(False)}, '\\}}\n[ ]*\\}}\n$', '') AS code, false AS renamed
FROM orders""")
def q_rename_fallback(spark, d):
    # cut before the method's closing brace: no method is whole, so nothing changes
    return rename.rename_identifiers(method_snippets(spark, d, cut=r"\}\n *\}\n\z"))


@query("number_declarations", """
SELECT o_orderkey AS snippet_id, name, new_name FROM (
  SELECT o_orderkey, 'p' || CAST(o_custkey AS VARCHAR) AS name,
         CASE o_orderstatus WHEN 'F' THEN 'str1' WHEN 'O' THEN 'num1' ELSE 'num_arr1' END AS new_name FROM orders
  UNION ALL SELECT o_orderkey, 'n' || CAST(o_orderkey AS VARCHAR),
         CASE WHEN o_orderstatus = 'O' THEN 'num2' ELSE 'num1' END FROM orders
  UNION ALL SELECT o_orderkey, 't' || CAST(o_orderkey AS VARCHAR),
         CASE o_orderstatus WHEN 'F' THEN 'str2' WHEN 'O' THEN 'num3' ELSE 'num_arr2' END FROM orders
  UNION ALL SELECT o_orderkey, 'i', CASE WHEN o_orderstatus = 'O' THEN 'num4' ELSE 'num2' END FROM orders)""")
def q_number_declarations(spark, d):
    snippets = method_snippets(spark, d)
    n = rename.token_partitions(snippets)
    sig = stage(rename.snippet_tokens(snippets, partitions=n, declared=True), "tokens")
    m = rename.scope_mappings(rename.declarations(sig, stage(rename.scope_spans(sig, n), "scopes"), n), n)
    return m.select(F.col("sid").alias("snippet_id"), "name", "new_name")


TOKEN_RE2 = (r'''(?s)//[^\n]*|/\*.*?\*/|"""[^"\\]*(?:"{0,2}\\.[^"\\]*|"{1,2}[^"\\][^"\\]*)*"""|"(?:[^"\\]|\\.)*"|'''
             r"""'(?:[^'\\]|\\.)*'|[\pL_$][\pL\pN_$]*|\d[\pL\pN_.]*|\s+|\.\.\.|->|::|.""")


@query("token_table", fx.sql_with(f"""
SELECT snippet_id, unnest(range(len(toks))) AS pos, unnest(toks) AS tok
FROM (SELECT snippet_id, regexp_extract_all(code, {sql_lit(TOKEN_RE2)}) AS toks FROM snippets)""", "snippets"))
def q_token_table(spark, d):
    t = rename.token_table(fx.spark_snippets(spark, d))
    return t.select(F.col("sid").alias("snippet_id"), F.col("pos").cast("long").alias("pos"), "tok")


# One class per order in one of these shapes, with the text expected (#K: the order key).
SHAPES = [
    ("class C#K { boolean f#K(int a#K, int b) { boolean c = false; c = a#K > b; return c; } }",
     "class C#K { boolean f#K(int num1, int num2) { boolean bool1 = false; bool1 = num1 > num2; return bool1; } }"),
    ("class S#K { int g(int h#K, long k) { h#K = h#K >>> k; return h#K; } }",
     "class S#K { int g(int num1, long num2) { num1 = num1 >>> num2; return num1; } }"),
    ("class R#K { int g(int lo, int hi#K) { int s = 0; for (int i = hi#K; i > lo; i--) { s += i; } return s; } }",
     "class R#K { int g(int num1, int num2) { int num3 = 0; for (int num4 = num2; num4 > num1; num4--) { num3 += num4; } return num3; } }"),
    ("class N#K { int f(int p#K) { return p#K; } static class In { String f(String p#K) { String q = p#K; return q; } } }",
     "class N#K { int f(int num1) { return num1; } static class In { String f(String str1) { String str2 = str1; return str2; } } }"),
    ("class G#K { int f(Map<String, List<Integer>> m#K) { List<Integer> v = m#K.get(\"x\"); for (Integer e : v) { use(e); } return v.size(); } }",
     "class G#K { int f(Map<String, List<Integer>> obj1) { List<Integer> obj2 = obj1.get(\"x\"); for (Integer obj3 : obj2) { use(obj3); } return obj2.size(); } }"),
    ("class K#K { // a { is \" open\n  int f(int a, int b#K) { /* a > b#K; } */ return a - b#K; }\n}",
     "class K#K { // a { is \" open\n  int f(int num1, int num2) { /* a > b#K; } */ return num1 - num2; }\n}"),
    ("class A#K { Runnable f(int n#K) { Runnable r = new Runnable() { int cnt#K = 0; public void run() { int d = n#K; cnt#K += d; } }; return r; } }",
     "class A#K { Runnable f(int num1) { Runnable obj1 = new Runnable() { int cnt#K = 0; public void run() { int num2 = num1; cnt#K += num2; } }; return obj1; } }"),
    ("class D#K { int f(int z) { @Deprecated int k#K = z; @SuppressWarnings(\"x\") List<String> s = t(k#K); return k#K; } }",
     "class D#K { int f(int num1) { @Deprecated int num2 = num1; @SuppressWarnings(\"x\") List<String> obj1 = t(num2); return num2; } }"),
    ("class W#K { int f(int k#K) { switch (k#K) { case 1: int a = k#K; return a; default: String s#K = \"x\"; return s#K.length(); } } }",
     "class W#K { int f(int num1) { switch (num1) { case 1: int num2 = num1; return num2; default: String str1 = \"x\"; return str1.length(); } } }"),
    ("class I#K { int f(int n#K) { int[] q = {1, n#K}, r = {3}; Runnable a = new Runnable() { public void run() { use(n#K); } }, b = a; b.run(); return r[0] + q[1]; } }",
     "class I#K { int f(int num1) { int[] num_arr1 = {1, num1}, num_arr2 = {3}; Runnable obj1 = new Runnable() { public void run() { use(num1); } }, obj2 = obj1; "
     "obj2.run(); return num_arr2[0] + num_arr1[1]; } }"),
    ("class P#K { int f(P#K this, int p#K) { @A(x = 1) List<String> l#K = of(p#K); return l#K.size() + p#K; } }",
     "class P#K { int f(P#K this, int num1) { @A(x = 1) List<String> obj1 = of(num1); return obj1.size() + num1; } }"),
    ("class T#K { String f(int n#K) { String t = \"\"\"\n { \"( #K\n \"\"\"; return t + n#K; } }",
     "class T#K { String f(int num1) { String str1 = \"\"\"\n { \"( #K\n \"\"\"; return str1 + num1; } }"),
]

# Snippets that begin or end inside a class, a method or a bracket pair, with the text expected: the methods that are whole are renamed.
CUT = [
    ("int u#K = 0; return u#K; } void f(int p#K) { int q = p#K; use(q); } }", "int u#K = 0; return u#K; } void f(int num1) { int num2 = num1; use(num2); } }"),
    ("class C#K { void f(int p#K) { int q = p#K; } void g(", "class C#K { void f(int num1) { int num2 = num1; } void g("),
    ("class C#K { void f(int p#K) { int q = p#K; } void g(int z#K) { int y = z#K;", "class C#K { void f(int num1) { int num2 = num1; } void g(int z#K) { int y = z#K;"),
    ("class C#K { void f(int p#K) { use((p#K; } void g(int z#K) { use(z#K); } }", "class C#K { void f(int p#K) { use((p#K; } void g(int num1) { use(num1); } }"),
    ("class C#K { void f(int p#K) { int q = p#K;", None),
]


@query("rename_shapes", f"""
SELECT o_orderkey AS snippet_id, true AS renamed, replace([{', '.join(sql_lit(out) for _, out in SHAPES)}]
       [(o_custkey % {len(SHAPES)}) + 1], '#K', CAST(o_orderkey AS VARCHAR)) AS code FROM orders""")
def q_rename_shapes(spark, d):
    # an order without a customer names no shape: the text that Spark's element_at gives it stays as it is
    shapes = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("snippet_id"), _template_of(SHAPES).alias("code"), "o_custkey")
    named, others = shapes.filter("o_custkey is not null").drop("o_custkey"), shapes.filter("o_custkey is null").drop("o_custkey")
    return rename.rename_identifiers(named).unionByName(others.withColumn("renamed", F.lit(False)))


def _template_of(rows):
    return F.replace(F.element_at(F.array(*[F.lit(src) for src, _ in rows]), (F.col("o_custkey") % len(rows)).cast("int") + 1),
                     F.lit("#K"), F.col("o_orderkey").cast("string"))


@query("rename_cut", f"""
SELECT o_orderkey AS snippet_id, i < {len(CUT)} AS renamed,
       replace([{', '.join(sql_lit(out or src) for src, out in CUT)}][i], '#K', CAST(o_orderkey AS VARCHAR)) AS code
FROM (SELECT o_orderkey, (o_custkey % {len(CUT)}) + 1 AS i FROM orders)""")
def q_rename_cut(spark, d):
    return rename.rename_identifiers(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("snippet_id"), _template_of(CUT).alias("code")))


@query("normalize_renamed", f"""
SELECT o_orderkey AS snippet_id,
       regexp_replace({_sql_parts(True)}, '\\b0\\b', '<NUM>', 'g') AS code FROM orders""")
def q_normalize_renamed(spark, d):
    return normalize_code(method_snippets(spark, d))


@query("occurrence_match", f"""
SELECT snippet_id, pos,
       CASE WHEN tok = 'i' THEN CASE WHEN o_orderstatus = 'O' THEN 'num4' ELSE 'num2' END
            WHEN tok = 'p' || CAST(o_custkey AS VARCHAR)
              THEN CASE o_orderstatus WHEN 'F' THEN 'str1' WHEN 'O' THEN 'num1' ELSE 'num_arr1' END
            WHEN tok = 'n' || CAST(snippet_id AS VARCHAR) THEN CASE WHEN o_orderstatus = 'O' THEN 'num2' ELSE 'num1' END
            ELSE CASE o_orderstatus WHEN 'F' THEN 'str2' WHEN 'O' THEN 'num3' ELSE 'num_arr2' END END AS new_name
FROM (SELECT o_orderkey AS snippet_id, o_orderstatus, o_custkey,
             unnest(range(len(toks))) AS pos, unnest(toks) AS tok
      FROM (SELECT *, regexp_extract_all({_sql_parts(False)}, {sql_lit(TOKEN_RE2)}) AS toks FROM orders))
WHERE tok IN ('i', 'p' || CAST(o_custkey AS VARCHAR), 'n' || CAST(snippet_id AS VARCHAR),
              't' || CAST(snippet_id AS VARCHAR))""")
def q_occurrence_match(spark, d):
    # Every use of a declared name inside its method, with the new name
    snippets = method_snippets(spark, d)
    n = rename.token_partitions(snippets)
    sig = stage(rename.snippet_tokens(snippets, partitions=n, declared=True), "tokens")
    scopes = stage(rename.scope_spans(sig, n), "scopes")
    maps = stage(rename.scope_mappings(rename.declarations(sig, scopes, n), n), "mappings")
    reps = rename.replacements(sig, scopes, maps, n)
    return reps.select(F.col("sid").alias("snippet_id"), F.col("pos").cast("long").alias("pos"), "new_name")


@query("apply_renames", fx.sql_with("SELECT snippet_id, code, false AS renamed FROM snippets", "snippets"))
def q_apply_renames(spark, d):
    # Texts without a method keep every token (class bodies with fields only)
    return rename.rename_identifiers(fx.spark_snippets(spark, d))


@query("scope_spans", f"""
SELECT snippet_id, CAST(list_position(toks, 'm' || CAST(snippet_id AS VARCHAR)) - 1 AS INTEGER) AS lo,
       CAST(list_filter(range(len(toks)), lambda i: toks[i + 1] = '}}')[-2] AS INTEGER) AS hi, CAST(1 AS BIGINT) AS depth
FROM (SELECT o_orderkey AS snippet_id, regexp_extract_all({_sql_parts(False)}, {sql_lit(TOKEN_RE2)}) AS toks FROM orders)""")
def q_scope_spans(spark, d):
    # Method span = from the method name to its body's closing brace (token positions)
    snippets = method_snippets(spark, d)
    n = rename.token_partitions(snippets)
    return rename.scope_spans(rename.snippet_tokens(snippets, partitions=n, declared=True), n).select(F.col("sid").alias("snippet_id"), "lo", "hi", "depth")
