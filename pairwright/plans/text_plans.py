"""Queries for text normalisation, line slicing and snippet fetch."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.functions import lines as L
from pairwright.functions import text as T
from pairwright.operators import fetch
from pairwright.plans.registry import query, sql_lit
from pairwright.sources import fixtures as fx

# DuckDB (RE2) forms of the same rules: no look-around, no possessive
# quantifiers, ASCII \b and \d (test texts for the masks are ASCII).
WS = (r"[\t\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
      r"\x{202f}\x{205f}\x{3000}]")
WS_NL = WS[:-1] + r"\n]"
BLOCK_RE2 = r"/\*(?s:.*?)\*/"
STRING_RE2 = r"""(?s)"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'"""
NUMBER_RE2 = T.NUMBER_LITERAL.replace("(?U)", "")


def ws_sql(t: str) -> str:
    t = f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"
    t = f"replace({t}, chr(9), '    ')"
    t = f"regexp_replace({t}, '{WS}+(\\n|$)', '\\1', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    t = f"regexp_replace({t}, '^{WS_NL}+|{WS_NL}+$', '', 'g')"
    return f"(CASE WHEN {t} = '' THEN '' ELSE {t} || chr(10) END)"


def block_sql(t: str) -> str:
    blanks = f"list_transform(regexp_extract_all({t}, '{BLOCK_RE2}'), lambda m: repeat(' ', length(m)))"
    return (f"array_to_string(list_transform(string_split_regex({t}, '{BLOCK_RE2}'), "
            f"lambda p, i: p || coalesce({blanks}[i], '')), '')")


def line_sql(t: str) -> str:
    return f"regexp_replace({t}, '(?m)//.*?$', '', 'g')"


def strings_sql(t: str) -> str:
    return f"regexp_replace({t}, {sql_lit(STRING_RE2)}, '<STR>', 'g')"


def numbers_sql(t: str) -> str:
    return f"regexp_replace({t}, {sql_lit(NUMBER_RE2)}, '<NUM>', 'g')"


def lines_sql(t: str) -> str:
    return f"regexp_extract_all(regexp_replace({t}, '\\r\\n?', chr(10), 'g'), '[^\\n]*\\n|[^\\n]+$')"


def snip(fn):
    return lambda spark, d: fx.spark_snippets(spark, d).select("snippet_id", fn(F.col("code")).alias("code"))


def snip_sql(expr: str) -> str:
    return fx.sql_with(f"SELECT snippet_id, {expr} AS code FROM snippets", "snippets")


query("ws_normalize", snip_sql(ws_sql("code")))(snip(T.normalize_whitespace))
query("block_comments", snip_sql(block_sql("code")))(snip(T.blank_block_comments))
query("line_comments", snip_sql(line_sql(block_sql("code"))))(snip(T.remove_comments))
query("mask_strings", snip_sql(strings_sql("code")))(snip(T.mask_strings))
query("mask_numbers", snip_sql(numbers_sql("code")))(snip(T.mask_numbers))
query("normalize_text", snip_sql(ws_sql(numbers_sql(strings_sql(line_sql(block_sql(ws_sql("code"))))))))(
    snip(T.normalize_no_rename))


@query("ws_normalize_docs", f"SELECT doc_id, {ws_sql('text')} AS text FROM documents")
def q_ws_docs(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", T.normalize_whitespace("text").alias("text"))


# Type names built from part rows: element type by p_size, array depth by p_partkey.
# fixed values: test type names (a spread over every bucket of the rename rules)
TYPE_NAMES = ["int", "long", "short", "byte", "float", "double", "boolean", "char", "String",
              "CharSequence", "java.lang.String", "Object", "java.util.List<String>", "Integer"]


@query("type_bucket", f"""
SELECT p_partkey, type_name,
       CASE split_part(regexp_replace(type_name, '[\\[\\]]+$', ''), '.', -1)
         {' '.join(f"WHEN '{n}' THEN '{T.TYPE_PREFIX[n]}'" for n in T.TYPE_PREFIX)}
         ELSE 'obj' END || CASE WHEN suffix(type_name, '[]') THEN '_arr' ELSE '' END AS bucket
FROM (SELECT p_partkey,
             [{', '.join(sql_lit(n) for n in TYPE_NAMES)}][p_size % {len(TYPE_NAMES)} + 1]
             || repeat('[]', CAST(p_partkey % 3 AS INTEGER)) AS type_name FROM part)""")
def q_type_bucket(spark, d):
    p = fx.table(spark, d, "part")
    names = F.array(*[F.lit(n) for n in TYPE_NAMES])
    t = F.concat(F.element_at(names, (F.col("p_size") % len(TYPE_NAMES) + 1).cast("int")),
                 F.repeat(F.lit("[]"), (F.col("p_partkey") % 3).cast("int")))
    return p.select("p_partkey", t.alias("type_name")).withColumn("bucket", T.type_bucket("type_name"))


@query("split_lines", fx.sql_with(f"SELECT path, {lines_sql('text')} AS lines FROM files", "files"))
def q_split_lines(spark, d):
    return fetch.file_lines(fx.spark_files(spark, d))


# Ranges over every document: strict bounds partly beyond the end, lenient ones partly negative.
RANGES_SQL = """
SELECT path, CAST(n % 4 AS VARCHAR) AS b, CAST(n % 4 + 3 AS VARCHAR) AS e,
       CAST(n % 5 - 2 AS VARCHAR) AS lb, CAST(n % 5 + 2 AS VARCHAR) AS le, lines
FROM (SELECT path, length(path) + length(text) AS n, {lines} AS lines FROM files)"""


def _ranges(spark, d):
    f = fx.spark_files(spark, d)
    n = F.length("path") + F.length("text")
    return fetch.file_lines(f).join(f.select("path", n.alias("n")), "path").select(
        "path", (F.col("n") % 4).cast("string").alias("b"), (F.col("n") % 4 + 3).cast("string").alias("e"),
        (F.col("n") % 5 - 2).cast("string").alias("lb"), (F.col("n") % 5 + 2).cast("string").alias("le"),
        "lines")


def _strict_sql(lines, b, e):
    bb = f"coalesce(TRY_CAST({b} AS INTEGER), 0)"
    ee = f"CASE WHEN TRY_CAST({b} AS INTEGER) IS NULL THEN 0 ELSE coalesce(TRY_CAST({e} AS INTEGER), 0) END"
    bb = f"CASE WHEN TRY_CAST({e} AS INTEGER) IS NULL THEN 0 ELSE {bb} END"
    return (f"CASE WHEN {bb} >= 0 AND {ee} >= {bb} AND {ee} <= coalesce(len({lines}), 0) "
            f"THEN array_to_string(list_slice({lines}, {bb} + 1, {ee}), '') ELSE '' END")


def _clamp_sql(i, n):
    return f"(CASE WHEN {i} < 0 THEN greatest({i} + {n}, 0) ELSE least({i}, {n}) END)"


def _lenient_sql(lines, b, e):
    n = f"len({lines})"
    bb, ee = _clamp_sql(f"CAST({b} AS INTEGER)", n), _clamp_sql(f"CAST({e} AS INTEGER)", n)
    return f"CASE WHEN {ee} > {bb} THEN array_to_string(list_slice({lines}, {bb} + 1, {ee}), '') ELSE '' END"


@query("slice_strict", fx.sql_with(
    f"SELECT path, b, e, {_strict_sql('lines', 'b', 'e')} AS code FROM ({RANGES_SQL.format(lines=lines_sql('text'))})",
    "files"))
def q_slice_strict(spark, d):
    return _ranges(spark, d).select("path", "b", "e", L.slice_strict("lines", "b", "e").alias("code"))


@query("slice_lenient", fx.sql_with(
    f"SELECT path, lb, le, {_lenient_sql('lines', 'lb', 'le')} AS code "
    f"FROM ({RANGES_SQL.format(lines=lines_sql('text'))})", "files"))
def q_slice_lenient(spark, d):
    return _ranges(spark, d).select("path", "lb", "le", L.slice_lenient("lines", "lb", "le").alias("code"))


FETCH_SQL = """
SELECT p.row_pos, {c1} AS code1, {c2} AS code2, p.label
FROM pairs p
LEFT JOIN (SELECT path, {lines} AS lines FROM files) f1 ON f1.path = p.folder1 || '/' || p.file1
LEFT JOIN (SELECT path, {lines} AS lines FROM files) f2 ON f2.path = p.folder2 || '/' || p.file2"""


@query("fetch_pairs", fx.sql_with(FETCH_SQL.format(
    c1=_strict_sql("f1.lines", "p.begin1", "p.end1"), c2=_strict_sql("f2.lines", "p.begin2", "p.end2"),
    lines=lines_sql("text")), "pairs", "files"))
def q_fetch_pairs(spark, d):
    out = fetch.fetch_pairs(fx.spark_pairs(spark, d), fx.spark_files(spark, d))
    return out.select("row_pos", "code1", "code2", "label")


@query("fetch_lenient", fx.sql_with(FETCH_SQL.format(
    c1=_lenient_sql("coalesce(f1.lines, [])", "p.begin1", "p.end1"),
    c2=_lenient_sql("coalesce(f2.lines, [])", "p.begin2", "p.end2"),
    lines=lines_sql("text")), "pairs", "files"))
def q_fetch_lenient(spark, d):
    out = fetch.fetch_pairs(fx.spark_pairs(spark, d), fx.spark_files(spark, d), strict=False)
    return out.select("row_pos", "code1", "code2", "label")


@query("normalize_pairs", fx.sql_with(FETCH_SQL.format(
    c1=f"(CASE WHEN ({_strict_sql('f1.lines', 'p.begin1', 'p.end1')}) = '' THEN '' ELSE "
       + ws_sql(numbers_sql(strings_sql(line_sql(block_sql(ws_sql(_strict_sql('f1.lines', 'p.begin1', 'p.end1')))))))
       + " END)",
    c2=f"(CASE WHEN ({_strict_sql('f2.lines', 'p.begin2', 'p.end2')}) = '' THEN '' ELSE "
       + ws_sql(numbers_sql(strings_sql(line_sql(block_sql(ws_sql(_strict_sql('f2.lines', 'p.begin2', 'p.end2')))))))
       + " END)",
    lines=lines_sql("text")), "pairs", "files"))
def q_normalize_pairs(spark, d):
    out = fetch.fetch_pairs(fx.spark_pairs(spark, d), fx.spark_files(spark, d),
                            normalizer=T.normalize_no_rename)
    return out.select("row_pos", "code1", "code2", "label")


@query("decode_utf8", "SELECT doc_id, replace(text, chr(65533), '') AS text FROM documents")
def q_decode_utf8(spark, d):
    # Text -> UTF-8 bytes -> lenient decode (invalid sequences dropped)
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", L.decode_utf8_lenient(F.encode("text", "UTF-8")).alias("text"))


@query("normalize_pairs_renamed", fx.sql_with(FETCH_SQL.format(
    c1=f"(CASE WHEN ({_strict_sql('f1.lines', 'p.begin1', 'p.end1')}) = '' THEN '' ELSE "
       + ws_sql(numbers_sql(strings_sql(line_sql(block_sql(ws_sql(_strict_sql('f1.lines', 'p.begin1', 'p.end1')))))))
       + " END)",
    c2=f"(CASE WHEN ({_strict_sql('f2.lines', 'p.begin2', 'p.end2')}) = '' THEN '' ELSE "
       + ws_sql(numbers_sql(strings_sql(line_sql(block_sql(ws_sql(_strict_sql('f2.lines', 'p.begin2', 'p.end2')))))))
       + " END)",
    lines=lines_sql("text")), "pairs", "files"))
def q_normalize_pairs_renamed(spark, d):
    # T8 with the reference's default flags (renaming on); the documents hold
    # prose, so renaming finds no method and leaves the texts as masked
    out = fetch.fetch_pairs(fx.spark_pairs(spark, d), fx.spark_files(spark, d), normalize={})
    return out.select("row_pos", "code1", "code2", "label")
