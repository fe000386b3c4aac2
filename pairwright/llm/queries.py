"""The registered queries of this subpackage (production parameters, whole tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import (ann, binpack, bpe, chat, linededup, packing, quality, runs, simhash, substring, tokenbin,
                            toxicity, trie)
from pairwright.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


@query("op1_toxicity")
def op1(spark: SparkSession, d: str) -> DataFrame:
    out = toxicity.fit_and_score(table(spark, d, "documents"), table(spark, d, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "n_hits")


@query("op2_substring_dedup")
def op2(spark, d):
    out = substring.substring_dedup(table(spark, d, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_simhash")
def op3(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


@query("op4_bpe")
def op4(spark, d):
    import public_tokenizers
    return bpe.encode_digest(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_token_output")
def op5(spark, d):
    import public_tokenizers
    return tokenbin.round_trip(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, len(words) AS n,
         [array_to_string(words[i:i + 4], chr(10)) for i in range(1, greatest(len(words) - 3, 1))] AS grams FROM w),
p AS (SELECT doc_id, unnest(grams) AS g, unnest(range(1, len(grams) + 1)) AS i FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p),
s AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS gap FROM r WHERE c > 1),
q AS (SELECT doc_id, sum(gap) AS n_repeat_words FROM s GROUP BY doc_id),
m AS (
  SELECT w.doc_id, text, lines, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters
  FROM w LEFT JOIN q USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.1 * n_words
            OR length(regexp_replace(text, '[^!]+', '', 'g')) > 0.1 * n_words
            OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR n_dup_lines > 0.3 * len(lines)
            OR length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > 0.4 * letters
            OR letters < 0.6 * word_chars
            OR len(list_filter(string_split(text, chr(10)), lambda x: suffix(x, '...') OR suffix(x, '…'))) > 0.3 * len(lines)) AS kept
FROM f"""


@query("op6_quality", OP6_SQL)
def op6(spark, d):
    return quality.judge(table(spark, d, "documents"))


@query("op7_packing")
def op7(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


@query("op8_neighbours")
def op8(spark, d):
    return ann.search(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op9_line_dedup", r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
a AS (SELECT key, max(doc_id) AS m FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, coalesce(a.m <> k.doc_id, false) AS gone FROM k LEFT JOIN a USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""")
def op9(spark, d):
    out = linededup.line_dedup(table(spark, d, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op10_chat")
def op10(spark, d):
    return chat.format_chats(table(spark, d, "conversations"))


OP11_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                         lambda c, b: list_reduce(CAST(range(8) AS BIGINT[]), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)),
                         CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
k AS (SELECT c.*, (SELECT count(*) FROM t WHERE t.conv_id = c.base AND t.pos < c.h) AS taken FROM c),
r AS (
  SELECT k.conv_id, pos + 1 AS depth, role, text FROM k JOIN t ON t.conv_id = k.base AND t.pos < k.h
  UNION ALL SELECT k.conv_id, pos - h + taken + 1, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos >= k.h),
p AS (
  SELECT conv_id, depth, strlen(text) AS size,
         md5(string_agg(md5(concat(strlen(role), ':', role, text)), ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS key
  FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM k),
q AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS up, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, any_value(up) AS up,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM q GROUP BY depth, key),
m AS (SELECT n.*, (SELECT count(*) FROM n AS x WHERE x.depth = n.depth + 1 AND x.up = n.key) AS n_children FROM n),
s AS (
  SELECT q.depth, q.key, count(*) FILTER (WHERE m.n_children = 0) AS n_leaves, CAST(sum((m.n_convs - 1) * m.size) AS BIGINT) AS saved_tokens
  FROM m JOIN q ON q.conv_id = m.conv_id AND q.depth <= m.depth GROUP BY q.depth, q.key)
SELECT m.conv_id, m.depth, x.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s USING (depth, key) LEFT JOIN n AS x ON x.depth = m.depth - 1 AND x.key = m.up"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark, d):
    return trie.prefix_trie(*trie.rebuild(trie.encode_turns(table(spark, d, "conversations"))))


@query("op12_periodic_runs")
def op12(spark, d):
    found = runs.collapse(runs.repeat_tails(table(spark, d, "documents")))
    best = runs.longest_run(F.col("runs"))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
                        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
                        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


@query("op13_best_fit")
def op13(spark, d):
    import public_tokenizers
    return binpack.pack_documents(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
