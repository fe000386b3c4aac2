"""Each registered query over a whole test table, against brute force."""

import zlib

import brute
import pytest

from pairwright.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def rows(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_op1(spark, sf, docs):
    got = {r["doc_id"]: r for r in QUERIES["op1_toxicity"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_op1_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r["predicted"], labels[r["doc_id"]]) for r in QUERIES["op1_toxicity"](spark, sf).collect()
           if r["held_out"] and r["doc_id"] in labels]
    hit = sum(p and t for p, t in got)
    assert hit / sum(p for p, _ in got) > 0.9 and hit / sum(t for _, t in got) > 0.8


def test_op2(spark, sf, docs):
    assert rows(QUERIES["op2_substring_dedup"](spark, sf), "n_words", "n_removed", "kept_sha256") == brute.substring(list(docs.items()))


def test_op3(spark, sf, docs):
    fps = {d: brute.simhash(t) for d, t in docs.items()}
    comp = brute.components(fps)
    assert rows(QUERIES["op3_simhash"](spark, sf), "fingerprint", "component_id") == {d: (f"{fps[d]:016x}", comp[d]) for d in docs}


def test_op4(spark, sf, docs):
    import base64

    import public_tokenizers as P
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in docs.items():
        ids = enc.encode_ordinary(t or "")
        want[d] = (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or ""))
    assert rows(QUERIES["op4_bpe"](spark, sf), "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op5(spark, sf, docs):
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, at = {}, 0
    for d in sorted(docs):
        ids = [*t.encode(docs[d] or "", add_special_tokens=False).ids, 0]
        want[d] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert rows(QUERIES["op5_token_output"](spark, sf), "start", "n_tokens", "ids_crc32") == want


def test_op6(spark, sf, docs):
    got = rows(QUERIES["op6_quality"](spark, sf), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {d: brute.quality(t) for d, t in docs.items()}


def test_op7(spark, sf, docs):
    from pairwright.llm import packing
    got = QUERIES["op7_packing"](spark, sf).toPandas()
    assert dict(zip(got["doc_id"], got["length"])) == {d: len(brute.WORD.findall(t or "")) + 1 for d, t in docs.items()}
    for (_, up), g in got.groupby(["bucket", "bucket_len"]):
        per = max(1, packing.BUDGET // up)
        sizes = g.groupby("batch").size()
        assert (g["length"] <= up).all() and (g["pad"] == up - g["length"]).all()
        assert (sizes.iloc[:-1] == per).all() and sizes.iloc[-1] <= per
        assert list(sizes.index) == list(range(len(sizes))) and not g.duplicated(["batch", "slot"]).any()
    assert got["bucket"].nunique() <= packing.BUCKETS


def test_op8(spark, sf):
    import numpy as np
    vecs = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(vecs["embedding"]).astype(float)
    ids, hit, n = vecs["vec_id"].to_numpy(), 0, 0
    got = QUERIES["op8_neighbours"](spark, sf).toPandas()
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        best = [j for j in np.lexsort((ids, -s)) if j != i][:20]
        own = got[got["query_id"] == ids[i]].sort_values("rank")
        assert list(own["rank"]) == list(range(1, len(best) + 1))
        by = dict(zip(ids, s))
        assert all(abs(by[v] - sc) < 1e-12 for v, sc in zip(own["vec_id"], own["score"]))
        hit, n = hit + len(set(own["vec_id"]) & set(ids[best])), n + len(best)
    assert hit / n >= 0.9


def test_op9(spark, sf, docs):
    assert rows(QUERIES["op9_line_dedup"](spark, sf), "n_lines", "n_dropped", "kept_sha256") == brute.lines(list(docs.items()))


def test_op10(spark, sf):
    from pairwright.llm import chat
    turns = spark.read.parquet(f"{sf}/conversations.parquet").toPandas()
    got = QUERIES["op10_chat"](spark, sf).toPandas()
    assert len(got) == len(turns)
    for conv, g in turns.groupby("conv_id"):
        g = g.sort_values(["turn", "role", "text"])
        own = got[got["conv_id"] == conv].sort_values("pos")
        assert list(own["role"]) == list(g["role"])
        assert own["cost"].sum() == brute.chat_cost([chat.role_of(r) for r in g["role"]]) if len(g) < 7 else True
        text = "".join(own["piece"])
        heads = [p.split("|>")[0] for p in text.split("<|")[1:] if not p.startswith("end")]
        rest = heads[1:] if heads[0] == "system" else heads
        assert rest == ["user", "assistant"] * (len(rest) // 2)


def test_pipeline(spark, sf, docs):
    """The stages that have a plain form, on the rows that reach them."""
    import corpus_pipeline as C
    from pairwright.llm.common import staged, table
    cur, stages = table(spark, sf, "documents"), dict(C.STAGES)
    cols = cur.columns
    kept = staged(stages["toxicity"](spark, cur, sf), "t")
    bad = {r["doc_id"] for r in QUERIES["op1_toxicity"](spark, sf).filter("predicted = 1").collect()}
    assert kept.columns == cols and {r["doc_id"] for r in kept.collect()} == docs.keys() - bad
    lines = staged(stages["line_dedup"](spark, kept, sf), "l")
    before, after = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (kept, lines))
    want = brute.lines(list(before.items()))
    assert lines.columns == cols and {d: brute.sha(t or "") for d, t in after.items()} == {d: w[2] for d, w in want.items()}
    near = staged(stages["simhash"](spark, lines, sf), "n")
    comp = brute.components({d: brute.simhash(t) for d, t in after.items()})
    one = {r["doc_id"]: r["text"] for r in near.collect()}
    assert near.columns == cols and one == {d: after[d] for d in set(comp.values())}
    sub = staged(stages["substring_dedup"](spark, near, sf), "s")
    left = {r["doc_id"]: r["text"] for r in sub.collect()}
    for d, (_, n, digest) in brute.substring(list(one.items())).items():
        assert left[d] == one[d] if not n else brute.sha(left[d]) == digest
    packed = stages["packing"](spark, sub, sf).toPandas()
    assert sorted(packed["doc_id"]) == sorted(left)
    assert C.run(spark, sf).count() == len(left)


def test_op7_padding_is_least(spark, sf, docs):
    """The query's whole padding against a plain dynamic program over all bucket bounds."""
    from collections import Counter

    from pairwright.llm import packing
    hist = Counter(len((t or "").encode().split()) + 1 for t in docs.values())
    lengths = sorted(hist)
    best = {0: 0}  # lengths covered -> least padding with the buckets so far
    for _ in range(packing.BUCKETS):
        new = dict(best)
        for i, cost in best.items():
            pad = 0
            for j in range(i, len(lengths)):
                pad = sum(hist[x] * (lengths[j] - x) for x in lengths[i:j + 1])
                new[j + 1] = min(new.get(j + 1, cost + pad), cost + pad)
        best = new
    assert sum(r["pad"] for r in QUERIES["op7_packing"](spark, sf).collect()) == best[len(lengths)]


def test_op11_sql(spark, sf):
    """The SQL form gives the query's rows."""
    import duckdb
    from pairwright.llm.queries import ORACLES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    out = con.execute(ORACLES["op11_prefix_trie"])
    names = [c[0] for c in out.description]
    want = sorted(out.fetchall())
    assert sorted(tuple(r[c] for c in names) for r in QUERIES["op11_prefix_trie"](spark, sf).collect()) == want
