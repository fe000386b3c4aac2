"""Large ids beside a null id in one batch, in every operator: no id changes, no rows are mixed up."""

import time

import brute
import numpy as np
import pytest

from pairwright.llm import binpack, bpe, chat, linededup, packing, runs, simhash, substring, tokenbin, toxicity, trie

BIG = [(1 << 60) + i for i in range(1, 9)]
IDS = [None, *BIG]
LINE = "A line that nine documents hold and that is long enough"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{LINE}\nown words of {k} and {k * k} here") for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).cache()


def ids(df, c="doc_id"):
    return sorted([r[c] for r in df.collect()], key=str)


def test_documents(docs):
    import public_tokenizers as P
    want = sorted(IDS, key=str)
    path = P.path("byte_bpe_50k.json")
    assert ids(toxicity.score(docs, toxicity.ToxicityModel({}))) == want
    assert ids(substring.substring_dedup(docs)) == want
    assert ids(simhash.near_duplicates(docs)) == want
    assert ids(bpe.encode_digest(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)) == want
    assert ids(bpe.encode_decode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)) == want
    assert ids(tokenbin.round_trip(docs, path)) == want
    assert ids(packing.pack_documents(docs)) == want
    assert ids(binpack.pack_documents(docs, path)) == want
    assert ids(runs.collapse(docs)) == want


def test_line_dedup(docs):
    got = linededup.line_dedup(docs, shards=1).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {i: int(i != BIG[-1]) for i in IDS}


@pytest.mark.parametrize("block", [1, 64])
def test_chat(spark, block):
    rows = [(c, t, role, f"{c} {t}") for c in IDS for t, role in ((None, "system"), (1 << 60, "user"), ((1 << 60) + 1, "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = chat.format_chats(df, block=block).collect()
    assert sorted(((r["conv_id"], r["turn"]) for r in got), key=str) == sorted(((c, t) for c, t, _, _ in rows), key=str)
    for r in got:
        assert f"{r['conv_id']} {r['turn']}" in r["piece"]


def test_trie(spark):
    rows = [(c, t, "user", "x") for c in IDS for t in (None, 1 << 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = trie.prefix_trie(*trie.rebuild(trie.encode_turns(df))).collect()
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got} == brute.prefix_trie(brute.rebuilt(rows))


def test_words_that_polynomials_confuse(spark):
    """Thue-Morse words collide modulo 2**64 whatever the base; they are different words."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(10))
    docs = [(1, f"{rest} {word} {rest}"), (2, f"{rest} {other} {rest}"), (3, f"{rest} {word} {rest} end")]
    got = substring.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["kept"])) for r in got.collect()} == brute.substring(docs)


def test_exception_phrases_in_linear_time():
    model = toxicity.ToxicityModel({" scum ": 2.0, " pond": 1.0}, ["pond scum"])
    a = model.automaton()
    folded = toxicity.fold("pond scum " * 80_000 + "scum")
    began = time.perf_counter()
    assert model.weigh(a, folded) == (2.0, 1) and time.perf_counter() - began < 3


def test_score_by_hand():
    """The score against its definition: every term looked for at every place, phrases found by search."""
    rng = np.random.default_rng(4)
    model = toxicity.ToxicityModel({" bad ": 2.5, " nast": 3.0, " ugiy ": 2.0}, ["not bad", "bad iuck"], (-1.0, 0.7, 0.4))
    a = model.automaton()
    for _ in range(200):
        folded = toxicity.fold(" ".join(rng.choice(["bad", "not", "nasty", "n4sty", "ugly", "luck", "fine", "bаd"], int(rng.integers(0, 15)))))
        spans = [(i, i + len(p) + 2) for p in model.exceptions for i in range(len(folded)) if folded.startswith(f" {p} ", i)]
        hits = [w for t, w in model.terms.items() for i in range(len(folded)) if folded.startswith(t, i)
                and not any(s <= i and i + len(t) <= e for s, e in spans)]
        total, n = sum(hits), max(1, len(folded.split()))
        z = -1.0 + 0.7 * np.log1p(total) + 0.4 * np.log1p(100 * total / n)
        got = model.weigh(a, folded)
        assert got[1] == len(hits) and abs(got[0] - total) < 1e-9
        assert abs(model.probability(model.features(got[0], folded)) - 1 / (1 + np.exp(-z))) < 1e-9


