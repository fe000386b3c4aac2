"""op12: runs against their definition, on random words and on a whole table; edge cases."""

import random

import brute
import numpy as np
import pytest

from pairwright.llm import runs
from pairwright.llm.queries import QUERIES
from pairwright.llm.wavelet import WaveletMatrix

COLS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 300):
        v = rng.permutation(n)
        w = WaveletMatrix(v)
        lo = rng.integers(0, n, 200)
        hi = np.minimum(n, lo + rng.integers(1, n + 1, 200))
        x = v[rng.integers(lo, hi)]
        prev, after = w.neighbours(lo, hi, x)
        for a, b, y, p, q in zip(lo, hi, x, prev, after, strict=True):
            own = v[a:b]
            assert p == max(own[own < y], default=-1) and q == min(own[own > y], default=-1)


def test_runs_by_definition():
    rng = random.Random(11)
    for _ in range(300):
        docs = []
        for _ in range(rng.randrange(1, 6)):
            n, k = rng.choice([0, 1, 5, 6, 8, 24, 60, 130]), rng.choice([1, 2, 3, 40])
            ws = [b"w%d" % rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // (3 + rng.randrange(8))
                ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
            docs.append(ws)
        for ws, (s, n, q, text) in zip(docs, runs._batch(docs, 4, 6), strict=True):
            want = brute.runs(ws)
            assert [(int(a), int(b), int(c)) for a, b, c in zip(s, n, q, strict=True)] == want
            gone = {i for a, b, c in want for i in range(a + c, a + b)}
            assert text == b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()


def test_op12(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLS) for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert got == {r["doc_id"]: brute.run_row(r["doc_id"], r["text"]) for r in docs}


def test_runs_odd(odd, none, spark):
    got = runs.collapse(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert [tuple(x) for x in by[4]["runs"]] == [(0, 30_000, 977)] and len(by[4]["text"].split()) == 977
    assert [tuple(x) for x in by[9]["runs"]] == [(0, 30_000, 977)] and by[9]["text"].endswith(" tail")
    assert [tuple(x) for x in by[7]["runs"]] == [(0, 25, 1)] and by[7]["text"] == "x"
    assert by[1]["runs"] == by[2]["runs"] == [] and by[1]["text"] == by[2]["text"] == ""
    assert runs.collapse(none).count() == 0
    one = spark.createDataFrame([(None, "a b"), *(((1 << 60) + i, "a " * 8) for i in range(8))], "doc_id long, text string")
    assert {r["doc_id"] for r in runs.collapse(one.coalesce(1)).collect()} == {None, *((1 << 60) + i for i in range(8))}
    assert runs.collapse(one, batch_words=1).count() == 9


def test_planted_tails_keep_the_rest(odd):
    """Texts that are not chosen, and texts without words, stay as they are."""
    before = {r["doc_id"]: r["text"] for r in odd.filter("doc_id is not null").collect()}
    for r in runs.repeat_tails(odd.filter("doc_id is not null")).collect():
        want = b" ".join(brute.repeated_tail(r["doc_id"], (before[r["doc_id"]] or "").encode().split())).decode()
        assert " ".join((r["text"]).split()) == want


def test_fewer_periods_are_refused(odd):
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(9, np.int64), 9, 3)
