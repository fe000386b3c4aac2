"""op13: sequences filled without gaps or overflow, ids as the library gives them, bounds that hold."""

import zlib

import numpy as np
import pytest

from pairwright.llm import binpack
from pairwright.llm.queries import QUERIES


def best(lengths, capacity):
    """Fewest bins, by trying all placements."""
    lengths, least = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, bins):
        if len(bins) >= least[0]:
            return
        if i == len(lengths):
            least[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + lengths[i] <= capacity}.values():
            go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1:]])
        go(i + 1, [*bins, lengths[i]])
    go(0, [])
    return least[0]


def test_bound_and_best_fit():
    rng = np.random.default_rng(5)
    for _ in range(300):
        capacity = int(rng.choice([10, 30, 100]))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 9)))
        bins, offsets, fills = binpack.best_fit_decreasing(lengths, capacity)
        least = best(lengths.tolist(), capacity)
        assert binpack.lower_bound(lengths, capacity) <= least <= len(fills)
        for k, fill in enumerate(fills):
            own = sorted(zip(offsets[bins == k], lengths[bins == k], strict=True))
            assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])][:-1] and sum(n for _, n in own) == fill <= capacity


def test_bound_beats_the_sum():
    assert binpack.lower_bound(np.array([600] * 5)) == 5  # by sum: 3
    assert binpack.lower_bound(np.array([400] * 6)) == 3
    assert binpack.lower_bound(np.array([], np.int64)) == 0


def whole(rows, capacity=1024):
    """Every document's pieces in order, every sequence gapless; the number of sequences."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at and n > 0
            at += n
        assert at <= capacity
    for own in docs.values():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])][:-1]
        assert all(r["length"] == capacity for r in own[1:])
    return docs, len(seqs)


def test_op13(spark, sf):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs, n = whole(QUERIES["op13_best_fit"](spark, sf).collect())
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert docs.keys() == {r["doc_id"] for r in texts}
    total = 0
    for r in texts:
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        for p in docs[r["doc_id"]]:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"]:p["start"] + p["length"]].tobytes())
        assert sum(p["length"] for p in docs[r["doc_id"]]) == len(ids)
    assert -(-total // 1024) <= n <= 1.01 * total / 1024 + 1


@pytest.mark.parametrize("part_rows", [40, 300, 10_000])
def test_rounds(spark, part_rows):
    """Partitions exchange what does not fit: nothing is lost, sequences stay near the bound."""
    rng = np.random.default_rng(8)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(1, 700, 1500))]
    rows += [(i, 0, 0, 1024, i) for i in range(1500, 1520)] + [(None, 0, 0, 5, 1)]
    df = spark.createDataFrame(rows, binpack._PIECES)
    out = binpack.pack(df, part_rows=part_rows)
    got = out.collect()
    assert sorted((r["doc_id"] or -1, r["length"]) for r in got) == sorted((r[0] or -1, r[3]) for r in rows)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in seqs.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])][:-1] and sum(n for _, n in own) <= 1024
    c = binpack.certificate(out).first()
    assert c["n_sequences"] == len(seqs) <= 1.03 * c["bound"] + 1


def test_binpack_odd(odd, none):
    import public_tokenizers as P
    path = P.path("byte_bpe_50k.json")
    got = binpack.pack_documents(odd, path).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["length"])
    assert by[1] == by[2] == [1] and sorted(by[3])[0] == sorted(by[3])[1] and len(by[None]) == 2
    assert len(by[4]) == len(by[5]) > 20
    assert binpack.pack_documents(none, path).count() == 0


def test_ids_beside_a_null(spark):
    import public_tokenizers as P
    ids = [None, *((1 << 60) + i for i in range(1, 9))]
    df = spark.createDataFrame([(i, "a few words") for i in ids], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in binpack.pack_documents(df, P.path("byte_bpe_50k.json")).collect()} == set(ids)
