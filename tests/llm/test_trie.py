"""op11: every node against a trie of dictionaries; blocks, shards, ties, nulls and long conversations."""

import random

import brute
import pytest

from pairwright.llm import trie
from pairwright.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string, tid string, size int"


def got(df):
    rows = df.collect()
    assert df.columns == trie.COLUMNS
    out = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def trie_of(turns, **options):
    return trie.prefix_trie(*trie.rebuild(trie.encode_turns(turns)), **options)


def test_op11(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op11_prefix_trie"](spark, sf)) == brute.prefix_trie(brute.rebuilt(rows))


def made(seed, n=70):
    """Conversations that share beginnings, copies, nulls, ties, gaps in the ids."""
    rng, rows = random.Random(seed), []
    for c in range(0, 2 * n, rng.choice([1, 2])):
        start = rng.choice([[], ["x", "y"], ["x", "y", "z", "x", "y", "z"]])
        for i, t in enumerate(start + [rng.choice("xyzü") for _ in range(rng.randrange(9))]):
            turn = rng.choice([i, i, i, None, 3])
            rows.append((c + (1 << 60) * (c > n), turn, rng.choice(["user", "user", None]), rng.choice([t * 3, t * 3, None, ""]), "q", 1))
    rows += [(None, 1, "user", "x", "q", 1)] * 3
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block,shard", [(2, 1024, 7), (3, 2, 5), (5, 1, 4096)])
def test_blocks_and_shards(spark, monkeypatch, seed, block, shard):
    monkeypatch.setattr(trie, "SHARD_SEQS", shard)
    monkeypatch.setattr(trie, "SMALL", 0 if shard == 7 else trie.SMALL)
    rows = made(seed)
    assert got(trie_of(spark.createDataFrame(rows, TURNS), block=block)) == brute.prefix_trie(brute.rebuilt([r[:4] for r in rows]))


def test_long_conversations(spark):
    """One conversation longer than many blocks, a copy, one that leaves it late, and one that ends with a block."""
    rows = [(5, i, "user", f"t{i}") for i in range(40)]
    rows += [(c, t, r, x) for c in (10, 15, 20, 25, 30) for _, t, r, x in rows[:40]]
    rows += [(35, i, "user", f"t{i}" if i < 17 else f"u{i}") for i in range(30)]
    rows += [(40, i, "user", f"t{i}") for i in range(12)]
    rows += [(45, i, "user", f"v{i}") for i in range(24)]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], TURNS)
    for block in (4, 1024):
        assert got(trie_of(df, block=block, chunk=2)) == brute.prefix_trie(brute.rebuilt(rows))


def test_odd(spark):
    assert trie_of(spark.createDataFrame([], TURNS)).collect() == []
    absent = [(7, 1, "user", "a", "q", 1)]  # nothing to start with: conversation 5 is not there
    assert got(trie_of(spark.createDataFrame(absent, TURNS))) == brute.prefix_trie(brute.rebuilt([r[:4] for r in absent]))


def test_ternary_tree_is_shallow():
    tree = trie.TernaryTree()
    for i in trie.medians(1000):
        tree.insert([i])
    assert sorted(tree.sym) == list(range(1000))

    def height(v):
        return 0 if v < 0 else 1 + max(height(tree.lo[v]), height(tree.hi[v]))
    assert height(0) <= 10
