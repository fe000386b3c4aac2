"""Leakage-safe train/val/test generation and exact re-balancing
(SURVEY K3-K6, J2, J3, J5).

Splits are made over *functions*, not pairs: a pair is kept in a split only
when both of its functions were assigned to that split, so no function
occurs in two splits.  The seeded shuffle is a hash order (K1), so the
assignment is reproducible on any number of partitions, and every count the
reference computes from list lengths is an exact rank here (see ``rank``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.identity import function_universe
from pairwright.operators.quality import class_rows
from pairwright.operators.rank import never_null, hash_row_number, position_row_number, positions_across, seeded_hash
from pairwright.schema import CLONE, FUNC_COLS, LEFT, NON_CLONE, PAIR_COLS, RIGHT
from pairwright.session import stage

SPLITS = ("train", "val", "test")


def assign_functions(universe: DataFrame, train: float, val: float, seed: int = 0,
                     digits: int | None = None) -> DataFrame:
    """Seeded partition of distinct functions (K3).

    ``k1 = int(train*N)``, ``k2 = int(val*N)`` in double arithmetic; the
    first k1 functions of the seeded order go to train, the next k2 to val,
    the rest to test.  The test fraction is implied, as in the reference,
    and fractions summing above 1 shorten val and empty test.
    """
    # The universe (a distinct over all pairs) is written once: the rank reads
    # it twice, and N comes from the rank's bucket-size table.
    hashed = stage(universe.withColumn("_h", seeded_hash(seed, *FUNC_COLS)), "universe")
    ranked = hash_row_number(hashed, "_h", FUNC_COLS, out="rank", digits=digits, total="_n")
    k1 = F.floor(F.lit(float(train)) * F.col("_n"))
    k2 = F.floor(F.lit(float(val)) * F.col("_n"))
    split = (F.when(F.col("rank") <= k1, "train")
             .when(F.col("rank") <= k1 + k2, "val").otherwise("test"))
    return ranked.select(*FUNC_COLS, "rank", split.alias("split"))


def _named(assignment: DataFrame, cols: Sequence[str], split_name: str) -> DataFrame:
    return assignment.select(*[F.col(f).alias(c) for f, c in zip(FUNC_COLS, cols)],
                             F.col("split").alias(split_name))


def in_split_pairs(pairs: DataFrame, assignment: DataFrame) -> DataFrame:
    """Pairs whose two functions share a split, tagged with it.

    Two equi-joins replace the reference's three membership scans; pairs
    that straddle splits drop out.  A function used by very many pairs is a
    skewed join key on the pairs side only (the assignment has one row per
    function), which adaptive skew-join splitting handles.
    """
    def tagged(df, cols, split_name):
        own = _named(assignment, [f"_{c}" for c in cols], split_name)
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols])
        return df.join(own, same).drop(*[f"_{c}" for c in cols])

    return (tagged(tagged(pairs, LEFT, "_s1"), RIGHT, "_s2")
            .filter(F.col("_s1") == F.col("_s2"))
            .withColumn("split", F.col("_s1")).drop("_s1", "_s2"))


def semi_in_set(pairs: DataFrame, functions: DataFrame) -> DataFrame:
    """Pairs whose both functions are members of ``functions`` (J3: left-semi twice; repeated members do no harm)."""
    def named(cols):
        return functions.select(*[F.col(f).alias(c) for f, c in zip(FUNC_COLS, cols)])
    return (pairs.join(named(LEFT), list(LEFT), "left_semi")
            .join(named(RIGHT), list(RIGHT), "left_semi"))


def interleave_classes(df: DataFrame, by: Sequence[str] = ("split",), pos: str = "row_pos") -> DataFrame:
    """Alternate clone / non-clone rows taken from the *end* of each class.

    The reference pops both lists until one is empty: the i-th pop of each
    class is its i-th row counted from the end, clone first.  So with
    ``rn`` = rank by position descending per (split, class) and
    ``m`` = the smaller class size, rows with ``rn <= m`` are kept at
    ``out_pos = 2*(rn-1) + (class is 0)``; the earliest surplus rows of the
    larger class are dropped.  No join of the two classes is needed.
    """
    keys = {f"_by{i}": never_null(c) for i, c in enumerate(by)}  # a null group is a group
    sizes = df.withColumns(keys).groupBy(*keys).agg(F.least(F.count_if(F.col("label") == CLONE),
                                                            F.count_if(F.col("label") == NON_CLONE)).alias("_m"))
    ranked = position_row_number(df, pos, partition_by=[*by, "label"], out="_rn", descending=True)
    return (ranked.withColumns(keys).join(sizes, list(keys))
            .filter(F.col("_rn") <= F.col("_m"))
            .withColumn("out_pos", 2 * (F.col("_rn") - 1) + (F.col("label") == NON_CLONE).cast("long"))
            .drop("_rn", "_m", *keys))


def split_pairs(pairs: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 0,
                digits: int | None = None, src: str | None = None) -> DataFrame:
    """The dataset generator (K4): universe -> seeded partition -> in-split pairs -> alternate.

    ``pairs`` holds ``row_pos`` and the nine pair columns; rows whose label
    is neither class are ignored, as in the reference's single-file mode.
    Output: ``split, out_pos, row_pos`` and the nine pair columns; the
    written file of a split is its rows ordered by ``out_pos``.

    ``src`` names the file column when ``row_pos`` counts within each file
    (as ``read_pairs`` gives it for many files): the files then count as one
    table, in the order of their names, and ``row_pos`` is the position in it.
    """
    if src:
        pairs = positions_across(pairs, src)
    valid = class_rows(pairs).select("row_pos", *PAIR_COLS)
    # The assignment feeds two joins, the in-split pairs feed three passes of
    # the interleave rank: each is written once to the checkpoint folder.
    assignment = stage(assign_functions(function_universe(valid), train, val, seed, digits), "assignment")
    tagged = stage(in_split_pairs(valid, assignment), "in_split")
    return interleave_classes(tagged).select("split", "out_pos", "row_pos", *PAIR_COLS)


def two_file_pairs(clones: DataFrame, non_clones: DataFrame) -> DataFrame:
    """Double mode: one all-clone and one all-non-clone input, class added."""
    return (clones.withColumn("label", F.lit(CLONE))
            .unionByName(non_clones.withColumn("label", F.lit(NON_CLONE))))


def rebalance(df: DataFrame, seed: int = 0, by: Sequence[str] = ("src",), digits: int | None = None) -> DataFrame:
    """Down-sample the larger class to exactly the smaller class size, per input.

    Sampling without replacement = the k rows of each class with the
    smallest seeded hash of their position, k = min(class sizes) of the
    input (k = 0 leaves nothing).  ``out_pos`` is the output order, a second
    seeded hash order over the kept rows.  ``sampleBy`` is not used: it does
    not give exact counts.
    """
    valid = stage(class_rows(df).withColumn("_h", seeded_hash(seed, "row_pos")), "rebalance")
    keys = {f"_by{i}": never_null(c) for i, c in enumerate(by)}  # a null group is a group
    k = valid.withColumns(keys).groupBy(*keys).agg(F.least(F.count_if(F.col("label") == CLONE),
                                                           F.count_if(F.col("label") == NON_CLONE)).alias("_k"))
    ranked = hash_row_number(valid, "_h", ["row_pos"], partition_by=[*by, "label"], out="_rn",
                             digits=digits)
    kept = stage(ranked.withColumns(keys).join(k, list(keys)).filter(F.col("_rn") <= F.col("_k")).drop("_rn", "_k", "_h", *keys)
                 .withColumn("_h", seeded_hash(seed, F.lit("order"), "row_pos")), "kept")
    out = hash_row_number(kept, "_h", ["row_pos"], partition_by=list(by), out="_o", digits=digits)
    return out.select(*by, (F.col("_o") - 1).alias("out_pos"), "row_pos", *PAIR_COLS)
