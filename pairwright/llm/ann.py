"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index: each vector is normalised, rotated by one seeded random orthogonal
matrix and kept as the packed signs of its coordinates, with two correction
scalars: its norm and the inner product of the rotated vector with its code.
For a query the inner product is estimated from the bits and the scalars; the
estimate's error is bounded (with probability growing with ``eps``) by a term
that follows from the second scalar.

Search: queries are taken in blocks of at most ``block`` (so what is sent to
every task is bounded: block x dimension numbers), each block against all
codes.  A task keeps the k nearest so far of each query, by exact inner products
of the original vectors in double precision.  Of the next slice of codes only
the vectors whose upper bound reaches a query's k-th exact product are
reranked, so the bounds prune more the further a task is.  (Where they still leave a
large share, one matrix product with a margin for its rounding thins it out
first.)  Tasks give out k rows a query, which are merged by (score, smaller vec_id).

Vectors that are null or zero, hold a null or non-finite component, have no
vec_id, or another dimension than the first of all vec_ids, take no part.
Rows that repeat a vec_id are each a candidate (never for their own id).  With
fewer candidates than k all are returned; without valid vectors no row is.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.common import staged as stage

EPS, BLOCK, SLICE, SEED = 1.9, 2048, 4096, 7


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def valid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    first = v.agg(F.min(F.struct("vec_id", F.size("v").alias("d"))).alias("m")).first()["m"]
    return v.filter(F.size("v") == (first["d"] if first else 0))


def encode(vectors: DataFrame, dim: int, seed: int = SEED) -> DataFrame:
    """vec_id, v, code (packed signs), norm, fit (inner product of unit vector and code)."""
    def run(batches):
        rot = rotation(dim, seed)
        for b in batches:
            x = np.stack([np.asarray(v, dtype=np.float64) for v in b["v"]])
            norm = np.linalg.norm(x, axis=1)
            y = (x / norm[:, None]) @ rot
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "code": [r.tobytes() for r in np.packbits(y > 0, axis=1)],
                                "norm": norm, "fit": np.abs(y).sum(1) / np.sqrt(dim)})
    return vectors.mapInPandas(run, "vec_id long, v array<double>, code binary, norm double, fit double")


def _scan(ids: np.ndarray, queries: np.ndarray, dim: int, k: int, eps: float, seed: int):
    """The k nearest of each query of the block among a task's vectors."""
    def run(batches):
        length = np.linalg.norm(queries, axis=1)
        turned = ((queries / length[:, None]) @ rotation(dim, seed)).astype(np.float32)
        score, near = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)  # best first
        for b in batches:
            for at in range(0, len(b), SLICE):
                s = b.iloc[at:at + SLICE]
                cand, x = s["vec_id"].to_numpy(), np.stack(s["v"].to_numpy())
                bits = np.unpackbits(np.frombuffer(b"".join(s["code"]), np.uint8).reshape(len(s), -1), axis=1, count=dim)
                fit, norm = s["fit"].to_numpy(), s["norm"].to_numpy()
                wide = eps * np.sqrt(np.maximum(0, 1 - fit ** 2)) / fit / np.sqrt(max(1, dim - 1))
                signs = ((bits.astype(np.float32) * 2 - 1) * (norm / fit / np.sqrt(dim))[:, None].astype(np.float32)).T
                err = (wide * norm + 1e-5 * norm).astype(np.float32)  # and what single precision leaves out
                slack = 1e-12 * norm
                for q0 in range(0, len(ids), 256):
                    q = slice(q0, min(q0 + 256, len(ids)))
                    cut = score[q, -1] / length[q]
                    maybe = turned[q] @ signs + err >= cut[:, None].astype(np.float32)
                    for i in np.flatnonzero(np.isin(ids[q], cand)):
                        maybe[i, cand == ids[q][i]] = False
                    if maybe.mean() > 0.1:
                        whole = (queries[q] / length[q][:, None]) @ x.T
                        if len(s) > k:
                            whole[~maybe] = -np.inf
                            cut = np.maximum(cut, np.partition(whole, -k, axis=1)[:, -k])
                        maybe &= whole + slack >= cut[:, None] - 1e-12 * np.abs(cut[:, None], where=np.isfinite(cut[:, None]), out=np.zeros((len(cut), 1)))
                    qi, ci = np.nonzero(maybe)
                    if not len(qi):
                        continue
                    new = np.einsum("ij,ij->i", queries[q][qi], x[ci])  # exact, in double precision
                    m = len(cut)
                    qi = np.concatenate([np.repeat(np.arange(m), k), qi])
                    ni, si = np.concatenate([near[q].ravel(), cand[ci]]), np.concatenate([score[q].ravel(), new])
                    order = np.lexsort((ni, -si, qi))
                    kept = order[(np.searchsorted(qi[order], np.arange(m))[:, None] + np.arange(k)).ravel()]
                    score[q], near[q] = si[kept].reshape(m, k), ni[kept].reshape(m, k)
        qi, ki = np.nonzero(score > -np.inf)
        yield pd.DataFrame({"query_id": ids[qi], "vec_id": near[qi, ki], "score": score[qi, ki]})
    return run


def search(vectors: DataFrame, is_query, k: int = 20, eps: float = EPS, block: int = BLOCK, seed: int = SEED,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every query (rows where ``is_query``, a column of vec_id, holds)."""
    v = valid(vectors, id_col, vec_col)
    spark = vectors.sparkSession
    head = v.select(F.size("v").alias("d")).first()
    if head is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = stage(encode(v, head["d"], seed), "ann-codes")
    asked = stage(codes.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    n = asked.count()
    blocks = max(1, -(-n // block))
    found = None
    for i in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)
        rows = part.collect()  # about ``block`` rows of ``dim`` numbers
        ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        if not len(ids):
            continue
        queries = np.array([r["v"] for r in rows], dtype=np.float64)
        hits = codes.mapInPandas(_scan(ids, queries, head["d"], k, eps, seed), "query_id long, vec_id long, score double")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = stage(hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "ann-block")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return found.select("query_id", "rank", "vec_id", "score")
