"""Approximate nearest neighbours by a forest of hash prefixes.

Every tree gives a vector a string of ``BITS`` bits, the sides of random orthogonal hyperplanes it lies on, and keeps the strings in a
sorted array. A query descends to its longest common prefix with any tree, then all trees ascend together: at each depth the
vectors that share a prefix of that length join the candidates, until there are ``share`` of the vectors (at least ``least``).
The candidates are compared exactly.

Vectors are spread over blocks of about ``block`` rows, each with a forest of its own; every query visits every block, and the best
of all blocks remain. Equal vectors in a block are one entry of its arrays, so copies do not crowd others out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

BITS = 48


def planes(tree: int, size: int, seed: int) -> np.ndarray:
    """``BITS`` directions of a tree, orthogonal to each other as far as the number of components allows."""
    rng = np.random.default_rng((seed, tree, size))
    rows = [np.linalg.qr(rng.standard_normal((size, size)))[0].T for _ in range(-(-BITS // size))]
    return np.concatenate(rows)[:BITS]


def strings(vectors: np.ndarray, tree: int, seed: int) -> np.ndarray:
    bits = vectors @ planes(tree, vectors.shape[1], seed).T > 0
    return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two strings."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


class Forest:
    """Sorted strings of a block's distinct vectors, tree by tree."""

    def __init__(self, vectors: np.ndarray, trees: int, seed: int) -> None:
        self.size, self.trees, self.seed = len(vectors), trees, seed
        found = [strings(vectors, t, seed) for t in range(trees)]
        self.order = [np.argsort(f, kind="stable") for f in found]
        self.sorted = [f[o] for f, o in zip(found, self.order)]

    def candidates(self, queries: np.ndarray, wanted: int):
        """For each query, the numbers of its candidates: all that share the longest prefixes, until there are ``wanted``."""
        own = [strings(queries, t, self.seed) for t in range(self.trees)]
        depth = np.zeros(len(queries), np.int64)
        for s, q in zip(self.sorted, own):  # descend: the longest common prefix is with a neighbour in sorted order
            at = np.searchsorted(s, q)
            depth = np.maximum(depth, np.maximum(_common(s[np.minimum(at, self.size - 1)], q), _common(s[np.maximum(at - 1, 0)], q)))
        low = np.zeros((BITS + 1, self.trees, len(queries)), np.int32)
        high = np.zeros_like(low)
        for x in range(int(depth.max(initial=0)) + 1):
            rest = np.uint64((1 << (BITS - x)) - 1)
            for t in range(self.trees):
                low[x, t] = np.searchsorted(self.sorted[t], own[t] & ~rest, "left")
                high[x, t] = np.searchsorted(self.sorted[t], own[t] | rest, "right")
        for i in range(len(queries)):
            marked = np.zeros(self.size, bool)
            for x in range(int(depth[i]), -1, -1):  # ascend in all trees at once
                spans = high[x, :, i] - low[x, :, i]
                if spans.sum() < wanted and x:
                    continue  # even without overlaps there are too few
                for t in np.flatnonzero(spans):
                    marked[self.order[t][low[x, t, i] : high[x, t, i]]] = True
                if np.count_nonzero(marked) >= wanted:
                    break
            yield i, np.flatnonzero(marked)


def _block_best(found: pd.DataFrame, asked: pd.DataFrame, k: int, trees: int, share: float, least: int, seed: int) -> pd.DataFrame:
    """The ``k`` best of one block for each of the queries sent to it."""
    best: list[tuple[int, int, float]] = []
    if len(found) and len(asked):
        raw = np.array(found["vector"].tolist(), np.float32)
        distinct, of = np.unique(raw.view(np.uint32), axis=0, return_inverse=True)
        of = of.ravel()
        ids = found["vec_id"].to_numpy()
        by = np.lexsort((ids, of))
        first = np.searchsorted(of[by], np.arange(len(distinct) + 1))
        vectors = distinct.view(np.float32).astype(np.float64)
        norms = np.sqrt((vectors * vectors).sum(1))
        queries = np.array(asked["vector"].tolist(), np.float64)
        lengths = np.sqrt((queries * queries).sum(1))
        forest = Forest(vectors, trees, seed)
        own = asked["query_id"].to_numpy()
        for i, near in forest.candidates(queries, max(least, int(np.ceil(share * len(vectors))))):
            cosine = (vectors[near] * queries[i]).sum(1) / (norms[near] * lengths[i])  # one order of additions, so equal vectors tie
            # of the entries, the best k + 1 and all that tie with the last one: the query itself may be one row among them
            if len(near) > k + 1:
                cut = np.partition(cosine, len(cosine) - k - 1)[len(cosine) - k - 1]
                near, cosine = near[cosine >= cut], cosine[cosine >= cut]
            rows = [(-c, v) for n, c in zip(near, cosine) for v in _others(ids[by[first[n] : first[n + 1]]], own[i], k)]
            best += [(int(own[i]), int(v), -c) for c, v in sorted(rows)[:k]]
    return pd.DataFrame(best, columns=["query_id", "vec_id", "score"])


def _others(ids: np.ndarray, own: int, k: int) -> list[int]:
    """The ``k`` smallest distinct of sorted ids that are not the query's own."""
    ids = np.unique(ids)
    return ids[ids != own][:k].tolist()


def usable(vector: Column) -> Column:
    """Vectors that take part: with components, none of them null or not finite, and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    rows: DataFrame,
    asked: Column,
    k: int = 5,
    trees: int = 64,
    share: float = 0.4,
    least: int = 1500,
    block: int = 20_000,
    chunk: int = 5_000,
    seed: int = 5,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found by cosine for each row of ``rows`` (vec_id, embedding) where ``asked`` holds.

    A query's own row, and any row that repeats its id, is not its neighbour. Unusable vectors, null ids and, for a query,
    vectors of another length take no part. Ties go to the smaller id; rows that repeat an id count once. Fewer than ``k`` others give
    as many rows. ``share`` bounds from below how much of a block is compared: near-uniform vectors, the worst case, need about
    a third for a recall over 0.9.
    """
    fit = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").alias("vector"), F.size("embedding").alias("size"))
    n = fit.count()
    blocks = max(1, -(-n // block))
    queries = fit.where(asked).select(F.col("vec_id").alias("query_id"), "vector", "size").dropDuplicates(["query_id"])
    chunks = max(1, -(-queries.count() // chunk))
    placed = fit.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    sent = queries.withColumn("chunk", F.pmod(F.xxhash64("query_id", F.lit("chunk")), F.lit(chunks)).cast("int"))
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    key = ["size", "block", "chunk"]
    best = placed.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(
        lambda found, wanted: _block_best(found, wanted, k, trees, share, least, seed), "query_id long, vec_id long, score double"
    )
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
