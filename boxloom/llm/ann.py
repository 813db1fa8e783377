"""Nearest neighbours by inner product with a vantage-point tree per shard.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest
norm, which is zero for queries; then the nearest in distance has the largest inner product.
Vectors are dealt to shards by a hash of their id, each shard of about ``SHARD`` vectors builds
one tree, and blocks of queries visit every tree.  A subtree is left out when the triangle
inequality, relaxed by ``factor``, rules it out: distances to its shell must be below ``factor``
times the query's current radius.  Factor one prunes nothing that could matter, so the search
is exact; smaller factors look at less.

A task holds one tree and one block of queries, and keeps k results per query.  Trees are built
once and stored in the shared folder.  Scores are exact inner products of the original vectors
in double precision.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, neither
as queries nor as candidates.  Vectors are only compared with vectors of the same length.  Rows that
agree in id and vector are one; rows that agree in the id only are vectors, and queries, of their own, with
a list each, and none is a candidate of the other.  Ties go to the smaller id.  With fewer than k
candidates all are returned.  Where components are so large that products overflow, all vectors are
scaled by one power of two for the search, and scores may be infinite.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpoint

K = 20
#: Vectors of a tree and queries of a block, on average.
SHARD = 16_384
BLOCK = 8_192
#: Points of a leaf.
LEAF = 256
FACTOR = 0.2


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (doubles), dim of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & fine).withColumn("dim", F.size("v"))


def build(x: np.ndarray, seed: int, leaf: int = LEAF):
    """A tree over the rows of x: nested (vantage row, radius, inside, outside) or arrays of rows."""
    rng = np.random.default_rng(seed)

    def node(rows: np.ndarray):
        if len(rows) <= leaf:
            return rows
        # the vantage point with the widest spread of a few
        best = None
        for c in rng.choice(rows, 4, replace=False):
            d = np.sqrt(np.maximum(0, ((x[rows] - x[c]) ** 2).sum(axis=1)))
            if best is None or d.std() > best[1].std():
                best = (c, d)
        c, d = best
        cut = np.median(d)
        inside = d <= cut
        if inside.all():  # many equal distances
            return rows
        return (int(c), float(cut), node(rows[inside]), node(rows[~inside]))

    return node(np.arange(len(x)))


class Search:
    """All queries of a block in one tree."""

    def __init__(self, ids, x, lift, tree, k: int, factor: float):
        self.ids, self.x, self.tree, self.k, self.factor = ids, x, tree, k, factor
        self.lifted = np.hstack([x, lift[:, None]])

    def run(self, qids: np.ndarray, q: np.ndarray):
        n = len(q)
        self.q, self.qids = q, qids
        self.sq = (q * q).sum(axis=1)
        self.score = np.full((n, self.k), -np.inf)
        self.found = np.full((n, self.k), np.iinfo(np.int64).max)
        self.radius = np.full(n, np.inf)
        self.seen = 0
        self._visit(self.tree, np.arange(n))
        return self.score, self.found

    def _visit(self, node, qs: np.ndarray) -> None:
        if not len(qs):
            return
        if isinstance(node, np.ndarray):
            return self._leaf(node, qs)
        c, cut, inside, outside = node
        p = self.lifted[c]
        d = np.sqrt(np.maximum(0, self.sq[qs] + p @ p - 2 * self.q[qs] @ p[:-1]))
        near = d <= cut
        self._visit(inside, qs[near])
        self._visit(outside, qs[~near])
        # the other side only where the ball reaches over the shell, but for what rounding does to distances
        slack = 1e-7 * np.sqrt(len(p) * (self.sq[qs] + self.top))
        far = np.abs(d - cut) <= self.factor * self.radius[qs] + slack
        self._visit(outside, qs[near & far])
        self._visit(inside, qs[~near & far])

    def _leaf(self, rows: np.ndarray, qs: np.ndarray) -> None:
        self.seen += len(rows) * len(qs)
        s = self.q[qs] @ self.x[rows].T
        s[self.qids[qs][:, None] == self.ids[rows][None, :]] = -np.inf
        better = (s >= self.score[qs, -1][:, None]).any(axis=1)
        qs, s = qs[better], s[better]
        if not len(qs):
            return
        scores = np.hstack([self.score[qs], s])
        ids = np.hstack([self.found[qs], np.broadcast_to(self.ids[rows], s.shape)])
        ids = np.where(np.isinf(scores), np.iinfo(np.int64).max, ids)
        # all that tie with the k-th stay in the running
        kth = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
        width = max(self.k, int((scores >= kth[:, None]).sum(axis=1).max()))
        if width < scores.shape[1]:
            top = np.argpartition(-scores, width - 1, axis=1)[:, :width]
            scores, ids = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)
        order = np.lexsort((ids, -scores))[:, : self.k]
        self.score[qs], self.found[qs] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        worst = self.score[qs, -1]
        self.radius[qs] = np.where(np.isinf(worst), np.inf, np.sqrt(np.maximum(0, self.sq[qs] + self.top - 2 * worst)))

    top = 0.0


def build_trees(x: DataFrame, shards: int, top: float, leaf: int = LEAF, scale: int = 0) -> DataFrame:
    """dim, shard, tree: one pickled tree per shard of the usable vectors, over 2**scale."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "hash"])
        vectors = np.ldexp(np.stack(pdf.v.to_numpy()), -scale)
        lift = np.sqrt(np.maximum(0, top - (vectors * vectors).sum(axis=1)))
        tree = build(np.hstack([vectors, lift[:, None]]), int(key[1]), leaf)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [pickle.dumps((pdf.id.to_numpy(), vectors, lift, tree))]})

    dealt = x.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInPandas(one, "dim int, shard int, tree binary")


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, factor: float = FACTOR, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that the search found for each query row.

    ``is_query`` is a condition on the column ``id``.
    """
    x = usable(vectors, id_col, vec_col).dropDuplicates(["id", "v"]).withColumn("hash", F.xxhash64("v"))
    largest = x.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    scale = int(np.frexp(largest)[1]) if largest > 2.0**400 else 0
    norm = F.aggregate("v", F.lit(0.0), lambda a, b: a + (b * 2.0**-scale) * (b * 2.0**-scale))
    n, top = x.agg(F.count("*"), F.max(norm)).first()
    shards = max(1, -(-n // shard))
    trees = checkpoint(build_trees(x, shards, top or 0.0, leaf, scale))
    queries = x.where(is_query)
    blocks = max(1, -(-queries.count() // block))
    # each query goes to each shard, in blocks of bounded size
    q = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    t = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "hash": [], "vec_id": [], "score": []})
        s = Search(*pickle.loads(right.tree.iloc[0]), k, factor)
        s.top = top
        qids = left.id.to_numpy()
        score, found = s.run(qids, np.ldexp(np.stack(left.v.to_numpy()), -scale))
        out = pd.DataFrame({"query_id": np.repeat(qids, k), "hash": np.repeat(left.hash.to_numpy(), k), "vec_id": found.ravel(), "score": score.ravel()})
        out = out[np.isfinite(out.score)]
        # an exact power of two, beyond what doubles hold at worst
        with np.errstate(over="ignore"):
            return out.assign(score=np.ldexp(out.score, 2 * scale))

    found = q.groupBy("dim", "shard", "block").cogroup(t.groupBy("dim", "shard", "block")).applyInPandas(search, "query_id long, hash long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "hash").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
