"""Exact top-k by inner product over an impact-ordered index, a score at a time.

Vectors are dealt into blocks. A block's index holds, for each dimension, posting segments by quantised impact: segment p has
the vectors whose component, counted from the dimension's least value in the block, has bit p set, and adds q * 2^p to the
scores of a query with weight q there. Segments are worked off by descending impact 2^p. What the segments still to come can
add is bounded on both sides, so a query stops as soon as its k-th best lower bound proves that no other vector can enter;
the vectors that still can are scored exactly. Without such proof all segments are used and the scores are exact anyway.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from stallkeeper.session import stored

#: Vectors and queries that one task compares at most, about.
BLOCK, QUERY_BLOCK = 8192, 1024
#: Possible members, as a multiple of k, at which the segments are left for exact scores.
RESCORE = 64


class ImpactIndex:
    """Impact-ordered segments of a block of integer vectors in the order in which ties go; `rows` are their row numbers."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray):
        self.rows, self.vectors = rows, vectors.astype(np.float64)
        self.least = vectors.min(axis=0)
        above = vectors - self.least
        planes = int(above.max()).bit_length()
        self.segments = [(1 << p, ((above >> p) & 1).astype(np.float32)) for p in range(planes - 1, -1, -1)]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the places and exact scores of its k best vectors, without the row in `own`; ties to the earlier."""
        q = queries.astype(np.float64)
        score = np.repeat((q @ self.least.astype(np.float64))[:, None], len(self.rows), axis=1)
        mine = self.rows[None, :] == own[:, None]
        rises, falls = np.maximum(q, 0).sum(axis=1), np.minimum(q, 0).sum(axis=1)
        active, out = np.arange(len(q)), [None] * len(q)
        most = min(k, len(self.rows))
        for weight, members in self.segments:
            score[active] += weight * (q[active] @ members.T.astype(np.float64))
            left = []
            for i in active:
                seen = np.where(mine[i], -np.inf, score[i])
                floor = np.partition(seen, len(seen) - most)[len(seen) - most] + falls[i] * (weight - 1)
                possible = np.flatnonzero(seen + rises[i] * (weight - 1) >= floor)
                if len(possible) <= RESCORE * k or weight == 1:
                    out[i] = self._exact(q[i], possible, mine[i], k)
                else:
                    left.append(i)
            active = np.array(left, np.int64)
            if not len(active):
                break
        return [x if x is not None else self._exact(q[i], np.arange(len(self.rows)), mine[i], k) for i, x in enumerate(out)]

    def _exact(self, q: np.ndarray, possible: np.ndarray, mine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        possible = possible[~mine[possible]]
        exact = self.vectors[possible] @ q
        best = np.argsort(-exact, kind="stable")[:k]
        return possible[best], exact[best].astype(np.int64)


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, vector): components as floor(scale * x); without null vectors and those with null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select("vec_id", F.transform("embedding", lambda v: F.floor(v * scale)).alias("vector"))


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector that `is_query` picks, its k highest integer inner products.

    `vectors` has (vec_id, embedding, ...). All usable rows but the query's own are candidates, ties go to the smaller vec_id;
    a query with fewer candidates returns all. Rows count by themselves: repeated rows, or rows of one vec_id with different
    vectors, are each a query or candidate, and equal ids among the results are told apart by rank. Vectors compare with those
    of equal length; an empty vector scores 0. Queries and candidates meet in blocks of bounded size (an equi-join on block
    numbers); each returns its k best, so what is merged grows with queries times blocks, never with pairs.
    """
    rows = stored(usable(vectors, scale).withColumns({"row": F.monotonically_increasing_id(), "n": F.size("vector")}), "vectors")
    shapes = rows.groupBy("n").agg(F.count("*").alias("rows"), F.sum(is_query.cast("long")).alias("asks"))
    shapes = shapes.select("n", F.ceil(F.col("rows") / block).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("asks") / QUERY_BLOCK)).alias("turns"))
    placed = rows.join(shapes, "n")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    hashed = lambda c, s: F.pmod(F.xxhash64("row", F.lit(s)), F.col(c))
    seen = placed.select("n", "row", "vec_id", "vector", hashed("blocks", 1).alias("block"), every("turns").alias("turn"))
    asked = placed.where(is_query).select(*(F.col(c).alias(c) for c in ("n", "row", "vec_id", "vector")), hashed("turns", 2).alias("turn"), every("blocks").alias("block"))

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({c: [] for c in ("query_row", "query_id", "row", "vec_id", "score")}).astype("int64")
        block = block.sort_values(["vec_id", "row"])
        n = int(block["n"].iloc[0])
        matrix = lambda t: np.array(t["vector"].tolist(), np.int64).reshape(len(t), n)
        rows, own = block["row"].to_numpy(), queries["row"].to_numpy()
        if n:
            found = ImpactIndex(rows, matrix(block)).search(matrix(queries), own, k)
        else:
            first = np.arange(min(k + 1, len(rows)))
            found = [(places, np.zeros(len(places), np.int64)) for places in (first[rows[first] != row][:k] for row in own)]
        sizes, places = [len(f[0]) for f in found], np.concatenate([f[0] for f in found])
        asked = {"query_row": own, "query_id": queries["vec_id"].to_numpy()}
        return pd.DataFrame({**{c: np.repeat(x, sizes) for c, x in asked.items()}, "row": rows[places], "vec_id": block["vec_id"].to_numpy()[places], "score": np.concatenate([f[1] for f in found])})

    key = ["n", "turn", "block"]
    best = asked.groupBy(*key).cogroup(seen.groupBy(*key)).applyInPandas(search, "query_row long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
