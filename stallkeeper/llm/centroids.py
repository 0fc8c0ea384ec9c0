"""Centroid clustering with exact integer centroids, assigned by Orchard's search.

Every round sends the centroids (a bounded number of integers) to the tasks, each of which keeps, per centroid, the list of
all others by ascending distance. A vector starts at some centroid and walks that centroid's list. By the triangle inequality
no centroid that lies farther from the current one than twice the vector's own distance to it can be nearer, so the walk
stops strictly beyond that; when a nearer centroid is found, the walk goes on in its list from the beginning, and centroids
that were looked at before are marked and skipped. All vectors of a batch walk in step, with numpy.

Each task adds its vectors up by cluster, Spark adds the tasks' sums as decimals; no vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.session import stored

#: Vectors that walk together.
STEP_ROWS = 8192
#: Components below this have squared distances below 2^63 up to 512 dimensions; larger ones take Python's integers.
SMALL = 1 << 26
MOST = 2**63 - 1


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows; as Python integers where components are large."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap) if gap.dtype != object else (gap * gap).sum(axis=1)


def exact(rows: np.ndarray) -> np.ndarray:
    """Integers whose differences and squares cannot overflow."""
    big = rows.size and (rows.dtype == object or rows.max() >= SMALL or rows.min() <= -SMALL)
    return rows.astype(object) if big else rows


class Orchard:
    """Nearest of a list of integer centroids; ties go to the smaller number."""

    def __init__(self, centroids: list[list[int]]):
        large = any(abs(x) >= SMALL for c in centroids for x in c)
        self.centroids = np.array(centroids, object if large else np.int64)
        n = len(centroids)
        between = np.array([squared(np.broadcast_to(c, self.centroids.shape), self.centroids) for c in self.centroids]).reshape(n, n)
        order = [sorted((j for j in range(n) if j != i), key=lambda j: (between[i][j], j)) for i in range(n)]
        self.lists = np.array(order, np.int64).reshape(n, n - 1)
        self.gaps = np.take_along_axis(between, self.lists, axis=1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each row's nearest centroid, and how many distances that took."""
        rows = exact(rows)
        if rows.dtype == object or self.centroids.dtype == object:
            rows, centroids = rows.astype(object), self.centroids.astype(object)
        else:
            centroids = self.centroids
        n, k = len(rows), len(centroids)
        now = np.zeros(n, np.int64)
        best = squared(rows, centroids[now])
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        at, walking, looked = np.zeros(n, np.int64), np.arange(n if k > 1 else 0), n
        while len(walking):
            here, place = now[walking], at[walking]
            # At exactly twice the distance a centroid can still be as near, and win by its number.
            within = self.gaps[here, place] <= 4 * best[walking]
            walking, here, place = walking[within], here[within], place[within]
            other = self.lists[here, place]
            new = ~seen[walking, other]
            seen[walking, other] = True
            asked = walking[new]
            looked += len(asked)
            distance = squared(rows[asked], centroids[other[new]])
            better = (distance < best[asked]) | ((distance == best[asked]) & (other[new] < now[asked]))
            at[walking] += 1
            moved = asked[better]
            now[moved], best[moved], at[moved] = other[new][better], distance[better], 0
            walking = walking[at[walking] < k - 1]
        return now, best, looked


def usable(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, vector): vectors of `dims` finite components as integers floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dims) & fine)
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * scale)).alias("vector"))


def first_centroids(rows: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The `k` vectors of smallest SHA-256 of `seed:vec_id`, in that order; equal ids by vector, rows without id last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r["vector"]) for r in rows.orderBy(digest.asc_nulls_last(), "vector").limit(k).select("vector").collect()]


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP_ROWS):
            part = batch.slice(lo, STEP_ROWS)
            yield part.column(0), part.column(1).flatten().to_numpy().reshape(part.num_rows, dims)


def totals(rows: DataFrame, centroids: list[list[int]]) -> dict[int, list[int]]:
    """Of each non-empty cluster its count, then its sum by component; every task sends at most one row a cluster."""
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums = Orchard(centroids), {}
        for _, matrix in _matrices(batches, dims):
            near, _, _ = search.nearest(matrix)
            wide = exact(matrix)
            for c in np.unique(near):
                mine = near == c
                added = [int(mine.sum()), *map(int, wide[mine].sum(axis=0))]
                sums[int(c)] = [a + b for a, b in zip(sums.get(int(c), [0] * (dims + 1)), added, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([[str(x) for x in v] for v in sums.values()], pa.list_(pa.string()))], ["cluster", "sums"])

    parts = rows.mapInArrow(run, "cluster int, sums array<string>")
    each = parts.select("cluster", F.posexplode("sums").alias("place", "x")).groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out: dict[int, list[int]] = {}
    for r in each.orderBy("cluster", "place").collect():  # at most clusters x (dims + 1) numbers
        out.setdefault(r["cluster"], []).append(int(r["x"]))
    return out


def assigned(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for ids, matrix in _matrices(batches, dims):
            near, distance, _ = search.nearest(matrix)
            distance = np.minimum(distance, MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(near, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every usable row of `vectors`.

    `vectors` has (vec_id, embedding, ...); other columns are not read. Vectors that are null, have not exactly `dims`
    components, or have a null or non-finite one, take no part; without any vector left the result is empty. Fewer than `k`
    vectors give as many centroids. Repeated rows count by themselves, and rows without a vec_id too (they become first
    centroids only if there are not enough others). Equal distances go to the smaller number, so of equal centroids the later
    ones stay empty, and an empty one keeps its place. Components are floor(scale * x) as doubles, bounded by 64-bit integers;
    distances and sums are exact, and given as 2^63 - 1 where they are larger.
    """
    rows = stored(usable(vectors, dims, scale), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.select("vec_id", *(F.lit(0).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    for _ in range(rounds):
        found = totals(rows, centroids)
        centroids = [[x // found[i][0] for x in found[i][1:]] if i in found else c for i, c in enumerate(centroids)]
    final = stored(assigned(rows, centroids), "assigned")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    named = reduce(lambda c, i: c.when(F.col("cluster") == i, digests[i]), range(1, len(digests)), F.when(F.col("cluster") == 0, digests[0]))
    long_ = lambda x: F.least(x, F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s"))  # one row a cluster
    joined = final.join(F.broadcast(sums), "cluster")
    return joined.select("vec_id", "cluster", "distance", long_(F.col("s")).alias("cluster_inertia"), long_(sums.agg(F.sum("s")).scalar()).alias("inertia"), named.alias("centroid_sha256"))
