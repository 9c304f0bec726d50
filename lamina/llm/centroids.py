"""Centroid clustering over exact integers, with the distances of a block from one matrix product.

A vector's components x become floor(scale * x). The squared distance to a centroid is expanded as
|x|^2 - 2 x.c + |c|^2; in a block of vectors the middle term is one product of float64 matrices.
This is exact while every partial sum stays below 2^53: 64 (max|x| + max|c|)^2 bounds them all,
for any order of summation. Vectors and centroids are told apart by that bound: pairs within it go
through the matrix product, larger ones through int64 differences, and those that could leave
int64 through Python integers. So no vector, however large, changes the way of the others.

Every round reads the vectors where they lie; a task sums its blocks, and RDD.treeAggregate
combines the tasks' sums of at most k centroids. Nothing is shuffled by cluster, so a cluster of
a third of the rows, or one repeated vector, is as cheap as any other. The driver holds k centroids.

Only vectors with exactly `dims` components, none null or not finite, take part; others give no row.
Equal rows are vectors of their own. Ties in distance go to the smaller centroid number. Initial
centroids with equal hashes (repeated ids; null ids count as an empty text) go by their components.
Fewer than k vectors are all centroids; no vectors give no rows. A centroid without vectors stays.
Sums that a long can't hold are null (distance, inertia). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, few, tidy

by_value(__name__)

ROWS = 4096
INT64 = 1 << 63


def usable(vector: str, dims: int):
    """Whether a vector has exactly dims components, all finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(F.when(F.size(vector) == dims, fine), F.lit(False))


def reaches(dims: int) -> tuple[int, int]:
    """The largest magnitudes of components for which float64 products, and int64 differences, are exact."""
    return math.isqrt((1 << 53) // dims) // 2 - 1, math.isqrt((1 << 63) // dims) // 2 - 1


def tiers(m: np.ndarray, dims: int) -> np.ndarray:
    """0, 1 or 2 for each row of an integer matrix: float64, int64 or Python integers."""
    low, high = reaches(dims)
    most = np.abs(m).max(axis=1) if len(m) else np.zeros(0)
    return np.array((most > low).astype(int) + (most > high).astype(int), dtype=int)


def scaled(batch_column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x): float64 where a double holds them as integers of an int64, else objects."""
    flat = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(flat * scale).reshape(-1, dims)
    if np.abs(x).max(initial=0.0) < 2.0**53:
        return x
    whole = lambda v: math.floor(v) if math.isfinite(v) else 0
    return np.array([[whole(v) for v in row] for row in x], dtype=object)


def distances(x: np.ndarray, c: np.ndarray, tier: int) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    if tier == 0:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    kind = np.int64 if tier == 1 else object
    x, c = x.astype(kind), c.astype(kind)
    if tier == 1:
        return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    return np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in c] for u in x], dtype=object).reshape(len(x), len(c))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(number of the nearest centroid, squared distance) of each row."""
    dims = x.shape[1]
    tx, tc = tiers(x, dims), tiers(c, dims)
    if not tx.any() and not tc.any():
        d = distances(x, c, 0)
        best = d.argmin(axis=1)
        return best, d[np.arange(len(x)), best].tolist()
    best, dist = np.zeros(len(x), dtype=int), [None] * len(x)
    for a in set(tx.tolist()):
        for b in sorted(set(tc.tolist())):
            rows, cols = np.flatnonzero(tx == a), np.flatnonzero(tc == b)
            d = distances(x[rows], c[cols], max(a, b))
            for i, row in zip(rows, d, strict=True):
                k = min(range(len(cols)), key=lambda j: (row[j], j))
                if dist[i] is None or (int(row[k]), cols[k]) < (dist[i], best[i]):
                    best[i], dist[i] = cols[k], int(row[k])
    return best, dist


def nothing(k: int, dims: int) -> tuple:
    """(vectors, distances, sums of components) of each cluster, as Python integers."""
    return [0] * k, [0] * k, np.zeros((k, dims), dtype=object)


def added(acc: tuple, x: np.ndarray, best: np.ndarray, dist: list[int]) -> tuple:
    """acc with a block of vectors."""
    n, inertia, sums = acc
    order = np.argsort(best, kind="stable")
    x, label = x[order], best[order]
    at = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    # A block has few rows, so its sums of components below 2^40 stay within int64.
    x = x.astype(np.int64) if x.dtype != object and np.abs(x).max(initial=0) < 2.0**40 else np.array([[int(v) for v in r] for r in x], dtype=object)
    totals = np.add.reduceat(x, at, axis=0)
    ends = np.r_[at[1:], len(label)]
    for k, s, a, z in zip(label[at].tolist(), totals, at.tolist(), ends.tolist(), strict=True):
        sums[k] += s.astype(object)
        n[k] += z - a
    for k, d in zip(best.tolist(), dist, strict=True):
        inertia[k] += d
    return acc


def merged(a: tuple, b: tuple) -> tuple:
    both = lambda x, y: [p + q for p, q in zip(x, y, strict=True)]
    return both(a[0], b[0]), both(a[1], b[1]), a[2] + b[2]


def _as_matrix(c: list[list[int]], dims: int) -> np.ndarray:
    m = np.array(c, dtype=object).reshape(-1, dims)
    return m.astype(np.int64) if all(abs(v) < INT64 for row in c for v in row) else m


def gather(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> tuple:
    """One pass over the vectors: (vectors, distances, sums) by nearest centroid, combined by treeAggregate."""
    import pickle

    k = len(centroids)

    def run(batches):
        c, out = _as_matrix(centroids, dims), nothing(k, dims)
        for batch in few((b for b in batches if b.num_rows), ROWS):
            x = scaled(batch.column("v"), dims, scale)
            added(out, x, *nearest(x, c))
        yield pa.RecordBatch.from_pydict({"s": [pickle.dumps(out)]}, schema=pa.schema([("s", pa.binary())]))

    parts = vectors.select("v").mapInArrow(tidy(run), "s binary").rdd
    return parts.treeAggregate(nothing(k, dims), lambda acc, row: merged(acc, pickle.loads(bytes(row.s))), merged)


def initial(vectors: DataFrame, k: int, scale: int, seed: int) -> list[list[int]]:
    """The k vectors whose hash of seed and id is smallest, in ascending order of the hash."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(place.alias("place"), "v").orderBy("place", "v").limit(k).collect()  # k rows
    return [[math.floor(scale * float(x)) for x in r.v] for r in sorted(rows, key=lambda r: (r.place, r.v))]


def cluster(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """(id, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256): a row for every usable vector, by its nearest final centroid."""
    kind = embeddings.schema[id].dataType
    vectors = embeddings.where(usable(vector, dims)).select(F.col(id).alias("id"), F.col(vector).alias("v"))
    schema = T.StructType([T.StructField(id, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    centroids = initial(vectors, k, scale, seed)
    if not centroids:
        return embeddings.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        counts, _, sums = gather(vectors, centroids, dims, scale)
        centroids = [[int(v) // n for v in s] if n else c for c, n, s in zip(centroids, counts, sums, strict=True)]
    last = gather(vectors, centroids, dims, scale)[1]
    long = lambda v: v if v < INT64 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = long(sum(last))

    def run(batches):
        c = _as_matrix(centroids, dims)
        for batch in few((b for b in batches if b.num_rows), ROWS):
            best, dist = nearest(scaled(batch.column("v"), dims, scale), c)
            best = best.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(best, pa.int32()), pa.array([long(d) for d in dist], pa.int64()), pa.array([long(last[b]) for b in best], pa.int64()), pa.array([total] * len(best), pa.int64()), pa.array([digests[b] for b in best], pa.string())],
                names=[id, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return vectors.mapInArrow(tidy(run), schema)
