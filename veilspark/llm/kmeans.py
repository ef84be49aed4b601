"""Exact rounds of centroid clustering over integer vectors, with bounds loosened by planar geometry.

Each vector keeps an upper bound on the distance to its centroid and a lower bound on that to all others. While the
upper one is smaller, the vector stays where it is without a look at other centroids. When centroids move, upper
bounds grow by the own centroid's drift. Lower ones need not shrink by another's whole drift: all vectors of a cluster
lie in a sphere around its old centroid, and how much nearer a centroid that moves from p to q can come to a point x is

    |x - p| - |x - q|  =  2 (x - m)(q - p) / (|x - p| + |x - q|)  <=  |q - p| cos a,        m = (p + q) / 2,

a being the angle at m between x and q (as |x - p| + |x - q| >= 2 |x - m|). In the plane of p, q and the sphere's
centre, the sphere with radius r and distance D from m takes an angle of asin(r / D) to each side of its centre, so
that the greatest cosine in it is known; it is 1 only if the sphere meets the line from m in q's direction, and a
centroid that moves away from the whole sphere takes nothing off. Vectors whose bounds meet are scanned exactly.

All sums are integers, so results don't depend on how the vectors are dealt out. A pass writes the vectors with their
bounds and, from each task, what it adds to the clusters' sums; only these sums, k rows after a grouping, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, map_arrow, materialize

#: Greatest absolute integer component: distances then have 62 bits. Greatest for which products of doubles are exact.
MOST, EXACT = 1 << 27, 1 << 20
#: What bounds are widened by, more than rounding can take off.
SLACK = 1e-9
VECTOR = "v array<int>, cluster int, upper double, lower double, n long, sums array<long>, radius double"


def integers(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component, of the rows with exactly `dims` components, none null or non-finite."""
    x = F.col("embedding")
    good = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    fits = F.forall(whole, lambda e: F.abs(e) <= MOST)
    return vectors.where(good).select("vec_id", F.when(fits, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST} / {scale}")).cast("array<bigint>")).cast("array<int>").alias("v"))


def seeds(points: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hashes, of equal ones those with the smaller components; fewer if there are no more."""
    rows = points.orderBy(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        fx, fc = x.astype(np.float64), c.astype(np.float64)
        return ((fx * fx).sum(1)[:, None] + (fc * fc).sum(1) - 2 * (fx @ fc.T)).astype(np.int64)
    return ((x * x).sum(1)[:, None] + (c * c).sum(1)) - 2 * (x @ c.T)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(drift of each centroid, by how much the distance of each cluster's vectors to another centroid can have shrunk)."""
    p, q = old.astype(np.float64), new.astype(np.float64)
    drift, middle = np.sqrt(((q - p) ** 2).sum(1)), (p + q) / 2
    off = p[:, None, :] - middle[None, :, :]  # of cluster i's centre from centroid j's middle
    far = np.sqrt((off**2).sum(2))
    along = (off * (q - p)[None, :, :]).sum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip(along / (far * drift[None, :]), -1, 1))
        half = np.arcsin(np.clip(radius[:, None] / far, 0, 1))
        most = drift[None, :] * np.clip(np.cos(np.maximum(angle - half, 0)), 0, 1)
    most = np.where(radius[:, None] >= far * (1 - SLACK), drift[None, :], most)
    most = np.where(drift[None, :] == 0, 0.0, most)
    np.fill_diagonal(most, 0.0)
    return drift * (1 + SLACK), most.max(1) * (1 + SLACK) + SLACK * (drift.max() > 0)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower) by a scan of all centroids; of equally near ones the first."""
    d = squared(x, c)
    best = d.argmin(1)
    upper = np.sqrt(d[np.arange(len(d)), best]) * (1 + SLACK)
    lower = np.sqrt(np.partition(d, 1, axis=1)[:, 1]) * (1 - SLACK) if len(c) > 1 else np.full(len(d), np.inf)
    return best, upper, lower


def own_distance(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    gap = x - c[cluster]
    return (gap * gap).sum(1)


def moved(x: np.ndarray, c: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray, loose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, scanned vectors) after the centroids moved."""
    upper, lower = upper + drift[cluster], lower - loose[cluster]
    unsure = np.flatnonzero(upper >= lower)
    if len(unsure):
        upper[unsure] = np.sqrt(own_distance(x[unsure], c, cluster[unsure])) * (1 + SLACK)
        unsure = unsure[upper[unsure] >= lower[unsure]]
    if len(unsure):
        cluster = cluster.copy()
        cluster[unsure], upper[unsure], lower[unsure] = nearest(x[unsure], c)
    return cluster, upper, lower, len(unsure)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1), kind))


def assign(points: DataFrame, centres: np.ndarray, change: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """points (vec_id, v and, if change has what loosening() gives, cluster and bounds) with new clusters and bounds; and a row
    for each task and cluster with n, sums of its vectors, and their radius, the greatest upper bound."""
    k, dims = centres.shape
    first = change is None
    vec_id = points.schema["vec_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, radius, ids = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k), None
        for b in batches:
            ids = b.column(0)
            if not len(ids):
                continue
            x = _matrix(b.column(1), dims)
            if first:
                cluster, upper, lower = nearest(x, centres)
            else:
                cluster, upper, lower, _ = moved(x, centres, *(b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4)), *change)
            order = np.argsort(cluster, kind="stable")
            there, begin = np.unique(cluster[order], return_index=True)
            total[there] += np.add.reduceat(x[order], begin)
            count += np.bincount(cluster, minlength=k)
            np.maximum.at(radius, cluster, upper)
            n = len(ids)
            yield pa.RecordBatch.from_arrays([ids, b.column(1), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.float64())], names)
        there = np.flatnonzero(count)
        if len(there):
            n, none = len(there), pa.nulls(len(there), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, ids.type), pa.nulls(n, pa.list_(pa.int32())), pa.array(there, pa.int32()), none, none, pa.array(count[there]), _lists(total[there], pa.int64()), pa.array(radius[there])], names)

    names = ["vec_id", "v", "cluster", "upper", "lower", "n", "sums", "radius"]
    columns = ["vec_id", "v"] + ([] if first else ["cluster", "upper", "lower"])
    return map_arrow(points.select(*columns), run, f"vec_id {vec_id.simpleString()}, {VECTOR}")


def replaced(table: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new centroids, radius of each cluster around the old one) from the tasks' rows of a written pass."""
    parts = table.where("n is not null")
    sums = parts.select("cluster", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new, radius = centres.copy(), np.zeros(len(centres))
    count = {}
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect():
        count[r.cluster], radius[r.cluster] = r.n, r.radius
    for r in sums.collect():  # k * dims rows
        new[r.cluster, r["at"]] = int(r.s) // count[r.cluster]
    return new, radius


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """(rows vec_id, v, cluster, distance, written to the shared folder; centroids): k centroids after so many rounds, and the vectors assigned to them.

    Vectors count that have exactly `dims` components, none null or non-finite, as integers floor(scale * x); one beyond
    2 ** 27 raises an error. Centroids start as the k vectors with the smallest sha256 of salt and vec_id (null: the
    salt alone), of equal ones those with smaller components; if there are fewer vectors, all of them. Vectors as near to
    two centroids belong to the one with the smaller number. Rows that repeat count each; an empty table gives an empty
    result. Columns besides vec_id and embedding are not looked at.
    """
    points = integers(vectors, dims, scale)
    centres = seeds(points, k, salt)
    if not len(centres):
        return points.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dims), np.int64)
    table, change = None, None
    for _ in range(rounds):
        before, table = table, materialize(assign(points if table is None else table.where("n is null"), centres, change), "bounds")
        if before is not None:
            drop_table(before)
        old = centres
        centres, radius = replaced(table, old)
        change = loosening(old, centres, radius)
    last = materialize(assign(points if table is None else table.where("n is null"), centres, change), "assigned")
    if table is not None:
        drop_table(table)
    rows = last.where("n is null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = own_distance(_matrix(b.column(1), dims), centres, b.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    return map_arrow(rows.select("vec_id", "v", "cluster"), run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v array<int>, cluster int, distance long"), centres


def digest(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of cluster()."""
    rows, centres = cluster(vectors, **options)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    found = rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect() if sha else []  # k rows
    inertia = {r.cluster: r.s for r in found}
    values = F.array(*[F.struct(F.lit(inertia.get(i, 0)).cast("long").alias("s"), F.lit(x).alias("sha")) for i, x in enumerate(sha or [""])])
    mine = F.element_at(values, F.col("cluster") + 1)
    return rows.select("vec_id", "cluster", "distance", mine["s"].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), mine["sha"].alias("centroid_sha256"))
