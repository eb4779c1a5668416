"""Centroid clustering of whole-number vectors: sorted centroids, search outward from a vector's mean, exact distances."""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.session import cut_lineage

# With components below 2**30 / dims, sums, deviations and distances of vectors are exact in 64 bits.
SAFE = 1 << 30
# Sums leave a task in pieces of 40 bits, which Spark can add up for any number of tasks.
PIECE = 40
MOST = (1 << 63) - 1


class Clusters(NamedTuple):
    assigned: DataFrame
    centroids: DataFrame


class Centroids:
    """Centroids in ascending order of their mean, searched outward from the mean of a vector.

    Sums stand for means and ``spread`` (dims times the squared deviation) for variances. With dims times the
    squared distance D: (sum - sum')**2 <= D bounds all centroids beyond, (sum - sum')**2 + (sqrt(spread) - sqrt(spread'))**2 <= D
    one of them. Equality does not reject, as the smaller number wins ties.
    """

    def __init__(self, rows: Sequence[Sequence[int]]):
        self.rows = [list(map(int, r)) for r in rows]
        self.dims = len(self.rows[0]) if self.rows else 0
        sums = [sum(r) for r in self.rows]
        self.order = sorted(range(len(self.rows)), key=lambda c: (sums[c], c))
        self.sums = [sums[c] for c in self.order]
        self.spreads = [self.dims * sum(x * x for x in self.rows[c]) - s * s for c, s in zip(self.order, self.sums)]
        self.safe = all(abs(x) * self.dims <= SAFE for r in self.rows for x in r)

    def nearest(self, vector: Sequence[int]) -> tuple[int, int]:
        """Number of the nearest centroid and the squared distance; whole numbers of any size."""
        total = sum(vector)
        spread = self.dims * sum(x * x for x in vector) - total * total
        right = bisect.bisect_left(self.sums, total)
        left, best = right - 1, None
        while left >= 0 or right < len(self.sums):
            if right == len(self.sums) or (left >= 0 and total - self.sums[left] <= self.sums[right] - total):
                at, left = left, left - 1
            else:
                at, right = right, right + 1
            gap = (total - self.sums[at]) ** 2
            if best and gap > self.dims * best[0]:
                break
            # the difference of the roots, rounded towards 0
            low, high = sorted((spread, self.spreads[at]))
            if best and gap + max(0, math.isqrt(high) - math.isqrt(low) - 1) ** 2 > self.dims * best[0]:
                continue
            found = (sum((x - y) ** 2 for x, y in zip(vector, self.rows[self.order[at]])), self.order[at])
            best = min(best, found) if best else found
        return best[1], best[0]

    def nearest_rows(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for rows of 64-bit numbers in the safe range, all rows a step outward at a time."""
        n, k = len(vectors), len(self.rows)
        table = np.array([self.rows[c] for c in self.order], dtype=np.int64)
        sums, number = np.array(self.sums, dtype=np.int64), np.array(self.order, dtype=np.int64)
        roots = np.sqrt(np.array(self.spreads, dtype=np.int64))
        total = vectors.sum(axis=1)
        root = np.sqrt(self.dims * np.einsum("ij,ij->i", vectors, vectors) - total * total)
        right = np.searchsorted(sums, total)
        left = right - 1
        best, found = np.full(n, MOST // max(self.dims, 1)), np.full(n, k)
        rows = np.arange(n)
        for _ in range(k):
            l, r = left[rows], right[rows]
            t = total[rows]
            below = np.where(l >= 0, t - sums[np.maximum(l, 0)], MOST)
            above = np.where(r < k, sums[np.minimum(r, k - 1)] - t, MOST)
            go_left = below <= above
            at = np.where(go_left, l, r)
            left[rows] -= go_left
            right[rows] += ~go_left
            gap = np.minimum(below, above) ** 2
            ok = gap <= self.dims * best[rows]
            rows, at, gap = rows[ok], at[ok], gap[ok]
            # the difference of the roots is a little too small, never too large
            apart = np.maximum(np.abs(root[rows] - roots[at]) - 1e-5, 0).astype(np.int64)
            near = gap + apart * apart <= self.dims * best[rows]
            tried, c = rows[near], at[near]
            step = vectors[tried] - table[c]
            distance = np.einsum("ij,ij->i", step, step)
            better = (distance < best[tried]) | ((distance == best[tried]) & (number[c] < found[tried]))
            best[tried[better]], found[tried[better]] = distance[better], number[c][better]
            rows = rows[(left[rows] >= 0) | (right[rows] < k)]
            if not len(rows):
                break
        return found, best


def whole_numbers(vectors: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``key`` and floor(scale * component) of every vector with ``dims`` components, none null or non-finite.

    ``whole`` holds them as 32-bit numbers if all are in the safe range; otherwise ``wide`` holds them as decimal strings.
    """
    limit = SAFE // dims
    schema = T.StructType([T.StructField("__key", vectors.schema[key].dataType), T.StructField("whole", T.ArrayType(T.IntegerType())),
                           T.StructField("wide", T.ArrayType(T.StringType()))])
    slim = vectors.select(F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("__vector")).where(F.size("__vector") == dims)

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)
            kept = np.flatnonzero(np.isfinite(values).all(axis=1))
            values = values[kept]
            with np.errstate(over="ignore"):
                floors = np.floor(values * scale)
            safe = (np.abs(floors) <= limit).all(axis=1)
            small = np.where(safe[:, None], floors, 0).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * dims), pa.array(small.ravel()), mask=pa.array(~safe))
            wide = pa.array([None if s else [str(_floor(x, scale)) for x in v] for s, v in zip(safe, values)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), whole, wide], names=schema.names)

    return slim.mapInArrow(run, schema)


def _floor(x: float, scale: int) -> int:
    over, under = x.as_integer_ratio()
    return over * scale // under


def _rows(batch, dims: int):
    """Rows in the safe range as a table of numbers, the others as lists of whole numbers, both with their places."""
    whole, wide = batch.column("whole"), batch.column("wide")
    safe = np.flatnonzero(whole.is_valid().to_numpy(zero_copy_only=False))
    numbers = whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(safe), dims)
    return safe, numbers, [(at, list(map(int, v))) for at, v in enumerate(wide.to_pylist()) if v is not None]


def _assign(batch, centroids: Centroids):
    """Number and distance of every row of a batch."""
    safe, numbers, wide = _rows(batch, centroids.dims)
    cluster, distance = [0] * batch.num_rows, [0] * batch.num_rows
    if centroids.safe:
        found = zip(safe.tolist(), *(a.tolist() for a in centroids.nearest_rows(numbers)))
    else:
        found = ((at, *centroids.nearest(v)) for at, v in zip(safe.tolist(), numbers.tolist()))
    for at, c, d in found:
        cluster[at], distance[at] = c, d
    for at, vector in wide:
        cluster[at], distance[at] = centroids.nearest(vector)
    return cluster, distance, safe, numbers, wide


def _pieces(total: int) -> Iterator[tuple[int, int]]:
    """A whole number as pieces of 40 bits; the last one has the sign."""
    at = 0
    while not -(1 << PIECE) < total < 1 << PIECE:
        yield at, total & ((1 << PIECE) - 1)
        total, at = total >> PIECE, at + 1
    yield at, total


def _sums(centroids: Centroids) -> Callable:
    k, dims = len(centroids.rows), centroids.dims

    def run(batches):
        count, total, more = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64), {}
        for batch in batches:
            cluster, _, safe, numbers, wide = _assign(batch, centroids)
            cluster = np.array(cluster, dtype=np.int64)
            count += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster[safe]):
                total[c] += numbers[cluster[safe] == c].sum(axis=0)
            for at, vector in wide:
                held = more.setdefault(int(cluster[at]), [0] * dims)
                more[int(cluster[at])] = [a + b for a, b in zip(held, vector)]
        out = []
        for c in np.flatnonzero(count).tolist():
            out.append((c, -1, 0, int(count[c])))
            sums = [a + b for a, b in zip(total[c].tolist(), more.get(c, [0] * dims))]
            out.extend((c, position, at, piece) for position, s in enumerate(sums) for at, piece in _pieces(s))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                         names=["cluster", "position", "piece", "value"])

    return run


def _moved(whole: DataFrame, centroids: Centroids) -> Centroids:
    """Every centroid at the floor of the mean of its vectors; those without vectors stay."""
    sums = whole.mapInArrow(_sums(centroids), "cluster int, position int, piece int, value long")
    totals: dict[tuple[int, int], int] = {}
    # at most clusters x (dims + 1) x pieces rows: the size of the model
    for r in sums.groupBy("cluster", "position", "piece").agg(F.sum("value").alias("value")).collect():
        totals[r.cluster, r.position] = totals.get((r.cluster, r.position), 0) + (r.value << (PIECE * r.piece))
    rows = [[totals[c, p] // totals[c, -1] for p in range(centroids.dims)] if (c, -1) in totals else row for c, row in enumerate(centroids.rows)]
    return Centroids(rows)


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 1024, clusters: int = 8, rounds: int = 10,
                    seed: int = 3) -> Clusters:
    """Exact clustering by ``rounds`` rounds of moving centroids, in whole numbers.

    The project keeps no vectors, so any table with a key and an array column will do. Vectors with exactly ``dims`` components, none null or
    non-finite, take part, each component as floor(scale * component). Centroids 0, 1, ... start as the ``clusters`` vectors with the
    smallest SHA-256 of ``<seed>:<key>``, in that order. A round gives every vector to the nearest centroid (squared Euclidean
    distance; ties: smaller number) and moves each centroid to the floor of its vectors' mean; one without vectors stays.

    Gives ``assigned`` (``key``, ``cluster``, ``distance``, ``cluster_inertia`` and ``inertia``: distances summed over the cluster and over
    all) and ``centroids`` (``cluster``, ``n``, ``centroid`` as decimal strings). Vectors are written once as whole numbers and read each round;
    a round shuffles one partial sum for each task, centroid and component. The model, clusters x dims numbers, lies on the driver and travels to the tasks.

    Equal keys are told apart by their vectors at the start, and each row is assigned. A null key takes the last places at the start. Fewer
    vectors than centroids: as many centroids as vectors. No vectors: no rows. Distances and sums that no long can hold are null.
    """
    whole = cut_lineage(whole_numbers(vectors, key, vector, dims, scale))
    kind = whole.schema["__key"].dataType
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__key").cast("string")), 256)
    starts = whole.orderBy(digest.asc_nulls_last(), "whole", "wide").limit(clusters).collect()
    centroids = Centroids([r.whole if r.whole is not None else r.wide for r in starts])
    spark = vectors.sparkSession
    if not starts:
        return Clusters(spark.createDataFrame([], T.StructType([T.StructField(key, kind)])).withColumns(
            {"cluster": F.lit(0), "distance": F.lit(0).cast("long"), "cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long")}),
            spark.createDataFrame([], "cluster int, n long, centroid array<string>"))
    for _ in range(rounds):
        centroids = _moved(whole, centroids)

    def last(batches):
        for batch in batches:
            cluster, distance, *_ = _assign(batch, centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster, pa.int32()), pa.array([d if d <= MOST else None for d in distance], pa.int64())],
                                             names=["__key", "cluster", "distance"])

    schema = T.StructType([T.StructField("__key", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    given = cut_lineage(whole.mapInArrow(last, schema))
    exact = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    totals = given.groupBy("cluster").agg(exact.alias("s"), F.count(F.lit(1)).alias("n")).collect()
    known = {r.cluster: r for r in totals}
    whole_sum = None if any(r.s is None for r in totals) else sum(int(r.s) for r in totals)
    model = spark.createDataFrame(
        [(c, known[c].n if c in known else 0, [str(x) for x in row], _long(int(known[c].s) if c in known and known[c].s is not None else None), _long(whole_sum))
         for c, row in enumerate(centroids.rows)], "cluster int, n long, centroid array<string>, cluster_inertia long, inertia long")
    assigned = given.join(model.select("cluster", "cluster_inertia", "inertia"), "cluster")
    return Clusters(assigned.select(F.col("__key").alias(key), "cluster", "distance", "cluster_inertia", "inertia"), model.select("cluster", "n", "centroid"))


def _long(x: int | None) -> int | None:
    return x if x is not None and x <= MOST else None
