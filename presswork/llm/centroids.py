"""Clustering of vectors around centroids, with exact whole numbers and a Walsh-Hadamard search.

The transform of a vector of 64 whole numbers has whole coefficients, and the sum of the squared
differences of all 64 of two vectors is 64 times their squared distance. A sum over some
coefficients is at most that, so it tells that a centroid is too far before all are seen.
"""

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import scaled
from .shared import stored

DIMS = 64
CLUSTERS = 40
ROUNDS = 5
#: Numbers of coefficients after which centroids are eliminated.
STEPS = (4, 8, 16, 32)
#: Components up to here keep every sum of squares within 64 bits; beyond, Python's numbers are used.
SMALL = 1 << 20
#: Rows that are compared with all centroids at once.
ROWS = 2048
LARGEST = (1 << 63) - 1


def transformed(points: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose length is a power of two; coarse to fine.

    The first ``2^k`` coefficients only see the sums of ``2^k`` equal blocks of
    neighbouring components (the natural order with the bits of each place reversed).
    """
    rows, size = points.shape
    span = 1
    while span < size:
        pairs = points.reshape(rows, size // (2 * span), 2, span)
        points = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]],
                          axis=2).reshape(rows, size)
        span *= 2
    bits = size.bit_length() - 1
    return points[:, [int(f"{i:0{bits}b}"[::-1], 2) for i in range(size)] if bits else [0]]


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Number and squared distance of each point's nearest centroid, of equal ones the smaller number.

    Squared coefficient differences are added coarse to fine. After each step the
    centroid with the least sum so far is finished; all whose sum is strictly
    more than the least finished one are out. What is left in the end has all 64.
    Also returns how many pairs of point and centroid each step still had.
    """
    large = max(int(np.abs(a).max(initial=0)) for a in (points, centroids)) > SMALL
    kind = object if large else np.int64
    x, c = transformed(points.astype(kind)), transformed(centroids.astype(kind))
    count, dims = x.shape
    row = np.repeat(np.arange(count), len(c))
    of = np.tile(np.arange(len(c)), count)
    total = np.zeros(len(row), kind)
    finished = None
    seen, alive = 0, []
    for to in [s for s in STEPS if s < dims] + [dims]:
        alive.append(len(row))
        if seen:
            part = x[row, seen:to] - c[of, seen:to]
            total = total + (part * part).sum(axis=1)
        else:
            part = x[:, None, :to] - c[None, :, :to]
            total = (part * part).sum(axis=2).reshape(-1)
        seen = to
        if to == dims:
            break
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.minimum.reduceat(total, start)
        leads = np.flatnonzero(total == np.repeat(least, np.diff(np.append(start, len(row)))))
        lead = leads[np.concatenate([[True], row[leads[1:]] != row[leads[:-1]]])]
        rest = x[:, to:] - c[of[lead], to:]
        whole = least + (rest * rest).sum(axis=1)
        finished = whole if finished is None else np.minimum(finished, whole)
        open_ = total <= finished[row]
        row, of, total = row[open_], of[open_], total[open_]
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    least = np.minimum.reduceat(total, start)
    at = np.flatnonzero(total == np.repeat(least, np.diff(np.append(start, len(row)))))
    at = at[np.concatenate([[True], row[at[1:]] != row[at[:-1]]])]
    return of[at], total[at] // dims, alive


def whole(vector: Column, dims: int = DIMS) -> Column:
    """floor(256 * x) of each component; null for vectors of another length or with a null or non-finite one."""
    return F.when(F.size(vector) == dims, scaled(vector))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, _matrix(part["v"], dims)


def _starts(rows: DataFrame, clusters: int) -> list[list[int]]:
    """The vectors that centroids start as: those with the least hash of ``2:`` and the id."""
    mark = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    least = (rows.select(mark.alias("mark"), "v")
             .orderBy(F.asc_nulls_last("mark"), "v").limit(clusters))
    return [r.v for r in least.collect()]


def _means(rows: DataFrame, centroids: np.ndarray, dims: int) -> dict[int, list[int]]:
    """The new place of each centroid that has vectors: floor(sum / count) per component.

    Each task sends one row per centroid and component, so the shuffle and what
    the driver gets (centroids times components) do not grow with the vectors.
    """
    def sums(batches):
        total = np.zeros(centroids.shape, object)
        count = np.zeros(len(centroids), np.int64)
        for _, points in _blocks(batches, dims):
            of, _, _ = nearest(points, centroids)
            if int(np.abs(points).max(initial=0)) <= SMALL:
                part = np.zeros(centroids.shape, np.int64)
                np.add.at(part, of, points)
                total += part
            else:
                np.add.at(total, of, points.astype(object))
            count += np.bincount(of, minlength=len(centroids))
        found = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(found, dims).astype(np.int32)),
             pa.array(np.tile(np.arange(dims), len(found)).astype(np.int32)),
             pa.array([Decimal(int(s)) for s in total[found].reshape(-1)], pa.decimal128(38, 0)),
             pa.array(np.repeat(count[found], dims))], ["cluster", "place", "total", "members"])

    parts = rows.mapInArrow(sums, "cluster int, place int, total decimal(38,0), members long")
    means: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "place").agg(
            F.sum("total").alias("total"), F.sum("members").alias("members")).collect():
        means.setdefault(r.cluster, [0] * dims)[r.place] = int(r.total) // r.members
    return means


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of ``dims`` (a power of two) components, none of them null or
    non-finite, take part with floor(256 * x) of each. Centroids start as the
    ``clusters`` vectors (all, if fewer) with the smallest hex SHA-256 of ``2:``
    and the id, ties by the vector, null ids last. Each of ``rounds`` rounds gives
    every vector to its nearest centroid by squared distance, of equally near
    ones the smaller number, and moves each centroid that has vectors to the
    floor of their mean. In the end vectors are given once more.

    Null ids are kept like others; repeated rows count and come out as often as
    they are there. Other columns are not read. No vector, an empty result.
    Distances and sums beyond the range of a long stop at its end.

    A round is one pass over the vectors, written once as whole numbers. A task
    holds the centroids and some thousand vectors; the driver the centroids only.
    """
    if dims < 1 or dims & (dims - 1):
        raise ValueError("the transform needs a power of two components")
    rows = stored(vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                                 whole(F.col(vector_col), dims).alias("v"))
                  .where("v is not null"), "whole-vectors")
    places = _starts(rows, clusters)
    for _ in range(rounds if places else 0):
        for number, mean in _means(rows, _table(places, dims), dims).items():
            places[number] = mean
    centroids = _table(places, dims)

    def assign(batches):
        for part, points in _blocks(batches, dims):
            of, far, _ = nearest(points, centroids)
            yield pa.RecordBatch.from_arrays(
                [part["vec_id"], pa.array(of.astype(np.int32)),
                 pa.array([min(int(d), LARGEST) for d in far], pa.int64())],
                ["vec_id", "cluster", "distance"])

    given = stored(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clustered")
    own = {r.cluster: int(r.own) for r in given.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}
    everything = min(sum(own.values()), LARGEST)
    named = given.sparkSession.createDataFrame(
        [(n, min(total, LARGEST), everything,
          hashlib.sha256(",".join(map(str, places[n])).encode()).hexdigest())
         for n, total in own.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row per centroid, at most ``clusters``
    return (given.join(F.broadcast(named), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def _table(places: list[list[int]], dims: int) -> np.ndarray:
    return np.array(places, np.int64).reshape(-1, dims)
