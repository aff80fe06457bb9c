"""Operator 11: Lloyd's clustering with Hamerly's bounds over exact integers.

A vector is kept if it has exactly `size` components, all finite; component x becomes the integer floor(scale * x).  Each vector's row
carries its cluster, an upper bound of the distance to its centroid and a lower bound of that to any other.  A round
loosens both by the centroids' drift; where the upper one is still smaller, or smaller than half the way to the nearest
other centroid, the cluster stands unlooked at.  Otherwise the upper bound is made exact, and what is still ambiguous gets a
scan of all centroids in exact integers, with ties to the smaller number.  Bounds are floats that err to the safe side; all
distances that decide are integers.

A round reads and writes the rows once, then adds up only the vectors that moved: each task gives at most a row for each centroid,
and the driver holds k centroids and their sums.  Rows are written to the shared folder, so a lost executor costs its tasks only.

Repeated rows count each; of rows with one hash the smaller vector is the earlier centroid; a null id hashes as empty.  Fewer vectors than k: as many centroids.
Nulls, other lengths and non-finite components drop the row; an empty table gives no rows.  Components beyond 2**27 in size
are an error, since squared distances would not fit a long.  Further columns change nothing.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import drop, written

#: Largest component, and the largest for which all products and sums are exact in doubles.
MOST, EXACT = 1 << 27, 1 << 22
#: Relative error that bounds allow for; far above that of a few operations on doubles.
SLACK = 1e-12


def whole(batch: pa.RecordBatch, size: int, scale: int) -> pa.RecordBatch:
    """(vec_id, v) of the rows that are kept; v holds little-endian 32-bit integers."""
    column = batch.column("v")
    lengths = np.where(column.is_valid().to_numpy(False), column.value_lengths().fill_null(-1).to_numpy(False), -1)
    some = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(some)).flatten()
    x = flat.fill_null(np.nan).to_numpy(False).reshape(-1, size)
    good = np.isfinite(x).all(axis=1)
    x = np.floor(x[good] * scale)
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"a component beyond {MOST} after scaling: squared distances would not fit a long")
    return pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(some[good])), _binary(x.astype("<i4"))], ["vec_id", "v"])


def _binary(x: np.ndarray) -> pa.Array:
    at = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def vectors(column: pa.Array, size: int) -> np.ndarray:
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros((0, size), np.int64)
    begin = int(np.frombuffer(at, np.int32)[column.offset])
    return np.frombuffer(data, "<i4", len(column) * size, begin).reshape(-1, size).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:  # every product and sum below 2**53
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([_to(x, y) for y in c], axis=1)


def _to(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def above(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float)) * (1 + SLACK)


def below(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float)) * (1 - SLACK)


def assign(x: np.ndarray, centroids: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, drift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower) of each vector, and how many were scanned in full; state: the same of the round before, when the centroids had not yet drifted."""
    k = len(centroids)
    if state is None:
        cluster, upper, lower = np.full(len(x), -1, np.int32), np.full(len(x), np.inf), np.zeros(len(x))
        open_ = np.arange(len(x))
    else:
        cluster, upper, lower = (a.copy() for a in state)
        far = np.argsort(drift)
        others = np.where(np.arange(k) == far[-1], drift[far[-2]] if k > 1 else 0.0, drift[far[-1]])
        upper = (upper + drift[cluster]) * (1 + SLACK)
        lower = lower - others[cluster]
        lower -= SLACK * np.abs(lower) + SLACK * others[cluster]
        apart = squared(centroids, centroids)
        np.fill_diagonal(apart, np.iinfo(np.int64).max)
        half = below(apart.min(axis=1)) / 2 if k > 1 else np.full(1, np.inf)
        safe = np.maximum(lower, half[cluster])
        open_ = np.flatnonzero(~(upper < safe))
        upper[open_] = above(_to(x[open_], centroids[cluster[open_]]))
        open_ = open_[~(upper[open_] < safe[open_])]
    for lo in range(0, len(open_), 4096):
        some = open_[lo : lo + 4096]
        d = squared(x[some], centroids)
        cluster[some] = best = d.argmin(axis=1)
        row = np.arange(len(some))
        upper[some] = above(d[row, best])
        d[row, best] = np.iinfo(np.int64).max
        lower[some] = below(d.min(axis=1)) if k > 1 else np.inf
    return cluster, upper, lower, len(open_)


STATE = "vec_id long, v binary, cluster int, was int, upper double, lower double"
_state = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("was", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64())])


def _round(size: int, centroids: np.ndarray, drift: np.ndarray | None):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, state = vectors(batch.column("v"), size), None
            if drift is not None:
                state = tuple(batch.column(c).to_numpy(False) for c in ("cluster", "upper", "lower"))
            cluster, upper, lower, _ = assign(x, centroids, state, drift)
            was = state[0] if state else np.full(len(x), -1, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster), pa.array(was), pa.array(upper), pa.array(lower)], schema=_state)

    return run


def _last(size: int, centroids: np.ndarray, drift: np.ndarray):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors(batch.column("v"), size)
            cluster, _, _, _ = assign(x, centroids, tuple(batch.column(c).to_numpy(False) for c in ("cluster", "upper", "lower")), drift)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(_to(x, centroids[cluster]))], ["vec_id", "cluster", "distance"])

    return run


def _moved(size: int, k: int):
    """What each cluster gained and lost in one task: its count, and its sums by component."""

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            x = vectors(batch.column("v"), size)
            for name, sign in (("cluster", 1), ("was", -1)):
                at = batch.column(name).to_numpy(False)
                order = np.argsort(at, kind="stable")
                order = order[at[order] >= 0]
                if len(order):
                    first = np.flatnonzero(np.diff(at[order], prepend=-1))
                    sums[at[order][first]] += sign * np.add.reduceat(x[order], first, axis=0)
                    n += sign * np.bincount(at[order], minlength=k)
        some = np.flatnonzero((n != 0) | sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, salt: str = "2", id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of the kept vectors after the rounds, stored, and the final centroids.

    The first centroids are the k vectors with the smallest sha256 of `salt:id`, in that order.  A round assigns each vector to
    the nearest centroid and moves each centroid that has vectors to the floor of their mean; a last assignment follows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"))
    state = written(rows.mapInArrow(lambda batches: (whole(b, size, scale) for b in batches), "vec_id long, v binary"), "vectors")
    first = state.orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "v").limit(k).collect()
    if not first:
        drop(state)
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    k = len(first)
    centroids = np.stack([np.frombuffer(r["v"], "<i4").astype(np.int64) for r in first])
    n, sums, drift = [0] * k, [[0] * size for _ in range(k)], None
    for _ in range(rounds):
        after = written(state.mapInArrow(_round(size, centroids, drift), STATE), "vectors")
        drop(state)
        state = after
        parts = state.filter("cluster <> was").select("cluster", "was", "v").mapInArrow(_moved(size, k), "cluster int, n long, sums array<long>")
        total = lambda c: F.sum(c.cast("decimal(38,0)"))
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(total(F.get("sums", F.lit(i))) for i in range(size))).alias("sums")).collect():
            n[r["cluster"]] += r["n"]
            sums[r["cluster"]] = [a + int(b) for a, b in zip(sums[r["cluster"]], r["sums"], strict=True)]
        moved = np.array([[s // n[j] for s in sums[j]] if n[j] else centroids[j] for j in range(k)], np.int64)
        drift = above(np.array([_to(moved[j : j + 1], centroids[j])[0] for j in range(k)]))
        centroids = moved
    if drift is None:
        state = written(state.mapInArrow(_round(size, centroids, None), STATE), "vectors")
        drift = np.zeros(k)
    out = written(state.mapInArrow(_last(size, centroids, drift), "vec_id long, cluster int, distance long"), "clusters")
    drop(state)
    return out, centroids.tolist()


def clustered(df: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, salt: str = "2") -> DataFrame:
    """cluster() with the sum of distances of each cluster and of all, and a digest of the cluster's centroid."""
    found, centroids = cluster(df, k, rounds, size, scale, salt)
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    table = lambda values, kind: F.get(F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>"), F.col("cluster"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    each = [Decimal(inertia.get(j, 0)) for j in range(len(centroids))] or [Decimal(0)]
    return found.withColumns({"cluster_inertia": table(each, "bigint"), "inertia": F.lit(sum(inertia.values())).cast("long"), "centroid_sha256": table(digests or [""], "string")})
