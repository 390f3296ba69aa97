"""Exact centroid clustering of integer vectors by Shallot search.

Each vector remembers its centroid, its second-nearest one and bounds on the distances to both, so
most vectors are settled by their bounds after a round. The others start from the closer of the
two remembered centroids and look through that one's neighbours in order of distance, within a
ball that shrinks as nearer ones are found; who survives is compared in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Components of a larger magnitude could make a squared distance overflow a long.
MOST = 1 << 27
#: Bounds are widened by this share, far above the rounding of doubles, so they never lie.
SLACK = 1e-9
STATE = "vec_id long, q binary, near int, second int, upper double, lower double, d2 long"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to a vector or to rows, in integers."""
    diff = x - c
    return np.einsum("ij,ij->i", diff, diff)


class Centres:
    """Centroids, each with the others in order of their distance from it."""

    def __init__(self, at: np.ndarray):
        self.at = at.astype(np.int64)
        k = len(at)
        apart = np.array([squared(self.at, c) for c in self.at]).reshape(k, k)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.order = np.array([o[o != j] for j, o in enumerate(self.order)], dtype=np.int32).reshape(k, max(k - 1, 0))
        self.apart = np.sqrt(np.take_along_axis(apart, self.order, 1).astype(float)) if k > 1 else np.zeros((k, 0))

    @property
    def half(self) -> np.ndarray:
        """Half the distance to the nearest other centroid."""
        return self.apart[:, 0] / 2 if self.apart.shape[1] else np.full(len(self.at), np.inf)


def search(x: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: Centres) -> tuple[np.ndarray, ...]:
    """near, second, upper, lower and the squared distance of each vector, all exact.

    ``upper`` bounds the distance to ``near`` from above, ``lower`` that to any other centroid
    from below. Of equal distances the smaller number is the nearest.
    """
    near, second, upper, lower = near.copy(), second.copy(), upper.copy(), lower.copy()
    d2 = squared(x, centres.at[near])
    if len(centres.at) == 1:
        return near, second, np.sqrt(d2.astype(float)) * (1 + SLACK), np.full(len(x), np.inf), d2
    bar = np.maximum(lower, centres.half[near])
    upper = np.where(upper < bar, upper, np.sqrt(d2.astype(float)) * (1 + SLACK))
    left = np.flatnonzero(upper >= bar)  # not settled by its bounds, or by the exact distance
    if not len(left):
        return near, second, upper, lower, d2
    a, b = near[left], second[left]
    da, db = d2[left], squared(x[left], centres.at[second[left]])
    swap = (db < da) | ((db == da) & (b < a))
    a, b, da, db = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)
    root = a.copy()
    for c in np.unique(root):
        at = np.flatnonzero(root == c)  # those that begin at c look through its neighbours together
        base = np.sqrt(da[at].astype(float)) * (1 + SLACK)
        started = b[at].copy()
        for j, far in zip(centres.order[c], centres.apart[c]):
            # nothing at j or farther from c is as near as the second by now: the ball has shrunk past it
            inside = far <= (base + np.sqrt(db[at].astype(float)) * (1 + SLACK)) * (1 + SLACK)
            if not inside.all():
                at, base, started = at[inside], base[inside], started[inside]
                if not len(at):
                    break
            ask = started != j
            who = at[ask]
            d = squared(x[left[who]], centres.at[j])
            first = (d < da[who]) | ((d == da[who]) & (j < a[who]))
            then = ~first & (d < db[who])
            b[who] = np.where(first, a[who], np.where(then, j, b[who]))
            db[who] = np.where(first, da[who], np.where(then, d, db[who]))
            a[who], da[who] = np.where(first, j, a[who]), np.where(first, d, da[who])
    near[left], second[left], d2[left] = a, b, da
    upper[left], lower[left] = np.sqrt(da.astype(float)) * (1 + SLACK), np.sqrt(db.astype(float)) * (1 - SLACK)
    return near, second, upper, lower, d2


def moved(near: np.ndarray, upper: np.ndarray, lower: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after each centroid has gone ``way``: upper grows by its own, lower loses the others' longest."""
    if len(way) < 2:
        return upper + way[near] * (1 + SLACK), lower
    far, nxt = np.argsort(-way, kind="stable")[:2]
    longest = np.where(near == far, way[nxt], way[far])
    return (upper + way[near] * (1 + SLACK)) * (1 + SLACK), np.maximum((lower - longest * (1 + SLACK)) * (1 - SLACK), 0.0)


def _table(ids, q, near, second, upper, lower, d2) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
    cols = [ids, q, near, second, upper, lower, d2]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in STATE.split(", ")])


def _matrix(q: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(q.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def integer_vectors(embeddings: DataFrame, width: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and q, the components times ``scale`` rounded down, as 32-bit integers.

    Vectors that are null, of another width, hold nulls, non-finite components or ones whose
    integer is beyond ``MOST`` (their distances would overflow a long) are left out.
    """
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.floor(v * F.lit(scale)))
    fine = (F.size("embedding") == width) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) <= F.lit(MOST / scale)))
    rows = embeddings.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("q"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch["q"].flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(batch.num_rows, width)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array([r.tobytes() for r in m], pa.binary())], names=["vec_id", "q"])

    return rows.mapInArrow(pack, "vec_id long, q binary")


def seeds(vectors: DataFrame, k: int, width: int, salt: str = "2:") -> np.ndarray:
    """The k vectors of smallest sha256 of ``salt`` and id: ascending, null ids last, ties by components."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = vectors.select(key.alias("_key"), "q").orderBy(F.asc_nulls_last("_key"), F.hex("q")).limit(k).collect()  # k rows
    return np.array([np.frombuffer(r["q"], "<i4") for r in first], dtype=np.int64).reshape(len(first), width)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scratch: Scratch | None = None, out: str = "final") -> tuple[DataFrame, np.ndarray]:
    """Rows of vec_id, q, near, second, upper, lower, d2 after the rounds, and the centroids.

    A round assigns every vector to its nearest centroid (ties: smaller number) and replaces each
    non-empty centroid by its vectors' mean, rounded down for each component; vectors are then
    assigned once more. The state of a round is one written table, freed when the next is written;
    tasks hold the centroids (k times ``width`` numbers, whatever the table's size), and only
    sums for each task and centroid are shuffled, k times ``width`` of them come to the driver.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "centroids")
    vectors = scratch.save(vectors, "vectors")
    at = seeds(vectors, k, width)

    def assign(centres: Centres, way: np.ndarray | None):
        held = spark.sparkContext.broadcast((centres, way))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, way = held.value
            for batch in batches:
                x, n = _matrix(batch["q"], width), batch.num_rows
                if not n:
                    continue
                if way is None:  # nothing is known yet: bounds that settle nothing
                    near, second = np.zeros(n, np.int32), np.full(n, min(1, len(centres.at) - 1), np.int32)
                    upper, lower = np.full(n, np.inf), np.zeros(n)
                else:
                    near, second = (batch[c].to_numpy() for c in ("near", "second"))
                    upper, lower = moved(near, *(batch[c].to_numpy() for c in ("upper", "lower")), way)
                yield _table(batch["vec_id"], batch["q"], *search(x, near, second, upper, lower, centres))

        return run

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(at), width), np.int64), np.zeros(len(at), np.int64)
        for batch in batches:
            near, x = batch["near"].to_numpy(), _matrix(batch["q"], width)
            count += np.bincount(near, minlength=len(at))
            order = np.argsort(near, kind="stable")
            cuts = np.flatnonzero(np.diff(near[order], prepend=-1))
            if len(order):
                total[near[order][cuts]] += np.add.reduceat(x[order], cuts, axis=0)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(full, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(full))), pa.array(total[full].ravel()), pa.array(np.repeat(count[full], width))],
            names=["near", "place", "total", "count"])

    if not len(at):
        return spark.createDataFrame([], STATE), at
    state, way, before = vectors, None, "vectors"
    for n in range(rounds + 1):
        name = out if n == rounds else f"round{n}"
        state = scratch.save(state.mapInArrow(assign(Centres(at), way), STATE), name)
        scratch.drop(before)
        before = name
        if n < rounds:
            fresh = at.copy()
            for r in state.select("near", "q").mapInArrow(sums, "near int, place int, total long, count long").groupBy("near", "place").agg(F.sum("total").alias("total"), F.sum("count").alias("count")).collect():
                fresh[r["near"], r["place"]] = r["total"] // r["count"]  # rounded down
            way = np.sqrt(squared(fresh, at).astype(float))
            at = fresh
    return state, at


def cluster_embeddings(embeddings: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every
    vector that ``integer_vectors`` keeps.

    Repeated rows and equal ids are vectors like others; equal vectors may start as centroids, of
    which the smaller number takes all and the other stays where it is. With fewer than k vectors
    each is a centroid. Null ids are kept and start as centroids last. Without any vector there
    are no rows. Other columns are left aside.
    """
    import hashlib

    spark = embeddings.sparkSession
    rows, at = cluster(integer_vectors(embeddings.select("vec_id", "embedding"), width, scale), k, rounds, width)
    names = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(at)]
    own = rows.groupBy("near").agg(F.sum("d2").alias("cluster_inertia"))
    whole = own.agg(F.sum("cluster_inertia").alias("inertia")).first()["inertia"]
    told = own.join(spark.createDataFrame(names, "near int, centroid_sha256 string"), "near")  # k rows
    return rows.join(F.broadcast(told), "near").select(
        "vec_id", F.col("near").alias("cluster"), F.col("d2").alias("distance"), "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256")
