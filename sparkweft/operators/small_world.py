"""A layered small-world graph of chunks' vectors, as tables; searches keep to a scope.

Every distinct vector is a node; a hash gives it its level, so that each level has a sixteenth of
the one below. A node is linked with near nodes of its level in different directions. A search
begins at the nearest of the top level and goes down; at the lowest level it walks from node to
node over links, a hop of all queries being one join. Nodes outside the scope are walked over like
others but don't count, so a scope leaves as many results as it has. Links carry half-precision
copies of the vectors, so a hop reads nothing else; results are ranked by the original vectors in
double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import retrieval

NONE = np.iinfo(np.int64).max
STATE = "query long, q binary, ids binary, d binary, flags binary, open boolean, rows long, hops int"
OPEN, INSIDE = 1, 2


@dataclass(frozen=True)
class SmallWorld:
    """Where an index is, the width of its vectors, its top level and its links for each node."""

    spark: SparkSession
    path: str
    dim: int
    top: int
    m: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def links(self, level: int) -> DataFrame:
        return self.table(f"links{level}")


def _units(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Rows whose vector can be used: of ``dim`` finite components, not all zero; adds q, its unit
    vector in half precision."""
    v = F.col(vector)
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(key).isNotNull()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch[vector].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, dim)
            x = x / np.abs(x).max(1, keepdims=True)
            half = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in half], pa.binary())], names=[*batch.schema.names, "q"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.where(fine).mapInArrow(run, f"{kinds}, q binary")


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float16).reshape(-1, dim).astype(np.float32)


def diverse(ids: np.ndarray, d: np.ndarray, v: np.ndarray, m: int) -> np.ndarray:
    """Places of at most m links: by distance, those nearer to the node than to any link kept before;
    if these are fewer, the nearest of the others as well."""
    order = np.lexsort((ids, d))
    order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
    near = 1 - v[order] @ v[order].T
    kept: list[int] = []
    for i in range(len(order)):
        if len(kept) == m:
            break
        if not kept or near[i, kept].min() > d[order[i]]:
            kept.append(i)
    rest = [i for i in range(len(order)) if i not in set(kept)]
    return order[sorted(kept + rest[: m - len(kept)])]


def _pruned(pairs: DataFrame, halves: DataFrame, dim: int, m: int) -> DataFrame:
    """node, to, d, halves: the diverse links among each node's candidates (node, id, d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, near, far = [], [], []
            for x in batch["x"].to_pylist():
                ids, d = np.array([r["id"] for r in x], np.int64), np.array([r["d"] for r in x], np.float32)
                raw = np.frombuffer(b"".join(r["half"] for r in x), np.float16).reshape(-1, dim)
                at = diverse(ids, d, raw.astype(np.float32), m)
                to.append(ids[at])
                far.append(d[at])
                near.append(raw[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(to, pa.list_(pa.int64())), pa.array(far, pa.list_(pa.float32())), pa.array(near, pa.binary())], names=["node", "to", "d", "halves"])

    full = pairs.join(halves.select(F.col("node").alias("id"), "half"), "id")
    return full.groupBy("node").agg(F.collect_list(F.struct("id", "d", "half")).alias("x")).mapInArrow(run, "node long, to array<long>, d array<float>, halves binary")


def _linked(cands: DataFrame, halves: DataFrame, dim: int, m: int, ef: int, scratch: Scratch, name: str) -> DataFrame:
    """Links both ways from candidates (node, ids, d): each node's own diverse ones of the nearest
    ``ef``, then also those that chose it, pruned again. Of those that chose a node the ``ef``
    nearest are looked at, ranked before they are shuffled."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, far = [], []
            for x, d in zip(batch["ids"].to_pylist(), batch["d"].to_pylist()):
                x, at = np.unique(np.array(x, np.int64), return_index=True)
                d = np.array(d, np.float32)[at]
                order = np.argsort(d, kind="stable")[:ef]
                order = order[np.isfinite(d[order])]
                ids.append(x[order])
                far.append(d[order])
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(ids, pa.list_(pa.int64())), pa.array(far, pa.list_(pa.float32()))], names=["node", "ids", "d"])

    lists = cands.groupBy("node").agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("d")).alias("d")).mapInArrow(best, "node long, ids array<long>, d array<float>")
    each = lambda df, col: df.select("node", F.explode(F.arrays_zip(F.col(col).alias("id"), F.col("d").alias("d"))).alias("x")).select("node", "x.id", "x.d")
    own = scratch.save(_pruned(each(lists, "ids"), halves, dim, m).select("node", "to", "d"), f"own{name}")
    own = each(own, "to")
    back = own.select(F.col("id").alias("node"), F.col("node").alias("id"), "d")
    back = back.withColumn("_n", F.row_number().over(W.partitionBy("node").orderBy("d", "id"))).where(F.col("_n") <= ef).drop("_n")
    return _pruned(own.unionByName(back), halves, dim, 2 * m).select("node", "to", "halves")


def _begun(queries: DataFrame, top: tuple[np.ndarray, np.ndarray], dim: int, ef: int) -> DataFrame:
    """The state of a search (query, q) at the top level: the nearest ``ef`` of its nodes, all of which
    are compared; the top level has a bounded number."""
    held = queries.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at = held.value
        for batch in batches:
            n = batch.num_rows
            d = 1 - _matrix(batch["q"], dim) @ at.T
            order = np.argsort(d, axis=1, kind="stable")[:, :ef]
            near, far = np.full((n, ef), NONE), np.full((n, ef), np.inf, np.float32)
            near[:, : order.shape[1]], far[:, : order.shape[1]] = ids[order], np.take_along_axis(d, order, 1)
            yield _state(batch["query"], batch["q"], near, far, np.where(near < NONE, OPEN, 0), np.full(n, len(ids)), np.zeros(n, np.int32))

    return queries.select("query", "q").mapInArrow(run, STATE)


def _state(query, q, ids, d, flags, rows, hops) -> pa.RecordBatch:
    packed = lambda x, kind: pa.array([r.tobytes() for r in np.ascontiguousarray(x.astype(kind))], pa.binary())
    cols = [query, q, packed(ids, np.int64), packed(d, np.float32), packed(flags, np.uint8), pa.array((flags & OPEN).any(1)), pa.array(rows, pa.int64()), pa.array(hops, pa.int32())]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in STATE.split(", ")])


def _beam(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    return tuple(np.frombuffer(b"".join(batch[c].to_pylist()), k).reshape(n, -1) for c, k in (("ids", np.int64), ("d", np.float32), ("flags", np.uint8)))


def _chosen(d: np.ndarray, flags: np.ndarray, ef: int, width: int) -> np.ndarray:
    """The nodes that a hop goes on from: the nearest open ones, no farther than the ef-th inside the scope."""
    inside = (flags & INSIDE) > 0
    nth = np.cumsum(inside, 1)
    bound = np.where(nth[:, -1:] >= ef, np.take_along_axis(d, np.argmax(nth >= ef, 1)[:, None], 1), np.inf)
    may = ((flags & OPEN) > 0) & (d <= bound) & np.isfinite(d)
    return may & (np.cumsum(may, 1) <= width)


def walk(index: SmallWorld, state: DataFrame, level: int, ef: int, scratch: Scratch, width: int = 8, room: int | None = None, inside: DataFrame | None = None) -> DataFrame:
    """The state after a walk at a level: nearest nodes first, until the nearest ``ef`` inside the
    scope have been gone on from.

    ``room`` is how many nodes a query keeps (``ef`` without a scope), ``inside`` the nodes in
    scope (node). A hop joins the nodes chosen with their links; distances are computed there and
    come back to the query as one row. Each hop may take twice as many nodes as the one before.
    """
    dim, room, links, k, scoped = index.dim, room or ef, index.links(level), 0, inside is not None

    def fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All nodes are open again at a new level, and outside the scope until they are looked up."""
        for batch in batches:
            ids, d, _ = _beam(batch)
            n, have = len(ids), min(ids.shape[1], room)
            near, far = np.full((n, room), NONE), np.full((n, room), np.inf, np.float32)
            near[:, :have], far[:, :have] = ids[:, :have], d[:, :have]
            flags = np.where(near < NONE, OPEN | (0 if scoped else INSIDE), 0)
            yield _state(batch["query"], batch["q"], near, far, flags, batch["rows"].to_numpy(), batch["hops"].to_numpy())

    def choose(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, d, flags = _beam(batch)
                who, at = np.nonzero(_chosen(d, flags, ef, width))
                yield pa.RecordBatch.from_arrays([batch["query"].take(pa.array(who)), batch["q"].take(pa.array(who)), pa.array(ids[who, at])], names=["query", "q", "node"])

        return run

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch["to"].offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
            v, q = _matrix(batch["halves"], dim), np.repeat(_matrix(batch["q"], dim), size, axis=0)
            yield pa.RecordBatch.from_arrays([batch["query"], batch["to"], pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array((1 - np.einsum("ij,ij->i", v, q)).astype(np.float32)))], names=["query", "to", "far"])

    def update(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, d, flags = _beam(batch)
                chosen = _chosen(d, flags, ef, width)
                flags = np.where(chosen, flags & ~np.uint8(OPEN), flags)
                met, far, mine = ([x or [] for x in batch[c].to_pylist()] for c in ("to", "far", "mine"))
                size = np.array([len(x) for x in met])
                most = int(size.max(initial=0))
                there = np.arange(most) < size[:, None]
                new, nd, nf = np.full((len(ids), most), NONE), np.full((len(ids), most), np.inf, np.float32), np.zeros((len(ids), most), np.uint8)
                new[there], nd[there] = np.concatenate([np.array(x, np.int64) for x in met]), np.concatenate([np.array(x, np.float32) for x in far])
                nf[there] = OPEN | (INSIDE * np.concatenate([np.array(x, np.uint8) for x in mine]) if scoped else INSIDE)
                ids, d, flags = np.hstack([ids, new]), np.hstack([d, nd]), np.hstack([flags, nf])
                at = np.argsort(ids, axis=1, kind="stable")  # what is known comes before the same node met again
                ids, d, flags = (np.take_along_axis(x, at, 1) for x in (ids, d, flags))
                again = np.zeros(ids.shape, bool)
                again[:, 1:] = ids[:, 1:] == ids[:, :-1]
                ids, d, flags = np.where(again, NONE, ids), np.where(again, np.inf, d), np.where(again, 0, flags)
                at = np.argsort(d, axis=1, kind="stable")[:, :room]
                ids, d, flags = (np.take_along_axis(x, at, 1) for x in (ids, d, flags))
                keeps = _chosen(d, flags, ef, room)  # others are too far to go on from by now
                flags = np.where(keeps, flags, flags & ~np.uint8(OPEN))
                yield _state(batch["query"], batch["q"], ids, d, flags, batch["rows"].to_numpy() + size, batch["hops"].to_numpy() + chosen.any(1))

        return run

    label = f"walk{level}"
    if inside is None:
        state = state.mapInArrow(fresh, STATE)
    else:  # which of the nodes that it begins with are inside
        state = scratch.save(state.mapInArrow(fresh, STATE), f"{label}-begun")
    now, before = scratch.save(state, f"{label}-0") if inside is None else state, f"{label}-0" if inside is None else f"{label}-begun"
    first = inside is not None
    while first or not now.where("open").isEmpty():
        if first:
            asked = now.mapInArrow(_listed, "query long, to array<long>, far array<float>")
        else:
            asked = now.where("open").mapInArrow(choose(width), "query long, q binary, node long").join(links, "node").select("query", "q", "to", "halves").mapInArrow(measure, "query long, to array<long>, far array<float>")
        if inside is None:
            found = asked.groupBy("query").agg(F.flatten(F.collect_list("to")).alias("to"), F.flatten(F.collect_list("far")).alias("far"), F.array().cast("array<tinyint>").alias("mine"))
        else:
            one = asked.select("query", F.explode(F.arrays_zip("to", "far")).alias("x")).select("query", F.col("x.to").alias("node"), F.col("x.far").alias("far"))
            one = one.join(inside.select("node", F.lit(1).cast("tinyint").alias("mine")), "node", "left")
            found = one.groupBy("query").agg(F.collect_list(F.struct("node", "far", F.coalesce("mine", F.lit(0).cast("tinyint")).alias("mine"))).alias("x")).select("query", F.col("x.node").alias("to"), F.col("x.far").alias("far"), F.col("x.mine").alias("mine"))
        k += 1
        joined = now.join(found, "query", "left")
        made = joined.mapInArrow(_marked(ef, room) if first else update(width), STATE)
        now = scratch.save(made, f"{label}-{k}")
        scratch.drop(before)
        before = f"{label}-{k}"
        width, first = width if first else min(2 * width, 128), False
    return now


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that a state holds."""
    for batch in batches:
        ids, d, _ = _beam(batch)
        yield pa.RecordBatch.from_arrays([batch["query"], pa.array([r[r < NONE] for r in ids], pa.list_(pa.int64())), pa.array([x[r < NONE] for r, x in zip(ids, d)], pa.list_(pa.float32()))], names=["query", "to", "far"])


def _marked(ef: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, d, flags = _beam(batch)
            flags = flags.copy()
            for row, (to, mine) in enumerate(zip(batch["to"].to_pylist(), batch["mine"].to_pylist())):
                own = [t for t, x in zip(to or [], mine or []) if x]
                flags[row][np.isin(ids[row], own)] |= INSIDE
            yield _state(batch["query"], batch["q"], ids, d, flags, batch["rows"].to_numpy(), batch["hops"].to_numpy())

    return run


def build(chunks: DataFrame, path: str, m: int = 16, ef: int = 64, cells: int = 32, top_size: int = 4096) -> SmallWorld:
    """Writes an index of ``chunks`` (chunk_id long, embedding) under ``path``.

    Chunks whose vector is null, zero, of another width than the longest, or holds nulls or
    non-finite components are left out. Equal vectors are one node, named by their smallest
    chunk_id, so copies can't crowd each other's links. A level's nodes look for their ``cells``
    nearest nodes one level up, meet those that share one, and keep ``m`` of the nearest ``ef``,
    in different directions (twice as many with those that chose them). A cell holds some
    m * cells nodes; one that is eight times as large is dealt out by hash. The top level is the
    first that has ``top_size`` nodes at most; it is what tasks hold whole.
    """
    spark, scratch = chunks.sparkSession, Scratch(chunks.sparkSession, "small_world")
    dim = max(chunks.agg(F.max(F.size("embedding")).alias("dim")).first()["dim"] or 0, 1)
    rows = _units(chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding"), "chunk_id", "embedding", dim)
    keyed = rows.select("chunk_id", "q", *[F.xxhash64(F.lit(k), "embedding").alias(f"_k{k}") for k in (1, 2)])
    nodes = keyed.groupBy("_k1", "_k2").agg(F.min("chunk_id").alias("node"), F.first("q").alias("half"))
    level = F.floor(-F.log((F.pmod(F.col("_k1"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))) / F.log(F.lit(float(m)))).cast("int")
    nodes = scratch.save(nodes.withColumn("level", level), "keys")
    keyed.select("chunk_id", "_k1", "_k2").join(nodes.select("_k1", "_k2", "node"), ["_k1", "_k2"]).select("node", "chunk_id").write.parquet(f"{path}/members")
    nodes = nodes.select("node", "half", "level")
    sizes = {r["level"]: r["count"] for r in nodes.groupBy("level").count().collect()}  # some twenty levels
    top = next(x for x in range(max(sizes, default=0) + 2) if sum(n for level, n in sizes.items() if level >= x) <= top_size)
    nodes.where(F.col("level") >= top).select("node", "half").write.parquet(f"{path}/top")
    index = SmallWorld(spark, path, dim, top, m)
    held = spark.sparkContext.broadcast(_top(index))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _nearest(batch["node"].to_numpy(), _matrix(batch["half"], dim), *held.value, ef)

    def meet(table):
        ids, x = table["node"].to_numpy(), _matrix(table["half"], dim)
        return pa.Table.from_batches([_nearest(ids, x, ids, x, max(12, ef // cells))])

    kinds = "node long, ids array<long>, d array<float>"
    cands = nodes.where(F.col("level") >= top).select("node", "half").mapInArrow(whole, kinds)
    _linked(cands, nodes, dim, m, ef, scratch, str(top)).write.parquet(f"{path}/links{top}")
    for low in range(top - 1, -1, -1):
        own = nodes.where(F.col("level") >= low).select(F.col("node").alias("query"), F.col("half").alias("q"))
        state = descend(index, own, low + 1, cells, scratch)
        near = scratch.save(state.select(F.col("query").alias("node"), F.col("q").alias("half"), F.explode(_first_ids(state, cells)).alias("cell")), f"cells{low}")
        size = near.groupBy("cell").agg(F.count("*").alias("_n")).where(F.col("_n") > 8 * m * cells)
        dealt = near.join(size, "cell", "left").withColumn("deal", F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / (4 * m * cells)))).otherwise(0))
        cands = dealt.select("cell", "deal", "node", "half").groupBy("cell", "deal").applyInArrow(meet, kinds)
        _linked(cands, nodes, dim, m, ef, scratch, str(low)).write.parquet(f"{path}/links{low}")
    scratch.keep()
    return index


def _nearest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, most: int) -> pa.RecordBatch:
    """node, ids, d: each node's nearest others."""
    d = 1 - x @ y.T
    d[ids[:, None] == others[None]] = np.inf
    most = min(most, max(len(others) - 1, 0))
    at = np.argpartition(d, most - 1, axis=1)[:, :most] if most else np.zeros((len(ids), 0), int)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(others[at]), pa.list_(pa.int64())), pa.array(list(np.take_along_axis(d, at, 1).astype(np.float32)), pa.list_(pa.float32()))], names=["node", "ids", "d"])


def _first_ids(state: DataFrame, k: int):
    """The first k nodes of a state, as an array."""

    def run(column):
        return column.map(lambda b: [int(x) for x in np.frombuffer(b, np.int64)[:k] if x < NONE])

    return F.pandas_udf(run, "array<long>")("ids")


def _top(index: SmallWorld) -> tuple[np.ndarray, np.ndarray]:
    rows = index.table("top").collect()  # top_size nodes at most
    ids = np.array([r["node"] for r in rows], np.int64)
    at = np.frombuffer(b"".join(bytes(r["half"]) for r in rows), np.float16).reshape(len(rows), index.dim).astype(np.float32)
    order = np.argsort(ids)
    return ids[order], at[order]


def descend(index: SmallWorld, queries: DataFrame, until: int, ef: int, scratch: Scratch) -> DataFrame:
    """The state of queries (query, q) at a level: from the top, a walk a level, the lowest included."""
    state = _begun(queries, _top(index), index.dim, ef)
    for level in range(index.top - 1, until - 1, -1):
        state = walk(index, state, level, ef, scratch)
    return state


def search(index: SmallWorld, chunks: DataFrame, queries: DataFrame, k: int = 10, ef: int = 100, scope: DataFrame | None = None, few: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Each query's k nearest chunks (query_id, chunk_id, similarity, rank), and what it took
    (query_id, rows: vectors compared, hops).

    ``queries`` has query_id (long, unique) and vector, ``chunks`` the original vectors, ``scope`` the
    chunks that may be found (chunk_id). The walk goes on until ``ef`` nodes inside the scope are
    settled; it keeps ef / share nodes, share being the scope's part of all nodes. A scope with a
    share of less than ``few`` is searched exactly instead, as there is less to read. Of copies
    of a vector the k smallest ids are looked at, which are all that can be among the k nearest.
    Queries with a vector that can't be used find nothing.
    """
    spark, scratch = index.spark, Scratch(index.spark, "small_world_search")
    members, inside, room = index.table("members"), None, ef
    if scope is not None:
        members = scratch.save(members.join(scope.select("chunk_id").distinct(), "chunk_id", "left_semi").select("node", "chunk_id"), "members")
        inside = scratch.save(members.select("node").distinct(), "inside")
        share = inside.count() / max(1, index.table("members").select("node").distinct().count())
        if share < few:
            near = retrieval.nearest_chunks(chunks.join(scope.select("chunk_id").distinct(), "chunk_id", "left_semi"), queries, k)
            read = chunks.join(scope.select("chunk_id").distinct(), "chunk_id", "left_semi").count()
            return near, near.select("query_id").distinct().select("query_id", F.lit(read).cast("long").alias("rows"), F.lit(0).alias("hops"))
        room = int(ef / share)
    own = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    asked = scratch.save(_units(own, "query_id", "vector", index.dim).select(F.col("query_id").cast("long").alias("query"), "q", "vector"), "asked")
    state = descend(index, asked, 1, 16, scratch)
    done = walk(index, state, 0, ef, scratch, room=room, inside=inside)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _, flags = _beam(batch)
            may = ((flags & INSIDE) > 0) & (ids < NONE)
            who, at = np.nonzero(may & (np.cumsum(may, 1) <= ef))
            yield pa.RecordBatch.from_arrays([batch["query"].take(pa.array(who)), pa.array(ids[who, at])], names=["query", "node"])

    found = done.mapInArrow(hits, "query long, node long")
    first = members.join(found.select("node").distinct(), "node", "left_semi").withColumn("_n", F.row_number().over(W.partitionBy("node").orderBy("chunk_id"))).where(F.col("_n") <= k)
    pool = found.join(first, "node").join(chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding")), "chunk_id").join(asked.select("query", "vector"), "query")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch[c].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("vector", "embedding"))
            like = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([batch["query"], batch["chunk_id"], pa.array(like)], names=["query_id", "chunk_id", "similarity"])

    made = pool.select("query", "chunk_id", "vector", "embedding").mapInArrow(rank, "query_id long, chunk_id long, similarity double")
    made = made.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))).where(F.col("rank") <= k)
    return made, done.select(F.col("query").alias("query_id"), "rows", "hops")
