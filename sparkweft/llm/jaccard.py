"""Exact n-gram Jaccard join as a metric-space join: Voronoi regions, windows, recursion.

The Jaccard distance is a metric. With similarity s the join asks for distance at most e = 1 - s.

Sets. Every distinct set of shingles is one node. Shingles are dealt by hash into parts of bounded
size, packed as bytes; a part tells which of its shingles two nodes hold and how many do.
What two nodes have in common is among those, so from here on a node is its shared shingles and
its size, and distances are exact without its text. A node that shares too little to be linked
with anything is settled.

Regions. Of a linked pair's shingles, ordered from rare to common for all alike, the first
n - ceil(s * n) + 1 of each have one in common. A shingle's pivot is the least node (node ids are
hashes, so it is a random one) that holds it there, and a region is a pivot document with all
nodes that hold one of its shingles there: linked nodes are together in a region.

Recursion. A region of more than ``small`` nodes takes pivots from its nodes. Each node goes to
the Voronoi region of its nearest pivot and, as partners may lie across the boundary, to those of
all pivots within 2e of that distance: if x and y are linked and p is nearest to x, then
d(y, p) <= d(x, p) + e <= d(x, q) + e <= d(y, q) + 2e for every pivot q. Nodes within e of a pivot
are linked to it, and pivots, being compared with all of their region, leave it. A region that
its windows don't make smaller stays whole: up to ``PAIRED`` times ``small`` its chunks are joined
two by two, as small regions; a larger one takes its next, more pivots, from its smallest
components. Regions end when they are one component or small; small ones are joined in a task.

Only links that join components are written: a task joins what it finds to one node of its own, so
no group's pairs are and no node has more than a task's; what a region holds besides its pivots is
dealt into chunks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORD_HASHES, Scratch, raw, small as slices
from .parts import DEALT, KEY, deal, gathered, heads, held_twice, longs, packed, part_count, part_of, unpacked

MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
PAIRED = 16  # chunks of a region that are joined two by two, at most
HELD = 1 << 20  # shingles that a task holds before it deals them out


def shingles(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 63-bit hashes; a shorter text is one."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    mix = np.full(n, np.uint64(min(len(h), size)))
    for k in range(min(len(h), size)):
        mix = (mix ^ h[k : k + n]) * MULT[k % 8]
        mix ^= mix >> np.uint64(31)
    mix = (mix ^ (mix >> np.uint64(29))) * MULT[1]
    mix ^= mix >> np.uint64(32)
    mix = np.sort((mix >> np.uint64(1)).astype(np.int64))
    return mix[np.concatenate([[True], mix[1:] != mix[:-1]])]


def window_size(n, percent: int):
    """How many of n shingles come first, so that linked sets share one of them."""
    return n - -(-percent * n // 100) + 1


#: kinds of dealt rows: documents, sizes of nodes, shingles by part, hot shingles by node
ROWS, SIZES, KEYS, HOT = range(4)
RANKED = np.dtype([("key", "u1", KEY), ("rank", "u1")])
FOUND = "kind int, part int, a binary, b binary, c binary"


def node_of(own: np.ndarray) -> int:
    """A set's node, a 63-bit hash; -1 if it is empty."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) >> 1 if len(own) else -1


def hot_keys(docs: DataFrame, size: int, rows: int, sample: int, least: int = 8) -> np.ndarray:
    """Shingles that ``least`` sets of a sample of some ``sample`` documents hold, sorted.

    They are dealt by node instead of by shingle, so that none fills a part; that changes no
    result. There are at most sample / least times a document's shingles of them.
    """
    def run(batches):
        for batch in slices(batches):
            sets = [shingles(text, size) for text in batch["raw"].to_pylist()]
            nodes = np.repeat(np.array([node_of(s) for s in sets], np.int64), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(nodes)], names=["key", "node"])

    some = docs.where(F.pmod(F.xxhash64("raw"), F.lit(-(-rows // sample))) == 0)
    found = some.mapInArrow(run, "key long, node long").distinct().groupBy("key").count().where(F.col("count") >= least)
    return np.sort(found.select("key").toArrow()["key"].to_numpy())


def _deal(size: int, parts: int, hot):
    """Documents (doc_id, n, node) and nodes' sizes, many a row; for each part the shingles that
    a task's nodes have there; nodes' hot shingles. A set that a task meets again isn't dealt again."""
    def run(batches):
        met: set[int] = set()
        nodes, sets, held, late = [], [], 0, hot.value

        def flush():
            flat, size_of, ids = np.concatenate(sets), np.array([len(s) for s in sets], np.int64), np.array(nodes, np.int64)
            who, owners, home = np.repeat(np.arange(len(sets)), size_of), ids.view(np.uint8).reshape(-1, 8), part_of(ids, parts)
            yield from deal(home, np.arange(len(sets)), owners, size_of.view(np.uint8).reshape(-1, 8), SIZES)
            is_hot = np.zeros(len(flat), bool)
            if len(late):
                is_hot = late[np.minimum(np.searchsorted(late, flat), len(late) - 1)] == flat
            if is_hot.any():
                yield from deal(home[who[is_hot]], who[is_hot], owners, packed(flat[is_hot]), HOT)
            if not is_hot.all():
                yield from deal(part_of(flat[~is_hot], parts), who[~is_hot], owners, packed(flat[~is_hot]), KEYS)
            nodes.clear()
            sets.clear()

        for batch in slices(batches):
            n, node = [], []
            for text in batch["raw"].to_pylist():
                own = shingles(text, size)
                n.append(len(own))
                node.append(node_of(own))
                if len(own) and node[-1] not in met:
                    met.add(node[-1])
                    nodes.append(node[-1])
                    sets.append(own)
                    held += len(own)
            ids = batch["doc_id"]
            there = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), np.uint8)
            cols = ids.fill_null(0).to_numpy().tobytes() + there.tobytes(), np.array(n, np.int64).tobytes(), np.array(node, np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([abs(node[0]) % parts], pa.int32()), pa.array([ROWS], pa.int32()), *(pa.array([x], pa.binary()) for x in cols)], names=["part", "kind", "a", "b", "c"])
            if held >= HELD:
                yield from flush()
                held = 0
        if sets:
            yield from flush()
    return run


def _rows(batches):
    """doc_id, n, node of the documents that are packed in rows."""
    for batch in batches:
        for a, b, c in zip(*(batch[x].to_pylist() for x in "abc")):
            m = len(b) // 8
            ids = pa.array(np.frombuffer(a[: 8 * m], np.int64), mask=np.frombuffer(a[8 * m :], np.uint8) == 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.frombuffer(b, np.int64)), pa.array(np.frombuffer(c, np.int64))], names=["doc_id", "n", "node"])


def _find(parts: int):
    """Documents and sizes as they are; of each node the shingles of this part that another node
    holds, with a byte each for how many do (the logarithm in eighths; 255 for hot ones), dealt
    by node."""
    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        out = [table.filter(pa.array((kind == ROWS) | (kind == SIZES))).select(["kind", "part", "a", "b", "c"])]
        for which in (KEYS, HOT):
            dealt = table.filter(pa.array(kind == which))
            if not dealt.num_rows:
                continue
            owners, records = gathered(dealt, 8, KEY)
            node, key = longs(owners), longs(records)
            del owners, records
            if which == KEYS:
                node, key, many = held_twice(node, key)
                rank = np.minimum(254, 8 * np.log2(many)).astype(np.uint8)
            else:
                order = np.lexsort((key, node))
                order = order[heads(node[order], key[order])]
                node, key, rank = node[order], key[order], np.full(len(order), 255, np.uint8)
            if len(node):
                first = heads(node)
                own, record = node[first], np.zeros(len(node), RANKED)
                record["key"], record["rank"] = packed(key), rank
                made = deal(part_of(node, parts), np.cumsum(first) - 1, own.view(np.uint8).reshape(-1, 8), record.view(np.uint8).reshape(-1, RANKED.itemsize), KEYS)
                out.append(pa.Table.from_batches(made).select(["kind", "part", "a", "b", "c"]))
        return pa.concat_tables(out)
    return run


LIVE = "node long, n long, lead int, keys binary"


def _live(percent: int):
    """node, n, keys (shared, rare to common) and how many of them are in its window, of the
    nodes that share enough to be linked with anything."""
    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        out = pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "lead": pa.array([], pa.int32()), "keys": pa.array([], pa.binary())})
        dealt = table.filter(pa.array(kind == KEYS))
        if not dealt.num_rows:
            return out
        owners, sizes = gathered(table.filter(pa.array(kind == SIZES)), 8, 8)
        known, at = np.unique(longs(owners), return_index=True)
        sizes = longs(sizes)[at]
        owners, records = gathered(dealt, 8, RANKED.itemsize)
        node, record = longs(owners), records.reshape(-1).view(RANKED)
        key = longs(record["key"])
        order = np.lexsort((key, record["rank"], node))
        node, key = node[order], key[order]
        cuts = np.append(np.flatnonzero(heads(node)), len(node))
        node, count = node[cuts[:-1]], np.diff(cuts)
        n = sizes[np.searchsorted(known, node)]
        lead = window_size(n, percent) - (n - count)
        stay = np.flatnonzero(lead > 0)
        keys = packed(key)
        return pa.table({
            "node": pa.array(node[stay]), "n": pa.array(n[stay]), "lead": pa.array(lead[stay].astype(np.int32)),
            "keys": pa.array([keys[cuts[k] : cuts[k + 1]].tobytes() for k in stay.tolist()], pa.binary())})
    return run


def _windows(batches):
    """node and key for each shingle in a node's window."""
    for batch in slices(batches):
        keys = [unpacked(k[: KEY * lead]) for k, lead in zip(batch["keys"].to_pylist(), batch["lead"].to_pylist())]
        node = np.repeat(batch["node"].to_numpy(), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))], names=["node", "key"])


class Sets:
    """Some nodes' shared shingles, turned so that one set's common shingles with all are counted at once."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes = sets, np.asarray(sizes, np.int64)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.flat, self.who = flat[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]

    def common(self, own: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.flat, own), np.searchsorted(self.flat, own, side="right")
        width = high - low
        at = np.repeat(low - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
        return np.bincount(self.who[at], minlength=len(self.sets))

    def distances(self, own: np.ndarray, n: int) -> np.ndarray:
        both = self.common(own)
        return 1 - both / (self.sizes + n - both)

    def linked(self, own: np.ndarray, n: int, percent: int) -> np.ndarray:
        both = self.common(own)
        return both * 100 >= (self.sizes + n - both) * percent


def _forest(sets: Sets, percent: int, comp: np.ndarray) -> list[tuple[int, int]]:
    """Links of a small region's components, each with the smallest of those that it is joined with."""
    ids, own = np.unique(comp, return_inverse=True)
    label = own.copy()
    for k in range(len(own)):
        other = label != label[k]
        if not other.any():
            break
        for met in np.unique(label[sets.linked(sets.sets[k], int(sets.sizes[k]), percent) & other]).tolist():
            label[label == met] = label[k]
    now = np.empty(len(ids), np.int64)
    now[own] = label
    _, first, at = np.unique(now, return_index=True, return_inverse=True)
    return [(a, b) for a, b in zip(ids[first[at]].tolist(), ids.tolist()) if a != b]


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])


def _join_small(percent: int):
    """Edges of regions that come one after another, sorted by region; none is large."""
    def run(batches):
        held, now = [], None

        def done():
            rows = pa.Table.from_batches(held)
            comp = rows["comp"].to_numpy()
            if (comp != comp[0]).any():
                sets = [unpacked(k) for k in rows["keys"].to_pylist()]
                edges = _forest(Sets(sets, rows["n"].to_numpy()), percent, comp)
                if edges:
                    yield _edges(edges)

        for batch in batches:
            region = batch["region"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(region[1:] != region[:-1]) + 1, [len(region)]])
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if x == y:
                    continue
                if region[x] != now and held:
                    yield from done()
                    held.clear()
                now = region[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield from done()
    return run


SPLIT = "region long, node long, subs array<long>, many long, a long, b long"


def _split(percent: int):
    """A chunk of a region's nodes against its pivots: a row (region, node, subs) with the Voronoi
    regions that each node goes to, how many go to each (region, node, many), and links (a, b) of
    what is joined here with the smallest node of the chunk among it."""
    reach = 2 * (1 - percent / 100) + 1e-9

    def run(key: tuple[pa.Scalar, ...], chunk: pa.Table, pivots: pa.Table) -> pa.Table:
        node, subs, edges = [], [], []
        if chunk.num_rows and pivots.num_rows:
            own = Sets([unpacked(k) for k in pivots["held"].to_pylist()], pivots["size"].to_numpy())
            ids = pivots["pivot"].to_numpy()
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            for x, n, keys in zip(chunk["node"].to_pylist(), chunk["n"].to_pylist(), chunk["keys"].to_pylist()):
                both = own.common(unpacked(keys))
                either = own.sizes + n - both
                for p in ids[(both * 100 >= either * percent) & (ids != x)].tolist():
                    root[find(p)] = find(x)
                if x not in ids:
                    d = 1 - both / either
                    node.append(x)
                    subs.append(ids[d <= d.min() + reach].tolist())
            hub: dict[int, int] = {}
            for x in sorted(set(chunk["node"].to_pylist()) & root.keys()):
                hub.setdefault(find(x), x)
            edges = [(hub[find(x)], x) for x in root if x != hub[find(x)]]
        sub, many = np.unique([p for x in subs for p in x], return_counts=True)
        m, k, e = len(node), len(sub), len(edges)
        none = lambda count: [None] * count
        return pa.table({
            "region": pa.array([key[0].as_py()] * (m + k) + none(e), pa.int64()), "node": pa.array(node + sub.astype(np.int64).tolist() + none(e), pa.int64()), "subs": pa.array(subs + none(k + e), pa.list_(pa.int64())),
            "many": pa.array(none(m) + many.tolist() + none(e), pa.int64()), "a": pa.array(none(m + k) + [x for x, _ in edges], pa.int64()), "b": pa.array(none(m + k) + [x for _, x in edges], pa.int64())})
    return run


def _starred(edges: DataFrame) -> bool:
    """Whether each larger node a hangs on one smaller node b, which hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 or (up = 1 and n > 1)").count() == 0


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """node, root: the smallest node that is reachable, for every node of the edges (a, b).

    Alternates two steps on the edges, until they are stars: larger neighbours are hung on a
    node's smallest one, then smaller ones. Minima are combined before the shuffle, so a node may
    have any number of edges.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    now, k = scratch.save(now, f"{label}-0"), 0
    while not _starred(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = scratch.save(hung.where("a != b").distinct(), f"{label}-{k + 1}")
        scratch.drop(f"{label}-{k}")
        now, k = after, k + 1
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, small: int = 256, pivots: int = 32, sample: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Shingles are ``size`` consecutive words, A-Z lower-cased; documents link when their sets have
    a Jaccard similarity of ``percent`` or more. component_id is the smallest doc_id reachable.
    Null and empty texts have no shingles, link with nothing and are their own component; texts
    with fewer words are one shingle. Equal sets are one node. Rows of equal doc_id are judged each
    by its own text; a row without a doc_id is judged too, but lends its component no id (null
    where no other row does). No rows, no result. Only doc_id and text are read.

    ``small`` is the size to which regions are joined in one task, ``pivots`` how many a larger one
    takes at first, ``sample`` from how many documents the hot shingles are known; none of them
    changes results. Sets are told apart by 63-bit hashes, shingles by 48
    bits within their part.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw("text").alias("raw"))
    size_of = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = part_count(size_of["bytes"] or 0)
    hot = docs.sparkSession.sparkContext.broadcast(hot_keys(own, size, max(1, size_of["rows"]), sample))
    dealt = own.mapInArrow(_deal(size, parts, hot), DEALT)
    found = scratch.save(dealt.groupBy("part").applyInArrow(_find(parts), FOUND), "found", "kind")
    rows = found.where(f"kind = {ROWS}").select("a", "b", "c").mapInArrow(_rows, "doc_id long, n long, node long")
    live = found.where(f"kind != {ROWS}").groupBy("part").applyInArrow(_live(percent), LIVE)
    live = scratch.save(live, "live")

    first = live.select("node", "lead", "keys").mapInArrow(_windows, "node long, key long")
    least = first.groupBy("key").agg(F.min("node").alias("region"), F.count("*").alias("many")).where("many > 1").select("key", "region")
    regions = scratch.save(first.join(least, "key").select("region", "node").distinct(), "regions")
    join = _Join(live, percent, small, scratch)
    join.run(regions, pivots)

    roots = join.comp.select("node", "comp") if join.comp is not None else None
    placed = rows.select("doc_id", "n", "node")
    placed = placed.join(roots, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if roots is not None else placed.withColumn("comp", F.col("node"))
    least = placed.where("comp >= 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    scratch.keep("found", *join.kept)
    return out


class _Join:
    """Regions of nodes, and the components that their links have made so far."""

    def __init__(self, live: DataFrame, percent: int, small: int, scratch: Scratch):
        self.live, self.percent, self.small, self.scratch = live, percent, small, scratch
        self.comp, self.kept, self.step = None, [], 0

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        self.step += 1
        self.last = f"{name}-{self.step}"
        return self.scratch.save(df, self.last)

    def _merge(self, edges: DataFrame) -> None:
        """Components of all nodes that have had a link: those of before and the new links."""
        if self.comp is not None:
            edges = edges.unionByName(self.comp.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        made = components(edges, self.scratch, f"comp-{self.step}").select("node", F.col("root").alias("comp"))
        self.comp = self._save(made, "comp")
        self.kept = [self.last]

    def _with_comp(self, df: DataFrame) -> DataFrame:
        if self.comp is None:
            return df.withColumn("comp", F.col("node"))
        return df.join(self.comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def _open(self, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Regions that hold two components (region, node, comp, m): those to be joined in a task,
        pairs of chunks of stuck ones among them, and large ones."""
        own = self._with_comp(regions)
        many = own.groupBy("region").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("region", "m")
        own = self._save(own.join(many, "region").select("region", "node", "comp", "m", "stuck"), "open")
        few, paired = F.col("m") <= self.small, F.col("stuck") & (F.col("m") <= PAIRED * self.small)
        chunk, last = self._chunk(), self._chunks() - 1
        pairs = own.where(~few & paired).withColumn("with", F.explode(F.sequence(F.lit(0), last)))
        pairs = pairs.withColumn("region", F.xxhash64("region", F.least(chunk, "with"), F.greatest(chunk, "with")))
        return own.where(few).unionByName(pairs.drop("with")), own.where(~few & ~paired)

    def _chunks(self) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col("m") / self.small)).cast("int")

    def _chunk(self) -> Column:
        return F.pmod(F.xxhash64("node"), self._chunks()).cast("int")

    def _join_small(self, few: DataFrame) -> DataFrame:
        full = few.select("region", "node", "comp").join(self.live.select("node", "n", "keys"), "node").select("region", "node", "comp", "n", "keys")
        return self._save(full.repartition("region").sortWithinPartitions("region").mapInArrow(_join_small(self.percent), "a long, b long"), "edges")

    def run(self, regions: DataFrame, pivots: int) -> None:
        regions = regions.withColumn("stuck", F.lit(False))
        while True:
            few, many = self._open(regions)
            edges = self._join_small(few)
            more = not many.isEmpty()
            if more:
                regions, links = self._split(many, pivots)
                edges = edges.unionByName(links)
                pivots = min(4 * pivots, 512)
            if not edges.isEmpty():
                self._merge(edges)
            if not more:
                return

    def _split(self, many: DataFrame, pivots: int) -> tuple[DataFrame, DataFrame]:
        """The next regions of large ones (region, node, stuck), and links."""
        # pivots: nodes of a region's smallest components, in order of node ids, which are hashes
        sized = many.join(many.groupBy("region", "comp").agg(F.count("*").alias("size")), ["region", "comp"])
        chosen = self._save(_least(sized, pivots), "chosen")
        sets = self.live.select("node", "n", "keys")
        sides = chosen.select("region", "m", F.explode("p").alias("node")).join(sets, "node").select(F.explode(F.sequence(F.lit(0), self._chunks() - 1)).alias("side_chunk"), F.col("region").alias("side_region"), F.col("node").alias("pivot"), F.col("n").alias("size"), F.col("keys").alias("held"))
        members = many.join(sets, "node").select("region", self._chunk().alias("chunk"), "node", "n", "keys")
        made = self._save(members.groupBy("region", "chunk").cogroup(sides.groupBy("side_region", "side_chunk")).applyInArrow(_split(self.percent), SPLIT), "split")
        # a region is split where no part has more than half of it, and all have twice as much as it; else it stays, without its pivots
        parts = made.where("many is not null").groupBy("region", "node").agg(F.sum("many").alias("part")).groupBy("region").agg(F.max("part").alias("most"), F.sum("part").alias("all"))
        m = F.col("m")
        fits = parts.join(chosen.select("region", "m"), "region").select("region", ((F.col("most") * 2 <= m) & (F.col("all") <= 2 * m)).alias("fits"))
        both = made.where("subs is not null").select("region", "node", "subs").join(fits, "region")
        after = F.when(F.col("fits"), F.transform("subs", lambda sub: F.xxhash64("region", sub))).otherwise(F.array("region"))
        return self._save(both.select(F.explode(after).alias("region"), "node", (~F.col("fits")).alias("stuck")), "next"), made.where("a is not null").select("a", "b")


def _least(sized: DataFrame, pivots: int) -> DataFrame:
    """region, p (nodes of the ``pivots`` smallest (size, node)), m; combined before the shuffle."""
    from pyspark.sql import Window as W

    spread = sized.withColumn("_s", F.spark_partition_id())
    near = spread.withColumn("_k", F.row_number().over(W.partitionBy("region", "_s").orderBy("size", "node"))).where(F.col("_k") <= pivots)
    best = near.groupBy("region").agg(F.slice(F.sort_array(F.collect_list(F.struct("size", "node"))), 1, pivots).alias("p"), F.max("m").alias("m"))
    return best.select("region", F.col("p.node").alias("p"), "m")
