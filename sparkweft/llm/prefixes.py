"""The trie of conversations by their turns, from ROLLUPs over positional turn-id columns.

A conversation is a row with a column for each of its first turns; one ROLLUP over those columns
aggregates all prefixes together, and grouping_id tells how long a prefix is. Conversations that
go on, together with others, come into a further block of columns, keyed by the node where the
block before ended. A second ROLLUP, over the nodes of a block, sums what lies below each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
ROOT = "00" * 16


def turn_ids(role: Column, text: Column) -> Column:
    """24 bytes that tell a turn from all others: half a SHA-256 of role and text, then the words of the text."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    name = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return F.concat(F.substring(name, 1, 16), F.unhex(F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 16, "0")))


def _words(turn: Column) -> Column:
    return F.coalesce(F.conv(F.hex(F.substring(turn, 17, 8)), 16, 10).cast("long"), F.lit(0).cast("long"))


def ordered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, pos (from 1) and tid of every turn, by turn (null first), then tid.

    Rows are cut by range, so a conversation of any length is spread; a task numbers what it has,
    and only conversations that go across a cut get the count of their rows before it.
    """
    cut = turns.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "tid").withColumn("_part", F.spark_partition_id())
    cut = scratch.save(cut, "cut")
    held = cut.groupBy("conv_id", "_part").agg(F.count("*").alias("_n"))
    before = held.withColumn("_before", F.sum("_n").over(W.partitionBy("conv_id").orderBy("_part")) - F.col("_n")).where("_before > 0").drop("_n")
    here = F.row_number().over(W.partitionBy("conv_id", "_part").orderBy(F.asc_nulls_first("turn"), "tid"))
    return cut.withColumn("_here", here).join(before, ["conv_id", "_part"], "left").select(
        "conv_id", (F.col("_here") + F.coalesce("_before", F.lit(0))).cast("long").alias("pos"), "tid")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, pos, tid) of every conversation c after its head is replaced, and each
    conversation's count of them (conv_id, n).

    The head is the first h turns of conversation c - c % 20 (all if fewer, none if absent), with
    h = crc32(c) % 4; then come the turns of c after its own first h.
    """
    at = scratch.save(ordered(turns, scratch), "ordered")
    h, base = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, F.col("conv_id") - F.col("conv_id") % 20
    own = scratch.save(at.groupBy("conv_id").agg(F.max("pos").alias("_own")), "own")
    bases = own.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("_base"), F.col("_own").alias("_has"))
    convs = own.withColumn("_base", base).withColumn("_h", h).join(bases, "_base", "left")
    head = F.least("_h", F.coalesce("_has", F.lit(0)))
    convs = convs.select("conv_id", "_base", "_h", head.alias("_head"), (head + F.greatest(F.col("_own") - F.col("_h"), F.lit(0))).cast("long").alias("n"))
    convs = scratch.save(convs, "convs")
    heads = at.where((F.col("conv_id") % 20 == 0) & (F.col("pos") <= 3)).select(F.col("conv_id").alias("_base"), "pos", "tid")
    first = convs.join(heads, "_base").where(F.col("pos") <= F.col("_h")).select("conv_id", "pos", "tid")
    moved = convs.where("_head < _h").select("conv_id", (F.col("_h") - F.col("_head")).alias("_up"))  # a base too short or absent
    rest = at.where(F.col("pos") > h).join(moved, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("_up", F.lit(0))).cast("long").alias("pos"), "tid")
    out = scratch.save(first.unionByName(rest), "rebuilt")
    scratch.drop("cut")
    scratch.drop("ordered")
    return out, convs.select("conv_id", "n")


def _key(prev: str, cols: list[str], upto: Column | None = None) -> Column:
    """The name of a node: its block's start and the turns from there, half a SHA-256; with no turns, the start itself."""
    parts = [F.col(c) if upto is None else F.when(F.lit(i) <= upto, F.col(c)) for i, c in enumerate(cols, 1)]
    name = F.substring(F.unhex(F.sha2(F.concat(F.col(prev), *[F.coalesce(p, F.lit(b"")) for p in parts]), 256)), 1, 16)
    return F.when(parts[0].isNull(), F.col(prev)).otherwise(name)


def _rollup(df: DataFrame, cols: list[str], aggs: str) -> DataFrame:
    """``aggs`` for every prefix of the turn columns, with d, its length within the block.

    A prefix's last turn is there; groups of conversations that have ended before it are none.
    """
    names = ", ".join(cols)
    out = df.sparkSession.sql(f"SELECT prev, {names}, {len(cols)} - bit_count(grouping_id()) AS d, {aggs} FROM {{rows}} GROUP BY prev, ROLLUP ({names})", rows=df)
    return out.withColumn("last", F.get(F.array(*cols), F.col("d") - 1)).where((F.col("d") == 0) | F.col("last").isNotNull())


def _ends(terminals: DataFrame) -> DataFrame:
    """key and ends_sha256: the hash of all conv_ids of a key, ascending, joined by commas.

    Ids are sorted by range and packed, so a node where a third of all conversations end comes to
    the task that hashes it as a few long strings, one after another.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch["key"].to_pylist(), batch["conv_id"].to_pylist()
            cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            runs = list(zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array([keys[x] for x, _ in runs], pa.binary()), "first": pa.array([ids[x] for x, _ in runs], pa.int64()),
                "ids": pa.array([",".join(map(str, ids[x:y])) for x, y in runs], pa.string())})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for key, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist()):
                if key == now:
                    state.update(b"," + ids.encode())
                else:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in done], pa.binary()), "ends_sha256": pa.array([v for _, v in done], pa.string())})
                done = []
        if state:
            yield pa.RecordBatch.from_pydict({"key": pa.array([now], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})

    packs = terminals.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pack, "key binary, first long, ids string")
    return packs.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends_sha256 string")


def prefix_nodes(turns: DataFrame, convs: DataFrame, scratch: Scratch, width: int = 8, widest: int = 32) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, pos, tid) of ``convs`` (conv_id, n).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. The first block has ``width`` columns, each further one twice as many, to
    ``widest`` at most. Who is alone at the end of a block needs no more grouping: the rest is
    a chain of nodes of its own. So there are as many rounds as the longest prefix that
    two conversations share asks for, however long one alone is.
    """
    spark = convs.sparkSession
    now = convs.withColumn("prev", F.unhex(F.lit(ROOT)))
    blocks, alone, ends, start = [], [], [], 0
    while True:
        b, cols = len(blocks), [f"t{i}" for i in range(1, width + 1)]
        some = turns.where((F.col("pos") > start) & (F.col("pos") <= start + width))
        wide = some.groupBy("conv_id").agg(*[F.max(F.when(F.col("pos") == start + i, F.col("tid"))).alias(c) for i, c in enumerate(cols, 1)])
        wide = scratch.save(now.join(wide, "conv_id", "left" if b == 0 else "inner"), f"wide{b}")
        nodes = _rollup(wide, cols, "min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS longest")
        nodes = nodes.where((F.lit(b) == 0) | (F.col("d") > 0))
        d = F.col("d")
        nodes = scratch.save(nodes.select(
            "prev", *cols, "d", (d + start).cast("long").alias("depth"), "conv_id", "n_convs", "longest", ((F.col("n_convs") - 1) * F.when(d > 0, _words(F.col("last"))).otherwise(0)).alias("own"),
            _key("prev", cols).alias("key"), F.when(d > 0, _key("prev", cols, d - 1)).alias("up")), f"nodes{b}")
        blocks.append((nodes, cols))
        end = start + width
        ends.append(wide.where(F.col("n") <= end).select(_key("prev", cols).alias("key"), "conv_id"))
        longer = wide.where(F.col("n") > end).select("conv_id", "n", _key("prev", cols).alias("prev"))
        shared = nodes.where((F.col("d") == width) & (F.col("n_convs") > 1)).select(F.col("key").alias("prev"))
        alone.append(scratch.save(longer.join(shared, "prev", "left_anti").select("conv_id", F.lit(end).cast("long").alias("_from"), "n"), f"alone{b}"))
        now = scratch.save(longer.join(shared, "prev", "left_semi"), f"longer{b}")
        start, width = end, min(2 * width, widest)
        if now.isEmpty():
            break

    below, all_nodes = None, None
    for b, (nodes, cols) in reversed(list(enumerate(blocks))):  # what lies below a block's last nodes is known when the later block is summed
        goes_on = (F.col("d") == len(cols)) & (F.col("longest") > F.col("depth"))
        leaf = F.when(F.col("longest") == F.col("depth"), 1).when(goes_on & (F.col("n_convs") == 1), 1).otherwise(0).cast("long")
        rows = nodes.withColumn("leaves", leaf).withColumn("saved", F.col("own"))
        if below is not None:
            rows = rows.join(below, "key", "left").withColumn("leaves", F.col("leaves") + F.coalesce("_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("_saved", F.lit(0)))
        sums = _rollup(rows, cols, "sum(leaves) AS leaves, sum(saved) AS saved").select("d", _key("prev", cols).alias("key"), "leaves", "saved")
        sums = scratch.save(sums, f"sums{b}")
        below = sums.where("d = 0").select("key", F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
        own = nodes.select("key", "up", "depth", "conv_id", "n_convs", "longest", (goes_on & (F.col("n_convs") == 1)).alias("_chain")).join(
            sums.where("d > 0 or key = unhex('%s')" % ROOT).select("key", "leaves", "saved"), "key")
        all_nodes = own if all_nodes is None else all_nodes.unionByName(own)
    all_nodes = scratch.save(all_nodes, "nodes")

    kids = all_nodes.where("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("_kids"))
    parents = all_nodes.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    told = ends[0]
    for more in ends[1:]:
        told = told.unionByName(more)
    none = F.sha2(F.lit(""), 256)
    grouped = all_nodes.join(kids, "key", "left").join(_ends(told), "key", "left").join(parents, "up", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.coalesce("_kids", F.lit(0)) + F.col("_chain").cast("int")).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
    chains = alone[0]
    for more in alone[1:]:
        chains = chains.unionByName(more)
    last = F.col("pos") == F.col("n")
    chained = turns.join(chains, "conv_id").where(F.col("pos") > F.col("_from")).select(
        "conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"))
    out = scratch.save(grouped.unionByName(chained), "trie")
    scratch.keep("trie")
    return out


def conversation_trie(conversations: DataFrame, width: int = 8) -> DataFrame:
    """A row for every node of the trie of the rebuilt conversations; see ``prefix_nodes``.

    Turns are ordered by turn, null first; those of one turn number by what they hold, so the
    order of rows means nothing, and a row that is there twice is two turns. Null roles and texts
    are empty. Rows without conv_id belong to no conversation. Texts are hashed and counted
    where they are read, whole; what moves afterwards is 24 bytes a turn. A table without
    conversations gives no rows, not even the root. Other columns are left aside.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), turn_ids(F.col("role"), F.col("text")).alias("tid"))
    return prefix_nodes(*rebuilt(turns, scratch), scratch, width)
