"""Two-pass external shuffle: rows into memory-sized buckets, each bucket shuffled, then shards.

The first pass scatters rows by a seeded hash of their content into buckets that a task can hold;
the second shuffles each bucket by Fisher-Yates and writes it to its place in the global order.
That order is cut into shards whose row counts are at most one apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch

OWN = ("_k1", "_k2", "_size", "_copies", "_bucket", "_place")


def fisher_yates(n: int, *seed: int) -> np.ndarray:
    """A permutation of 0 .. n - 1: from the end, each place swaps with one drawn at or before it."""
    order = np.arange(n)
    draws = (np.random.PCG64(list(seed)).random_raw(n) % np.arange(1, n + 1, dtype=np.uint64)).tolist()
    out = order.tolist()
    for i in range(n - 1, 0, -1):
        j = draws[i]
        out[i], out[j] = out[j], out[i]
    return np.array(out, dtype=np.int64)


def _hashes(df: DataFrame, seed: int) -> list[Column]:
    """Two 64-bit hashes of all columns; maps, which have no hash, count as JSON."""
    cols = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in df.dtypes]
    return [F.xxhash64(F.lit(seed), F.lit(k), *cols).alias(name) for k, name in ((1, "_k1"), (2, "_k2"))]


def _cut(position: Column, rows: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a place in the global order; the first ``rows % shards`` have one more."""
    each, more = divmod(rows, shards)
    late = position - more * (each + 1)
    early = position < more * (each + 1)
    least = max(each, 1)
    shard = F.when(early, F.floor(position / (each + 1))).otherwise(more + F.floor(late / least))
    slot = F.when(early, position % (each + 1)).otherwise(late % least)
    return shard.cast("int"), slot.cast("long")


def shuffled_shards(df: DataFrame, path: str, shards: int = 24, seed: int = 0, bucket_bytes: int = 32 << 20, text: str = "text") -> DataFrame:
    """Writes every row of ``df`` to Parquet folders ``shard=N`` under ``path``, in random order,
    and returns them as read back: the columns of ``df``, slot (0, 1, ... in its shard) and shard.

    A row's size is the bytes of ``text`` and eight. Buckets are as many as ``bucket_bytes`` asks
    for on average, so a task holds about that much, or its longest text. A row that is repeated
    whole, so often that its copies would weigh on a bucket, is kept once with its count and dealt
    evenly to all buckets. The result depends on the rows and the parameters only, not on how the
    input is cut; repeated rows are alike, so which of them has a place means nothing.

    Null texts have no bytes; null and equal ids are rows like others, as the whole row is hashed.
    A table without rows gives a table without rows, and no more shards than rows are filled.
    Columns named ``slot``, ``shard`` or like those in ``OWN`` (letter case aside) can't be kept
    and raise.
    """
    if taken := {c.lower() for c in df.columns} & {"slot", "shard", *OWN}:
        raise ValueError(f"columns {sorted(taken)} clash with those that are added")
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "sharding")
    size = F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8).cast("long")
    keyed = df.select("*", *_hashes(df, seed))
    keys = scratch.save(keyed.groupBy("_k1", "_k2").agg(F.count("*").alias("_copies"), F.first(size).alias("_size")), "keys")
    total = keys.agg(F.sum("_copies").alias("rows"), F.sum(F.col("_copies") * F.col("_size")).alias("bytes")).first()
    rows, buckets = total["rows"] or 0, max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    # written, so that its size is known where it is joined: at most 16 rows a bucket
    hot = scratch.save(keys.where((F.col("_copies") > 1) & (F.col("_copies") * F.col("_size") > bucket_bytes // 16)), "hot")
    own = F.pmod(F.xxhash64("_k1", "_k2"), F.lit(buckets))
    # a hot row's copies: so many in each bucket, and one more in as many as are left over, from its own bucket on
    spread = hot.withColumn("_from", own).withColumn("_bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    more = F.pmod(F.col("_bucket") - F.col("_from"), F.lit(buckets)) < F.col("_copies") % buckets
    spread = spread.withColumn("_copies", F.floor(F.col("_copies") / buckets) + more.cast("long")).where("_copies > 0")
    spread = scratch.save(spread.select("_k1", "_k2", "_bucket", "_copies"), "spread")

    held = keys.join(hot.select("_k1", "_k2"), ["_k1", "_k2"], "left_anti").select(own.alias("_bucket"), "_copies").unionByName(spread.select("_bucket", "_copies"))
    counts = held.groupBy("_bucket").agg(F.sum("_copies").alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = scratch.save(counts.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before")), "offsets")

    cold = keyed.join(hot.select("_k1", "_k2"), ["_k1", "_k2"], "left_anti").withColumn("_copies", F.lit(1).cast("long")).withColumn("_bucket", own)
    names = [f"`{c}`" for c in df.columns]
    one = keyed.join(hot.select("_k1", "_k2"), ["_k1", "_k2"], "left_semi").groupBy("_k1", "_k2").agg(F.first(F.struct(*names)).alias("_row"))
    warm = one.join(spread, ["_k1", "_k2"]).select("_row.*", "_k1", "_k2", "_copies", "_bucket")
    scattered = cold.select(*names, "_k1", "_k2", "_copies", "_bucket").unionByName(warm)

    def shuffle(key, table):
        bucket = key[0].as_py()
        lo, hi, n = (table[c].to_numpy() for c in ("_k1", "_k2", "_copies"))
        at = np.lexsort((hi, lo))  # rows arrive in any order
        at = np.repeat(at, n[at])
        at = at[fisher_yates(len(at), seed, bucket)]
        return table.select(table.column_names[:-3]).take(pa.array(at)).append_column("_place", pa.array(np.arange(len(at), dtype=np.int64)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    placed = scattered.select(*names, "_bucket", "_k1", "_k2", "_copies").groupBy("_bucket").applyInArrow(shuffle, f"{kinds}, _bucket long, _place long")
    shard, slot = _cut(F.col("_before") + F.col("_place"), rows, shards)
    out = placed.join(F.broadcast(offsets) if buckets <= 1 << 16 else offsets, "_bucket").select(*names, slot.alias("slot"), shard.alias("shard"))
    out.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    scratch.keep()
    return spark.read.schema(out.schema).parquet(path)


def shard_digest(documents: DataFrame, shards: int = 24) -> DataFrame:
    """Where each of ``documents`` went, from the shards as written: doc_id, size, text_crc32,
    law (``rows``), shard, slot, grown_shard (null: another count of shards deals anew)."""
    scratch = Scratch(documents.sparkSession, "shards")
    written = shuffled_shards(documents.select("doc_id", "text"), f"{scratch.base}/shards", shards)
    return written.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
