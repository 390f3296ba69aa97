"""Counts of distinct things as mergeable sketches, kept by day, beside the exact path.

A day's row has exact sums and a HyperLogLog sketch for each distinct count; months, tenants and
totals are unions of days' rows, so a new day is read alone. The relative standard error of a
sketch is 1.04 / sqrt(2^precision), 1.6% at 12, whatever it counts; ``error`` gives three times that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRECISION = 12


def error(precision: int = PRECISION) -> float:
    """The share that an estimate is off by at most, but for one case in some 370."""
    return 3 * 1.04 / 2 ** (precision / 2)


def by_day(rows: DataFrame, time: str, keys: list[str], distinct: dict[str, str], sums: dict[str, str] | None = None, precision: int = PRECISION) -> DataFrame:
    """day, the keys, n (rows), a sum for each of ``sums`` and a sketch for each of ``distinct``
    (name: column). Null values count in n only; rows without a time are under the day null."""
    aggs = [F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in (sums or {}).items()]]
    aggs += [F.hll_sketch_agg(F.col(c), precision).alias(name) for name, c in distinct.items()]
    return rows.groupBy(F.to_date(time).alias("day"), *keys).agg(*aggs)


def rolled(days: DataFrame, keys: list[str], distinct: list[str], sums: list[str] = (), levels: bool = False) -> DataFrame:
    """Rows of days put together by keys: sums added, sketches united and estimated. With ``levels``
    for every prefix of the keys down to the total, told apart by ``level`` (keys that are given)."""
    grouped = days.rollup(*keys) if levels else days.groupBy(*keys)
    level = [(F.lit(len(keys)) - F.bit_count(F.grouping_id())).cast("int").alias("level")] if levels else []
    return grouped.agg(*level, *[F.sum(c).alias(c) for c in ("n", *sums)], *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in distinct])


def sketch_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, time: str, keys: list[str], distinct: dict[str, str], sums: dict[str, str] | None = None):
    """Keeps the days' rows of files as they come, until what is there is read; returns the query.
    A batch writes rows of its own, in a folder that a replayed batch writes anew, and reads nothing
    of those before; ``rolled`` unites them."""
    def persist(batch: DataFrame, epoch: int) -> None:
        by_day(batch, time, keys, distinct, sums).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(persist).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
