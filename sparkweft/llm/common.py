"""What the operators of this subpackage share: scratch tables, ordered buckets, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

#: A-Z to a-z and nothing else, for bytes.translate.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class WordHashes(dict):
    """Word to a 64-bit hash, for all tasks of a Python worker; forgets all when full."""

    most = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        key = self[word] = xxhash.xxh3_64_intdigest(word)
        return key


WORD_HASHES = WordHashes()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that a task holds few texts as Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def map_rows(df: DataFrame, schema: str, f: Callable[[pa.RecordBatch], Iterator[dict] | dict]) -> DataFrame:
    """``mapInArrow`` with a function from a record batch to columns (a dict), or to several."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in small(batches):
            made = f(batch)
            for cols in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([pa.array(cols[x.name], x.type) for x in kinds], schema=kinds)

    return df.mapInArrow(run, schema)


def raw(name: str) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def task_count(df: DataFrame, per_task: int, rows: int) -> int:
    """Tasks for so many rows, at least as many as the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def ranked(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2 ... in ascending order of a column, nulls last.

    Rows are range-partitioned, numbered within each part, and shifted by the rows before it;
    only one count for each part meets in one place.
    """
    from pyspark.sql import Window as W

    parts = df.repartitionByRange(F.asc_nulls_last(order)).withColumn("_part", F.spark_partition_id())
    parts = Scratch(df.sparkSession, "ranked").save(parts, "parts")
    before = parts.groupBy("_part").count().select(
        "_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_part").orderBy(F.asc_nulls_last(order))) - 1
    return parts.withColumn("_in", within).join(before, "_part").withColumn(name, F.col("_before") + F.col("_in")).drop(
        "_part", "_before", "_in")
