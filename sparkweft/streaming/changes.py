"""Changes of sources that spread by themselves: deletes, moves and new versions as a feed.

Tables that hang on a source (facts, mentions, chunks, queue, documents) are Parquet folders dealt
by a hash of the source. A batch of changes rewrites the parts that its sources are in, and no
other; doing so once more changes nothing, so a replayed or repeated epoch is harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch

CHANGES = "seq long, kind string, source_id long, subject_id long, version long"


def part_of(source: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(parts)).cast("int").alias("part")


def lay_out(table: DataFrame, path: str, parts: int = 64) -> None:
    """Writes a table (with source_id) in its parts, one folder each."""
    table.withColumn("part", part_of(F.col("source_id"), parts)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def effects(changes: DataFrame) -> DataFrame:
    """source_id, gone, subject_id, version: what a batch of changes comes to for each source. By seq:
    once deleted a source is gone, a later move or version of it counts for nothing; of moves and
    of versions the last counts. Changes without a source or of another kind are left out."""
    known = changes.where(F.col("source_id").isNotNull() & F.col("kind").isin("deleted", "moved", "version"))
    last = lambda kind, col: F.max_by(F.when(F.col("kind") == kind, F.col(col)), F.when(F.col("kind") == kind, F.col("seq")))
    return known.groupBy("source_id").agg(F.max((F.col("kind") == "deleted").cast("int")).alias("gone"), last("moved", "subject_id").alias("_subject"), last("version", "version").alias("_version"))


def apply(spark: SparkSession, changes: DataFrame, tables: dict[str, str], parts: int = 64) -> None:
    """Brings the tables (name: path) after a batch of changes. Rows of a deleted source go, those of
    a version older than a new one go (tables with version), those of a moved one get its subject
    (tables with subject_id). Each part is written beside the table first and then put in its place."""
    scratch = Scratch(spark, "changes")
    effect = scratch.save(effects(changes), "effect")
    touched = [r["part"] for r in effect.select(part_of(F.col("source_id"), parts)).distinct().collect()]  # ``parts`` at most
    if not touched:
        return
    for name, path in tables.items():
        old = spark.read.parquet(path)
        both = old.where(F.col("part").isin(touched)).join(effect, "source_id", "left").where(F.coalesce("gone", F.lit(0)) == 0)
        if "version" in old.columns:
            both = both.where(F.coalesce(F.col("version") >= F.col("_version"), F.lit(True)))
        if "subject_id" in old.columns:
            both = both.withColumn("subject_id", F.coalesce("_subject", "subject_id"))
        fresh = scratch.save(both.select(*old.columns), name)
        held = {r["part"] for r in fresh.select("part").distinct().collect()}
        fresh.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        for part in set(touched) - held:  # nothing is left of these
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    scratch.keep()


def change_stream(spark: SparkSession, source: str, checkpoint: str, tables: dict[str, str], parts: int = 64):
    """Applies change files (``CHANGES``) as they come, until what is there is read; returns the query."""
    def run(batch: DataFrame, epoch: int) -> None:
        apply(spark, batch, tables, parts)

    return spark.readStream.schema(CHANGES).parquet(source).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """A table as it is now."""
    return spark.read.parquet(path).drop("part")

