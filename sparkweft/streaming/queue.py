"""The embedding queue as a stream of chunk files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.embedding import Strategy, hashed, sweep


def embed_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, s: Strategy, embed):
    """Embeds chunks as their files arrive: once for each chunk and hash, then stops at the end
    of what is there. Returns the query; the sink is a Parquet folder."""
    chunks = spark.readStream.schema(schema).parquet(source)
    fresh = hashed(chunks, s).dropDuplicates(["chunk_id", "input_hash"])

    def persist(batch: DataFrame, epoch: int) -> None:
        sweep(batch, s, embed).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")  # a replayed epoch replaces itself

    return fresh.writeStream.foreachBatch(persist).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
