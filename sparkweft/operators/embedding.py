"""Strategy-versioned embeddings: hashing, queueing, sweeping and coverage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import input_hash, render


@dataclass(frozen=True)
class Strategy:
    """How chunks become vectors."""

    id: str
    model: str
    version: str | None = None
    normalization: str = "l2"
    document_template: str = "{input}"
    query_template: str = "{input}"
    dimension: int = 64


def hashed(chunks: DataFrame, s: Strategy) -> DataFrame:
    """Adds the rendered input and the hash that makes embedding it idempotent."""
    text = render(F.lit(s.document_template), F.col("embedding_text"))
    return chunks.withColumn("input", text).withColumn("input_hash", input_hash(F.lit(s.id), F.lit(s.model), F.lit(s.version), F.lit(s.normalization), F.lit(s.document_template), text))


def enqueue(chunks: DataFrame, queue: DataFrame, s: Strategy, force: bool = False) -> DataFrame:
    """The queue after enqueueing hashed active chunks.

    A chunk without a row of its hash gets a pending one; other completed rows of such a chunk
    become stale; ``force`` resets rows that are there.
    """
    own = hashed(chunks, s).select("chunk_id", F.lit(s.id).alias("strategy_id"), "input_hash")
    key = ["chunk_id", "strategy_id", "input_hash"]
    new = own.join(queue, key, "left_anti")
    fresh = new.select(*key, F.lit("pending").alias("embedding_status"), F.lit(0).alias("attempt_count"))
    outdated = new.select("chunk_id", "strategy_id").distinct().withColumn("_old", F.lit(True))
    kept = queue.join(outdated, ["chunk_id", "strategy_id"], "left")
    status = F.when(F.col("_old") & (F.col("embedding_status") == "completed"), "stale").otherwise(F.col("embedding_status"))
    kept = kept.withColumn("embedding_status", status).drop("_old")
    if force:
        current = own.withColumn("_now", F.lit(True))
        kept = kept.join(current, key, "left").withColumn("embedding_status", F.when(F.col("_now") & F.col("embedding_status").isin("completed", "stale", "failed"), "pending").otherwise(F.col("embedding_status"))).drop("_now")
    return kept.select(*key, "embedding_status", "attempt_count").unionByName(fresh)


def hashing_embedder(dimension: int) -> Callable[[list[str]], np.ndarray]:
    """A deterministic offline model: signed hashed words, L2-normalised."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % dimension] += 1 if h & 0x80000000 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)
    return embed


def sweep(pending: DataFrame, s: Strategy, embed: Callable[[list[str]], np.ndarray], batch: int = 64) -> DataFrame:
    """chunk_id, input_hash, embedding, embedding_status, error_message of pending rows (with input).

    A failing call fails its batch; a vector of another dimension fails its row.
    """
    kind = pending.schema["chunk_id"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                try:
                    made = list(embed(part["input"].tolist()))
                    error = [None if len(v) == s.dimension else f"dimension {len(v)}, not {s.dimension}" for v in made]
                except Exception as e:  # a provider's failure is a row's state
                    made, error = [None] * len(part), [str(e)] * len(part)
                yield pd.DataFrame({
                    "chunk_id": part["chunk_id"].to_numpy(), "input_hash": part["input_hash"].to_numpy(), "embedding": [None if e else list(map(float, v)) for v, e in zip(made, error)],
                    "embedding_status": ["failed" if e else "completed" for e in error], "error_message": error})

    return pending.select("chunk_id", "input_hash", "input").mapInPandas(run, f"chunk_id {kind}, input_hash string, embedding array<double>, embedding_status string, error_message string")


def retry_failed(queue: DataFrame, in_scope: DataFrame) -> DataFrame:
    """Failed rows of chunks in scope are pending again."""
    mine = in_scope.select("chunk_id").distinct().withColumn("_in", F.lit(True))
    status = F.when(F.col("_in") & (F.col("embedding_status") == "failed"), "pending").otherwise(F.col("embedding_status"))
    return queue.join(mine, "chunk_id", "left").withColumn("embedding_status", status).drop("_in")


def status_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("embedding_status").agg(F.count("*").alias("n"))


def coverage(queue: DataFrame, *by: str) -> DataFrame:
    """Chunks, completed ones and their share in percent to one place."""
    out = queue.groupBy(*by).agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct(F.when(F.col("embedding_status") == "completed", F.col("chunk_id"))).alias("completed"))
    return out.withColumn("coverage_pct", F.round(F.col("completed") * 100.0 / F.col("chunks"), 1))


# strategies and the queue's worker

def new_strategies(payload: DataFrame, models: DataFrame) -> DataFrame:
    """Strategy rows: provider, dimension and normalization are the model's; templates default to
    the model's own, and those of a model without one to the bare input."""
    own = models.select(F.col("id").alias("model_id"), "provider", "dimension", "normalization", F.col("document_template").alias("_d"), F.col("query_template").alias("_q"))
    bare = F.lit("{input}")
    return payload.join(own, "model_id").withColumns({
        "document_template": F.coalesce("document_template", "_d", bare), "query_template": F.coalesce("query_template", "_q", bare), "is_active": F.coalesce("is_active", F.lit(True))}).drop("_d", "_q")


def updated_strategies(strategies: DataFrame, changes: DataFrame) -> DataFrame:
    """Names and activity may change; what vectors were made with may not."""
    given = changes.select("id", F.col("name").alias("_name"), F.col("is_active").alias("_active"))
    return strategies.join(given, "id", "left").withColumns({"name": F.coalesce("_name", "name"), "is_active": F.coalesce("_active", "is_active")}).select(*strategies.columns)


def claimed(queue: DataFrame, strategy_id, limit: int = 500) -> DataFrame:
    """The queue with its oldest pending rows of a strategy, at most ``limit``, processing, and one
    more attempt each. The limit is the size of a claim; the next one takes the next rows."""
    mine = (F.col("strategy_id") == strategy_id) & (F.col("embedding_status") == "pending")
    key = ["chunk_id", "strategy_id", "input_hash"]
    first = queue.where(mine).orderBy("created_at", *key).limit(limit).select(*key, F.lit(True).alias("_claimed"))
    taken = F.coalesce("_claimed", F.lit(False))
    return queue.join(first, key, "left").withColumns({
        "embedding_status": F.when(taken, "processing").otherwise(F.col("embedding_status")), "attempt_count": F.col("attempt_count") + taken.cast("int")}).select(*queue.columns)


def sweep_counters(swept: DataFrame) -> DataFrame:
    return swept.agg(F.count("*").alias("claimed"), F.count_if(F.col("embedding_status") == "completed").alias("completed"), F.count_if(F.col("embedding_status") == "failed").alias("failed"))


def drained(queue: DataFrame, inputs: DataFrame, s: Strategy, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """The queue after its worker: claimed rows (processing) have their vector and status."""
    key = ["chunk_id", "input_hash"]
    going = queue.where("embedding_status = 'processing'").select(*key).join(inputs, key)
    done = sweep(going, s, embed).select(*key, F.col("embedding_status").alias("_status"), "embedding", "error_message")
    return queue.join(done, key, "left").withColumn("embedding_status", F.when(F.col("embedding_status") == "processing", F.coalesce("_status", "embedding_status")).otherwise(F.col("embedding_status"))).drop("_status")
