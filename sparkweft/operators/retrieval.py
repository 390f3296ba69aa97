"""Vector retrieval: exact nearest chunks, diversity selection, reranking, evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import Scratch


class _Best:
    """A task's k best chunks of each query of a block, ties to the smaller id. A batch is compared with
    the least that a query has kept, so of most batches only few similarities are sorted."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held: dict[int, pd.DataFrame] = {}

    def add(self, first: int, sim: np.ndarray, ids: pa.Array) -> None:
        """``sim`` has a row for each query from ``first`` on, ``ids`` the chunks of its columns."""
        some, width = slice(first, first + len(sim)), sim.shape[1]
        if np.isnan(sim.sum()):  # of vectors with such numbers; last of all
            sim = np.where(np.isnan(sim), -np.inf, sim)
        hit = sim >= self.least[some, None]
        if width > self.k and np.count_nonzero(hit) > 4 * self.k * len(sim):
            own = np.partition(sim, width - self.k, axis=1)[:, width - self.k]
            hit = sim >= np.maximum(self.least[some], own)[:, None]
        at, column = np.nonzero(hit)
        if not len(at):
            return
        made = pd.DataFrame({"at": at + first, "chunk_id": ids.take(pa.array(column)).to_pandas(), "similarity": sim[at, column]})
        both = pd.concat([self.held[first], made]) if first in self.held else made
        kept = both.sort_values(["at", "similarity", "chunk_id"], ascending=[True, False, True]).groupby("at").head(self.k)
        full = kept.groupby("at")["similarity"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.least[full.index.to_numpy()] = full["min"].to_numpy()
        self.held[first] = kept

    @property
    def rows(self) -> pd.DataFrame | None:
        return pd.concat(self.held.values()).replace({"similarity": {-np.inf: np.nan}}) if self.held else None


def nearest_chunks(chunks: DataFrame, queries: DataFrame, k: int = 50, query_block: int = 4096) -> DataFrame:
    """query_id, chunk_id, similarity, rank: each query's k chunks of greatest cosine.

    ``queries`` has query_id and vector. A scan of all chunks takes ``query_block`` queries,
    which are broadcast, as matrix products of 256 of them; each task keeps its own k for each
    query, so what meets in the last step is k rows a task and query. Queries of several blocks are
    written once; the chunks should be a written table then, as each block reads them. Zero vectors have similarity 0; chunks and
    queries whose vector is null, holds nulls or has another dimension take no part.
    """
    spark = chunks.sparkSession
    numbered = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    size = numbered.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    usable = lambda c: (F.size(c) == (size["dim"] or 0)) & ~F.exists(c, lambda x: x.isNull())
    numbered, chunks = numbered.where(usable("vector")), chunks.where(usable("embedding"))
    parts = -(-size["n"] // query_block) or 1
    if parts > 1:
        numbered = Scratch(spark, "nearest").save(numbered, "queries")
    out = None
    for part in range(parts):
        block = numbered if parts == 1 else numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        rows = block.toPandas()  # bounded by query_block on average
        held = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), np.array(rows["vector"].tolist(), dtype=float).reshape(len(rows), size["dim"] or 0)))

        def run(batches, held=held):
            ids, q = held.value
            qn = np.linalg.norm(q, axis=1)
            best = _Best(len(q), k)
            for batch in batches:
                if not batch.num_rows or not len(q):
                    continue
                batch = batch.take(pc.sort_indices(batch["chunk_id"]))
                v = batch["embedding"].flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
                vn = np.linalg.norm(v, axis=1)
                for x in range(0, len(q), 256):
                    scale = np.outer(vn, qn[x : x + 256])
                    sim = np.divide(v @ q[x : x + 256].T, scale, out=np.zeros_like(scale), where=scale > 0)
                    best.add(x, np.ascontiguousarray(sim.T), batch["chunk_id"])
            if best.rows is not None:
                yield pa.RecordBatch.from_pandas(best.rows.assign(query_id=ids[best.rows["at"].to_numpy()])[["query_id", "chunk_id", "similarity"]], preserve_index=False)

        kinds = {f.name: f.dataType.simpleString() for f in (*chunks.schema, *queries.schema)}
        made = chunks.select("chunk_id", "embedding").mapInArrow(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, similarity double")
        out = made if out is None else out.unionByName(made)
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mmr_order(similarity: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[int]:
    """Positions picked by maximal marginal relevance; ties to the earlier candidate."""
    size = np.linalg.norm(vectors, axis=1)
    unit = np.divide(vectors, size[:, None], out=np.zeros_like(vectors), where=size[:, None] > 0)
    likeness = unit @ unit.T
    picked: list[int] = []
    worst = np.zeros(len(similarity))
    free = np.ones(len(similarity), bool)
    while free.any() and len(picked) < k:
        score = np.where(free, weight * similarity - (1 - weight) * worst, -np.inf)
        at = int(np.argmax(score))
        worst = likeness[at].copy() if not picked else np.maximum(worst, likeness[at])
        picked.append(at)
        free[at] = False
    return picked


def diversified(candidates: DataFrame, k: int = 10, weight: float = 0.7) -> DataFrame:
    """Adds mmr_rank to the k picks of each query; candidates have query_id, rank, similarity,
    embedding, and a query has a bounded pool of them."""
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        at = mmr_order(pdf["similarity"].to_numpy(), np.array(pdf["embedding"].tolist(), dtype=float), k, weight)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[at].to_numpy(), "chunk_id": pdf["chunk_id"].iloc[at].to_numpy(), "similarity": pdf["similarity"].iloc[at].to_numpy(), "mmr_rank": np.arange(1, len(at) + 1)})

    return candidates.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, similarity double, mmr_rank int")


def reranked(pool: DataFrame, scores: DataFrame, k: int = 5) -> DataFrame:
    """The pool by score; passages without a score get one less than the least, ties by pool order.

    ``pool`` has query_id and index, ``scores`` query_id, index, score. Without any score a query
    keeps the pool's order.
    """
    both = pool.join(scores, ["query_id", "index"], "left")
    floor = F.coalesce(F.min("score").over(W.partitionBy("query_id")), F.lit(0.0)) - 1
    filled = both.withColumn("score", F.coalesce("score", floor))
    return filled.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "index"))).where(F.col("rank") <= k)


def overlap_score(query: str, text: str):
    """A lexical stand-in for a reranker: the share of the query's words that the text has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.col(c)), r"\W+"), lambda w: w != ""))
    return F.round(F.size(F.array_intersect(words(query), words(text))) / F.greatest(F.size(words(query)), F.lit(1)), 4)


def evidence(chunks: DataFrame, queries: DataFrame, pool: int = 50, picks: int = 10, weight: float = 0.7) -> DataFrame:
    """Nearest chunks, then the diverse picks among them, similarity to 4 places."""
    near = nearest_chunks(chunks, queries, pool)
    full = near.join(chunks.select("chunk_id", "embedding"), "chunk_id")
    return diversified(full, picks, weight).withColumn("similarity", F.round("similarity", 4))
