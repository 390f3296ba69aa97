"""An index of vectors by cells, for approximate nearest chunks: a search reads few cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def centres(chunks: DataFrame, cells: int, sample: int = 65_536, seed: int = 7) -> np.ndarray:
    """Unit centres of the cells, fitted on a sample of at most some ``sample`` chunks."""
    unit = chunks.select("chunk_id", "embedding").where("embedding is not null")
    share = -(-max(1, unit.count()) // sample)
    some = unit.where(F.pmod(F.xxhash64("chunk_id"), F.lit(share)) == 0).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(some)
    return np.array(model.clusterCenters())


def placed(rows: DataFrame, vector: str, centre: np.ndarray, nearest: int) -> DataFrame:
    """Each row once for each of its ``nearest`` cells (cell); null vectors have none."""
    held = rows.sparkSession.sparkContext.broadcast(centre / np.linalg.norm(centre, axis=1, keepdims=True))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def run(frames):
        for pdf in frames:
            if len(pdf):
                at = np.argsort(-(np.array(pdf[vector].tolist(), float) @ held.value.T), axis=1, kind="stable")[:, :nearest]
                out = pdf.loc[pdf.index.repeat(at.shape[1])].reset_index(drop=True)
                yield out.assign(cell=at.ravel().astype(np.int32))

    return rows.where(F.col(vector).isNotNull()).mapInPandas(run, f"{kinds}, cell int")


def search(indexed: DataFrame, queries: DataFrame, centre: np.ndarray, k: int = 10, probes: int = 8) -> DataFrame:
    """query_id, chunk_id, similarity, rank from the ``probes`` nearest cells of each query.

    ``indexed`` is ``placed(chunks, "embedding", centre, 1)``, best written with partitionBy("cell").
    """
    asked = placed(queries.select("query_id", "vector"), "vector", centre, probes)
    both = asked.join(indexed.select("cell", "chunk_id", "embedding"), "cell")
    kinds = {f.name: f.dataType.simpleString() for f in both.schema}

    def run(frames):
        for pdf in frames:
            if len(pdf):
                x, y = (np.array(pdf[c].tolist(), float) for c in ("vector", "embedding"))
                size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
                yield pd.DataFrame({"query_id": pdf["query_id"], "chunk_id": pdf["chunk_id"], "similarity": np.divide((x * y).sum(1), size, out=np.zeros(len(pdf)), where=size > 0)})

    near = both.mapInPandas(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, similarity double")
    return near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))).where(F.col("rank") <= k)
