"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are the distinct unigrams, bigrams and skip-grams (one word left out) of a text's
lower-cased word-character runs, hashed to 2**bits places. FTRL-proximal keeps for every
coordinate a learning rate of its own and, by its L1 term, exact zeros; what is left is a short
list of places and weights, bounded by 2**bits, that is broadcast to score all documents.

It is fitted on a bounded sample of labelled documents: those of the ``sample`` smallest hashes
of doc_id, in that order, ``epochs`` times over.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

WORD = re.compile(r"\w+").findall
MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        key = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return key


WORDS = Words()


def features(text: str, bits: int) -> np.ndarray:
    """Places of all features, repeats included; place 0 is the bias."""
    words = WORD(text.lower())
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    parts = [h * MULT[0], (h[:-1] ^ (h[1:] << np.uint64(1))) * MULT[1], (h[:-2] ^ (h[2:] << np.uint64(3))) * MULT[2]]
    mix = np.concatenate(parts)
    mix = (mix ^ (mix >> np.uint64(31))) * MULT[1]
    return np.concatenate([[0], (mix >> np.uint64(64 - bits)).astype(np.int64) | 1])


def fit(texts: list[str], labels: list[int], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that aren't zero."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        shrink = np.where(at == 0, 0.0, l1)  # the bias isn't shrunk
        return np.where(np.abs(zi) <= shrink, 0.0, -(zi - np.sign(zi) * shrink) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rows = [np.unique(features(t, bits)).astype(np.int32) for t in texts]
    for _ in range(epochs):
        for at, y in zip(rows, labels):
            w = weights(at)
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum()))))) - y
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    at = np.arange(1 << bits)
    w = weights(at)
    kept = np.flatnonzero(w)
    return at[kept], w[kept]


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int, bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Fits on labels rows for which ``usable`` (of doc_id) is true; one label a document, the
    largest. The sample's ids are bounded by ``sample``, so they are broadcast."""
    own = labels.where("doc_id is not null and toxic is not null").where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(own), "doc_id")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
        place, weight = fit(table["text"].to_pylist(), table["toxic"].to_pylist(), bits, alpha, beta, l1, l2, epochs)
        return pa.table({"place": pa.array(place, pa.int64()), "weight": pa.array(weight, pa.float64())})

    model = rows.withColumn("at", F.xxhash64("doc_id")).withColumn("toxic", F.col("toxic").cast("int")).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "place long, weight double").toArrow()
    return model["place"].to_numpy(), model["weight"].to_numpy()


def score_documents(
    docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = 16384, bits: int = 20, alpha: float = 1.0,
    beta: float = 1.0, l1: float = 6.0, l2: float = 0.01, epochs: int = 5, threshold: float = 0.3, rows: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; with ``rows`` also the struct
    ``row`` of all its columns, whatever their names.

    Labels of documents for which ``held_out`` is true are never read for the fit (a null is
    false). Null and empty texts have the bias alone. Without usable labels all score 0. Repeated
    rows are scored alike. ``labels`` gives doc_id and toxic; other columns aren't looked at.
    """
    out = F.coalesce(held_out, F.lit(False))
    place, weight = train(docs, labels, ~out, sample, bits, alpha, beta, l1, l2, epochs)
    held = docs.sparkSession.sparkContext.broadcast((place, weight))

    def run(batch):
        at, w = held.value
        table = np.zeros(1 << bits)
        table[at] = w
        scores = []
        for text in batch["text"].to_pylist():
            if not len(at):
                scores.append(0.0)
                continue
            own = features(text, bits)
            own = np.unique(own[table[own] != 0])
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(table[own].sum()))))))
        return {c: batch[c] for c in batch.schema.names if c != "text"} | {"score": scores, "predicted": [int(s >= threshold) for s in scores]}

    own = docs.select("doc_id", out.alias("held_out"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []), F.coalesce("text", F.lit("")).alias("text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name != "text")
    return map_rows(own, f"{kept}, score double, predicted int", run)
