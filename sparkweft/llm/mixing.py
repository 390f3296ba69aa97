"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is a rate r; every document is taken floor(r) times and once
more with inclusion probability pi = r - floor(r). The cube method settles the ones more: pi
moves along the null space of two balancing rows (1 and the document's size), so the totals of
documents and of words stay as they are while every move fixes at least one document at 0 or 1.

Flight runs in blocks of a bounded number of documents, so a hot source is many blocks; a block
leaves at most two open documents. Open documents of a source meet again in blocks of the next
round, until one block is left. Its landing problem, those left open and twelve documents of all sizes,
is settled by the choice that comes nearest to the totals, words before documents.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows, ranked, raw

EPS = 1e-9


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source and size, the number of words of the whole text (null: 0)."""
    return map_rows(
        docs.select("doc_id", "source", raw(text).alias("raw")), "doc_id long, source string, size long",
        lambda b: {"doc_id": b["doc_id"], "source": b["source"], "size": [len(x.split()) for x in b["raw"].to_pylist()]})


def targets(sized: DataFrame, weights: tuple[int, ...], max_repeat: int, scratch: Scratch) -> DataFrame:
    """source, source_size, n, target.

    Targets are weight * level, and stop at max_repeat * size; the level at which they share
    100% of all sizes rises while any source stops, as the excess goes to the others by weight.
    """
    totals = ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "source", "nth")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    sources = scratch.save(totals.select("source", "source_size", "n", pick.alias("weight"), (F.col("source_size") * max_repeat).cast("double").alias("most")), "sources")
    level, stopped = 0.0, -1
    while True:
        at = F.col("most") < F.col("weight") * level
        row = sources.agg(
            F.sum("source_size").alias("all"), F.sum(at.cast("long")).alias("stopped"),
            F.sum(F.when(at, F.col("most")).otherwise(0.0)).alias("kept"), F.sum(F.when(~at, F.col("weight")).otherwise(0.0)).alias("open")).first()
        if not row["all"] or row["stopped"] == stopped or not row["open"]:
            break
        stopped, level = row["stopped"], (row["all"] - row["kept"]) / row["open"]
    return sources.withColumn("target", F.least("most", F.col("weight") * level)).drop("weight", "most")


def landing(pi: np.ndarray, size: np.ndarray, held: list[int], words: float, documents: float) -> None:
    """Settles the few entries ``held``: of all choices, the one that comes nearest the totals.

    A word off counts as one, a document off as a hundredth of the mean size.
    """
    choices = (np.arange(1 << len(held))[:, None] >> np.arange(len(held))) & 1
    rest = np.setdiff1d(np.arange(len(pi)), held)
    off = np.abs(choices @ size[held] + pi[rest] @ size[rest] - words)
    off += np.abs(choices.sum(1) + pi[rest].sum() - documents) * size.mean() / 100
    pi[held] = choices[np.argmin(off)]


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool, kept: int = 12) -> np.ndarray:
    """Moves pi until at most two entries are open.

    With ``land`` none stays open: ``kept`` entries of all sizes don't fly but join the open ones
    in the landing problem.
    """
    words, documents, all_size = float(pi @ size), float(pi.sum()), size.astype(float)
    pi, size = pi.astype(float).tolist(), all_size.tolist()
    opened = [k for k, x in enumerate(pi) if EPS < x < 1 - EPS]
    saved = {opened[j] for j in np.linspace(0, len(opened) - 1, min(kept, len(opened))).astype(int)} if land and opened else set()
    coins = rng.random(2 * len(pi) + 8).tolist()
    held: list[int] = []

    def move(u: list[float]) -> None:
        up = min(((1 - pi[k]) if v > 0 else pi[k]) / abs(v) for k, v in zip(held, u) if v)
        down = min((pi[k] if v > 0 else (1 - pi[k])) / abs(v) for k, v in zip(held, u) if v)
        step = up if coins.pop() * (up + down) < down else -down
        for k, v in zip(held, u):
            x = pi[k] + step * v
            pi[k] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x
        held[:] = [k for k in held if 0 < pi[k] < 1]

    for k in range(len(pi)):
        if not EPS < pi[k] < 1 - EPS:
            pi[k] = float(round(pi[k]))
            continue
        if k in saved:
            continue
        held.append(k)
        if len(held) == 3:
            a, b, c = (size[i] for i in held)
            u = [c - b, a - c, b - a]  # sums to 0, and so do its products with the sizes
            top = max(map(abs, u))
            move([x / top for x in u] if top else [1.0, -1.0, 0.0])
    out = np.array(pi)
    if land and (saved or held):
        landing(out, all_size, sorted([*saved, *held]), words, documents)
    return out


def _fly(block_rows: int):
    def run(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        """A block of a source; the only block of its source lands."""
        block = block.drop_columns("_block").combine_chunks()
        ids, size = block["doc_id"].to_pylist(), block["size"].to_numpy()
        coin = np.array([zlib.crc32(b"%d" % (-1 if x is None else x)) for x in ids], np.int64)
        # the longest first, so what stays open to the end is short and landing it costs few words
        order = np.lexsort((block["doc_id"].fill_null(-(1 << 63)).to_numpy(), coin, -size))
        rng = np.random.default_rng(zlib.crc32(f"{key[0].as_py()}/{key[1].as_py()}/{len(ids)}".encode()))
        block = block.take(pa.array(order))
        pi = flight(block["pi"].to_numpy(), size[order], rng, block["n"][0].as_py() <= block_rows)
        return block.set_column(block.schema.get_field_index("pi"), "pi", pa.array(pi, pa.float64()))
    return run


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, block_rows: int = 4096) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs``.

    Sources in order of code points, null last, weigh ``weights`` in turn. Null and empty texts
    have size 0 and are taken 0 times; equal rows count each for itself; a null doc_id is a row like others; an empty table gives an
    empty result. Only doc_id, source and text are read, so other columns can't clash. Reruns
    agree: coins are drawn from a seed made of source, block and rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = scratch.save(word_counts(docs), "sized")
    goal = targets(sized, weights, max_repeat, scratch)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = sized.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_rate", rate)
    whole = F.floor(F.col("_rate") + EPS)
    units = units.withColumn("whole", whole).withColumn("pi", F.when(F.col("size") > 0, F.greatest(F.col("_rate") - F.col("whole"), F.lit(0.0))).otherwise(0.0)).drop("_rate")
    cols = "doc_id long, source string, size long, source_size long, n long, target double, whole long, pi double"
    units = units.select(*[x.split()[0] for x in cols.split(", ")])
    left = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    settled, k = None, 0
    while True:
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows))
        last = left <= block_rows
        block = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(k)), blocks)
        flown = units.withColumn("_block", block).groupBy("source", "_block")
        flown = scratch.save(flown.applyInArrow(_fly(block_rows), cols), f"round{k}")
        is_open = (F.col("pi") > 0) & (F.col("pi") < 1)
        done = flown if last else flown.where(~is_open)
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        # at most two of each block stay open; n becomes the most that may meet
        units = flown.where(is_open).withColumn("n", 2 * F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)))
        left, k = 2 * math.ceil(left / block_rows), k + 1
    taken = F.col("size") * (F.col("whole") + F.round("pi").cast("long"))
    return settled.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))

