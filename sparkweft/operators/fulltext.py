"""Full-text search by score: an inverted index of impacts in blocks, and exact top k by block maxima.

A word's postings are cut by ranges of documents, so a word that a third of all texts
have is many blocks. A block keeps the greatest impact in it; a query looks first at the ranges
that may score highest and then only at those that may still reach its k-th best score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..scratch import Scratch

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class FullText:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def text_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, of one letter and more."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def build(texts: DataFrame, path: str, per_block: int = 4096, most: int = 1 << 20) -> FullText:
    """Writes an index of ``texts`` (id, text) under ``path``.

    Tables: blocks (word, range, most: the greatest impact, size), postings (word, range, ids,
    impacts), words (word, idf). An impact is the part of BM25 that one text has for a word. A range
    is ``per_block`` texts that one task reads one after another, fewer where they have ``most``
    different words in all; so the postings of a range are made where it is read and texts are
    never shuffled. Null texts and texts without words are in no posting; the impacts of rows of
    one id add up.
    """
    spark = texts.sparkSession
    own = texts.select("id", text_words(F.col("text")).alias("words"))
    total = own.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("length")).first()
    length, kind = total["length"] or 1.0, to_arrow_type(texts.schema["id"].dataType)

    def block(held: dict[str, tuple[list, list]], part: int) -> pa.RecordBatch:
        names = sorted(held)
        cuts = pa.array(np.cumsum([0, *(len(held[w][0]) for w in names)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array([x for w in names for x in held[w][k]], t)) for k, t in ((0, kind), (1, pa.float64()))]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.full(len(names), part)), *lists], names=["word", "range", "ids", "impacts"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size, part = {}, 0, 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for name, task, words in zip(batch["id"].to_pylist(), batch["task"].to_pylist(), batch["words"].to_pylist()):
                    norm, counts = K1 * (1 - B + B * len(words) / length), Counter(words)
                    for word, tf in counts.items():
                        ids, impacts = held.setdefault(word, ([], []))
                        ids.append(name)
                        impacts.append(tf / (tf + norm))
                    rows, size = rows + 1, size + len(counts)
                    if rows >= per_block or size >= most:
                        yield block(held, (task << 32) + part)
                        held, rows, size, part = {}, 0, 0, part + 1
                if batch.num_rows:
                    last = task
        if held:
            yield block(held, (last << 32) + part)

    dealt = own.select("id", F.spark_partition_id().cast("long").alias("task"), "words")
    dealt.mapInArrow(post, f"word string, range long, ids array<{texts.schema['id'].dataType.simpleString()}>, impacts array<double>").write.option("compression", "zstd").parquet(f"{path}/postings")
    index = FullText(spark, path)
    index.table("postings").select("word", "range", F.array_max("impacts").alias("most"), F.size("impacts").alias("size")).write.parquet(f"{path}/blocks")
    df = index.table("blocks").groupBy("word").agg(F.sum("size").alias("df"))
    df.select("word", F.log(1 + (F.lit(total["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")).write.parquet(f"{path}/words")
    return index


def search(index: FullText, questions: DataFrame, k: int = 10, seeds: int = 4, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Each question's k texts of greatest BM25 (query_id, id, score, rank) and what it read
    (query_id, blocks, read, ranges, ranges_read).

    ``questions`` has query_id and words (an array; a word counts once). Ties, to nine places, go
    to the smaller id. ``prior``, with id and prior, sets those of greater prior first among equal
    scores, and leaves out texts that it lacks. The result is exact: the ``seeds`` ranges of
    greatest bound are scored first, and a range is left unread only if its bound is below the
    k-th score found there. Questions without a known word find nothing.
    """
    scratch = Scratch(index.spark, "fulltext_search")
    asked = questions.select("query_id", F.explode(F.array_distinct("words")).alias("word")).join(index.table("words"), "word")
    asked = scratch.save(asked, "asked")
    blocks = asked.join(index.table("blocks"), "word").select("query_id", "range", "word", "idf", (F.col("idf") * F.col("most")).alias("bound"))
    bounds = blocks.groupBy("query_id", "range").agg(F.sum("bound").alias("bound"), F.count("*").alias("blocks"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
    bounds = scratch.save(bounds.withColumn("nth", order), "bounds")

    def scored(ranges: DataFrame, name: str) -> DataFrame:
        """The best k of each question in the ranges given (query_id, range)."""
        # the words asked for are few beside all postings, so these are met first and what is left is dealt
        one = index.table("postings").join(asked, "word").join(ranges, ["query_id", "range"]).select("query_id", "idf", F.explode(F.arrays_zip("ids", "impacts")).alias("x"))
        sums = one.groupBy("query_id", F.col("x.ids").alias("id")).agg(F.round(F.sum(F.col("idf") * F.col("x.impacts")), 9).alias("score"))
        named = sums if prior is None else sums.join(prior.select("id", "prior"), "id")
        best = W.partitionBy("query_id").orderBy(F.desc("score"), *([F.desc("prior")] if prior is not None else []), "id")
        return scratch.save(named.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= k).drop("_nth"), name)

    first = scored(bounds.where(F.col("nth") <= seeds).select("query_id", "range"), "first")
    least = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query_id", "least")
    # a bound is a sum in another order than a score, so it is held against the score with room to spare
    rest = bounds.where(F.col("nth") > seeds).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6))
    rest = scratch.save(rest.select("query_id", "range", "blocks"), "rest")
    both = first.unionByName(scored(rest.select("query_id", "range"), "second"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), *([F.desc("prior")] if prior is not None else []), "id")
    found = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")
    read = bounds.where(F.col("nth") <= seeds).select("query_id", "blocks").unionByName(rest.select("query_id", "blocks")).groupBy("query_id").agg(F.sum("blocks").alias("read"), F.count("*").alias("ranges_read"))
    report = bounds.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.count("*").alias("ranges")).join(read, "query_id")
    return found, report.select("query_id", "blocks", "read", "ranges", "ranges_read")
