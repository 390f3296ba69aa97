"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last keep the columns of ``docs``; the decisions of each hold for those after it. Other
columns may have any names. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, mixing, recompression, toxicity
from .common import table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic. Null and empty texts are judged by the bias
    alone, rows without an id like others; repeated rows are judged alike."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), held_out, rows=True)
    return scored.where("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id.

    Rows of equal doc_id stay or go together, so repeats of the document that stays do, too; rows
    without an id stay, and so do null and empty texts, which are like nothing.
    """
    gone = jaccard.near_duplicates(docs).where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages of 50 words that a document of a smaller doc_id has.

    Every row stays, with n_chars of its new text where it has lost words; a null text stays null, a
    row without an id keeps its text; rows of equal doc_id are cut each by its own text.
    """
    cut = recompression.remove_repeats(docs, texts=True)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(~F.col("row.text_is_null"), F.col("kept")), "n_chars": F.when(changed, F.length("kept")).otherwise(F.col("row.n_chars"))}
    return cut.select(*[(new[c].alias(c) if c in new else F.col(f"row.`{c}`")) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: up to three times, or never. Texts without
    words are never taken. Rows of one doc_id, or without one, come as often as the one taken most."""
    mixed = mixing.mix_sources(docs).where("taken > 0")
    times = mixed.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("times"))
    rows = docs.select(F.col("doc_id").alias("own"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = rows.join(times, F.col("own").eqNullSafe(F.col("id"))).where(F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests that show they decode to its text. A null text
    has no tokens; repeated rows are encoded each."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix),
    ("byte_bpe", encode),
]
