"""Units to semantic blocks (a section each) and blocks to retrieval chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import embedding_text, token_count
from .units import NUMBERED, ROW, RULE

INLINE = 60


def blocks_of(units: DataFrame) -> DataFrame:
    """doc, block, path, title, content, kinds, units, page_start, page_end.

    A heading opens a block unless it is short, has no number and the block has a body: then it
    is a bold line of it. Blocks of headings alone join; they go to the end of the block with a
    body that follows, which keeps its own path.
    """
    by = W.partitionBy("doc").orderBy("unit")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    head = F.col("kind") == "heading"
    forced = head & (F.col("content").rlike(NUMBERED) | (F.length("content") > INLINE))
    marked = units.withColumn("body_at", F.coalesce(F.max(F.when(~head, F.col("unit"))).over(before), F.lit(0))).withColumn("forced_at", F.coalesce(F.max(F.when(forced, F.col("unit"))).over(before), F.lit(0)))
    opens = (head & (forced | (F.col("body_at") <= F.col("forced_at")))) | (F.row_number().over(by) == 1)
    marked = marked.withColumn("opens", opens).withColumn("part", F.sum(opens.cast("int")).over(by))
    shown = F.when(head & ~F.col("opens"), F.concat(F.lit("**"), "content", F.lit("**"))).otherwise(F.col("content"))
    own = marked.withColumn("shown", shown).groupBy("doc", "part").agg(
        F.sort_array(F.collect_list(F.struct("unit", "kind", "shown", "opens"))).alias("u"), F.min_by("path", "unit").alias("path"),
        F.min(F.when(head & F.col("opens"), F.col("content"))).alias("title"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    body = F.filter("u", lambda x: ~((x["kind"] == "heading") & x["opens"]))
    own = own.withColumn("bare", F.size(body) == 0).withColumn("content", F.when(F.size(body) == 0, F.col("title")).otherwise(F.array_join(F.transform(body, lambda x: x["shown"]), "\n\n")))
    # a run of bare blocks goes with the full block after it
    group = F.coalesce(F.sum((~F.col("bare")).cast("int")).over(W.partitionBy("doc").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = own.withColumn("block", group).groupBy("doc", "block").agg(
        F.sort_array(F.collect_list(F.struct("bare", "part", "content", "u", "path", "title"))).alias("parts"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
    first = F.col("parts")[0]  # the full block, if there is one
    return rows.select(
        "doc", F.row_number().over(W.partitionBy("doc").orderBy("block")).alias("block"), first["path"].alias("path"), first["title"].alias("title"),
        F.array_join(F.transform("parts", lambda p: p["content"]), "\n").alias("content"),
        F.array_distinct(F.flatten(F.transform("parts", lambda p: F.transform(p["u"], lambda x: x["kind"])))).alias("kinds"),
        F.flatten(F.transform("parts", lambda p: F.transform(p["u"], lambda x: x["unit"]))).alias("units"), "page_start", "page_end")


def runs(size: np.ndarray, between: int, room: int) -> np.ndarray:
    """For each part, where a run that begins with it ends: as many parts as ``room`` holds with
    ``between`` characters from one to the next, one at least."""
    end = np.cumsum(size + between) - between
    return np.maximum(np.searchsorted(end, end - size + room, side="right"), np.arange(1, len(size) + 1))


def packed(parts: list[str], sep: str, room: int, split=None, always: bool = False) -> Iterator[str]:
    """Runs of parts of ``room`` characters at most. A part goes to ``split`` instead, which may
    leave it whole, if it would begin a run right after another one, or ``always``."""
    stop, at, after_run = runs(np.array([len(x) for x in parts], int), len(sep), room), 0, False
    while at < len(parts):
        pieces = split(parts[at]) if split and (always or after_run) else None
        if pieces is None:
            yield sep.join(parts[at : stop[at]])
        else:
            yield from pieces
        at, after_run = (stop[at], True) if pieces is None else (at + 1, False)


def cut(text: str, room: int) -> list[str]:
    """The text in pieces of ``room`` characters at most, between words; only a word that is longer is
    cut itself. What stands between the words of a piece stays."""
    room = max(room, 1)
    spans = [(b, min(b + room, m.end())) for m in re.finditer(r"\S+", text) for b in range(m.start(), m.end(), room)]
    if not spans:
        return []
    begin, end = np.array(spans).T
    stop, at, out = np.maximum(np.searchsorted(end, begin + room, side="right"), np.arange(1, len(end) + 1)), 0, []
    while at < len(end):
        out.append(text[begin[at] : end[stop[at] - 1]])
        at = stop[at]
    return out


def split_block(content: str, kind: str, prefix: int, target: int, soft: int, hard: int, strict: bool = False) -> list[tuple[str, str]]:
    """Chunks of a block that is too large as a whole; sizes are in tokens of four characters.

    As the survey has it, a paragraph or sentence that comes first stays whole, and words are
    counted where tokens are meant, so chunks may be over ``hard``; ``strict`` holds every chunk to it.
    """
    room = lambda tokens: 4 * tokens + 3 - prefix  # noqa: E731  longest content of so many tokens
    lines = content.strip().split("\n")

    def by_words(text: str):
        if len(text) <= room(hard):
            return None
        words = text.split()
        return cut(text, room(target)) if strict else [" ".join(words[k : k + 4 * target]) for k in range(0, len(words), 4 * target)]

    def by_sentences(text: str):
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
        return list(packed(sentences, " ", room(target), by_words, strict)) if len(text) > room(soft) else None

    if kind == "figure" or kind == "key_value" and len(content) <= room(hard):
        made = [(content, kind)]
    elif kind == "key_value":
        made = [(c, kind) for c in packed(lines, "\n", room(target))]
    elif kind == "table" and len(lines) > 2 and re.match(ROW, lines[0]) and re.match(RULE, lines[1]):
        head = "\n".join(lines[:2])
        wide = max(room(target) - len(head) - 1, 1)
        rows = packed(lines[2:], "\n", wide, lambda row: cut(row, wide) if len(row) > wide else None, True) if strict and wide > 1 else packed(lines[2:], "\n", room(target) - len(head) - 1)
        made = [(f"{head}\n{r}", kind) for r in rows]
    else:
        paragraphs = [p.strip() for p in re.split(r"\n\s*\n", content) if p.strip()]
        made = [(c, "text") for c in packed(paragraphs, "\n\n", room(target), by_sentences, strict)]
    return [(piece, k) for c, k in made for piece in (cut(c, room(target)) if strict and len(c) > room(hard) else [c])]


def chunks_of(blocks: DataFrame, target: int = 500, soft: int = 600, hard: int = 1200, strict: bool = False) -> DataFrame:
    """doc, chunk_index, block, content, embedding_text, token_count, content_type, path, units,
    page_start, page_end. Whole blocks up to ``soft`` tokens stay in the engine; only larger ones
    go through the Python splitter, a row at a time.

    With ``strict`` no chunk has more than ``hard`` tokens and none of the content's words is lost:
    what is too long is cut between words, and a word that is itself too long within it. A path of
    more than a quarter of ``hard`` is shortened in the embedding text; ``path`` keeps it whole.
    """
    most = max(hard, 16)  # characters, a quarter of so many tokens

    def text_of(path, content):
        if not strict:
            return embedding_text(path, content)
        short = F.transform(path, lambda t: F.substring(t, F.lit(1), F.greatest(F.floor(F.lit(most) / F.greatest(F.size(path), F.lit(1))).cast("int") - 3, F.lit(1))))
        kept = F.slice(short, F.greatest(F.size(path) - most // 8, F.lit(0)) + 1, F.lit(most // 8))
        return embedding_text(F.when(F.length(F.array_join(path, " > ")) > most, kept).otherwise(path), content)

    body = F.array_except("kinds", F.array(F.lit("heading")))
    kind = F.when((F.size(body) == 1) & body[0].isin("table", "key_value", "figure"), body[0]).otherwise("mixed")
    sized = blocks.where("trim(content) != ''").withColumn("content_type", kind).withColumn("n", token_count(text_of(F.col("path"), F.col("content"))))
    prefix = F.length(text_of(F.col("path"), F.lit("")))
    cols = ["doc", "block", "part", "content", "content_type", "path", "units", "page_start", "page_end"]
    whole = sized.where(F.col("n") <= soft).withColumn("part", F.lit(0)).select(*cols)
    large = sized.where(F.col("n") > soft).withColumn("part", F.lit(0)).withColumn("prefix", prefix).select(*cols, "prefix")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [row | {"content": c, "content_type": k, "part": n} for row in pdf.to_dict("records") for n, (c, k) in enumerate(split_block(row["content"], row["content_type"], row["prefix"], target, soft, hard, strict))]
            yield pd.DataFrame(rows, columns=[*cols, "prefix"]).drop(columns="prefix")

    schema = whole.schema
    out = whole.unionByName(large.mapInPandas(run, schema))
    text = text_of(F.col("path"), F.col("content"))
    return out.select("doc", (F.row_number().over(W.partitionBy("doc").orderBy("block", "part")) - 1).alias("chunk_index"), "block", "content", text.alias("embedding_text"),
                      token_count(text).alias("token_count"), "content_type", "path", "units", "page_start", "page_end")


def quality(chunks: DataFrame, target: int = 500, soft: int = 600, hard: int = 1200) -> DataFrame:
    """One row of checks over chunks: counts by size, prefixes that lack, index gaps, empty chunks,
    pages out of order, token counts that don't fit their text."""
    n = F.col("token_count")
    checks = {
        "chunks": F.count("*"), "in_target": F.count_if(n <= target), "over_soft": F.count_if(n > soft), "over_hard": F.count_if(n > hard),
        "without_prefix": F.count_if((F.size("path") > 0) & ~F.col("embedding_text").startswith("Section: ")), "empty": F.count_if(F.trim("content") == ""), "pages_reversed": F.count_if(F.col("page_end") < F.col("page_start")), "wrong_counts": F.count_if(n != token_count(F.col("embedding_text"))), "documents_with_gaps": (F.max("chunk_index") + 1 != F.count("*")).cast("long")}
    by_document = chunks.groupBy("doc").agg(*[c.alias(name) for name, c in checks.items()])
    return by_document.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in checks])


def type_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("content_type").agg(F.count("*").alias("n"))


def content_coverage(chunks: DataFrame, blocks: DataFrame, least: float = 0.92) -> DataFrame:
    """doc, share, enough: how much of a document's block text its chunks hold."""
    solid = lambda c: F.sum(F.length(F.regexp_replace(c, r"\s+", "")))
    held = chunks.groupBy("doc").agg(solid("content").alias("held"))
    both = blocks.groupBy("doc").agg(solid("content").alias("all")).join(held, "doc", "left")
    share = F.when(F.col("all") > 0, F.coalesce("held", F.lit(0)) / F.col("all")).otherwise(1.0)
    return both.select("doc", F.round(share, 4).alias("share"), (share >= least).alias("enough"))
