"""Answers to questions from evidence: candidates, diverse picks, reranking, the prompt, the answer.

All questions go through each step together. Models are functions of batches: a reranker gives
scores for passages, an answerer texts for prompts; a model that fails leaves rows as they were.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import render
from ..scratch import Scratch
from . import retrieval
from .embedding import Strategy
from .listing import with_filenames, wrong_text

# fixed values: what is said without evidence, and how evidence is laid out
NOTHING_FOUND = "I could not find any information about that in the available knowledge. No embedded chunks matched your query."
TOO_LITTLE = "The available knowledge does not contain enough information to answer that question."


def embedded_questions(questions: DataFrame, s: Strategy, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """query_id, question, vector: questions through the strategy's query template and model. Empty
    and overlong ones are left out; ``wrong_text`` says why."""
    fine = questions.where(wrong_text(F.col("question"), "query").isNull()).select("query_id", F.trim("question").alias("question"))
    kind = fine.schema["query_id"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            yield pdf[["query_id", "question"]].assign(vector=[list(map(float, v)) for v in embed(pdf["input"].tolist())] if len(pdf) else [])

    rendered = fine.withColumn("input", render(F.lit(s.query_template), F.col("question")))
    return rendered.mapInPandas(run, f"query_id {kind}, question string, vector array<double>")


def chunk_header(nth: Column, path: Column, start: Column, end: Column) -> Column:
    section = F.when(F.size(path) > 0, F.concat(F.lit(" Section: "), F.array_join(path, " › "))).otherwise("")
    last = F.when((end != 0) & (end != start), F.concat(F.lit("–"), end)).otherwise("")
    pages = F.when(start.isNotNull(), F.concat(F.lit(" (page "), start, F.coalesce(last, F.lit("")), F.lit(")"))).otherwise("")
    return F.concat(F.lit("[Chunk "), nth, F.lit("]"), F.coalesce(section, F.lit("")), pages)


def prompts(questions: DataFrame, final: DataFrame) -> DataFrame:
    """query_id, prompt of questions with evidence (query_id, rank, content, path, page_start,
    page_end); a question has few chunks, so they are gathered in its row."""
    part = F.concat_ws("\n", chunk_header(F.col("rank"), F.col("path"), F.col("page_start"), F.col("page_end")), F.col("content"))
    parts = final.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    context = F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")
    text = F.concat(F.lit("Context chunks:\n\n"), context, F.lit("\n\nQuestion: "), F.col("question"), F.lit("\n\nAnswer the question using only the context above."))
    return questions.join(parts, "query_id").select("query_id", text.alias("prompt"))


def overlap_reranker(questions: DataFrame, pool: DataFrame) -> DataFrame:
    """query_id, index, score of the pool's passages: a lexical stand-in for a model."""
    both = pool.join(questions.select("query_id", "question"), "query_id")
    return both.select("query_id", "index", retrieval.overlap_score("question", "passage").alias("score"))


def final_chunks(pool: DataFrame, scores: DataFrame | None, k: int) -> DataFrame:
    """The pool (query_id, index, ...) by score, or in its own order where there are no scores."""
    if scores is None:
        return pool.withColumns({"score": F.lit(None).cast("double"), "rank": F.row_number().over(W.partitionBy("query_id").orderBy("index"))}).where(F.col("rank") <= k)
    return retrieval.reranked(pool, scores, k)


def answered(
    questions: DataFrame, chunks: DataFrame, sources: DataFrame, s: Strategy, embed, rerank=overlap_reranker, answer: Callable[[list[str]], list[str]] | None = None,
    pool: int = 50, picks: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Answers (query_id, question, answer, candidates, picked, final, reranker_used) and their
    evidence (query_id, rank, chunk_id, source_id, filename, similarity, score).

    ``chunks`` are the live candidates in scope: chunk_id, source_id, embedding, content,
    embedding_text, path, page_start, page_end. A question without candidates gets the stated
    answer; without ``answer`` answers are empty; ``rerank`` may be None. What several steps read,
    the comparison of all questions with all chunks above all, is written and made once.
    """
    scratch = Scratch(questions.sparkSession, "answers")
    asked = scratch.save(embedded_questions(questions, s, embed), "asked")
    near = scratch.save(retrieval.nearest_chunks(chunks, asked.select("query_id", "vector"), pool), "near")
    counts = near.groupBy("query_id").agg(F.count("*").alias("candidates"))
    picked = scratch.save(retrieval.diversified(near.join(chunks.select("chunk_id", "embedding"), "chunk_id"), picks), "picked")
    full = picked.join(chunks.drop("embedding"), "chunk_id").withColumns({"index": F.col("mmr_rank") - 1, "passage": F.coalesce("embedding_text", "content")})
    final = scratch.save(with_filenames(final_chunks(full, rerank(asked, full) if rerank else None, k), sources), "final")
    lines = prompts(asked, final)
    if answer is None:
        said = lines.select("query_id", F.lit("").alias("answer"))
    else:
        kind = lines.schema["query_id"].dataType.simpleString()

        def run(frames):
            for pdf in frames:
                yield pd.DataFrame({"query_id": pdf["query_id"], "answer": list(answer(pdf["prompt"].tolist())) if len(pdf) else []})
        said = lines.mapInPandas(run, f"query_id {kind}, answer string")
    sizes = picked.groupBy("query_id").agg(F.count("*").alias("picked")).join(final.groupBy("query_id").agg(F.count("*").alias("final")), "query_id")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("candidates", "picked", "final")}
    out = asked.select("query_id", "question").join(counts, "query_id", "left").join(sizes, "query_id", "left").join(said, "query_id", "left").withColumns(zero)
    text = F.when(F.col("candidates") == 0, NOTHING_FOUND).when((F.col("final") == 0) & F.lit(answer is not None), TOO_LITTLE).otherwise(F.coalesce("answer", F.lit("")))
    out = out.withColumns({"answer": text, "reranker_used": (F.col("final") > 0) & F.lit(rerank is not None)})
    return out, final.select("query_id", "rank", "chunk_id", "source_id", "filename", F.round("similarity", 4).alias("similarity"), F.round("score", 4).alias("score"))
