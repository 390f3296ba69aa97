"""The stored graph: upserts, scoped reads, seeds of questions, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fulltext, graph


def tenant_graphs(entities: DataFrame) -> DataFrame:
    return entities.select("tenant_id").distinct()


def without_tenant(rows: DataFrame, tenant_id) -> DataFrame:
    return rows.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant_id)))


def _appended(old: str, new: str) -> Column:
    """The old items, then the new ones that weren't there, in order."""
    empty = F.array().cast("array<string>")
    return F.array_union(F.coalesce(old, empty), F.coalesce(new, empty))


def upserted_entities(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Entities after an upsert by id: type, key and shown name are those of the first; aliases,
    alias keys and raw types are appended; search_text follows from names."""
    lists, once = ("aliases", "alias_keys", "raw_types"), ("tenant_id", "entity_type", "canonical_key", "display_name")
    both = stored.select("id", *[F.col(c).alias(f"{c}_old") for c in (*once, *lists)]).join(new.select("id", *[F.col(c).alias(f"{c}_new") for c in (*once, *lists)]), "id", "full")
    own = both.select("id", *[F.coalesce(f"{c}_old", f"{c}_new").alias(c) for c in once], *[_appended(f"{c}_old", f"{c}_new").alias(c) for c in lists])
    return own.withColumn("search_text", F.concat_ws(" ", "display_name", "aliases"))


def upserted_mentions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Mentions by (chunk, entity): a new description takes the place of the old one."""
    key = ["chunk_id", "entity_id"]
    both = stored.select(*key, F.col("source_id").alias("s_old"), F.col("description").alias("d_old")).join(new.select(*key, F.col("source_id").alias("s_new"), F.col("description").alias("d_new")), key, "full")
    return both.select(*key, F.coalesce("s_new", "s_old").alias("source_id"), F.coalesce("d_new", "d_old").alias("description"))


def upserted_facts(stored: DataFrame, new: DataFrame, relations: list[str]) -> DataFrame:
    """Facts by (a, relation, b, source): chunk ids are appended, description and raw relation are the
    first, confidence the greatest. Relations that the ontology lacks are left out."""
    key = ["a", "relation", "b", "source_id"]
    sides = [df.select(*key, *[F.col(c).alias(f"{c}_{s}") for c in ("chunk_ids", "description", "raw_relation", "confidence")]) for df, s in ((stored, "old"), (new.where(is_relation(F.col("relation"), relations)), "new"))]
    both = sides[0].join(sides[1], key, "full")
    return both.select(
        *key, _appended("chunk_ids_old", "chunk_ids_new").alias("chunk_ids"), F.coalesce("description_old", "description_new").alias("description"),
        F.coalesce("raw_relation_old", "raw_relation_new").alias("raw_relation"), F.greatest("confidence_old", "confidence_new").alias("confidence"))


def is_relation(name: Column, relations: list[str]) -> Column:
    """Whether a relation is of the ontology, or a label that is safe as one."""
    return F.coalesce(name.isin(*relations) & name.rlike(r"\A[A-Z][A-Z0-9_]*\z"), F.lit(False))


def known_entities(entities: DataFrame, tenant_id, types: list[str]) -> DataFrame:
    return entities.where((F.col("tenant_id") == tenant_id) & F.col("entity_type").isin(*types))


def moved_documents(documents: DataFrame, moves: DataFrame) -> DataFrame:
    """Documents under their new subjects (``moves``: source_id, to)."""
    to = moves.select("source_id", F.col("to").alias("_to"))
    return documents.join(to, "source_id", "left").withColumn("subject_id", F.coalesce("_to", "subject_id")).select(*documents.columns)


def orphaned_documents(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents of the graph whose source is gone."""
    return documents.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_anti")


def chunks_in_scope(chunks: DataFrame, wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of the ids wanted (chunk_id) whose source (source_id) is in scope."""
    return chunks.join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi").join(sources.select("source_id").distinct(), "source_id", "left_semi")


def mentioned(mentions: DataFrame, sources: DataFrame) -> DataFrame:
    """entity_id, mentions: distinct chunks of the sources in scope that mention an entity."""
    inside = mentions.join(sources.select("source_id").distinct().hint("merge"), "source_id", "left_semi")
    return inside.groupBy("entity_id").agg(F.countDistinct("chunk_id").alias("mentions"))


def by_keys(questions: DataFrame, entities: DataFrame, counts: DataFrame, limit: int = 5) -> DataFrame:
    """question_id, entity_id, mentions, nth: entities that a question names by key or alias, those
    of most mentions first. ``counts`` is of ``mentioned``: entities without one don't come."""
    names = entities.select(F.col("id").alias("entity_id"), F.explode(F.array_union(F.array("canonical_key"), F.coalesce("alias_keys", F.array().cast("array<string>")))).alias("key"))
    met = graph.question_keys(questions).select("question_id", "key").join(names, "key").select("question_id", "entity_id").distinct().join(counts, "entity_id")
    order = W.partitionBy("question_id").orderBy(F.desc("mentions"), "entity_id")
    return met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def by_words(questions: DataFrame, entities: DataFrame, counts: DataFrame, limit: int = 5) -> DataFrame:
    """question_id, entity_id, score, mentions, nth: entities whose search text has words of the
    question, those of most different words first, then by mentions. (A server's full-text score
    isn't public; the number of words that match stands in for it.)"""
    asked = questions.select("question_id", F.explode(graph.fulltext_words(F.col("question"))).alias("word"))
    held = entities.select(F.col("id").alias("entity_id"), F.explode(F.array_distinct(graph.question_words(F.col("search_text")))).alias("word"))
    met = asked.join(held, "word").groupBy("question_id", "entity_id").agg(F.count("*").alias("score")).join(counts, "entity_id")
    order = W.partitionBy("question_id").orderBy(F.desc("score"), F.desc("mentions"), "entity_id")
    return met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def by_score(questions: DataFrame, index: fulltext.FullText, counts: DataFrame, limit: int = 5) -> DataFrame:
    """question_id, entity_id, score, nth: entities of greatest full-text score (BM25) for the words
    of a question, of equal ones those of most mentions first. ``index`` is of entities (id, text:
    the search text); entities that ``counts`` lacks don't come."""
    asked = questions.select(F.col("question_id").alias("query_id"), graph.fulltext_words(F.col("question")).alias("words"))
    found, _ = fulltext.search(index, asked, limit, prior=counts.select(F.col("entity_id").alias("id"), F.col("mentions").alias("prior")))
    return found.select(F.col("query_id").alias("question_id"), F.col("id").alias("entity_id"), "score", F.col("rank").alias("nth"))


def seeds(questions: DataFrame, entities: DataFrame, counts: DataFrame, limit: int = 5, index: fulltext.FullText | None = None) -> DataFrame:
    """question_id, entity, rank: at most ``limit`` entities a question starts from: named ones
    first, then those that the full text finds: by score where there is an index, else by words."""
    keyed = by_keys(questions, entities, counts, limit).select("question_id", "entity_id", F.struct(F.lit(0).alias("way"), "nth").alias("at"))
    worded = (by_words(questions, entities, counts, limit) if index is None else by_score(questions, index, counts, limit)).select("question_id", "entity_id", F.struct(F.lit(1).alias("way"), "nth").alias("at"))
    first = keyed.unionByName(worded).groupBy("question_id", "entity_id").agg(F.min("at").alias("at"))
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy("at")))
    return ranked.where(F.col("rank") <= limit).select("question_id", F.col("entity_id").alias("entity"), "rank")


def view(facts: DataFrame, mentions: DataFrame, sources: DataFrame, max_entities: int = 100, max_facts: int = 200) -> tuple[DataFrame, DataFrame]:
    """The most mentioned entities of the sources in scope, and the facts among them that these
    sources state, merged, the surest first."""
    inside = sources.select("source_id").distinct()
    top = mentioned(mentions, sources).orderBy(F.desc("mentions"), "entity_id").limit(max_entities)
    own = facts.join(inside, "source_id", "left_semi").select(*facts.columns)
    among = graph.facts_among(own, top.select(F.col("entity_id").alias("entity")))
    return top, graph.merged_facts(among).orderBy(F.col("confidence").desc_nulls_last(), "a", "relation", "b").limit(max_facts)


def neighbours(facts: DataFrame, entity) -> DataFrame:
    """neighbour, relations: what an entity is linked with, either way."""
    ends = facts.where((F.col("a") == entity) | (F.col("b") == entity)).select(F.when(F.col("a") == entity, F.col("b")).otherwise(F.col("a")).alias("neighbour"), "relation")
    return ends.groupBy("neighbour").agg(F.sort_array(F.collect_set("relation")).alias("relations"))


def components(facts: DataFrame) -> DataFrame:
    """entity, component, size: the least entity that is reachable, and how many are.

    Every entity takes the least label of its neighbours and then that label's own label, until
    none changes; the jump makes long chains short.
    """
    from ..scratch import Scratch

    scratch, k = Scratch(facts.sparkSession, "components"), 0
    edges = facts.select("a", "b").unionByName(facts.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = scratch.save(edges, "edges")
    labels = scratch.save(edges.groupBy(F.col("a").alias("entity")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels0")
    while True:
        near = edges.join(labels.select(F.col("entity").alias("b"), "label"), "b").groupBy(F.col("a").alias("entity")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "entity").select("entity", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("entity").alias("to"), F.col("label").alias("beyond"))
        k += 1
        after = scratch.save(lower.join(jump, "to").select("entity", F.least("to", "beyond").alias("label"), (F.least("to", "beyond") != F.col("label")).alias("moved")), f"labels{k}")
        labels = after.select("entity", "label")
        if after.where("moved").isEmpty():
            break
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    return labels.join(sizes, "label").select("entity", F.col("label").alias("component"), "size")
