"""The graph's text side: text units, lenient extractions and their resolution by joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import confidence, entity_uuid
from . import graph
from .readings import item_field, json_items

#: A page marker line of a merged text, or a gap of blank lines.
GAP = re.compile(r"(?m)^<!--\s*[A-Za-z]+\s+(?P<page>\d+)\b[^\n]*?-->[ \t]*$|\n(?:[ \t]*\n)+")


def spans(content: str, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """begin, end, page (0: none) of the text between gaps, in pieces of at most ``limit``
    characters. A longer one is cut at its last newline, else at its last blank, if that leaves more
    than a quarter of ``limit``; else at ``limit``."""
    gaps = [(m.start(), m.end(), int(m["page"] or 0)) for m in GAP.finditer(content)]
    begin = np.array([0, *(g[1] for g in gaps)])
    end = np.array([*(g[0] for g in gaps), len(content)])
    marks = np.array([0, *(g[2] for g in gaps)])
    page = marks[np.maximum.accumulate(np.where(marks > 0, np.arange(len(marks)), 0))]
    chars = np.array(list(content))
    lines, blanks, solid = (np.flatnonzero(x) for x in (chars == "\n", (chars == " ") | (chars == "\t"), ~np.char.isspace(chars) if len(chars) else np.zeros(0, bool)))

    def trimmed(b, e, p):
        first, last = np.searchsorted(solid, b), np.searchsorted(solid, e) - 1
        there = first <= last
        return solid[first[there]], solid[last[there]] + 1, p[there]

    out = []
    for x, y, p in zip(*(v.tolist() for v in trimmed(begin, end, page))):
        while y - x > limit:
            room = ((at[np.searchsorted(at, x + limit) - 1] if np.searchsorted(at, x + limit) else -1) for at in (lines, blanks))
            cut = next((int(c) for c in room if c - x > limit // 4), x + limit)
            out.append((x, cut, p))
            x = cut
        out.append((x, y, p))
    return trimmed(*np.array(out, int).reshape(-1, 3).T)


def text_units(content: str, size: int = 3000, overlap: int = 300) -> list[dict]:
    """Units of up to ``size`` characters (no less than 200) of pieces joined by blank lines. A unit
    begins with the last pieces of the one before, if they have at most ``overlap`` characters, or
    with the end of its last piece, from a word on; without either where the next piece wouldn't fit.
    """
    size = max(200, size)
    overlap = max(0, min(overlap, size // 2))
    content = content or ""
    begin, end, page = spans(content, size)
    upto = np.concatenate([[0], np.cumsum(end - begin + 2)])  # lengths with the blank line after
    out, lead, start, fresh = [], None, 0, 0
    while fresh < len(begin):
        held = lead[1] - lead[0] + 2 if lead else 0
        stop = max(fresh + 1, int(np.searchsorted(upto, size + 2 - held + upto[start], side="right")) - 1)
        pieces = ([lead] if lead else []) + list(zip(begin[start:stop].tolist(), end[start:stop].tolist(), page[start:stop].tolist()))
        pages = [p for *_, p in pieces if p]
        out.append({
            "text": "\n\n".join(content[a:b] for a, b, _ in pieces), "char_start": pieces[0][0], "char_end": pieces[-1][1],
            "page_start": min(pages, default=None), "page_end": max(pages, default=None)})
        # what the next unit repeats
        back = max(start, int(np.searchsorted(upto, upto[stop] - overlap - 2)))
        whole = lead if lead and back == start and held + upto[stop] - upto[start] - 2 <= overlap else None
        if back == stop and overlap:
            a, b, p = pieces[-1]
            a = max(a, b - overlap)
            word = re.compile(r"\s*(\S(?:.*\S)?)", re.S).match(content, max(content.find(" ", a, b), a), b)
            whole = (word.start(1), word.end(1), p) if word else None
        repeat = (whole[1] - whole[0] + 2 if whole else 0) + int(upto[stop] - upto[back])
        fits = stop < len(begin) and repeat + end[stop] - begin[stop] <= size
        lead, start, fresh = (whole, back, stop) if fits else (None, stop, stop)
    return out


def units_of(contents: DataFrame, size: int = 3000, overlap: int = 300) -> DataFrame:
    """tenant_id, source_id, index, id and the unit's fields, from tenant_id, source_id, version,
    content; a row at a time."""
    kinds = {f.name: f.dataType.simpleString() for f in contents.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["tenant_id", "source_id", "version", "index", "text", "char_start", "char_end", "page_start", "page_end"]
        for pdf in frames:
            rows = [{"tenant_id": t, "source_id": s, "version": v, "index": k} | u for t, s, v, c in pdf.itertuples(index=False) for k, u in enumerate(text_units(c, size, overlap))]
            made = pd.DataFrame(rows, columns=cols)
            yield made.astype({"page_start": "Int64", "page_end": "Int64"})

    made = contents.select("tenant_id", "source_id", "version", "content").mapInPandas(run, f"tenant_id {kinds['tenant_id']}, source_id {kinds['source_id']}, version {kinds['version']}, index int, text string, char_start int, char_end int, page_start int, page_end int")
    return made.withColumn("id", F.concat_ws(":", "source_id", "version", "index"))


def strings(value: Column, most: int = 20) -> Column:
    """A list of a JSON text's strings: a lone one is a list of one; trimmed, blanks left out."""
    listed = F.from_json(value, "array<string>")
    return F.slice(F.filter(F.transform(F.coalesce(listed, F.array(value)), lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False))), 1, most)


def extractions(units: DataFrame, answers: str = "answer", most: int = 200) -> DataFrame:
    """Adds the entities and relationships that an answer holds in usable form, and how many items
    were dropped (``skipped``).

    The model's lists have ``most`` items at most: what comes after isn't read. Names are trimmed,
    an item without a name or with one over 300 characters goes; types and relations are cut to 64
    characters, descriptions to 1000; an item has 20 aliases at most.
    """
    answer = F.col(answers)
    named = lambda x: F.coalesce((x != "") & (F.length(x) <= 300), F.lit(False))
    field = lambda x, n, size=None: (F.trim(item_field(x, n)) if size is None else F.substring(F.trim(item_field(x, n)), 1, size)).alias(n)
    items = lambda name: F.slice(F.coalesce(json_items(answer, name), F.array().cast("array<string>")), 1, most)
    made = F.transform(items("entities"), lambda x: F.struct(field(x, "name"), field(x, "type", 64), field(x, "description", 1000), strings(item_field(x, "aliases")).alias("aliases")))
    linked = F.transform(items("relationships"), lambda x: F.struct(
        field(x, "source"), field(x, "source_type", 64), field(x, "relation", 64), field(x, "target"), field(x, "target_type", 64), field(x, "description", 1000), item_field(x, "confidence").alias("confidence")))
    read = units.withColumns({"_e": made, "_r": linked})
    entities = F.filter("_e", lambda e: named(e["name"]))
    links = F.filter("_r", lambda r: named(r["source"]) & named(r["target"]) & F.coalesce(r["relation"] != "", F.lit(False)))
    out = read.withColumns({"entities": entities, "relationships": links})
    return out.withColumn("skipped", F.size("_e") - F.size("entities") + F.size("_r") - F.size("relationships")).drop("_e", "_r")


def counters(read: DataFrame, entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row of a build's counts: units, items read and skipped, entities made, and mentions that
    met an entity that was there already."""
    items = read.agg(F.count("*").alias("units"), F.sum(F.size("entities")).alias("extracted"), F.sum(F.size("relationships")).alias("relationships"), F.sum("skipped").alias("skipped"))
    made = entities.agg(F.count("*").alias("created"))
    met = mentions.agg(F.count("*").alias("mentions"))
    return items.join(made).join(met).withColumn("matched", F.col("mentions") - F.col("created"))


def resolved(units: DataFrame, ontology: dict, tenant: str = "tenant_id", threshold: float = 92.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, mentions and facts of extractions, deduplicated in a tenant; see ``resolved_keys``."""
    return resolved_keys(units, ontology, tenant, threshold)[:3]


def resolved_keys(units: DataFrame, ontology: dict, tenant: str = "tenant_id", threshold: float = 92.0, known: graph.KeyIndex | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities, mentions and facts of extractions, deduplicated in a tenant, and the keys met
    (tenant_id, entity_type, key, to: the key of its entity, first).

    Positions go by source, unit index, place in the answer, unit id and key, so no two keys of
    a type are at one position. ``known`` holds the keys of earlier batches: these are earlier than
    all of this one's and none of them changes, so sources that come batch by batch in ascending
    order give the entities that they give at once, unless an alias is given for two of the known
    ones, which stay two. The keys returned are this batch's own, to be added to ``known``.

    Names with one key and type are one entity, and so are keys that ``graph.aliases_of`` joins;
    an alias names the entity that it is given for. Endpoints resolve by the unit's own names,
    whatever their type, before the type that the relationship gives. All steps are group-bys and
    joins by tenant and key, so a tenant of any size spreads over tasks.
    """
    base = units.select(F.col(tenant).alias("tenant_id"), F.col("id").alias("unit"), "source_id", "index", "entities", "relationships")
    named = base.select("tenant_id", "unit", "source_id", "index", F.posexplode("entities").alias("nth", "e")).select("*", "e.*")
    ends = base.select("tenant_id", "unit", "source_id", "index", F.posexplode("relationships").alias("rel", "r")).select("*", "r.*")
    typed = lambda df, raw: graph.mapped(df, raw, ontology["types"], ontology["type_synonyms"], ontology["fallback_type"], out="entity_type")
    named = typed(named, "type").withColumn("shown", graph.display_name("name")).withColumn("key", graph.canonical_key("shown", "entity_type")).where("key != ''")
    local = named.groupBy("tenant_id", "unit", F.lower("shown").alias("fold")).agg(F.min_by(F.struct("key", "entity_type"), "nth").alias("own"))
    points = None
    for side in ("source", "target"):
        one = typed(ends.withColumn("raw_type", F.col(f"{side}_type")), "raw_type").withColumn("shown", graph.display_name(side)).withColumn("fold", F.lower("shown")).withColumn("key", graph.canonical_key("shown", "entity_type"))
        one = one.join(local, ["tenant_id", "unit", "fold"], "left").select("tenant_id", "unit", "source_id", "index", "rel", F.lit(side).alias("side"), "shown", F.coalesce("own.key", "key").alias("key"), F.coalesce("own.entity_type", "entity_type").alias("entity_type"))
        points = one if points is None else points.unionByName(one)
    points = points.where("key != ''")
    every = named.select("tenant_id", "entity_type", "key", "shown", "unit", "source_id", F.struct("source_id", "index", F.lit(0).alias("late"), F.col("nth").alias("n"), "unit").alias("at"), "description").unionByName(
        points.select("tenant_id", "entity_type", "key", "shown", "unit", "source_id", F.struct("source_id", "index", F.lit(1).alias("late"), F.col("rel").alias("n"), "unit").alias("at"), F.lit(None).cast("string").alias("description")))
    firsts = every.groupBy("tenant_id", "entity_type", "key").agg(F.min("at").alias("at"))
    order = firsts.withColumn("first", F.struct("at.*", "key"))
    if known is not None:
        order = order.join(known.keys.select("tenant_id", "entity_type", "key"), ["tenant_id", "entity_type", "key"], "left_anti")
    given = named.select("tenant_id", "entity_type", F.col("key").alias("to"), F.explode("aliases").alias("alias")).withColumn("key", graph.canonical_key("alias", "entity_type")).where("key != '' and key != to")
    similar = graph.aliases_of(order.select("tenant_id", "entity_type", "key", "first"), threshold, known)
    # a given alias and its entity are one: the later points to the earlier, as similar keys do
    at = order.select("tenant_id", "entity_type", "key", F.struct(F.lit(1).alias("age"), "first").alias("first"))
    if known is not None:
        at = at.unionByName(known.keys.select("tenant_id", "entity_type", "key", F.struct(F.lit(0).alias("age"), "first").alias("first")))
    given = given.select("tenant_id", "entity_type", "key", "to").distinct().join(at, ["tenant_id", "entity_type", "key"], "left").join(at.select("tenant_id", "entity_type", F.col("key").alias("to"), F.col("first").alias("to_first")), ["tenant_id", "entity_type", "to"])
    given = given.where(F.coalesce(F.greatest("first", "to_first")["age"] == 1, F.lit(True)) | F.col("first").isNull())
    turned = F.coalesce(F.col("first") < F.col("to_first"), F.lit(False))
    given = given.select("tenant_id", "entity_type", F.when(turned, F.col("to")).otherwise(F.col("key")).alias("key"), F.when(turned, F.col("key")).otherwise(F.col("to")).alias("to"), F.when(turned, F.col("first")).otherwise(F.col("to_first")).alias("to_first"), F.lit(0).alias("late"))
    both = given.unionByName(similar.withColumns({"to_first": F.lit(None).cast(at.schema["first"].dataType), "late": F.lit(1)}))
    alias = both.groupBy("tenant_id", "entity_type", "key").agg(F.min_by("to", F.struct("late", "to_first", "to")).alias("to"))
    if known is not None:  # a known key leads to its entity, whatever this batch says of it
        old = known.keys.where("key != to").select("tenant_id", "entity_type", "key", "to")
        alias = alias.join(known.keys.select("tenant_id", "entity_type", "key"), ["tenant_id", "entity_type", "key"], "left_anti").unionByName(old)
    alias = graph.rooted(alias)

    def canonical(df: DataFrame) -> DataFrame:
        return df.join(alias, ["tenant_id", "entity_type", "key"], "left").withColumn("key", F.coalesce("to", "key")).drop("to").withColumn("entity_id", entity_uuid(F.col("tenant_id").cast("string"), F.col("entity_type"), F.col("key")))

    mine = canonical(every)
    entities = mine.groupBy("tenant_id", "entity_id").agg(F.min_by(F.struct("entity_type", F.col("key").alias("canonical_key"), F.col("shown").alias("display_name")), "at").alias("e"), F.sort_array(F.collect_set("shown")).alias("names")).select("tenant_id", "entity_id", "e.*", "names")
    mentions = mine.groupBy("tenant_id", F.col("unit").alias("chunk_id"), "entity_id", "source_id").agg(F.min_by("description", F.when(F.trim("description") != "", F.col("at"))).alias("description"))
    placed = canonical(points).groupBy("tenant_id", "unit", "rel").agg(F.max(F.when(F.col("side") == "source", F.col("entity_id"))).alias("s"), F.max(F.when(F.col("side") == "target", F.col("entity_id"))).alias("t"))
    links = graph.mapped(ends.select("tenant_id", "unit", "source_id", "index", "rel", F.col("relation").alias("label"), "description", confidence(F.col("confidence")).alias("confidence")), "label", ontology["relations"], ontology["relation_synonyms"], ontology["fallback_relation"], ontology["inverse_relations"], out="relation")
    both = links.join(placed, ["tenant_id", "unit", "rel"]).withColumns({"a": F.when(F.col("relation_reversed"), F.col("t")).otherwise(F.col("s")), "b": F.when(F.col("relation_reversed"), F.col("s")).otherwise(F.col("t"))})
    both = both.where("a is not null and b is not null and a != b").withColumn("at", F.struct("index", "rel", "unit"))
    facts = both.groupBy("tenant_id", "a", "relation", "b", "source_id").agg(
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("at", "unit"))), lambda x: x["unit"])).alias("chunk_ids"), F.min_by("description", F.when(F.trim("description") != "", F.col("at"))).alias("description"),
        F.max("confidence").alias("confidence"), F.min_by("relation_raw", "at").alias("raw_relation"))
    keys = order.select("tenant_id", "entity_type", "key", "first").join(alias, ["tenant_id", "entity_type", "key"], "left").select("tenant_id", "entity_type", "key", F.coalesce("to", "key").alias("to"), "first")
    # a name that was only given as an alias leads to its entity as well
    given_only = alias.join(order.select("tenant_id", "entity_type", "key"), ["tenant_id", "entity_type", "key"], "left_anti").select("tenant_id", "entity_type", "key", "to", F.lit(None).cast(order.schema["first"].dataType).alias("first"))
    if known is not None:
        given_only = given_only.join(known.keys.select("tenant_id", "entity_type", "key"), ["tenant_id", "entity_type", "key"], "left_anti")
    return entities, mentions, facts, keys.unionByName(given_only)
