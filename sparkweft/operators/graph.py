"""Knowledge graph over DataFrames: names, types, resolution, facts, bounded search.

Facts are rows (a, relation, b, source_id, ...), mentions rows (chunk_id, entity_id, source_id).
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import acronym, label
from ..scratch import Scratch

# fixed values: legal forms at the end of organisations' names, honorifics before people's
LEGAL_FORMS = set("inc incorporated corp corporation co company ltd limited llc llp lp plc pvt private pte gmbh ag sa sas bv nv oy ab kk srl spa".split())
HONORIFICS = set("mr mrs ms miss mx dr prof sir shri sri smt kumari thiru tmt selvi".split())
ORGANISATIONS = ("COMPANY", "ORGANIZATION")
# fixed values: words that begin or end no phrase of a question
STOP_WORDS = set(
    "a an and are as at be been by can could did do does for from had has have how i in into is it its me my of on or our so than that the their them "
    "then there these they this to us was we were what when where which who whom whose why will with would you your about any all also between connected "
    "related tell show list give find much many please other others".split())


_FORMS = re.compile(rf"(?<=.)(?: (?:{'|'.join(sorted(LEGAL_FORMS))}))+$")
_TITLES = re.compile(rf"^(?:(?:{'|'.join(sorted(HONORIFICS))}) )+")


def name_key(name: str | None, kind: str | None = None) -> str:
    """The identity of a name: folded words joined by ``_``, without legal forms or honorifics."""
    folded = unicodedata.normalize("NFKC", name or "").casefold().replace("&", " and ")
    plain = re.sub(r"\b[.'’]\b", "", folded)
    words = " ".join(w for w in re.split(r"\W+", plain) if w not in ("", "_"))
    if kind in ORGANISATIONS:
        words = _FORMS.sub("", re.sub("^the (?=.)", "", words))
    elif kind == "PERSON":
        words = _TITLES.sub("", words)
    return words.replace(" ", "_")


def _name_keys(name: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([name_key(n, k) for n, k in zip(name, kind)])


def _shown(name: pd.Series) -> pd.Series:
    return name.map(lambda n: " ".join(unicodedata.normalize("NFKC", n or "").split()).strip("\"'`“”‘’«» ").strip())


def canonical_key(name, kind) -> Column:
    return F.pandas_udf(_name_keys, "string")(name, kind)


def display_name(name) -> Column:
    return F.pandas_udf(_shown, "string")(name)


def ascii_key(name: Column) -> Column:
    """``canonical_key`` without type for ASCII names, inside the engine."""
    joined = F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), r"(?<=\w)[.'](?=\w)", "")
    return F.array_join(F.filter(F.split(joined, r"\W+"), lambda w: (w != "") & (w != "_")), "_")


def mapped(df: DataFrame, raw: str, allowed: list[str], synonyms: dict[str, str], fallback: str, inverse: dict[str, str] | None = None, out: str = "mapped") -> DataFrame:
    """Adds a label of the ontology, the model's own where it had to be mapped, and whether the
    relation turns round. The tables are configuration, so they are literals of the plan."""
    own = label(F.col(raw))
    look = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), own) if table else F.lit(None).cast("string")
    exact, same, turned = F.when(own.isin(allowed), own), look(synonyms), look(inverse or {})
    return df.withColumn(out, F.coalesce(exact, same, turned, F.lit(fallback))).withColumn(f"{out}_raw", F.when(exact.isNull() & (own != ""), own)).withColumn(
        f"{out}_reversed", exact.isNull() & same.isNull() & turned.isNotNull())


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions over both lengths), from the longest common subsequence:
    a whole number holds a bit for each character of ``a``, so a step covers all of them."""
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    every = (1 << len(a)) - 1
    free = every
    for y in b:
        hit = free & places.get(y, 0)
        free = (free + hit | free - hit) & every
    total = len(a) + len(b)
    return 100.0 * 2 * (len(a) - free.bit_count()) / total if total else 100.0


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def similarity(a, b) -> Column:
    return F.pandas_udf(_similarities, "double")(a, b)


def _lost(q: int, h: float) -> float:
    """The greatest share of a key's length that its q-grams lose against a partner.

    At a ratio of 200 h the common subsequence has at least h of both lengths. A character that
    only the key has takes q of its q-grams, one that only the partner has q - 1; the sum is
    linear in the partner's length, so it is greatest at an end of what h allows.
    """
    return max(q + (q - 1) * r - (2 * q - 1) * h * (1 + r) for r in (h / (1 - h), (1 - h) / h))


def key_grams(names: DataFrame, threshold: float) -> DataFrame:
    """The q-grams of each key, with how often a key has had one (nth). Keys of 16 characters and
    more have four letters to a gram, those that may meet shorter ones two as well."""
    h, n = threshold / 200, F.length("key")
    sizes = F.filter(F.array(F.when((n < 16) | (n * (h / (1 - h)) < 16), 2), F.when(n >= 16, 4)), lambda q: q.isNotNull())
    grams = names.select("tenant_id", "entity_type", "key", F.explode(sizes).alias("q")).select("*", F.posexplode(F.transform(F.sequence(F.lit(1), n - F.col("q") + 1), lambda i: F.col("key").substr(i, F.col("q")))).alias("pos", "gram"))
    return grams.withColumn("nth", F.row_number().over(W.partitionBy("tenant_id", "entity_type", "q", "key", "gram").orderBy("pos"))).drop("pos")


GRAM = ["tenant_id", "entity_type", "q", "gram", "nth"]


def rare_grams(names: DataFrame, threshold: float, counts: DataFrame | None = None) -> DataFrame:
    """The rarest grams of each key, as many as a partner at the threshold can't all lack.

    ``counts`` (GRAM, n) says what is rare, for any two tables that are to meet the same; a gram
    that it lacks is the rarest. Without it the names' own counts do.
    """
    h, n = threshold / 200, F.length("key")
    grams = key_grams(names, threshold)
    counts = grams.groupBy(*GRAM).agg(F.count("*").alias("n")) if counts is None else counts
    counted = grams.join(counts, GRAM, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lost = F.floor(n * F.when(F.col("q") == 2, _lost(2, h)).otherwise(_lost(4, h)) + 1e-9)
    rare = counted.withColumn("at", F.row_number().over(W.partitionBy("tenant_id", "entity_type", "q", "key").orderBy("n", "gram", "nth"))).where(F.col("at") <= lost + 1)
    return rare.select(*GRAM, "key").join(names, ["tenant_id", "entity_type", "key"])


def _spelled(threshold: float) -> int:
    """The length up to which a key loses at most two characters against a partner at the threshold,
    so that ``_by_spelling`` has few spellings of it."""
    h = threshold / 200
    lost = 1 - h / (1 - h) if h < 0.5 else 0.0
    return math.ceil(3 / lost - 1e-9) - 1 if lost > 0 else 1 << 30


def _by_spelling(every: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """tenant_id, entity_type, key, to, score, to_at: for each key of age 1 the earlier keys that may be
    its most similar, among keys of at most ``_spelled`` characters.

    Two keys have a common subsequence of a length if both spell it when characters are left out. So
    keys meet in what they spell, and of each length only the earliest key that spells something is
    looked at: the score goes by lengths alone, and a nearer key is met in what is longer. Work is in
    proportion to the keys, however many of them are alike.
    """
    name, n = ["tenant_id", "entity_type"], F.length("key")
    lengths = every.groupBy(*name).agg(F.collect_set(n).alias("lengths"))
    fits = lambda lost: F.exists("lengths", lambda m: (m >= n - lost) & (200.0 * (n - lost) / (n + m) >= threshold))
    shorter = lambda v: F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(v.substr(F.lit(1), i - 1), v.substr(i + 1, F.length(v))))
    one = F.array_distinct(shorter(F.col("key")))
    two = F.array_distinct(F.flatten(F.transform(one, shorter)))
    none = F.array().cast("array<string>")
    spelled = F.concat(*[F.when(fits(lost), v).otherwise(none) for lost, v in enumerate((F.array("key"), one, two))])
    cells = scratch.save(every.join(lengths, name).select(*name, "key", n.alias("n"), F.struct("age", "first").alias("at"), F.explode(spelled).alias("part")), "spelled")
    heads = cells.groupBy(*name, "part", F.col("n").alias("to_n")).agg(F.min(F.struct("at", F.col("key").alias("to"))).alias("head"))
    met = cells.where("at.age = 1").join(heads.hint("merge"), [*name, "part"]).where(F.col("head.at") < F.col("at"))
    met = met.withColumn("score", 200.0 * F.length("part") / (F.col("n") + F.col("to_n"))).where(F.col("score") >= threshold)
    return met.select(*name, "key", "head.to", "score", F.col("head.at").alias("to_at"))


def _sharing(names: DataFrame, threshold: float, known=None) -> DataFrame:
    """Pairs of keys of a type (key, at, to, to_at: the places), key of ``names``, with all that reach
    the ratio and of which one is longer than ``_spelled``.

    A key that loses at most m of its q-grams shares one of its m + 1 rarest with the partner's
    m + 1 rarest. Pairs of 16 characters and more meet by four, others by two. With ``known`` (a
    ``KeyIndex``) to may be one of its keys as well, whose rare grams are stored.
    """
    h = threshold / 200
    place = lambda side: F.struct(F.col(f"{side}.age").alias("age"), F.col(f"{side}.first").alias("first"))
    pair = ["tenant_id", "entity_type", F.col("x.key").alias("key"), place("x").alias("at"), F.col("y.key").alias("to"), place("y").alias("to_at")]
    bound = F.abs(F.length("x.key") - F.length("y.key")) <= (1 - 2 * h) * (F.length("x.key") + F.length("y.key")) + 1e-9
    every = names if known is None else names.unionByName(known.keys.select(*names.columns))
    if threshold < 90:  # the filter keeps too little then
        return names.alias("x").join(every.alias("y"), ["tenant_id", "entity_type"]).where(bound).select(*pair)
    long, name = F.length("key") > _spelled(threshold), ["tenant_id", "entity_type"]
    names = names.join(every.where(long).select(*name).distinct(), name, "left_semi")
    rare = rare_grams(names, threshold, known and known.counts)
    every = rare if known is None else rare.unionByName(known.rare.select(*rare.columns))
    pairs = lambda x, y: x.alias("x").join(y.alias("y"), GRAM).where(bound).select(*pair)
    return pairs(rare.where(long), every).unionByName(pairs(rare.where(~long), every.where(long)))


class KeyIndex:
    """The keys that a graph has already, with the rare grams that a new batch meets them by.

    Tables under ``path``: keys (tenant_id, entity_type, key, to: the entity's own key, first: the
    position), rare (grams of keys) and counts (what is rare, as of the first batch, so the order is
    one for all batches). A batch is a folder; adding one writes its keys only.
    """

    def __init__(self, spark, path: str, threshold: float = 92.0):
        self.spark, self.path, self.threshold = spark, path, threshold

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")

    keys = property(lambda self: self._read("keys"))
    rare = property(lambda self: self._read("rare"))
    counts = property(lambda self: self._read("counts"))

    def add(self, keys: DataFrame, batch: int) -> None:
        """Writes the keys of a batch (those of ``resolved_keys`` that are new)."""
        keys = keys.select("tenant_id", "entity_type", "key", "to", "first")
        keys.write.mode("overwrite").parquet(f"{self.path}/keys/{batch}")
        own = self.spark.read.parquet(f"{self.path}/keys/{batch}")
        long = own.where((F.length("key") >= 5) & F.col("first").isNotNull()).select("tenant_id", "entity_type", "key", "first")
        if batch == 0:
            key_grams(long, self.threshold).groupBy(*GRAM).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.path}/counts")
        rare_grams(long, self.threshold, self.counts).write.mode("overwrite").parquet(f"{self.path}/rare/{batch}")


def rooted(alias: DataFrame) -> DataFrame:
    """tenant_id, entity_type, key, to: each key's last target, chains followed to their ends.

    A round doubles the steps followed. Targets are earlier than keys, so there is no circle.
    """
    scratch, name, k = Scratch(alias.sparkSession, "aliases"), ["tenant_id", "entity_type"], 0
    now = scratch.save(alias, "to0")
    while True:
        ahead = now.select(*name, F.col("key").alias("to"), F.col("to").alias("beyond"))
        found = now.join(ahead, [*name, "to"], "left").select(*name, "key", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved"))
        k += 1
        found = scratch.save(found, f"to{k}")
        now = found.drop("moved")
        if found.where("moved").isEmpty():
            return now


def aliases_of(names: DataFrame, threshold: float = 92.0, known: KeyIndex | None = None) -> DataFrame:
    """key, to: keys of a type that name the same entity as an earlier one.

    ``names`` has tenant_id, entity_type, key and first, its first position: of any type that has
    an order, and no two keys of a type at one position. An organisation's acronym of three letters
    or more joins the key it abbreviates; keys of five characters or more join the most similar
    earlier one, the earliest of equals, if it is similar enough. No pair at the threshold is left
    out of the candidates. Keys of ``known`` are earlier than all names and stay as they are.
    """
    scratch = Scratch(names.sparkSession, "names")
    own = scratch.save(names.groupBy("tenant_id", "entity_type", "key").agg(F.min("first").alias("first")).withColumn("age", F.lit(1)), "own")
    every = own if known is None else own.unionByName(known.keys.select("tenant_id", "entity_type", "key", "first").withColumn("age", F.lit(0)))
    organisations = every.where(F.col("entity_type").isin(*ORGANISATIONS)).select("tenant_id", "entity_type", "key", F.struct("age", "first").alias("at"))
    short = organisations.withColumn("short", acronym(F.col("key"))).where(F.length("short") >= 3).select("tenant_id", "entity_type", F.col("key").alias("long"), F.col("at").alias("at_long"), F.col("short").alias("key"))
    later = F.col("at") > F.col("at_long")
    by_letters = organisations.join(short, ["tenant_id", "entity_type", "key"]).where(F.greatest("at", "at_long")["age"] == 1).select(
        "tenant_id", "entity_type", F.when(later, F.col("key")).otherwise(F.col("long")).alias("key"), F.when(later, F.col("long")).otherwise(F.col("key")).alias("to"), F.lit(100.0).alias("score"), F.least("at", "at_long").alias("to_at"))
    long = own.where(F.length("key") >= 5).select("tenant_id", "entity_type", "key", "first")
    near = _sharing(long.withColumn("age", F.lit(1)), threshold, known and _Aged(known)).where(F.col("to_at") < F.col("at")).drop("at").distinct()
    near = near.withColumn("score", similarity("key", "to")).where(F.col("score") >= threshold).select("tenant_id", "entity_type", "key", "to", "score", "to_at")
    both = by_letters.unionByName(near)
    if threshold >= 90:
        spelled = every.where(F.length("key").between(5, _spelled(threshold)) & ((F.col("age") == 1) | F.col("first").isNotNull()))
        both = both.unionByName(_by_spelling(spelled, threshold, scratch))
    return both.groupBy("tenant_id", "entity_type", "key").agg(F.min_by("to", F.struct(-F.col("score"), "to_at", "to")).alias("to"))


class _Aged:
    """An index whose keys are marked as older than a batch's."""

    def __init__(self, index: KeyIndex):
        self.keys, self.rare, self.counts = index.keys.withColumn("age", F.lit(0)), index.rare.withColumn("age", F.lit(0)), index.counts


def merged_facts(facts: DataFrame) -> DataFrame:
    """One row for each (a, relation, b): sorted distinct sources, greatest confidence, edges; where
    facts have them, all chunk ids and the description of the first source that gives one."""
    extra = []
    if "chunk_ids" in facts.columns:
        extra.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("chunk_ids"))
    if "description" in facts.columns:
        extra.append(F.min_by("description", F.when(F.trim("description") != "", F.struct("source_id", "description"))).alias("description"))
    return facts.groupBy("a", "relation", "b").agg(F.sort_array(F.collect_set("source_id")).alias("source_ids"), F.max("confidence").alias("confidence"), F.count("*").alias("edges"), *extra)


def facts_touching(facts: DataFrame, frontier: DataFrame) -> DataFrame:
    """Facts with an end in the frontier (entity): two semi-joins, no fact twice."""
    out = facts.join(frontier.select(F.col("entity").alias("a")), "a", "left_semi")
    into = facts.join(frontier.select(F.col("entity").alias("b")), "b", "left_semi").join(frontier.select(F.col("entity").alias("a")), "a", "left_anti")
    return out.unionByName(into.select(*facts.columns))


def facts_among(facts: DataFrame, entities: DataFrame) -> DataFrame:
    a, b = (entities.select(F.col("entity").alias(c)) for c in "ab")
    return facts.join(a, "a", "left_semi").join(b, "b", "left_semi").select(*facts.columns)


def reached(facts: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """entity, hop: everything within ``hops`` edges of the seeds, either way, at its least hop."""
    edges = facts.select("a", "b").distinct()
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = level = seeds.select("entity", F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        level = level.join(both, level["entity"] == both["a"]).select(F.col("b").alias("entity")).distinct().join(found.select("entity"), "entity", "left_anti").withColumn("hop", F.lit(hop))
        found = found.unionByName(level)
    return found


def top_entities(mentions: DataFrame, k: int) -> DataFrame:
    """Entities by distinct chunks that mention them, ties by id."""
    return mentions.groupBy("entity_id").agg(F.countDistinct("chunk_id").alias("mentions")).orderBy(F.desc("mentions"), "entity_id").limit(k)


def entity_details(mentions: DataFrame, k: int = 20, sources: DataFrame | None = None, words: int = 3) -> DataFrame:
    """entity_id, chunk_ids (the first ``k``), source_ids; with descriptions among the mentions, the
    first ``words`` of them by chunk. ``sources`` (source_id) are those in scope, if given."""
    own = mentions if sources is None else mentions.join(sources.select("source_id").distinct(), "source_id", "left_semi")
    extra = []
    if "description" in mentions.columns:
        told = F.sort_array(F.collect_set(F.when(F.trim("description") != "", F.struct("chunk_id", "description"))))
        extra.append(F.slice(F.array_distinct(F.transform(told, lambda x: x["description"])), 1, words).alias("descriptions"))
    return own.groupBy("entity_id").agg(F.slice(F.sort_array(F.collect_set("chunk_id")), 1, k).alias("chunk_ids"), F.sort_array(F.collect_set("source_id")).alias("source_ids"), *extra)


def without_source(facts: DataFrame, mentions: DataFrame, source_id) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts and mentions left when a source goes, and the entities that nothing mentions then."""
    left = mentions.where(F.col("source_id") != source_id)
    gone = mentions.where(F.col("source_id") == source_id).select("entity_id").distinct().join(left.select("entity_id").distinct(), "entity_id", "left_anti")
    return facts.where(F.col("source_id") != source_id), left, gone


def question_words(text: Column) -> Column:
    """A question's words of two characters or more, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[\W_]+"), lambda w: F.length(w) > 1)


def fulltext_words(text: Column) -> Column:
    """The words that a full-text search looks for: distinct ones that aren't stop words."""
    return F.array_distinct(F.filter(question_words(text), lambda w: ~w.isin(*sorted(STOP_WORDS))))


def fulltext_query(text: Column) -> Column:
    return F.array_join(fulltext_words(text), "|")


def question_keys(questions: DataFrame, longest: int = 4) -> DataFrame:
    """question_id, nth, key: keys of the phrases of one to ``longest`` words that a question may
    name, longest phrases first; as a free name and as an organisation's. ``questions`` has
    question_id and question; a null question names nothing."""
    stop = sorted(STOP_WORDS)
    worded = questions.select("question_id", question_words(F.col("question")).alias("w"))
    sizes = F.filter(F.sequence(F.lit(longest), F.lit(1), F.lit(-1)), lambda n: n <= F.size("w"))
    spans = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))))
    kept = F.filter(spans, lambda p: ~F.element_at(p, 1).isin(*stop) & ~F.element_at(p, -1).isin(*stop))
    phrases = worded.select("question_id", F.posexplode(F.transform(kept, lambda p: F.array_join(p, " "))).alias("nth", "phrase"))
    kinds = F.explode(F.array(F.lit(""), F.lit("COMPANY"))).alias("kind")
    keyed = phrases.select("question_id", "nth", "phrase", kinds).select("question_id", "nth", canonical_key("phrase", "kind").alias("key"))
    return keyed.where("key != ''").groupBy("question_id", "key").agg(F.min("nth").alias("nth")).select("question_id", "nth", "key")


def _within(max_entities: int):
    """A question's facts of a hop, best first: those that fit its budget of entities, and what
    they reach. A hop has at most as many facts as the question may still take."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        met, kept, added = set(pdf["visited"].iloc[0]), [], []
        for a, b in zip(pdf["a"], pdf["b"]):
            new = {a, b} - met
            fits = len(met) + len(new) <= max_entities
            kept.append(fits)
            if fits:
                added += sorted(new, key=[a, b].index)
                met |= new
        return pd.DataFrame({
            "question_id": [key[0]] * len(pdf), "a": pdf["a"].to_numpy(), "relation": pdf["relation"].to_numpy(), "b": pdf["b"].to_numpy(), "source_id": pdf["source_id"].to_numpy(), "confidence": pdf["confidence"].to_numpy(),
            "kept": kept, "added": [added if k == 0 else [] for k in range(len(pdf))]})
    return run


def _leading(facts: DataFrame, entities: DataFrame, most: int) -> DataFrame:
    """entity, fact: of each entity's facts those that may be among the best ``most`` of a question.

    A question has taken some facts before and has room for the rest of ``most``. Facts are taken out
    by (a, relation, b, source_id), with all their confidences; so of an entity's ``most`` best
    ones by that key enough are left, each with its ``most`` best confidences.
    """
    key = ["a", "relation", "b", "source_id"]
    own = facts.join(entities.select(F.col("entity").alias("a")), "a", "left_semi").select(F.col("a").alias("entity"), *facts.columns).unionByName(
        facts.join(entities.select(F.col("entity").alias("b")), "b", "left_semi").where("not (a <=> b)").select(F.col("b").alias("entity"), *facts.columns))
    sure = F.coalesce("confidence", F.lit(0.0))
    keyed = own.groupBy("entity", *key).agg(F.slice(F.sort_array(F.collect_set(F.struct(sure.alias("sure"), "confidence")), asc=False), 1, most).alias("_all"))
    best = keyed.withColumn("_nth", F.row_number().over(W.partitionBy("entity").orderBy(F.col("_all")[0]["sure"].desc(), *key))).where(F.col("_nth") <= most)
    return best.select("entity", *key, F.explode("_all").alias("_one")).select("entity", *key, "_one.confidence")


def budgeted_search(facts: DataFrame, seeds: DataFrame, hops: int = 2, max_entities: int = 20, max_facts: int = 50) -> tuple[DataFrame, DataFrame]:
    """Entities (question_id, entity, hop) and facts (question_id, hop, a, relation, b, source_id,
    confidence) that each question meets within one to three hops of its seeds (question_id,
    entity), under two budgets. A hop's best facts come first; facts over a budget are left out,
    and a fact of no new entity still fits a full budget of entities.

    All questions go a hop at once: a join of their frontiers with what ``_leading`` keeps of each
    entity's facts, so a hub that many questions meet is read once and not once for each of them.
    Questions of the same seeds meet the same; one of them is searched for all.
    """
    scratch = Scratch(facts.sparkSession, "search")
    sets = seeds.groupBy("question_id").agg(F.sort_array(F.collect_set(F.struct("entity"))).alias("_seeds"))
    alike = scratch.save(sets.join(sets.groupBy("_seeds").agg(F.min("question_id").alias("_as")), "_seeds").select("question_id", "_as"), "alike")
    one = seeds.join(alike.select(F.col("_as").alias("question_id")).distinct(), "question_id", "left_semi")
    met, taken = _searched(facts, one, hops, max_entities, max_facts, scratch)
    every = lambda df: df.withColumnRenamed("question_id", "_as").join(alike, "_as").select(*df.columns)
    return every(met), every(taken)


def _searched(facts: DataFrame, seeds: DataFrame, hops: int, max_entities: int, max_facts: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    kinds = {f.name: f.dataType.simpleString() for f in (*seeds.schema, *facts.schema)}
    cols = ["a", "relation", "b", "source_id", "confidence"]
    schema = f"question_id {kinds['question_id']}, " + ", ".join(f"{c} {kinds[c]}" for c in cols) + f", kept boolean, added array<{kinds['entity']}>"
    met = scratch.save(seeds.select("question_id", "entity").distinct().withColumn("hop", F.lit(0)), "met0")
    taken = None
    for hop in range(1, max(1, min(hops, 3)) + 1):
        ends = met.where(F.col("hop") == hop - 1).select("question_id", "entity")
        leading = scratch.save(_leading(facts.select(*cols), ends.select("entity").distinct(), max_facts), f"leading{hop}")
        touching = ends.join(leading, "entity").select("question_id", *cols).distinct()
        if taken is not None:
            touching = touching.join(taken.select("question_id", "a", "relation", "b", "source_id"), ["question_id", "a", "relation", "b", "source_id"], "left_anti")
            used = taken.groupBy("question_id").agg(F.count("*").alias("used"))
            touching = touching.join(used, "question_id", "left").withColumn("room", max_facts - F.coalesce("used", F.lit(0))).drop("used")
        else:
            touching = touching.withColumn("room", F.lit(max_facts))
        order = W.partitionBy("question_id").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "a", "relation", "b", "source_id")
        best = touching.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max_facts).where(F.col("nth") <= F.col("room"))
        visited = met.groupBy("question_id").agg(F.collect_list("entity").alias("visited"))
        made = scratch.save(best.join(visited, "question_id").groupBy("question_id").applyInPandas(_within(max_entities), schema), f"hop{hop}")
        now = made.where("kept").select("question_id", F.lit(hop).alias("hop"), *cols)
        taken = now if taken is None else taken.unionByName(now)
        met = met.unionByName(made.select("question_id", F.explode("added").alias("entity"), F.lit(hop).alias("hop")))
    return met, taken
