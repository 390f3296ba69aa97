"""Queries of the stored graph, of questions and answers, with their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers, embedding, extraction, fulltext, graph, ivf, memory, mutations, small_world
from ..scratch import Scratch
from ..sources.binding import Bound
from .registry import FACTS, TREE, _chunks, _mentions, query

#: Entities of the bound graph, with an alias key each.
ENTITIES = FACTS + """, e AS (SELECT DISTINCT entity_id AS id, split_part(entity_id, ':', 1) AS kind, split_part(entity_id, ':', 2) AS number FROM m WHERE entity_id NOT LIKE 'part:%'),
k AS (SELECT id, kind || '_' || number AS canonical_key, kind || number AS alias_key, kind || ' ' || number AS search_text FROM e),
n AS (SELECT entity_id, count(DISTINCT chunk_id) AS mentions FROM m GROUP BY 1)"""


def _entities(b: Bound, facts: DataFrame | None = None) -> DataFrame:
    ids = _mentions(b, facts).select(F.col("entity_id").alias("id")).distinct().where("id not like 'part:%'")
    kind, number = (F.split("id", ":")[k] for k in (0, 1))
    return ids.select("id", F.concat(kind, F.lit("_"), number).alias("canonical_key"), F.array(F.concat(kind, number)).alias("alias_keys"), F.concat(kind, F.lit(" "), number).alias("search_text"))


def _questions(b: Bound) -> DataFrame:
    """A question for each supplier: some name a nation by key, some by alias, some by words."""
    i, nation = F.col("s_suppkey"), F.col("s_nationkey")
    text = F.when(i % 3 == 0, F.concat(F.lit("What about the Nation "), nation, F.lit("?"))).when(i % 3 == 1, F.concat(F.lit("tell me of nation"), nation)).otherwise(F.concat(F.lit("which Region is "), nation, F.lit(" in, and which customer"), nation))
    return b.raw("supplier").select(i.alias("question_id"), text.alias("question"))


QUESTIONS = """q AS (SELECT s_suppkey AS question_id, CASE s_suppkey % 3 WHEN 0 THEN 'What about the Nation ' || s_nationkey || '?' WHEN 1 THEN 'tell me of nation' || s_nationkey ELSE 'which Region is ' || s_nationkey || ' in, and which customer' || s_nationkey END AS question FROM supplier)"""
STOPPED = "('" + "','".join(sorted(graph.STOP_WORDS)) + "')"
PHRASES = QUESTIONS + f""", w AS (SELECT question_id, list_filter(string_split_regex(lower(question), '[^a-z0-9]+'), lambda x: length(x) > 1) AS w FROM q),
p AS (SELECT question_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])) AS p FROM w, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE n <= len(w)),
keys AS (SELECT DISTINCT question_id, array_to_string(p, '_') AS key FROM p WHERE p[1] NOT IN {STOPPED} AND p[-1] NOT IN {STOPPED})"""


@query(f"WITH {PHRASES} SELECT question_id, key FROM keys")
def question_keys(b: Bound) -> DataFrame:
    """These questions hold no legal form, so an organisation's key is the free name's."""
    return graph.question_keys(_questions(b)).select("question_id", "key")


@query(f"WITH {QUESTIONS} SELECT question_id, array_to_string(list_distinct_in_order, '|') AS words FROM (SELECT question_id, list_filter(string_split_regex(lower(question), '[^a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN {STOPPED}) AS list_distinct_in_order FROM q)")
def fulltext_words(b: Bound) -> DataFrame:
    return _questions(b).select("question_id", graph.fulltext_query(F.col("question")).alias("words"))


SEEDS = f"""WITH {ENTITIES}, {PHRASES}, named AS (SELECT question_id, id, 0 AS way, row_number() OVER (PARTITION BY question_id ORDER BY mentions DESC, id) AS nth FROM
  (SELECT DISTINCT question_id, id FROM keys JOIN k ON key IN (canonical_key, alias_key)) JOIN n ON entity_id = id),
asked AS (SELECT DISTINCT question_id, unnest(list_filter(w, lambda x: x NOT IN {STOPPED})) AS word FROM w), held AS (SELECT DISTINCT id, unnest(list_filter(string_split(search_text, ' '), lambda x: length(x) > 1)) AS word FROM k),
worded AS (SELECT question_id, id, 1 AS way, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, mentions DESC, id) AS nth FROM (SELECT question_id, id, count(*) AS score FROM asked JOIN held USING (word) GROUP BY 1, 2) JOIN n ON entity_id = id),
u AS (SELECT question_id, id, min((way, nth)) AS best FROM (SELECT * FROM named WHERE nth <= 5 UNION ALL SELECT * FROM worded WHERE nth <= 5) GROUP BY 1, 2),
r AS (SELECT question_id, id AS entity, CAST(row_number() OVER (PARTITION BY question_id ORDER BY best) AS int) AS rank FROM u)
SELECT * FROM r WHERE rank <= 5"""


@query(SEEDS)
def question_seeds(b: Bound) -> DataFrame:
    every = b.facts.select("source_id")
    return memory.seeds(_questions(b), _entities(b), memory.mentioned(_mentions(b), every))


@query()
def question_search(b: Bound) -> DataFrame:
    """What every question meets within two hops and its budgets. The facts are written once, as the
    seeds and each hop read them, and so are the counts of mentions."""
    scratch = Scratch(b.spark, "facts")
    facts = scratch.save(b.facts, "facts")
    counts = scratch.save(memory.mentioned(_mentions(b, facts), facts.select("source_id")), "counts")
    found = scratch.save(memory.seeds(_questions(b), _entities(b, facts), counts), "seeds")
    return graph.budgeted_search(facts, found.select("question_id", "entity"))[1]


@query(f"""WITH {FACTS}, inside AS (SELECT * FROM m WHERE source_id % 3 = 0), t AS (SELECT entity_id, count(DISTINCT chunk_id) AS mentions FROM inside GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100)
SELECT a, relation, b, list_sort(list(DISTINCT source_id)) AS source_ids, max(confidence) AS confidence, count(*) AS edges FROM f WHERE source_id % 3 = 0 AND a IN (SELECT entity_id FROM t) AND b IN (SELECT entity_id FROM t)
GROUP BY 1, 2, 3 ORDER BY confidence DESC, a, relation, b LIMIT 200""")
def subject_view(b: Bound) -> DataFrame:
    return memory.view(b.facts, _mentions(b), b.facts.where("source_id % 3 = 0").select("source_id"))[1]


@query(f"""WITH RECURSIVE {TREE}, {FACTS}, down(id) AS (SELECT id FROM t WHERE id = (SELECT min(id) FROM t) UNION ALL SELECT t.id FROM down JOIN t ON t.parent = down.id), own AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (FROM down)),
top AS (SELECT entity_id FROM m WHERE source_id IN (FROM own) GROUP BY 1 ORDER BY count(DISTINCT chunk_id) DESC, 1 LIMIT 100)
SELECT a, relation, b, list_sort(list(DISTINCT source_id)) AS source_ids, max(confidence) AS confidence, count(*) AS edges FROM f WHERE source_id IN (FROM own) AND a IN (FROM top) AND b IN (FROM top) GROUP BY 1, 2, 3 ORDER BY confidence DESC, a, relation, b LIMIT 200""")
def subject_graph(b: Bound) -> DataFrame:
    """The view of a subject and all below it."""
    first = b.raw("customer").agg(F.min("c_custkey").alias("id"))
    inside = mutations.below(b.subjects, first).select(F.col("id").alias("subject_id"))
    return memory.view(b.facts, _mentions(b), b.sources.join(inside, "subject_id", "left_semi").select(F.col("id").alias("source_id")))[1]


@query("SELECT s_suppkey AS id, n_regionkey AS tenant_id, CASE WHEN s_suppkey % 2 = 0 THEN 'COMPANY' ELSE 'PERSON' END AS entity_type FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 4 AND s_suppkey % 2 = 0")
def known_entities(b: Bound) -> DataFrame:
    rows = b.actors.join(b.applications.select(F.col("id").alias("application_id"), "tenant_id"), "application_id")
    return memory.known_entities(rows.select("id", "tenant_id", F.when(F.col("id") % 2 == 0, "COMPANY").otherwise("PERSON").alias("entity_type")), 4, ["COMPANY", "LOCATION"])


@query("""SELECT count(*) AS units, CAST(sum(doc_id % 4) AS bigint) AS extracted, 0 AS relationships, count(*) AS skipped, CAST(max(doc_id % 4) AS bigint) AS created,
CAST(sum(doc_id % 4) AS bigint) AS mentions, CAST(sum(doc_id % 4) - 3 AS bigint) AS matched FROM documents""")
def build_counters(b: Bound) -> DataFrame:
    """Each document names up to three things, always the same three, and one thing without a name."""
    i = F.col("doc_id")
    things = F.transform(F.filter(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda k: k <= i % 4), lambda k: F.struct(F.concat(F.lit("thing"), k).alias("name")))
    units = b.raw("documents").select("doc_id", F.to_json(F.struct(F.concat(things, F.array(F.struct(F.lit("").alias("name")))).alias("entities"))).alias("answer"))
    read = extraction.extractions(units)
    mentions = read.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.name")
    return extraction.counters(read, mentions.select("name").distinct(), mentions)


@query(f"WITH {FACTS} SELECT DISTINCT chunk_id, source_id FROM m WHERE chunk_id % 5 = 0 AND source_id % 2 = 0")
def chunks_in_scope(b: Bound) -> DataFrame:
    chunks = _mentions(b).select("chunk_id", "source_id").distinct()
    return memory.chunks_in_scope(chunks, chunks.where("chunk_id % 5 = 0").select("chunk_id"), chunks.where("source_id % 2 = 0").select("source_id"))


@query("""SELECT s_suppkey AS id, s_nationkey AS tenant_id, s_name AS display_name, ['a' || (s_suppkey % 3), 'b'] || CASE WHEN s_suppkey % 2 = 0 THEN ['c'] ELSE [] END AS aliases,
s_name || ' a' || (s_suppkey % 3) || ' b' || CASE WHEN s_suppkey % 2 = 0 THEN ' c' ELSE '' END AS search_text FROM supplier
UNION ALL SELECT s_suppkey + 1000000, s_nationkey, 'new ' || s_suppkey, ['b', 'c'], 'new ' || s_suppkey || ' b c' FROM supplier WHERE s_suppkey % 2 = 1""")
def entity_upserts(b: Bound) -> DataFrame:
    i = F.col("s_suppkey")
    none = F.array().cast("array<string>")
    stored = b.raw("supplier").select(i.alias("id"), F.col("s_nationkey").alias("tenant_id"), F.lit("COMPANY").alias("entity_type"), F.lower("s_name").alias("canonical_key"), F.col("s_name").alias("display_name"),
                                      F.array(F.concat(F.lit("a"), i % 3), F.lit("b")).alias("aliases"), none.alias("alias_keys"), none.alias("raw_types"))
    new = b.raw("supplier").select(
        F.when(i % 2 == 0, i).otherwise(i + 1_000_000).alias("id"), F.col("s_nationkey").alias("tenant_id"), F.lit("COMPANY").alias("entity_type"), F.lower("s_name").alias("canonical_key"), F.concat(F.lit("new "), i).alias("display_name"),
        F.array(F.lit("b"), F.lit("c")).alias("aliases"), none.alias("alias_keys"), none.alias("raw_types"))
    return memory.upserted_entities(stored, new).select("id", "tenant_id", "display_name", "aliases", "search_text")


FACT_SIDES = """o AS (SELECT a, relation, b, source_id, max(confidence) AS confidence FROM f WHERE source_id % 3 < 2 GROUP BY ALL), w AS (SELECT a, relation, b, source_id, max(confidence) - 0.25 AS confidence FROM f WHERE source_id % 3 > 0 AND relation <> 'PART_OF' GROUP BY ALL)"""


@query(f"WITH {FACTS}, {FACT_SIDES} SELECT a, relation, b, source_id, CASE WHEN o.a IS NULL THEN ['new'] WHEN w.a IS NULL THEN ['old'] ELSE ['old', 'new'] END AS chunk_ids, round(greatest(o.confidence, w.confidence), 4) AS confidence, CASE WHEN o.a IS NULL THEN 'later' ELSE 'first' END AS description FROM o FULL JOIN w USING (a, relation, b, source_id)".replace("o.a IS NULL", "o.confidence IS NULL").replace("w.a IS NULL", "w.confidence IS NULL"))
def fact_upserts(b: Bound) -> DataFrame:
    def side(df, chunk, text):
        key = ["a", "relation", "b", "source_id"]
        return df.groupBy(*key).agg(F.max("confidence").alias("confidence")).withColumns({"chunk_ids": F.array(F.lit(chunk)), "description": F.lit(text), "raw_relation": F.lit(None).cast("string")})
    stored = side(b.facts.where("source_id % 3 < 2"), "old", "first")
    new = side(b.facts.where("source_id % 3 > 0"), "new", "later").withColumn("confidence", F.col("confidence") - 0.25)
    made = memory.upserted_facts(stored, new, ["LOCATED_IN", "PURCHASED"])
    return made.select("a", "relation", "b", "source_id", "chunk_ids", F.round("confidence", 4).alias("confidence"), "description")


@query("SELECT l_orderkey AS chunk_id, 'part:' || l_partkey AS entity_id, max(CASE WHEN l_linenumber % 2 = 0 THEN 'even' END) AS description FROM lineitem GROUP BY 1, 2")
def mention_upserts(b: Bound) -> DataFrame:
    own = b.raw("lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("part:"), "l_partkey").alias("entity_id"), F.col("l_orderkey").alias("source_id"), "l_linenumber")
    stored = own.select("chunk_id", "entity_id", "source_id").distinct().withColumn("description", F.lit(None).cast("string"))
    new = own.where("l_linenumber % 2 = 0").select("chunk_id", "entity_id", "source_id").distinct().withColumn("description", F.lit("even"))
    return memory.upserted_mentions(stored, new).select("chunk_id", "entity_id", "description")


@query("SELECT o_orderkey AS source_id, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE o_custkey END AS bigint) AS subject_id FROM orders")
def moved_documents(b: Bound) -> DataFrame:
    documents = b.sources.select(F.col("id").alias("source_id"), "subject_id")
    return memory.moved_documents(documents, documents.where("source_id % 7 = 0").select("source_id", F.lit(1).cast("long").alias("to")))


@query("SELECT DISTINCT l_orderkey AS source_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def orphaned_documents(b: Bound) -> DataFrame:
    documents = b.raw("lineitem").select(F.col("l_orderkey").alias("source_id")).distinct()
    return memory.orphaned_documents(documents, b.sources.where("status <> 'completed'"))


@query("SELECT n_regionkey AS tenant_id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey <> 2 GROUP BY 1")
def graph_catalogue(b: Bound) -> DataFrame:
    rows = b.actors.join(b.applications.select(F.col("id").alias("application_id"), "tenant_id"), "application_id")
    return memory.tenant_graphs(memory.without_tenant(rows, 2))


@query(f"WITH {FACTS} SELECT CASE WHEN a = 'nation:3' THEN b ELSE a END AS neighbour, list_sort(list(DISTINCT relation)) AS relations FROM f WHERE a = 'nation:3' OR b = 'nation:3' GROUP BY 1")
def entity_neighbours(b: Bound) -> DataFrame:
    return memory.neighbours(b.facts, "nation:3")


@query("""WITH e AS (SELECT 'supplier:' || s_suppkey AS entity, 'nation:' || s_nationkey AS hub FROM supplier), a AS (SELECT entity, hub FROM e UNION SELECT hub, hub FROM e),
c AS (SELECT hub, min(entity) AS component, count(*) AS size FROM a GROUP BY 1) SELECT entity, component, size FROM a JOIN c USING (hub)""")
def entity_components(b: Bound) -> DataFrame:
    return memory.components(b.facts.where("relation = 'LOCATED_IN' and a like 'supplier:%'"))


@query("""SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE least(200, doc_id % 230) END AS int) AS entities, CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS int) AS skipped, CASE WHEN doc_id % 2 = 1 AND doc_id % 230 > 0 THEN 64 END AS type_size,
 CASE WHEN doc_id % 2 = 1 AND doc_id % 230 > 0 THEN 20 END AS aliases FROM documents""")
def extraction_caps(b: Bound) -> DataFrame:
    """Answers with lists, types, aliases and names over the caps."""
    i = F.col("doc_id")
    entity = lambda name: F.struct(name.alias("name"), F.lit("T" * 70).alias("type"), F.array(*[F.lit(f"a{k}") for k in range(24)]).alias("aliases"))
    many = F.transform(F.filter(F.sequence(F.lit(0), F.lit(229)), lambda k: k < i % 230), lambda k: entity(F.concat(F.lit("n"), k)))
    one = F.array(entity(F.repeat(F.lit("x"), 301)))
    units = b.raw("documents").select("doc_id", F.to_json(F.struct(F.when(i % 2 == 0, one).otherwise(many).alias("entities"))).alias("answer"))
    read = extraction.extractions(units)
    first = F.try_element_at("entities", F.lit(1))
    return read.select("doc_id", F.size("entities").alias("entities"), "skipped", F.length(first["type"]).alias("type_size"), F.when(first.isNotNull(), F.size(first["aliases"])).alias("aliases"))


# answers

STRATEGY = embedding.Strategy("words", "hashing-64", "1", query_template="query: {input}")


def _passages(b: Bound) -> DataFrame:
    """The chunks of all documents as live ones, embedded by the offline model; written, as each block
    of questions reads them."""
    made = _chunks(b).select((F.col("doc") * 1_000_000 + F.col("chunk_index")).cast("long").alias("chunk_id"), (F.col("doc") % 50).alias("source_id"), "content", "embedding_text", "path", "page_start", "page_end")
    rows = Scratch(b.spark, "passages").save(made, "rows")
    own = embedding.sweep(embedding.hashed(rows, STRATEGY), STRATEGY, embedding.hashing_embedder(64)).where("embedding_status = 'completed'").select("chunk_id", "embedding")
    return Scratch(b.spark, "passages").save(rows.join(own, "chunk_id"), "embedded")


def _turns(b: Bound) -> DataFrame:
    """Every turn of a user as a question, whole; ``wrong_text`` refuses the overlong ones."""
    return b.raw("conversations").where("role = 'user'").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))


@query()
def answers_with_evidence(b: Bound) -> DataFrame:
    """Every user turn as a question: nearest, diverse, reranked chunks and the prompt's answer."""
    sources = b.sources.select("id", F.concat(F.lit("order-"), "id").alias("filename"))
    out, evidence = answers.answered(_turns(b), _passages(b), sources, STRATEGY, embedding.hashing_embedder(64), answer=lambda prompts: [str(len(p)) for p in prompts])
    return out.drop("question").join(evidence.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"].cast("string")), ",").alias("chunks")), "query_id", "left")


@query("""SELECT doc_id AS query_id, 'Context chunks:' || chr(10) || chr(10) || '[Chunk 1] Section: ' || lang || ' › ' || source || ' (page ' || (doc_id % 9 + 1) || CASE WHEN doc_id % 2 = 1 THEN '–' || (doc_id % 9 + 2) ELSE '' END || ')' || chr(10) || text
|| chr(10) || chr(10) || 'Question: why ' || doc_id || chr(10) || chr(10) || 'Answer the question using only the context above.' AS prompt FROM documents""")
def answer_prompts(b: Bound) -> DataFrame:
    rows = b.raw("documents")
    i = F.col("doc_id")
    final = rows.select(i.alias("query_id"), F.lit(1).alias("rank"), F.col("text").alias("content"), F.array("lang", "source").alias("path"), (i % 9 + 1).cast("int").alias("page_start"), (i % 9 + 1 + i % 2).cast("int").alias("page_end"))
    return answers.prompts(rows.select(i.alias("query_id"), F.concat(F.lit("why "), i).alias("question")), final)


@query("SELECT conv_id * 100000 + turn AS query_id, 64 AS dimension FROM conversations WHERE role = 'user' AND length(text) <= 4000 AND trim(text) <> ''")
def query_vectors(b: Bound) -> DataFrame:
    return answers.embedded_questions(_turns(b), STRATEGY, embedding.hashing_embedder(64)).select("query_id", F.size("vector").alias("dimension"))


@query()
def knn_ivf(b: Bound) -> DataFrame:
    """Approximate nearest chunks by cells, for all queries of vec_id divisible by 100."""
    chunks = b.chunks
    centre = ivf.centres(chunks, cells=32)
    asked = b.raw("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return ivf.search(ivf.placed(chunks.select("chunk_id", "embedding"), "embedding", centre, 1), asked, centre, probes=16)


def _small_world(b: Bound, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    index = small_world.build(b.chunks, Scratch(b.spark, "small_world_index").base)
    asked = b.raw("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return small_world.search(index, b.chunks, asked, scope=scope)


@query()
def graph_index_search(b: Bound) -> DataFrame:
    """Nearest chunks by the small-world graph, for all queries of vec_id divisible by 100."""
    return _small_world(b)[0]


@query()
def graph_index_scoped(b: Bound) -> DataFrame:
    """The same among the chunks of a tenth of all subjects, with the vectors that each query compared."""
    near, took = _small_world(b, b.chunks.where("subject_id % 10 = 3"))
    return near.join(took, "query_id")


BM25 = """t AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
total AS (SELECT count(*) AS n, avg(len(w)) AS length FROM t), p AS (SELECT id, len(any_value(w)) AS size, word, count(*) AS tf FROM (SELECT id, w, unnest(w) AS word FROM t) GROUP BY id, word),
df AS (SELECT word, count(*) AS df FROM p GROUP BY 1), asked AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS word FROM benchmark),
scores AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * size / length))), 9) AS score FROM asked JOIN p USING (word) JOIN df USING (word), total GROUP BY 1, 2),
best AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores)"""


def _bm25(b: Bound) -> tuple[DataFrame, DataFrame]:
    index = fulltext.build(b.raw("documents").select(F.col("doc_id").alias("id"), "text"), Scratch(b.spark, "fulltext_index").base)
    return fulltext.search(index, b.raw("benchmark").select(F.col("item_id").alias("query_id"), fulltext.text_words(F.col("text")).alias("words")))


@query(f"WITH {BM25} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS int) AS rank FROM best WHERE rank <= 10")
def fulltext_documents(b: Bound) -> DataFrame:
    """The ten documents of greatest score for every benchmark item."""
    return _bm25(b)[0].withColumn("score", F.round("score", 6))


@query()
def fulltext_blocks(b: Bound) -> DataFrame:
    """How many of its words' blocks each benchmark item read for that."""
    return _bm25(b)[1]


SCORED = f"""WITH {ENTITIES}, {PHRASES}, named AS (SELECT question_id, id, 0 AS way, row_number() OVER (PARTITION BY question_id ORDER BY mentions DESC, id) AS nth FROM
  (SELECT DISTINCT question_id, id FROM keys JOIN k ON key IN (canonical_key, alias_key)) JOIN n ON entity_id = id),
t AS (SELECT id, list_filter(string_split_regex(lower(search_text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM k), total AS (SELECT count(*) AS n, avg(len(w)) AS length FROM t),
held AS (SELECT id, len(any_value(w)) AS size, word, count(*) AS tf FROM (SELECT id, w, unnest(w) AS word FROM t) GROUP BY id, word), df AS (SELECT word, count(*) AS df FROM held GROUP BY 1),
asked AS (SELECT DISTINCT question_id, unnest(list_filter(w, lambda x: x NOT IN {STOPPED})) AS word FROM w),
scores AS (SELECT question_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * size / length))), 9) AS score FROM asked JOIN held USING (word) JOIN df USING (word), total GROUP BY 1, 2),
worded AS (SELECT question_id, id, 1 AS way, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, mentions DESC, id) AS nth FROM scores JOIN n ON entity_id = id),
u AS (SELECT question_id, id, min((way, nth)) AS best FROM (SELECT * FROM named WHERE nth <= 5 UNION ALL SELECT * FROM worded WHERE nth <= 5) GROUP BY 1, 2),
r AS (SELECT question_id, id AS entity, CAST(row_number() OVER (PARTITION BY question_id ORDER BY best) AS int) AS rank FROM u)
SELECT * FROM r WHERE rank <= 5"""


@query(SCORED)
def question_seeds_scored(b: Bound) -> DataFrame:
    """Seeds of questions where the full text goes by score instead of by the number of words."""
    scratch = Scratch(b.spark, "entities")
    entities, counts = scratch.save(_entities(b), "entities"), scratch.save(memory.mentioned(_mentions(b), b.facts.select("source_id")), "counts")
    index = fulltext.build(entities.select("id", F.col("search_text").alias("text")), f"{scratch.base}/index")
    return memory.seeds(_questions(b), entities, counts, index=index)
