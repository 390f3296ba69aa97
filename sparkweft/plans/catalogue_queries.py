"""Queries of lists, reads and changes of the catalogue, runs and strategies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog, embedding, intervals, ledger, listing, mutations, sketches
from ..operators.scope import Scope, in_application
from ..scratch import Scratch
from ..sources import store
from ..sources.binding import Bound
from ..streaming import changes, leases
from .registry import LEDGER, QUEUE, SOURCES, STRATEGY, TREE, _documents, _ledger, _queue, query

OWNED_TREE = TREE + ", o AS (SELECT t.*, n_regionkey AS tenant FROM t JOIN nation ON n_nationkey = app)"
RUNS = """runs AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS source_id, l_linenumber AS version, ['completed','partial','failed','processing'][CAST((l_partkey + l_linenumber) % 4 AS int) + 1] AS status
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, max(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_partkey FROM lineitem))"""


def _runs(b: Bound) -> DataFrame:
    """Runs of the sources: a version for each line number of an order."""
    state = F.element_at(F.array(*[F.lit(x) for x in ("completed", "partial", "failed", "processing")]), ((F.col("p") + F.col("version")) % 4 + 1).cast("int"))
    lines = b.raw("lineitem").groupBy(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("version")).agg(F.max("l_partkey").alias("p"))
    return lines.select((F.col("source_id") * 10 + F.col("version")).alias("id"), "source_id", "version", state.alias("status"))


def _owned_subjects(b: Bound) -> DataFrame:
    apps = b.applications.select(F.col("id").alias("application_id"), "tenant_id")
    return b.subjects.join(apps, "application_id")


# lists

@query(f"""WITH {OWNED_TREE} SELECT o.id, o.app AS application_id, o.tenant AS tenant_id, o.parent AS parent_subject_id, CAST(o.id % 100 AS int) AS actor_id, n_name AS application_name, r_name AS tenant_name, s_name AS actor_name
FROM o JOIN nation ON n_nationkey = app JOIN region ON r_regionkey = tenant LEFT JOIN supplier ON s_suppkey = o.id % 100""")
def subject_list(b: Bound) -> DataFrame:
    rows = _owned_subjects(b).drop("name").withColumn("actor_id", (F.col("id") % 100).cast("int"))
    out = listing.named(rows, (b.applications, "application"), (b.tenants, "tenant"), (b.actors, "actor"), optional=("actor",))
    return out.select("id", "application_id", "tenant_id", "parent_subject_id", "actor_id", "application_name", "tenant_name", "actor_name")


@query("SELECT n_nationkey AS id, n_regionkey AS tenant_id, n_name AS name, r_name AS tenant_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def application_list(b: Bound) -> DataFrame:
    return listing.named(b.applications, (b.tenants, "tenant")).select("id", "tenant_id", "name", "tenant_name")


@query("SELECT s_suppkey AS id, s_nationkey AS application_id, s_name AS name, n_name AS application_name FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def actor_list(b: Bound) -> DataFrame:
    return listing.named(b.actors, (b.applications, "application")).select("id", "application_id", "name", "application_name")


@query(f"WITH {SOURCES} SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS nth FROM s WHERE tenant_id = 1")
def sources_newest_first(b: Bound) -> DataFrame:
    from pyspark.sql import Window as W

    rows = Scope(tenants=(1,)).apply(b.owned_sources)
    # a numbered list: the same order as ``newest_first``
    return listing.newest_first(rows).withColumn("nth", F.row_number().over(W.orderBy(F.col("created_at").desc_nulls_last(), "id")).cast("long")).select("id", "nth")


@query(f"""WITH RECURSIVE {TREE}, down(id, path) AS (SELECT t.id, [c_name] FROM t JOIN customer ON c_custkey = t.id WHERE parent IS NULL
UNION ALL SELECT t.id, list_append(path, c_name) FROM down JOIN t ON t.parent = down.id JOIN customer ON c_custkey = t.id) SELECT id, path FROM down""")
def folder_paths(b: Bound) -> DataFrame:
    return listing.folder_paths(b.subjects)


@query("SELECT 'folder' AS kind, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'file', s_suppkey, s_name FROM supplier")
def explorer(b: Bound) -> DataFrame:
    return listing.folders_first(b.applications, b.actors)


@query(f"WITH {SOURCES} SELECT id, status, CASE WHEN id % 3 = 0 THEN 'local://' || id WHEN id % 3 = 1 THEN 'https://x/' || id END AS uri, id % 3 = 0 AS has_stored_content FROM s")
def stored_content(b: Bound) -> DataFrame:
    i = F.col("id")
    uri = F.when(i % 3 == 0, F.concat(F.lit("local://"), i)).when(i % 3 == 1, F.concat(F.lit("https://x/"), i))
    return b.sources.select("id", "status", uri.alias("uri"), listing.has_stored_content(uri).alias("has_stored_content"))


@query("SELECT l_orderkey AS source_id, l_linenumber AS line, CASE WHEN l_orderkey % 2 = 0 THEN 'order-' || l_orderkey || '.txt' END AS filename, count(*) AS n FROM lineitem GROUP BY ALL")
def filenames(b: Bound) -> DataFrame:
    sources = b.raw("orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order-"), "o_orderkey", F.lit(".txt")).alias("filename"))
    rows = b.raw("lineitem").groupBy(F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("line")).agg(F.count("*").alias("n"))
    return listing.with_filenames(rows, sources)


@query("SELECT event_type, count(*) AS n, CAST(round(100.0 * count(*) / sum(count(*)) OVER ()) AS bigint) AS share_pct FROM events GROUP BY 1")
def event_shares(b: Bound) -> DataFrame:
    return listing.share_of_total(catalog.count_by(b.raw("events"), "event_type"), "n")


@query("""WITH t AS (SELECT page_id, url, lower(trim('  User' || page_id || '@Example.' || CASE WHEN page_id % 3 = 0 THEN 'org' ELSE '' END || ' ')) AS mail, regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g') AS slug, CASE WHEN page_id % 4 = 0 THEN ' ' ELSE html END AS text FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN mail END AS email, CASE WHEN regexp_full_match(slug, '[a-z0-9]+(-[a-z0-9]+)*') THEN NULL ELSE 'slug must be lower-case words joined by hyphens' END AS slug_error,
  CASE WHEN trim(text) = '' THEN 'query is empty' WHEN length(text) > 4000 THEN 'query is longer than 4000' END AS query_error FROM t""")
def checked_input(b: Bound) -> DataFrame:
    mail = F.concat(F.lit("  User"), "page_id", F.lit("@Example."), F.when(F.col("page_id") % 3 == 0, "org").otherwise(""), F.lit(" "))
    text = F.when(F.col("page_id") % 4 == 0, " ").otherwise(F.col("html"))
    slug = F.regexp_replace(F.lower("url"), "[^a-z0-9]+", "-")
    return b.raw("pages").select("page_id", listing.email(mail).alias("email"), listing.wrong_slug(slug).alias("slug_error"), listing.wrong_text(text, "query").alias("query_error"))


# runs

@query(f"WITH {RUNS} SELECT source_id, max(version) AS version FROM runs WHERE status IN ('completed', 'partial') GROUP BY 1")
def latest_readable_run(b: Bound) -> DataFrame:
    return listing.latest_readable(_runs(b)).select("source_id", "version")


@query(f"WITH {RUNS} SELECT source_id, count(*) AS running FROM runs WHERE status = 'processing' GROUP BY 1")
def running_conflicts(b: Bound) -> DataFrame:
    return listing.running(_runs(b))


@query(f"""WITH {RUNS}, u AS (SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS calls, CAST(sum(CAST(l_quantity AS bigint)) AS bigint) AS pt, CAST(sum(CAST(l_quantity * 3 AS bigint)) AS bigint) AS ct FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1),
x AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY version DESC) AS nth FROM runs)
SELECT x.source_id, x.version, x.status, coalesce(calls, 0) AS calls, coalesce(pt, 0) AS prompt_tokens, coalesce(ct, 0) AS completion_tokens FROM x LEFT JOIN u USING (id) WHERE nth = 1""")
def latest_run_usage(b: Bound) -> DataFrame:
    calls = b.raw("lineitem").where("l_partkey % 2 = 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("extraction_id"), F.col("l_quantity").cast("long").alias("prompt_tokens"), (F.col("l_quantity") * 3).cast("long").alias("completion_tokens"))
    return listing.one_version(_runs(b), calls).select("source_id", "version", "status", "calls", "prompt_tokens", "completion_tokens")


@query(f"WITH {LEDGER} SELECT extraction_id, CAST(sum(pt) AS bigint) AS prompt_tokens, CAST(sum(ct) AS bigint) AS completion_tokens, coalesce(round(sum(cost), 6), 0) AS cost_usd FROM c GROUP BY 1")
def run_totals(b: Bound) -> DataFrame:
    return listing.run_totals(_ledger(b))


@query(f"""WITH {RUNS}, x AS (SELECT source_id, max_by(status, version) AS run FROM runs GROUP BY 1)
SELECT o_orderkey AS id, CASE run WHEN 'processing' THEN 'processing' WHEN 'completed' THEN 'completed' WHEN 'partial' THEN 'completed' WHEN 'failed' THEN 'failed' ELSE 'pending' END AS status FROM orders LEFT JOIN x ON source_id = o_orderkey""")
def source_states(b: Bound) -> DataFrame:
    return mutations.source_states(b.sources.select("id", "status"), _runs(b))


@query(f"WITH {RUNS} SELECT id, CASE WHEN status = 'processing' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'processing' THEN 'Interrupted: the server restarted during this run' END AS error FROM runs")
def interrupted_runs(b: Bound) -> DataFrame:
    return mutations.interrupted(_runs(b).withColumn("error", F.lit(None).cast("string")), "run").select("id", "status", "error")


@query("""WITH p AS (SELECT conv_id, turn, max(length(text)) % 3 > 0 AS ok FROM conversations GROUP BY 1, 2 HAVING turn < 6)
SELECT conv_id, count(*) FILTER (ok) AS processed, count(*) FILTER (NOT ok) AS failures, CASE WHEN count(*) FILTER (ok) = 0 THEN 'failed' WHEN count(*) FILTER (NOT ok) > 0 THEN 'partial' ELSE 'completed' END AS status FROM p GROUP BY 1""")
def ingest_outcome(b: Bound) -> DataFrame:
    parts = b.raw("conversations").groupBy("conv_id", F.col("turn").alias("index")).agg((F.max(F.length("text")) % 3 > 0).alias("ok"))
    return mutations.outcome(parts, "conv_id", limit=6)


@query(f"""WITH {RUNS} SELECT source_id, id AS extraction_id, version AS extraction_version, CASE WHEN status = 'partial' THEN id + 1 END AS retry_of_id, CASE WHEN status = 'partial' THEN CAST(version * 100 AS int) ELSE 3000 END AS chunk_chars,
CASE WHEN status = 'partial' THEN 10 ELSE 300 END AS chunk_overlap, 'processing' AS status, 'credential' AS triggered_by_kind, CAST(NULL AS varchar) AS triggered_by_user_id, 'k1' AS triggered_by_credential_id FROM runs""")
def build_rows(b: Bound) -> DataFrame:
    runs = _runs(b)
    old = runs.where("status = 'partial'").select((F.col("id") + 1).alias("id"), F.col("id").alias("extraction_id"), (F.col("version") * 100).cast("int").alias("chunk_chars"), F.lit(10).alias("chunk_overlap"))
    return mutations.new_builds(runs, {"chunk_chars": 3000, "chunk_overlap": 300}, Scope(tenant_id=1, application_id=7, credential_id="k1"), old)


@query(f"""WITH {RUNS} SELECT r.id AS build_id, turn AS index FROM runs r JOIN (SELECT DISTINCT conv_id, turn FROM conversations WHERE length(text) % 3 = 0) p ON p.conv_id = r.source_id WHERE r.status IN ('partial', 'failed') AND r.version = 1""")
def retried_parts(b: Bound) -> DataFrame:
    builds = _runs(b).where("version = 1")
    parts = b.raw("conversations").where(F.length("text") % 3 == 0).select(F.col("conv_id").alias("source_id"), F.col("turn").alias("index"), F.lit(False).alias("ok")).distinct()
    own = parts.join(builds.select("source_id", F.col("id").alias("build_id")), "source_id")
    return mutations.failed_parts(own, builds).select("build_id", "index")


# changes

@query(f"""WITH {TREE}, new AS (SELECT s_suppkey AS id, s_nationkey AS tenant_id, CASE WHEN s_suppkey % 5 = 0 THEN 'Bad Slug' ELSE 'app-' || (s_suppkey % 7) END AS slug FROM supplier),
have AS (SELECT n_nationkey AS tenant_id, 'app-3' AS slug FROM nation WHERE n_nationkey % 2 = 0), fine AS (SELECT *, min(id) OVER (PARTITION BY tenant_id, slug) AS first FROM new WHERE slug <> 'Bad Slug')
SELECT n.id, CASE WHEN n.slug = 'Bad Slug' THEN 'slug must be lower-case words joined by hyphens' WHEN (n.tenant_id, n.slug) IN (FROM have) OR f.first <> n.id THEN 'already exists: ' || n.tenant_id || ' ' || n.slug END AS reason
FROM new n LEFT JOIN fine f USING (id) WHERE reason IS NOT NULL""")
def refused_applications(b: Bound) -> DataFrame:
    i = F.col("s_suppkey")
    new = b.raw("supplier").select(i.alias("id"), F.col("s_nationkey").alias("tenant_id"), F.when(i % 5 == 0, "Bad Slug").otherwise(F.concat(F.lit("app-"), i % 7)).alias("slug"))
    have = b.applications.where("id % 2 = 0").select((F.col("id") + 100_000).alias("id"), F.col("id").alias("tenant_id"), F.lit("app-3").alias("slug"))
    return mutations.created(have, new, ("tenant_id", "slug"), slug="slug")[1].select("id", "reason")


@query("SELECT r_regionkey AS id, CASE WHEN r_regionkey % 2 = 0 THEN 'renamed ' || r_regionkey ELSE r_name END AS name FROM region")
def renamed_tenants(b: Bound) -> DataFrame:
    return mutations.updated(b.tenants, b.tenants.where("id % 2 = 0").select("id", F.concat(F.lit("renamed "), "id").alias("name")))


MOVES = """moves AS (SELECT id, CASE WHEN id % 3 = 0 THEN parent WHEN id % 3 = 1 THEN id + 1 END AS dest FROM t WHERE id % 11 = 0 OR parent IS NULL AND id % 2 = 0),
below(root, id) AS (SELECT id, id FROM moves UNION SELECT root, t.id FROM below JOIN t ON t.parent = below.id),
judged AS (SELECT m.id, m.dest, CASE WHEN m.dest IS NULL THEN NULL WHEN m.id = m.dest THEN 'its own parent' WHEN EXISTS (SELECT 1 FROM below WHERE below.root = m.id AND below.id = m.dest) THEN 'inside its own subtree'
  WHEN y.id IS NULL THEN 'no such parent' WHEN x.app <> y.app THEN 'another application' END AS reason FROM moves m JOIN t x ON x.id = m.id LEFT JOIN t y ON y.id = m.dest)"""


def _moves(b: Bound) -> DataFrame:
    i, parent = F.col("id"), F.col("parent_subject_id")
    chosen = b.subjects.where((i % 11 == 0) | parent.isNull() & (i % 2 == 0))
    return chosen.select("id", F.when(i % 3 == 0, parent).when(i % 3 == 1, i + 1).alias("to"))


@query(f"WITH RECURSIVE {TREE}, {MOVES} SELECT t.id, CASE WHEN j.id IS NOT NULL AND j.reason IS NULL THEN j.dest ELSE t.parent END AS parent_subject_id FROM t LEFT JOIN judged j ON j.id = t.id")
def moved_subjects(b: Bound) -> DataFrame:
    return mutations.moved(b.subjects, _moves(b))[0].select("id", "parent_subject_id")


@query(f"WITH RECURSIVE {TREE}, {MOVES} SELECT id, dest AS \"to\", reason FROM judged WHERE reason IS NOT NULL")
def refused_moves(b: Bound) -> DataFrame:
    return mutations.moved(b.subjects, _moves(b))[1]


@query(f"""WITH RECURSIVE {TREE}, gone(id) AS (SELECT id FROM t WHERE id % 7 = 3 UNION SELECT t.id FROM gone JOIN t ON t.parent = gone.id)
SELECT (SELECT count(*) FROM t WHERE id NOT IN (FROM gone)) AS subjects, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (FROM gone)) AS sources, (SELECT count(*) FROM orders WHERE o_custkey IN (FROM gone)) AS lost,
(SELECT count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey NOT IN (FROM gone)) AS runs""")
def deleted_subtrees(b: Bound) -> DataFrame:
    subjects, sources, lost = mutations.without_subjects(b.subjects, b.sources, b.subjects.where("id % 7 = 3").select("id"))
    runs = mutations.cascaded(lost, (b.usage, "extraction_id"))[0].join(b.sources.select(F.col("id").alias("extraction_id")), "extraction_id", "left_semi")
    return catalog.totals(subjects=subjects, sources=sources, lost=lost, runs=runs)


@query("""WITH gone AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 4 = 1)
SELECT (SELECT count(*) FROM gone WHERE id IN (SELECT c_custkey % 100 FROM customer WHERE c_custkey % 3 = 0)) AS held, (SELECT count(*) FROM orders WHERE o_orderkey % 100 NOT IN (FROM gone)) AS attributed""")
def deleted_actors(b: Bound) -> DataFrame:
    gone = b.actors.where("id % 4 = 1").select("id")
    held = mutations.held_by(gone, b.raw("customer").select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 100).alias("actor_id")), "actor_id")
    sources = mutations.forgotten(b.sources.select("id", (F.col("id") % 100).alias("actor_id")), "actor_id", gone)
    return catalog.totals(held=held, attributed=sources.where("actor_id is not null"))


@query(f"WITH {SOURCES} SELECT id, subject_id, tenant_id, application_id, 'pending' AS status FROM s WHERE id % 9 = 0")
def registered_sources(b: Bound) -> DataFrame:
    new = b.sources.where("id % 9 = 0").select("id", "subject_id")
    return mutations.registered(_owned_subjects(b), new).select("id", "subject_id", "tenant_id", "application_id", "status")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'chat' ELSE 'note' END || '-20240102-030405' || CASE WHEN doc_id % 5 = 0 THEN '.md' ELSE '.txt' END
 WHEN doc_id % 3 = 1 AND doc_id % 5 > 0 THEN 'Title.TXT' WHEN doc_id % 3 = 1 THEN 'Title.TXT.md' ELSE lang || CASE WHEN doc_id % 5 = 0 THEN '.md' ELSE '.txt' END END AS filename,
 CASE WHEN doc_id % 5 = 0 THEN 'text/markdown' ELSE 'text/plain' END || '; charset=utf-8' AS mime_type, CAST(strlen(text) AS bigint) AS size_bytes FROM documents JOIN customer ON c_custkey = doc_id % 50""")
def registered_texts(b: Bound) -> DataFrame:
    i = F.col("doc_id")
    new = b.raw("documents").select(
        i.alias("id"), (i % 50).alias("subject_id"), F.when(i % 2 == 0, "chat").otherwise("note").alias("type"), F.when(i % 3 == 1, "Title.TXT").when(i % 3 == 2, F.col("lang")).alias("title"), "text",
        F.when(i % 5 == 0, "markdown").otherwise("text").alias("format"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("at"))
    return mutations.registered_texts(_owned_subjects(b), new).select("id", "filename", "mime_type", "size_bytes")


@query("SELECT r_regionkey AS id FROM region WHERE r_regionkey % 2 = 1")
def owned_tenants(b: Bound) -> DataFrame:
    return mutations.owned_tenants(b.tenants.withColumn("user_owner_id", F.col("id") % 2), 1)


@query("SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_orderkey % 100 AND s_nationkey = c_nationkey)")
def foreign_actors(b: Bound) -> DataFrame:
    rows = b.owned_sources.select("id", "application_id", (F.col("id") % 100).cast("int").alias("actor_id"))
    return in_application(rows, b.actors).select("id")


# chunks, strategies, queue

@query("""WITH c AS (SELECT doc_id AS chunk_id, doc_id % 20 AS source_id, CAST(doc_id % 3 AS int) AS version FROM documents)
SELECT chunk_id, source_id, version, source_id % 2 = 1 AND version = 2 OR source_id % 2 = 0 AND version = 3 AS is_active FROM c WHERE NOT (source_id % 2 = 0 AND version = 1)
UNION ALL SELECT chunk_id + 1000000, source_id, 3, true FROM c WHERE source_id % 2 = 0 AND version = 0""")
def chunk_versions(b: Bound) -> DataFrame:
    """Even sources get a third version that takes its run's place; older ones rest."""
    i = F.col("doc_id")
    stored = b.raw("documents").select(i.alias("chunk_id"), (i % 20).alias("source_id"), (i % 3).cast("int").alias("version"), F.when(i % 3 == 1, 99).otherwise((i % 3).cast("int")).alias("extraction_id"), (i % 3 == 2).alias("is_active"))
    made = stored.where("source_id % 2 = 0 and version = 0").select((F.col("chunk_id") + 1_000_000).alias("chunk_id"), "source_id", F.lit(3).alias("version"), F.lit(99).alias("extraction_id"))
    return listing.chunk_versions(stored, made).select("chunk_id", "source_id", "version", "is_active")


@query("SELECT doc_id AS chunk_id, CAST(doc_id % 3 AS int) AS version, doc_id // 20 AS chunk_index FROM documents WHERE doc_id % 20 = 4 AND doc_id % 3 = 2")
def active_chunk_list(b: Bound) -> DataFrame:
    i = F.col("doc_id")
    stored = b.raw("documents").select(i.alias("chunk_id"), (i % 20).alias("source_id"), (i % 3).cast("int").alias("version"), F.floor(i / 20).alias("chunk_index"), (i % 3 == 2).alias("is_active"))
    return listing.chunk_list(stored, 4).select("chunk_id", "version", "chunk_index")


@query(f"WITH {QUEUE} SELECT q.chunk_id, n_chars FROM q JOIN documents ON doc_id = q.chunk_id WHERE embedding_status = 'completed' AND doc_id % 5 > 0")
def live_candidates(b: Bound) -> DataFrame:
    chunks = b.raw("documents").select(F.col("doc_id").alias("chunk_id"), "n_chars", (F.col("doc_id") % 5 > 0).alias("is_active"))
    return listing.live_candidates(_queue(b), chunks, STRATEGY.id).select("chunk_id", "n_chars")


MODELS = "m AS (SELECT r_regionkey AS id, 'p' || r_regionkey AS provider, CAST(64 * (1 + r_regionkey) AS int) AS dimension, 'l2' AS normalization, CASE WHEN r_regionkey % 2 = 0 THEN 'passage: {input}' END AS document_template FROM region)"


def _models(b: Bound) -> DataFrame:
    i = F.col("r_regionkey")
    return b.raw("region").select(i.alias("id"), F.concat(F.lit("p"), i).alias("provider"), (64 * (1 + i)).cast("int").alias("dimension"), F.lit("l2").alias("normalization"), F.when(i % 2 == 0, "passage: {input}").alias("document_template"), F.lit(None).cast("string").alias("query_template"))


def _strategies(b: Bound) -> DataFrame:
    i = F.col("n_nationkey")
    new = b.raw("nation").select(
        i.alias("id"), F.col("n_regionkey").alias("model_id"), F.col("n_name").alias("name"), F.when(i % 3 == 0, "own {input}").alias("document_template"), F.lit(None).cast("string").alias("query_template"), F.when(i % 4 == 0, False).alias("is_active"),
        F.date_sub(F.lit("2024-01-31").cast("date"), (i % 10).cast("int")).alias("created_at"))
    return embedding.new_strategies(new, _models(b))


@query(f"""WITH {MODELS} SELECT n_nationkey AS id, n_regionkey AS model_id, provider, dimension, normalization, CASE WHEN n_nationkey % 3 = 0 THEN 'own {{input}}' ELSE coalesce(document_template, '{{input}}') END AS document_template, '{{input}}' AS query_template,
CASE WHEN n_nationkey = 5 THEN 'new name' ELSE n_name END AS name, n_nationkey % 4 <> 0 AND n_nationkey <> 6 AS is_active FROM nation JOIN m ON m.id = n_regionkey""")
def strategies(b: Bound) -> DataFrame:
    changes = b.spark.sql("SELECT 5 AS id, 'new name' AS name, CAST(NULL AS boolean) AS is_active UNION ALL SELECT 6, NULL, false")
    return embedding.updated_strategies(_strategies(b), changes).drop("created_at")


@query("SELECT n_nationkey AS id, 'p' || n_regionkey AS provider FROM nation WHERE n_nationkey % 4 <> 0 ORDER BY n_nationkey % 10 DESC, n_nationkey LIMIT 1")
def active_strategy(b: Bound) -> DataFrame:
    return listing.active_strategy(_strategies(b)).select("id", "provider")


@query(f"WITH {MODELS} SELECT n_nationkey AS id, provider AS model_provider, dimension AS model_dimension FROM nation JOIN m ON m.id = n_regionkey")
def strategy_reads(b: Bound) -> DataFrame:
    return listing.strategy_reads(_strategies(b).drop("provider", "dimension"), _models(b)).select("id", "model_provider", "model_dimension")


@query(f"""WITH {QUEUE}, p AS (SELECT chunk_id, input_hash, row_number() OVER (ORDER BY chunk_id % 97, chunk_id) AS nth FROM q WHERE embedding_status = 'pending')
SELECT q.chunk_id, CASE WHEN nth <= 500 THEN 'processing' ELSE embedding_status END AS embedding_status, CAST(CASE WHEN nth <= 500 THEN 1 ELSE 0 END AS int) AS attempt_count FROM q LEFT JOIN p ON p.chunk_id = q.chunk_id AND p.input_hash = q.input_hash""")
def claimed_queue(b: Bound) -> DataFrame:
    queue = _queue(b).withColumn("created_at", F.col("chunk_id") % 97)
    return embedding.claimed(queue, STRATEGY.id).select("chunk_id", "embedding_status", "attempt_count")


@query(f"WITH {QUEUE} SELECT chunk_id, CASE WHEN embedding_status = 'pending' THEN 'completed' ELSE embedding_status END AS embedding_status, CASE WHEN embedding_status = 'pending' THEN 64 END AS dimension FROM q")
def drained_queue(b: Bound) -> DataFrame:
    """All pending rows claimed and embedded; other rows stay as they are."""
    queue = _queue(b).withColumn("embedding_status", F.when(F.col("embedding_status") == "pending", "processing").otherwise(F.col("embedding_status")))
    inputs = embedding.hashed(_documents(b), STRATEGY).select("chunk_id", "input_hash", "input")
    done = embedding.drained(queue, inputs, STRATEGY, embedding.hashing_embedder(64))
    return done.select("chunk_id", "embedding_status", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimension"))


@query("SELECT count(*) AS claimed, count(*) AS completed, 0 AS failed FROM documents")
def sweep_counters(b: Bound) -> DataFrame:
    return embedding.sweep_counters(embedding.sweep(embedding.hashed(_documents(b), STRATEGY), STRATEGY, embedding.hashing_embedder(64)))


@query("SELECT sum(CASE WHEN length(text) > 0 THEN greatest(1, length(text) // 4) ELSE 0 END)::bigint AS tokens FROM documents")
def token_sum(b: Bound) -> DataFrame:
    return b.raw("documents").agg(F.sum(tx.token_count(F.col("text"))).alias("tokens"))


@query("SELECT CASE WHEN l_orderkey % 4 = 0 THEN 'user:u' || (l_orderkey % 7) ELSE 'credential:k' || (l_orderkey % 5) END AS trigger, count(*) AS n FROM lineitem GROUP BY 1")
def attributed_calls(b: Bound) -> DataFrame:
    """Rows that carry their caller's columns, counted by caller."""
    i = F.col("extraction_id")
    user, credential = (Scope(tenants=(1,), user_id="u").triggered_by(), Scope(tenant_id=1, application_id=1, credential_id="k").triggered_by())
    rows = b.usage.select("extraction_id")
    both = rows.where(i % 4 == 0).withColumns({c: F.concat(v, i % 7) if c.endswith("_id") else v for c, v in user.items()}).unionByName(rows.where(i % 4 != 0).withColumns({c: F.concat(v, i % 5) if c.endswith("_id") else v for c, v in credential.items()}))
    return both.groupBy(ledger.trigger_key("triggered_by_kind", "triggered_by_user_id", "triggered_by_credential_id").alias("trigger")).agg(F.count("*").alias("n"))


PAIRS = f"""WITH RECURSIVE {TREE}, pairs(root, id, d) AS (SELECT id, id, 0 FROM t UNION ALL SELECT root, t.id, d + 1 FROM pairs JOIN t ON t.parent = pairs.id)"""


@query(f"{PAIRS}, up AS (SELECT id, max(d) AS depth FROM pairs GROUP BY 1) SELECT root AS id, any_value(depth) AS depth, count(*) AS size FROM pairs JOIN up ON up.id = root GROUP BY 1")
def tree_numbers(b: Bound) -> DataFrame:
    """Depth and size of every subject's subtree, from its interval."""
    return intervals.numbered(b.subjects).select("id", "depth", (F.col("last") - F.col("first") + 1).alias("size"))


@query(f"{PAIRS} SELECT root, id FROM pairs")
def tree_below(b: Bound) -> DataFrame:
    """Every subject with each subject of its subtree, by a join of dyadic blocks."""
    numbers = intervals.numbered(b.subjects)
    return intervals.below(numbers, numbers)


@query(f"{PAIRS}, moves AS (SELECT id, (SELECT min(id) FROM t) + id % 7 AS \"to\" FROM t) SELECT m.id, m.to FROM moves m JOIN pairs p ON p.root = m.id AND p.id = m.to")
def tree_refused_moves(b: Bound) -> DataFrame:
    """Of a move for each subject, those that would close a cycle."""
    least = b.raw("customer").agg(F.min("c_custkey").alias("_least"))
    moves = b.subjects.select("id").join(F.broadcast(least)).select("id", (F.col("_least") + F.col("id") % 7).alias("to"))
    return intervals.refused(intervals.numbered(b.subjects), moves)


@query("""SELECT doc_id AS chunk_id, CASE doc_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' ELSE 'failed' END AS embedding_status, CASE doc_id % 4 WHEN 3 THEN 3 ELSE 1 END AS attempt_count,
CASE doc_id % 4 WHEN 2 THEN 'refused' WHEN 3 THEN 'lease lost' END AS error FROM documents""")
def queue_leases(b: Bound) -> DataFrame:
    """The queue of all documents as a stream of events: some are done, some refused, some are
    claimed once or thrice by workers that are never heard of again."""
    scratch = Scratch(b.spark, "queue")
    i = F.col("doc_id")
    event = lambda kind, second: F.struct(F.lit(kind).alias("kind"), F.timestamp_seconds(F.lit(1_700_000_000 + second)).alias("at"))
    ending = F.when(i % 4 == 0, F.array(event("done", 20))).when(i % 4 == 2, F.array(event("failed", 20))).when(i % 4 == 3, F.array(event("claimed", 1000), event("claimed", 2000))).otherwise(F.array().cast("array<struct<kind:string,at:timestamp>>"))
    own = b.raw("documents").select(i.alias("chunk_id"), F.explode(F.concat(F.array(event("enqueued", 0), event("claimed", 10)), ending)).alias("e"))
    last = b.spark.range(1).select(F.lit(-1).cast("long").alias("chunk_id"), event("enqueued", 100_000).alias("e"))  # a later time, by which all leases have ended
    events = own.unionByName(last).select("chunk_id", F.lit("s").alias("strategy_id"), "e.kind", F.lit("h").alias("input_hash"), "e.at", F.when(F.col("e.kind") == "failed", "refused").alias("error"))
    scratch.save(events, "events")
    leases.lease_stream(b.spark, f"{scratch.base}/events", f"{scratch.base}/changes", f"{scratch.base}/state").awaitTermination()
    changes = b.spark.read.option("basePath", f"{scratch.base}/changes").parquet(f"{scratch.base}/changes")
    return leases.queue_of(changes).where("chunk_id >= 0").select("chunk_id", "embedding_status", "attempt_count", "error")


@query("SELECT 'documents/' || doc_id AS key, CAST(strlen(text) AS bigint) AS size, sha256(text) AS sha256 FROM documents WHERE doc_id % 5 <> 0")
def store_round_trip(b: Bound) -> DataFrame:
    """All documents put into the store, a fifth of them deleted again, and what is there read back."""
    b.spark.dataSource.register(store.ObjectStore)
    path = f"{Scratch(b.spark, 'store').base}/objects"
    key = F.concat(F.lit("documents/"), "doc_id").alias("key")
    put = lambda df: df.write.format("sparkweft_store").option("path", path).mode("append").save()
    put(b.raw("documents").select(key, F.col("text").cast("binary").alias("content")))
    put(b.raw("documents").where("doc_id % 5 = 0").select(key, F.lit(None).cast("binary").alias("content")))
    return b.spark.read.format("sparkweft_store").option("path", path).load().select("key", "size", "sha256")


@query("""SELECT l_returnflag || l_linestatus AS model, count(*) AS calls, true AS near FROM lineitem GROUP BY 1
UNION ALL SELECT NULL, count(*), true FROM lineitem""")
def usage_sketches(b: Bound) -> DataFrame:
    """Calls by model and in all from days' rows, and whether the estimate of distinct extractions
    is within the stated error of the exact count."""
    days = sketches.by_day(b.usage, "created_at", ["model"], {"extractions": "extraction_id"})
    made = sketches.rolled(days, ["model"], ["extractions"], levels=True)
    exact = b.usage.rollup("model").agg(F.countDistinct("extraction_id").alias("exact")).withColumnRenamed("model", "_model")
    both = made.join(exact, F.col("model").eqNullSafe(F.col("_model")))
    return both.select("model", F.col("n").alias("calls"), (F.abs(F.col("extractions") - F.col("exact")) <= sketches.error() * F.col("exact")).alias("near"))


@query("""SELECT l_orderkey AS source_id, CAST(CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS bigint) AS subject_id, count(*) AS lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_orderkey % 7 <> 0 AND NOT (l_orderkey % 5 = 1 AND l_linenumber % 3 = 0) GROUP BY 1, 2""")
def change_feed(b: Bound) -> DataFrame:
    """The lines of all orders after a feed that deletes some orders, moves some and sends new
    versions of some, delivered twice."""
    scratch = Scratch(b.spark, "feed")
    owners = b.sources.select(F.col("id").alias("l_orderkey"), "subject_id")
    lines = b.raw("lineitem").join(owners, "l_orderkey").select(F.col("l_orderkey").alias("source_id"), "subject_id", (F.col("l_linenumber") % 3).cast("long").alias("version"))
    changes.lay_out(lines, f"{scratch.base}/lines", 16)
    i = F.col("id")
    kinds = F.concat(*[F.when(when, F.array(F.lit(kind))).otherwise(F.array().cast("array<string>")) for kind, when in (("deleted", i % 7 == 0), ("moved", i % 3 == 0), ("version", i % 5 == 1))])
    feed = scratch.save(b.sources.select(i.alias("source_id"), F.explode(kinds).alias("kind")).select(F.lit(1).cast("long").alias("seq"), "kind", "source_id", F.lit(1).cast("long").alias("subject_id"), F.lit(1).cast("long").alias("version")), "feed")
    changes.change_stream(b.spark, f"{scratch.base}/feed", f"{scratch.base}/state", {"lines": f"{scratch.base}/lines"}, 16).awaitTermination()
    changes.apply(b.spark, feed, {"lines": f"{scratch.base}/lines"}, 16)
    return changes.current(b.spark, f"{scratch.base}/lines").groupBy("source_id", "subject_id").agg(F.count("*").alias("lines"))
