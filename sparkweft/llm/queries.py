"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, centroids, jaccard, mixing, ppm, prefixes, recompression, sharding, simhash, toxicity, urls, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return ppm.score_documents(table(spark, sf_dir, "documents"), held_out)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark, urls.RULES))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op11_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op12_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_embeddings(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.conversation_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_mix_sources, op2_jaccard_join, op3_toxicity, op4_warc, op5_nn_descent, op6_ppm, op7_bpe, op8_recompression, op9_url_filter, op10_simhash, op11_external_shuffle,
        op12_shallot, op13_prefix_trie)}


OP9_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS nth
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND f.nth = 1
"""


WORDS_SQL = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_have >= 75 * (p.n + q.n - both_have)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, met) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, y FROM reach r JOIN ways ON x = r.met)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.met) AS component_id
FROM documents d JOIN reach r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
""".format(words=WORDS_SQL.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY 1),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right('0000' || bin(strpos('0123456789abcdef', h[i]) - 1), 4)), '') AS bits FROM p JOIN f USING (h))
SELECT page_id, CAST(strlen(payload) AS bigint) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5 * i + 1] AS int) + 8 * CAST(bits[5 * i + 2] AS int)
    + 4 * CAST(bits[5 * i + 3] AS int) + 2 * CAST(bits[5 * i + 4] AS int) + CAST(bits[5 * i + 5] AS int)]), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""

OP8_SQL = """
WITH w AS (SELECT doc_id, {words} AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM w WHERE len(w) >= 50),
firsts AS (SELECT h, min(doc_id) AS lo FROM windows GROUP BY 1),
repeats AS (SELECT doc_id, pos FROM windows JOIN firsts USING (h) WHERE lo < doc_id),
each_word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM w),
judged AS (SELECT e.*, coalesce(bool_or(r.pos IS NOT NULL) OVER (PARTITION BY e.doc_id ORDER BY e.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
  FROM each_word e LEFT JOIN repeats r ON r.doc_id = e.doc_id AND r.pos = e.pos)
SELECT d.doc_id, count(j.pos) AS n_words, count(*) FILTER (j.gone) AS n_removed, sha256(coalesce(string_agg(j.word, ' ' ORDER BY j.pos) FILTER (NOT j.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j USING (doc_id) GROUP BY d.doc_id
""".format(words=WORDS_SQL.format(text="coalesce(text, '')"))



def _op12_sql(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """Plain rounds: every vector against every centroid, distances and means in whole numbers."""
    steps = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(CAST(x AS double) * 256)) AS q FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: isfinite(x))) = {width}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, q) - 1 AS j, q AS c FROM v QUALIFY j < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(q) AS q,
  min(CAST(list_dot_product(q, q) - 2 * list_dot_product(q, c) + list_dot_product(c, c) AS hugeint) * {k} + j) AS best FROM v, c{n} GROUP BY rid)""")
        if n < rounds:
            steps.append(f"""
e{n} AS (SELECT best % {k} AS j, unnest(q) AS x, unnest(range({width})) AS place FROM a{n}),
s{n} AS (SELECT j, place, CAST(sum(x) AS hugeint) AS s, count(*) AS n FROM e{n} GROUP BY 1, 2),
m{n} AS (SELECT j, list(CAST((s - (s % n + n) % n) // n AS double) ORDER BY place) AS c FROM s{n} GROUP BY 1),
c{n + 1} AS MATERIALIZED (SELECT o.j, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m USING (j))""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, CAST(best % {k} AS int) AS cluster, CAST(best // {k} AS bigint) AS distance,
  CAST(sum(best // {k}) OVER (PARTITION BY best % {k}) AS bigint) AS cluster_inertia, CAST(sum(best // {k}) OVER () AS bigint) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS bigint) AS varchar)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON j = best % {k}
"""


OP12_SQL = _op12_sql()


OP13_SQL = """
WITH RECURSIVE steps(i, k, v) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END) FROM steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
digits(c, s, crc, n) AS (SELECT DISTINCT conv_id, CAST(conv_id AS varchar), CAST(4294967295 AS bigint), 0 FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT c, s, xor(crc >> 8, t[xor(crc & 255, ascii(s[n + 1])) + 1]), n + 1 FROM digits, crc_table WHERE n < length(s)),
heads AS (SELECT c, xor(crc, 4294967295) % 4 AS h FROM digits WHERE n = length(s)),
turns AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS l FROM turns GROUP BY 1),
built AS (SELECT o.c, list_concat(coalesce(b.l[1:h], []), o.l[h + 1:]) AS l FROM own o JOIN heads USING (c) LEFT JOIN own b ON b.c = o.c - o.c % 20),
pre AS (SELECT c, len(l) AS n, unnest(range(0, len(l) + 1)) AS d, l FROM built),
m AS MATERIALIZED (SELECT c, n, d, l[d].text AS last, min(c) OVER w AS rep, count(*) OVER w AS n_convs, max(n) OVER w AS longest FROM pre WINDOW w AS (PARTITION BY d, l[1:d])),
nodes AS MATERIALIZED (SELECT rep, d, n_convs, longest = d AS leaf, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len({words}) END AS own FROM m WHERE c = rep),
below AS (SELECT m.rep, m.d, sum(CAST(leaf AS int)) AS n_leaves, sum(own) AS saved FROM nodes x JOIN m ON m.c = x.rep AND m.d <= x.d GROUP BY 1, 2),
up AS (SELECT x.rep, x.d, m.rep AS parent FROM nodes x JOIN m ON m.c = x.rep AND m.d = x.d - 1),
kids AS (SELECT parent AS rep, d - 1 AS d, count(*) AS n FROM up GROUP BY 1, 2),
ends AS (SELECT rep, d, string_agg(CAST(c AS varchar), ',' ORDER BY c) AS ids FROM m WHERE n = d GROUP BY 1, 2)
SELECT rep AS conv_id, CAST(d AS bigint) AS depth, parent AS parent_conv_id, n_convs, coalesce(k.n, 0) AS n_children, CAST(n_leaves AS bigint) AS n_leaves,
  CAST(saved AS bigint) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes JOIN below USING (rep, d) LEFT JOIN up USING (rep, d) LEFT JOIN kids k USING (rep, d) LEFT JOIN ends USING (rep, d)
""".format(words=WORDS_SQL.format(text="last"))


def oracle_sql() -> dict[str, str]:
    return {"op13_prefix_trie": OP13_SQL, "op12_shallot": OP12_SQL, "op2_jaccard_join": OP2_SQL, "op4_warc": OP4_SQL, "op8_recompression": OP8_SQL, "op9_url_filter": OP9_SQL}
