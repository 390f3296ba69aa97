"""URL filter: a blocked Bloom filter of listed URLs, then an exact hash join.

A list has rules (host, path, verdict). A rule's canonical URL is host + path, which begins
with the host and whose first slash begins the path. A page's candidates are its host's
suffixes at dots, each with its path's prefixes of the lengths that the list has.

The filter is a table of blocks of 256 bits (4 longs), about 16 bits a rule; a key sets four
bits in its one block. It is built with bit_or in a group-by and probed with a join on the
block's number: a broadcast while its size, known from the number of rules, is under
``broadcast_bytes``, else a shuffle of distinct candidates. What passes meets the rules in an
exact join on the key itself.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, UPPER_AZ

#: The list that the query applies: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    at = F.expr(f"instr(`{url}`, '://')")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", F.translate(host, UPPER_AZ, LOWER_AZ)).withColumn("path", path)


def _bits(key: Column, blocks: int) -> dict[str, Column]:
    """The key's block and its mask in each of the block's four longs."""
    h = F.xxhash64(key, F.lit(7))
    out = {"_block": F.pmod(F.xxhash64(key), F.lit(blocks))}
    for w in range(4):  # one bit in each long: 6 bits of the hash say which
        spot = F.shiftrightunsigned(h, 6 * w).bitwiseAND(F.lit(63)).cast("int")
        out[f"_m{w}"] = F.call_function("shiftleft", F.lit(1).cast("long"), spot)
    return out


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """One row for each block that has a bit: _block, _w0 .. _w3."""
    return keys.select(*[c.alias(n) for n, c in _bits(F.col("key"), blocks).items()]).groupBy("_block").agg(
        *[F.bit_or(f"_m{w}").alias(f"_w{w}") for w in range(4)])


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", bits_per_rule: int = 16, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``.

    The longest rule that fits wins; of two rules with one host and path, the one whose verdict
    is greater, ``block``. Null, empty and malformed URLs have empty host and path, fit no rule
    and get ``otherwise``, as unlisted pages do. Each distinct URL is judged once, so repeated
    URLs cost one row; repeated pages stay repeated. Only page_id and url are read.
    """
    listed = rules.select(F.concat("host", "path").alias("key"), "path", "verdict").where("key is not null and key != ''")
    listed = listed.groupBy("key").agg(F.max("verdict").alias("verdict"), F.first("path").alias("path"))
    sizes = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lengths")).first()
    n, lengths = sizes["n"], sorted(sizes["lengths"])
    judged = with_host_path(pages.select("page_id", "url"))
    if not n:
        return judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    blocks = max(1, n * bits_per_rule // 256)
    small = blocks * 40 + n * 128 <= broadcast_bytes
    near = F.broadcast if small else (lambda df: df)
    urls = judged.select("host", "path").distinct().where("host != ''")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths]), lambda x: x.isNotNull())
    candidates = urls.select("host", "path", F.explode(suffixes).alias("_suffix"), prefixes.alias("_prefixes"))
    candidates = candidates.select("host", "path", F.explode("_prefixes").alias("_prefix"), "_suffix").select("host", "path", F.concat("_suffix", "_prefix").alias("key"))
    probe = candidates.select("host", "path", "key", *[c.alias(x) for x, c in _bits(F.col("key"), blocks).items()])
    passes = F.lit(True)
    for w in range(4):
        passes = passes & (F.col(f"_w{w}").bitwiseAND(F.col(f"_m{w}")) == F.col(f"_m{w}"))
    possible = probe.join(near(bloom_filter(listed, blocks)), "_block").where(passes).select("host", "path", "key")
    hits = possible.join(near(listed.select("key", "verdict")), "key")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.col("key").alias("rule"), "verdict"), F.struct(F.length("key"), "key")).alias("_best"))
    out = judged.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(otherwise)).alias("verdict"))
