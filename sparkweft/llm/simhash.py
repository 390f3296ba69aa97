"""SimHash fingerprints with DataFrame functions only, and their search by permuted block tables.

Terms are shingles of five words (a shorter text is one shingle); a term weighs as often as it
occurs. Every occurrence votes on 64 bits. The ones are counted in 32 long sums of two lanes of
32 bits each, so a vote is 32 masked additions inside whole-stage code generation; a bit is set
when more than half of the terms set it.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

WORDS = r"[\x20\x09-\x0D]+"
LANES = 0x0000000100000001


def _lane(h: Column, k: int) -> Column:
    return F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANES))


def _fingerprint(n: Column, sums: list[Column]) -> Column:
    """64 bits from the number of terms and the lanes' counts of ones; 0 without terms."""
    bit = lambda ones, at: F.when(ones * 2 > n, F.lit(1 << at if at < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    low, high = [x.bitwiseAND(F.lit(0xFFFFFFFF)) for x in sums], [F.shiftrightunsigned(x, 32) for x in sums]
    bits = [bit(x, k) for k, x in enumerate(low)] + [bit(x, k + 32) for k, x in enumerate(high)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", shingle: int = 5) -> DataFrame:
    """The keys and ``fp`` (long): a row for each distinct key, which must tell texts apart.

    Null and empty texts have no terms and fingerprint 0. Rows are grouped where they are if the
    frame is already partitioned by some of the keys.
    """
    words = texts.select(*keys, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WORDS), lambda w: w != "").alias("_words"))
    words = words.select(*keys, "_words", F.greatest(F.least(F.size("_words"), F.lit(1)), F.size("_words") - (shingle - 1)).alias("_n"))
    parts = [F.slice("_words", k + 1, F.col("_n")) for k in range(shingle)]
    terms = words.select(*keys, F.inline_outer(F.arrays_zip(*[p.alias(f"_{k}") for k, p in enumerate(parts)])).alias(*[f"_{k}" for k in range(shingle)]))
    hashed = terms.select(*keys, F.when(F.col("_0").isNotNull(), F.xxhash64(*[f"_{k}" for k in range(shingle)])).alias("_h"))
    sums = hashed.groupBy(*keys).agg(F.count("_h").alias("_n"), *[F.sum(_lane(F.col("_h"), k)).alias(f"_s{k}") for k in range(32)])
    filled = [F.coalesce(f"_s{k}", F.lit(0).cast("long")) for k in range(32)]
    return sums.select(*keys, _fingerprint(F.col("_n"), filled).alias("fp"))


def as_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def near_fingerprints(fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """a, b, distance: all pairs of distinct fingerprints a < b within the Hamming radius.

    The 64 bits are cut into ``blocks``; two fingerprints within the radius agree on at least
    blocks - radius of them. There is a table for each choice of that many blocks, keyed by their
    bits, and within a table only rows of equal key meet, so none is missed. A pair is kept in
    the first table that shows it. Equal fingerprints are one row: join ``fp`` to get back to
    documents. Null fingerprints take no part.
    """
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be less than blocks")
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << cuts[k + 1]) - (1 << cuts[k])) for k in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tables = [signed(sum(masks[k] for k in chosen)) for chosen in combinations(range(blocks), blocks - radius)]
    own = fps.select("fp").where("fp is not null").distinct()
    keyed = own.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in tables])).alias("t", "key"))
    pairs = keyed.select("t", "key", F.col("fp").alias("a")).join(keyed.select("t", "key", F.col("fp").alias("b")), ["t", "key"]).where("a < b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = reduce(lambda rest, k: F.when(differ.bitwiseAND(F.lit(tables[k])) == 0, k).otherwise(rest), reversed(range(len(tables))), F.lit(-1))
    return pairs.withColumn("distance", F.bit_count(differ)).where((F.col("distance") <= radius) & (first == F.col("t"))).select("a", "b", "distance")


def _buckets(docs: DataFrame, key: str, rows: int, most: int = 4096) -> Column:
    """The number of the key's range, of about ``rows`` documents each; nulls go to the last.

    At most ``most`` ranges are cut at quantiles; each of them is cut evenly by value into as many
    as it needs, so ranges keep their size however many documents there are.
    """
    size = docs.agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    wanted = max(1, -(-size["n"] // rows))
    outer = min(most, wanted)
    inner = -(-wanted // outer)
    if size["lo"] is None or wanted == 1:
        return F.lit(0).cast("long")
    cuts = docs.approxQuantile(key, [k / outer for k in range(1, outer)], 0.25 / outer) if outer > 1 else []
    bounds = sorted({size["lo"], *(min(max(int(c), size["lo"]), size["hi"]) for c in cuts)})
    ends = F.array(*[F.lit(x) for x in [*bounds[1:], size["hi"]]])
    begins = F.array(*[F.lit(x) for x in bounds])
    nth = F.greatest(F.lit(1), F.size(F.filter(begins, lambda x: x <= F.col(key))))
    # as doubles: ids at both ends of a long are too far apart for one
    lo, hi = (F.element_at(x, nth).cast("double") for x in (begins, ends))
    within = F.least(F.lit(inner - 1), F.floor((F.col(key).cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * inner)) if inner > 1 else F.lit(0)
    return F.when(F.col(key).isNull(), len(bounds) * inner).otherwise((nth - 1) * inner + within).cast("long")


def near_counts(fps: DataFrame, radius: int = 3) -> DataFrame:
    """fp, n_near: how many other rows of ``fps`` have a fingerprint within the radius.

    Rows of one fingerprint are counted first, so copies meet as one row.
    """
    counts = Scratch(fps.sparkSession, "fingerprints").save(fps.groupBy("fp").agg(F.count("*").alias("n")), "counts")
    pairs = near_fingerprints(counts, radius).select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnRenamed("b", "fp").join(counts, "fp")
    others = both.groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    return counts.join(others, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"))


def edited_fingerprints(docs: DataFrame, bucket_rows: int = 1024, radius: int = 3) -> DataFrame:
    """Fingerprints of every whole text and of its edited text; see the contract of query op10.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    n_near, the number of other rows whose fingerprint is within ``radius`` bits, for each row. Null texts count as empty; rows of equal doc_id follow one another by text, null
    doc_ids come last; the last row's next is the first. One row is its own next. An empty table
    gives an empty result. Documents go once, whole, to ranges of doc_id; the first document of a
    range visits the range before it, so each range sees its last document's successor.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_bucket", _buckets(docs, "doc_id", bucket_rows))
    heads = rows.groupBy("_bucket").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text")).alias("_head"))
    # a range's predecessor is found among the ranges' numbers alone, a long each
    before = F.coalesce(F.lag("_bucket").over(W.orderBy("_bucket")), F.max("_bucket").over(W.partitionBy()))
    ranges = scratch.save(rows.select("_bucket").distinct().select("_bucket", before.alias("_before")), "ranges")
    visits = heads.join(ranges, "_bucket").select(F.col("_before").alias("_bucket"), F.col("_head.doc_id").alias("doc_id"), F.col("_head.text").alias("text"), F.lit(1).alias("_visit"))
    order = W.partitionBy("_bucket").orderBy("_visit", F.asc_nulls_last("doc_id"), "text")
    placed = rows.withColumn("_visit", F.lit(0)).unionByName(visits).select(
        "_bucket", "_visit", "doc_id", "text", F.row_number().over(order).alias("_nth"), F.lead("text").over(order).alias("_next")).where("_visit = 0")
    n, q = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.substring("_next", F.lit(1), q))
    both = placed.select("_bucket", "_nth", "doc_id", n.cast("long").alias("n_chars"), F.array("text", edited).alias("_both"))
    both = both.select("_bucket", "_nth", "doc_id", "n_chars", F.sha2(F.element_at("_both", 2).cast("binary"), 256).alias("edited_sha256"), F.posexplode("_both").alias("_which", "text"))
    made = fingerprints(both, ["_bucket", "_nth", "doc_id", "n_chars", "edited_sha256", "_which"])
    made = made.groupBy("_bucket", "_nth", "doc_id", "n_chars", "edited_sha256").agg(
        F.max(F.when(F.col("_which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("_which") == 1, F.col("fp"))).alias("efp"))
    made = scratch.save(made, "fingerprints")
    first = made.where("_nth = 1").join(ranges, "_bucket").select(F.col("_before").alias("_bucket"), F.col("fp").alias("_after"))
    follow = F.lead("fp").over(W.partitionBy("_bucket").orderBy("_nth"))
    out = made.withColumn("_lead", follow).join(first, "_bucket", "left").withColumn("_lead", F.coalesce("_lead", "_after"))
    out = out.join(near_counts(made.select("fp"), radius), "fp")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("_lead")).alias("near_next"), "n_near")
