"""External shuffle, Shallot clustering and the conversation trie against plain forms."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkweft.llm import centroids, prefixes, queries, sharding

DOCS = "doc_id long, text string, source string"


def rows_of(n, seed=3):
    rng = random.Random(seed)
    out = [(i, " ".join(rng.choice("abcdef") * rng.randrange(1, 9) for _ in range(rng.randrange(0, 40))), f"s{i % 3}") for i in range(n)]
    return out + [(None, None, None), (None, "no id", "s"), (7, "", ""), (7, "again", "s"), (n, "長い " * 30_000, "s")]


@pytest.mark.parametrize("bucket_bytes", [32 << 20, 20_000, 1000])
def test_shards_hold_every_row_once(spark, tmp_path, bucket_bytes):
    """With more buckets than rows, with few, with one; a third of all rows is one row repeated."""
    rows = rows_of(150) + [(5, "the same row", "s")] * 80
    df = spark.createDataFrame(rows, DOCS)
    got = sharding.shuffled_shards(df.repartition(5), f"{tmp_path}/a", bucket_bytes=bucket_bytes, seed=9)
    assert got.columns == ["doc_id", "text", "source", "slot", "shard"]
    held = [tuple(r) for r in got.collect()]
    assert Counter(r[:3] for r in held) == Counter(rows)
    by = {}
    for *_, slot, shard in held:
        by.setdefault(shard, []).append(slot)
    assert set(by) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shuffled_shards(df.repartition(2).orderBy("source"), f"{tmp_path}/b", bucket_bytes=bucket_bytes, seed=9)
    other = sharding.shuffled_shards(df, f"{tmp_path}/c", bucket_bytes=bucket_bytes, seed=10)
    key = lambda d: sorted(map(repr, (tuple(r) for r in d.collect())))
    assert key(again) == sorted(map(repr, held)) and key(other) != sorted(map(repr, held))


def test_shards_are_in_random_order(spark, tmp_path):
    """Neighbours of the input are no neighbours in the output: ranks of ids and places don't correlate."""
    n = 4000
    got = sharding.shuffled_shards(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), f"{tmp_path}/s", bucket_bytes=4000).toPandas()
    place = got["shard"] * n + got["slot"]
    assert abs(np.corrcoef(got["doc_id"], place.rank())[0, 1]) < 4 / n ** 0.5
    near = got.sort_values(["shard", "slot"])["doc_id"].diff().abs()
    assert abs(near.mean() - n / 3) < n / 15


def test_fisher_yates():
    assert all(sorted(sharding.fisher_yates(n, 1, 2).tolist()) == list(range(n)) for n in (0, 1, 2, 50))
    seen = Counter(tuple(sharding.fisher_yates(3, s).tolist()) for s in range(1200))
    assert len(seen) == 6 and all(140 < v < 260 for v in seen.values())


def test_shards_of_odd_tables(spark, tmp_path):
    few = spark.createDataFrame([(1, "a", {"k": 1}), (2, None, None)], "doc_id long, text string, `odd name` map<string,int>")
    got = sharding.shuffled_shards(few, f"{tmp_path}/few").collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got) in ([(1, 0, 0), (2, 1, 0)], [(1, 1, 0), (2, 0, 0)]) and {str(r["odd name"]) for r in got} == {"{'k': 1}", "None"}
    assert sharding.shuffled_shards(few.limit(0), f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        sharding.shuffled_shards(few.withColumn("Slot", F.lit(1)), f"{tmp_path}/clash")


def test_shard_digest(spark):
    rows = rows_of(40)
    got = sharding.shard_digest(spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit(1))).collect()
    want = Counter((i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def plain_clusters(vectors, k, rounds, width):
    kept = [(i, np.floor(np.array(v, float) * 256).astype(np.int64)) for i, v in vectors if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1].astype("<i4").tobytes().hex()))
    at, x = np.array([v for _, v in order[:k]]), np.array([v for _, v in kept])
    for n in range(rounds + 1):
        d = ((x[:, None] - at[None]) ** 2).sum(2)
        near = d.argmin(1)
        if n < rounds:
            at = np.array([[int(s) // int((near == j).sum()) for s in x[near == j].sum(0)] if (near == j).any() else at[j] for j in range(len(at))])
    own = {j: int(d.min(1)[near == j].sum()) for j in set(near.tolist())}
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in at]
    return sorted(((i, int(j), int(e), own[j], sum(own.values()), sha[j]) for (i, _), j, e in zip(kept, near.tolist(), d.min(1))), key=repr)


@pytest.mark.parametrize("n, k, width, span", [(400, 12, 4, 1.0), (60, 7, 2, 0.02), (3, 5, 3, 0.5), (200, 40, 64, 0.4)])
def test_clusters(spark, n, k, width, span):
    """Many ties (a small span), repeated vectors and ids, fewer vectors than centroids, vectors that take no part."""
    rng = np.random.default_rng(n)
    rows = [(i // 2 if i < 6 else i, (rng.standard_normal(width) * span).astype(np.float32).tolist()) for i in range(n)]
    rows += [(900 + j, rows[0][1]) for j in range(n // 4)]
    odd = [(None, rows[1][1]), (801, None), (802, []), (803, [1.0] * (width + 1)), (804, [None] * width), (805, [float("nan")] * width), (806, [float("inf")] * width)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"near": F.lit("x"), "q": F.lit(1)})
    got = sorted((tuple(r) for r in centroids.cluster_embeddings(df, k, 5, width).collect()), key=repr)
    assert got == plain_clusters(rows + odd, k, 5, width)


def test_clusters_of_nothing_and_of_huge_vectors(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, None)], "vec_id long, embedding array<float>")
    assert centroids.cluster_embeddings(df, 3, 2, 2).collect() == []
    one = spark.createDataFrame([(1, [500000.0, -500000.0]), (2, [-500000.0, 500000.0])], "vec_id long, embedding array<float>")
    assert [r["distance"] for r in centroids.cluster_embeddings(one, 1, 0, 2).orderBy("distance").collect()] == [0, 2 * (2 * 500000 * 256) ** 2]


def test_search_settles_most_by_bounds():
    """Vectors in tight groups are not looked at again once centroids rest."""
    rng = np.random.default_rng(1)
    at = rng.integers(-9000, 9000, (30, 8))
    x = (at[rng.integers(0, 30, 3000)] + rng.integers(-20, 20, (3000, 8))).astype(np.int64)
    centres = centroids.Centres(at)
    first = centroids.search(x, np.zeros(3000, np.int32), np.ones(3000, np.int32), np.full(3000, np.inf), np.zeros(3000), centres)
    upper, lower = centroids.moved(first[0], first[2], first[3], np.zeros(30))
    assert (upper < np.maximum(lower, centres.half[first[0]])).all()


def conversations(seed=5):
    """Shared and equal conversations, of 0 to 12 turns, with null turns, roles and texts and turns of one number."""
    rng = random.Random(seed)
    out = []
    for c in [*range(48), 100, 101, 205, 206, -3]:
        for t in range(rng.randrange(0, 13)):
            number = None if t == 0 and c % 3 == 0 else t // 2 if c % 5 == 1 else t
            out.append((c, number, rng.choice(["user", None, "bot"]) if t > 5 else "u", rng.choice(["a b", "a", None]) if t % 4 == 3 else " x\ty  z "))
    return out + [(None, 1, "u", "no conversation"), (300, 0, "u", "w " * 50_000), (301, 0, "u", ""), (301, 0, "u", "")]


@pytest.mark.parametrize("width", [8, 1, 2])
def test_trie(spark, width):
    rows = conversations()
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = sorted(map(repr, con.sql(f"select {', '.join(names)} from ({queries.OP13_SQL})").fetchall()))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"t1": F.lit(1), "prev": F.lit("x")}).repartition(6)
    got = prefixes.conversation_trie(df, width)
    assert got.columns == names and {k for n, k in got.dtypes[:-1]} == {"bigint"}
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_trie_of_many_copies_and_of_a_long_one(spark):
    """Equal conversations end in one node; one that is alone is a chain, however long."""
    rows = [(1000 + c, t, "u", f"turn {t}") for c in range(0, 300) for t in range(3)] + [(20_000, t, "u", f"t{t}") for t in range(500)]
    got = {(r["conv_id"], r["depth"]): r for r in prefixes.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    ids = ",".join(str(1000 + c) for c in range(300))
    assert got[1000, 3]["ends_sha256"] == hashlib.sha256(ids.encode()).hexdigest() and got[1000, 3]["n_convs"] == 300
    assert got[1000, 0]["n_children"] == 2 and got[1000, 0]["saved_tokens"] == 3 * 299 * 2 and got[1000, 0]["n_leaves"] == 2
    assert got[20_000, 500]["n_children"] == 0 and got[20_000, 500]["parent_conv_id"] == 20_000 and len(got) == 1 + 3 + 500
    assert prefixes.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# what earlier operators do with ids at both ends of a long and with vectors of several lengths

def test_ids_at_both_ends_of_a_long(spark):
    from sparkweft.llm import ppm, simhash

    lo, hi = -(1 << 63), (1 << 63) - 1
    ids = [lo, lo + 1, -5, 0, 1, 2, 3, hi - 1, hi, None, 7, 7, 7]
    rows = [(i, f"some words of text {k} and more of them here", "s") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, DOCS)
    got = simhash.edited_fingerprints(df, bucket_rows=2).collect()
    one = simhash.edited_fingerprints(df, bucket_rows=1000).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, one)) and len(got) == len(rows)
    small = ppm.score_documents(df, F.lit(False), block_bytes=100).collect()
    whole = ppm.score_documents(df, F.lit(False)).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 9)) for r in rows)
    assert key(small) == key(whole)


def test_vectors_of_another_length_take_no_part(spark):
    from sparkweft.llm import ann

    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(30)] + [(100, [1.0] * 8), (200, [1.0] * 3)]
    got = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 10 == 0, k=3).collect()
    assert {r["query_id"] for r in got} == {0, 10, 20} and {r["vec_id"] for r in got} <= set(range(30)) and len(got) == 9


@pytest.mark.parametrize("name", ["op4_warc", "op8_recompression", "op9_url_filter", "op11_external_shuffle", "op12_shallot", "op13_prefix_trie"])
def test_queries_on_a_given_table(spark, name):
    """The registered query on the smallest tables, against its SQL where it has one."""
    sf = "/root/testdata/sf0.001"
    rows = queries.queries()[name](spark, sf)
    got = sorted(repr(tuple(r[c] for c in sorted(rows.columns))) for r in rows.collect())
    assert got
    if sql := queries.oracle_sql().get(name):
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages", "conversations"):
            con.sql(f"create view {t} as from '{sf}/{t}.parquet'")
        r = con.sql(sql)
        assert got == sorted(repr(tuple(x[r.columns.index(c)] for c in sorted(r.columns))) for x in r.fetchall())
