"""The small-world graph against exact search, with and without a scope."""

import numpy as np
from pyspark.sql import functions as F

from sparkweft.operators import retrieval, small_world


def recall(got, want):
    got, want = ({(r["query_id"], r["chunk_id"]) for r in df.select("query_id", "chunk_id").collect()} for df in (got, want))
    return len(got & want) / len(want), len(got), len(want)


def test_search_with_and_without_scope(spark, tmp_path):
    """Three levels; a third of all rows is one vector, and there are rows that can't be used."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1200, 12)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000 + i, v[7].tolist()) for i in range(600)]
    odd = [(9000, None), (9001, [0.0] * 12), (9002, [1.0] * 5), (9003, [float("nan")] * 12), (9004, [None] * 12)]
    chunks = spark.createDataFrame(rows + odd, "chunk_id long, embedding array<float>")
    index = small_world.build(chunks, f"{tmp_path}/index", m=8, cells=16, top_size=60)
    assert index.top >= 2 and index.table("members").count() == 1800 and index.table("links0").count() == 1200
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 1200, 40)] + [(2000, [0.0] * 12)], "query_id long, vector array<double>")
    fine = chunks.where("chunk_id < 9000")
    got, took = small_world.search(index, chunks, asked)
    share, n, m = recall(got, retrieval.nearest_chunks(fine, asked.where("query_id < 2000"), 10))
    assert share >= 0.95 and n == m == 300
    assert took.agg(F.max("rows")).first()[0] > 0
    best = {(r["query_id"], r["rank"]): r for r in got.collect()}
    assert all(best[i, 1]["chunk_id"] == i and abs(best[i, 1]["similarity"] - 1) < 1e-12 for i in range(0, 1200, 40))
    for scope, few in (("chunk_id % 9 = 1", 0.02), ("chunk_id % 9 = 1", 0.5), ("chunk_id between 5000 and 5100", 0.0)):
        inside = chunks.where(scope)
        got, _ = small_world.search(index, chunks, asked.where("query_id < 2000"), k=10, scope=inside, few=few)
        share, n, m = recall(got, retrieval.nearest_chunks(inside.where("chunk_id < 9000"), asked.where("query_id < 2000"), 10))
        assert share >= 0.95 and n == m == 300


def test_index_of_nothing_and_of_one(spark, tmp_path):
    chunks = spark.createDataFrame([(3, [1.0, 2.0])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    one = small_world.build(chunks, f"{tmp_path}/one")
    assert [(r["chunk_id"], r["rank"]) for r in small_world.search(one, chunks, asked)[0].collect()] == [(3, 1)]
    none = small_world.build(chunks.limit(0), f"{tmp_path}/none")
    assert small_world.search(none, chunks.limit(0), asked)[0].count() == 0


def test_diverse_links():
    """The second is nearer to the first than to the node, so the third, in another direction, comes first."""
    v = np.array([[0.98, 0.199], [0.955, 0.296], [0.6, -0.8]], np.float32)
    d = 1 - v @ np.array([1, 0], np.float32)
    assert small_world.diverse(np.array([4, 5, 6]), d, v, 2).tolist() == [0, 2]
    assert small_world.diverse(np.array([4, 5, 4]), d, v, 9).tolist() == [0, 1]
