"""Sketches by day against exact counts; a day added alone; files that come one after another."""

from pyspark.sql import functions as F

from sparkweft.operators import sketches


def calls(spark, n=6000):
    i = F.col("id")
    return spark.range(n).select(
        F.timestamp_seconds(1_700_000_000 + (i % 5) * 86_400).alias("at"), F.when(i % 10 < 3, "a").otherwise("b").alias("tenant"), (i % 7).alias("model"),
        F.when(i % 11 > 0, i % 900).alias("chunk"), F.lit(2).alias("tokens"))


def exact(df, *keys):
    return {tuple(r[k] for k in keys): (r["n"], r["chunks"], r["tokens"]) for r in df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("chunk").alias("chunks"), F.sum("tokens").alias("tokens")).collect()}


def near(got, want):
    assert set(got) == set(want)
    for k, (n, chunks, tokens) in want.items():
        assert got[k][0] == n and got[k][2] == tokens and abs(got[k][1] - chunks) <= max(1, sketches.error() * chunks)


def test_rolled_days(spark):
    df = calls(spark)
    days = sketches.by_day(df, "at", ["tenant", "model"], {"chunks": "chunk"}, {"tokens": "tokens"})
    old, new = (days.where(F.col("day") != "2023-11-15"), days.where(F.col("day") == "2023-11-15"))
    both = old.unionByName(new)  # a day added without reading the others
    rows = sketches.rolled(both, ["tenant", "model"], ["chunks"], ["tokens"], levels=True).collect()
    at = lambda level, *keys: {tuple(r[k] for k in keys): (r["n"], r["chunks"], r["tokens"]) for r in rows if r["level"] == level}
    near(at(2, "tenant", "model"), exact(df, "tenant", "model"))
    near(at(1, "tenant"), exact(df, "tenant"))
    near(at(0), exact(df))
    assert sketches.by_day(df.limit(0), "at", ["tenant"], {"chunks": "chunk"}).count() == 0
    odd = spark.createDataFrame([(None, "t", None)], "at timestamp, tenant string, chunk long")
    assert [(r["n"], r["chunks"]) for r in sketches.rolled(sketches.by_day(odd, "at", ["tenant"], {"chunks": "chunk"}), ["tenant"], ["chunks"]).collect()] == [(1, 0)]


def test_stream_of_files(spark, tmp_path):
    df = calls(spark, 3000)
    schema = "at timestamp, tenant string, model long, chunk long, tokens int"
    for part in range(2):
        df.where(F.col("chunk").isNull() | (F.col("chunk") % 2 == part) if part else F.col("chunk") % 2 == 0).write.mode("append").parquet(str(tmp_path / "in"))
        sketches.sketch_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check"), "at", ["tenant"], {"chunks": "chunk"}, {"tokens": "tokens"}).awaitTermination(120)
    kept = spark.read.parquet(str(tmp_path / "out"))
    near({(r["tenant"],): (r["n"], r["chunks"], r["tokens"]) for r in sketches.rolled(kept, ["tenant"], ["chunks"], ["tokens"]).collect()}, exact(df, "tenant"))
