"""The object store: round trips, changes, refusals, and writes that fail half-way."""

import glob
import time

import pytest
from pyspark.sql import functions as F

from sparkweft.sources import store


@pytest.fixture
def at(spark, tmp_path):
    spark.dataSource.register(store.ObjectStore)
    return lambda: {r["key"]: bytes(r["content"]) for r in spark.read.format("sparkweft_store").option("path", str(tmp_path)).option("buckets", 4).load().collect()}, lambda rows, mode="append": put(spark, tmp_path, rows, mode)


def put(spark, path, rows, mode):
    df = rows if hasattr(rows, "write") else spark.createDataFrame(rows, "key string, content binary").repartition(3)
    df.write.format("sparkweft_store").option("path", str(path)).option("buckets", 4).mode(mode).save()


def test_put_replace_delete_overwrite(at):
    get, put = at
    assert get() == {}
    put([(f"a/b{k}.txt", bytes([k]) * k) for k in range(30)])
    assert get() == {f"a/b{k}.txt": bytes([k]) * k for k in range(30)}
    put([("a/b1.txt", b"new"), ("a/b2.txt", None), ("ünï/cödé", b""), ("missing", None)])
    now = get()
    assert now["a/b1.txt"] == b"new" and "a/b2.txt" not in now and now["ünï/cödé"] == b"" and len(now) == 30
    put([("only", b"x")], "overwrite")
    assert get() == {"only": b"x"}


def test_what_is_refused_leaves_nothing(spark, at, tmp_path):
    get, put = at
    put([("fine", b"1")])
    for key in ("../out", "/etc/passwd", "a//b", "a/./b", "", None, "a\\b", "nul\0"):
        with pytest.raises(Exception, match="no key of a store"):
            put([(f"x{k}", b"y") for k in range(20)] + [(key, b"z")])
    with pytest.raises(Exception, match="more than"):
        put(spark.range(1).select(F.lit("big").alias("key"), F.lit(b"x" * 1024).alias("c")).select("key", F.expr("cast(repeat(cast(c as string), 60000) as binary)").alias("content")))
    with pytest.raises(Exception):
        put(spark.range(60).repartition(4).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") == 59, F.raise_error(F.lit("stop"))).otherwise(F.lit("c")).cast("binary").alias("content")))
    assert get() == {"fine": b"1"}
    store.vacuum(str(tmp_path), older_s=3600)
    assert get() == {"fine": b"1"}
    time.sleep(1)  # tasks that were killed have ended
    store.vacuum(str(tmp_path), older_s=0)
    assert get() == {"fine": b"1"} and len(glob.glob(f"{tmp_path}/b*/*.pack")) == 1


def test_damaged_bytes_are_noticed(spark, at, tmp_path):
    get, put = at
    put([("k", b"some bytes")])
    name = glob.glob(f"{tmp_path}/b*/*.pack")[0]
    with open(name, "wb") as f:
        f.write(b"other byte")
    with pytest.raises(Exception, match="damaged"):
        get()
