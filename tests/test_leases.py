"""The queue as a stream: cut into batches, restarted and delivered twice it ends as the batch does."""

import random
from datetime import datetime, timedelta, timezone


from sparkweft.streaming import leases

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def event(chunk, kind, name, seconds, error=None):
    return (chunk, "s", kind, name, START + timedelta(seconds=seconds), error)


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.select("chunk_id", "input_hash", "embedding_status", "attempt_count", "lease", "error").collect())))


def test_life_of_a_row(spark):
    events = [
        event(1, "enqueued", "a", 0), event(1, "claimed", "a", 10), event(1, "done", "a", 20), event(1, "enqueued", "b", 30),
        event(2, "enqueued", "a", 0), event(2, "claimed", "a", 10), event(2, "claimed", "a", 1000), event(2, "failed", "a", 1010, "no"),
        event(3, "enqueued", "a", 0), event(3, "claimed", "a", 10), event(3, "done", "a", 2000), event(3, "done", "a", 2000),
        event(4, "enqueued", "a", 0), *[event(4, "claimed", "a", 10 + 700 * k) for k in range(3)],
        event(5, "enqueued", "a", 0), event(5, "gone", None, 5), event(5, "enqueued", "a", 4), (None, "s", "gone", None, START, None), event(6, "odd", "a", 1), event(7, "enqueued", None, 1)]
    df = spark.createDataFrame(events, leases.EVENTS)
    got = {(r["chunk_id"], r["input_hash"]): (r["embedding_status"], r["attempt_count"], r["error"]) for r in leases.replayed(df, int(START.timestamp() * 1000) + 10**8).collect()}
    assert got == {
        (1, "a"): ("stale", 1, None), (1, "b"): ("pending", 0, None), (2, "a"): ("failed", 2, "no"), (3, "a"): ("completed", 1, None), (4, "a"): ("failed", 3, "lease lost")}
    assert leases.replayed(df.limit(0)).count() == 0


def test_stream_ends_as_the_batch(spark, tmp_path):
    rng = random.Random(3)
    events = []
    for chunk in range(12):
        t = 0
        for _ in range(rng.randrange(1, 9)):
            t += rng.randrange(1, 500)
            events.append(event(chunk, rng.choice(["enqueued", "enqueued", "claimed", "claimed", "done", "failed", "retried", "gone"]), rng.choice("ab"), t, "e"))
    events.sort(key=lambda e: e[4])
    # a last event, of another key, brings the watermark past all leases
    events.append(event(99, "enqueued", "z", 10_000))
    source, third = str(tmp_path / "in"), len(events) // 3 + 1
    for k in range(3):
        part = events[k * third : (k + 1) * third]
        spark.createDataFrame(part + part[::2], leases.EVENTS).coalesce(1).write.mode("append").parquet(source)  # half of them twice
        query = leases.lease_stream(spark, source, str(tmp_path / "out"), str(tmp_path / "check"))  # a restart for each part
        query.awaitTermination(240)
        assert query.exception() is None
        if k == 0:
            spark.createDataFrame(part[:4], leases.EVENTS).coalesce(1).write.mode("append").parquet(source)  # and some once more, later
    changes = spark.read.parquet(str(tmp_path / "out"))
    whole = leases.replayed(spark.createDataFrame(events, leases.EVENTS), int((START + timedelta(seconds=10_000 - 3600)).timestamp() * 1000))
    assert rows_of(leases.queue_of(changes)) == rows_of(whole)
    again = leases.replayed(spark.createDataFrame(events * 2, leases.EVENTS), int((START + timedelta(seconds=10_000 - 3600)).timestamp() * 1000))
    assert rows_of(again) == rows_of(whole)
