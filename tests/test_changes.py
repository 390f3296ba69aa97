"""The change feed against plain tables: deletes, moves, versions, replays."""

import random

from sparkweft.streaming import changes


def plain(rows, events):
    """Rows (source, version, subject, n) after the events of one batch."""
    gone = {s for _, k, s, _, _ in events if k == "deleted"}
    subject, version = {}, {}
    for _, k, s, to, v in sorted(e for e in events if e[2] is not None):
        if k == "moved":
            subject[s] = to
        if k == "version":
            version[s] = v
    return sorted((s, v, subject.get(s, sub), n) for s, v, sub, n in rows if s not in gone and (s not in version or v >= version[s]))


def test_feed(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(40), rng.randrange(3), rng.randrange(5), n) for n in range(300)]
    facts = spark.createDataFrame(rows, "source_id long, version long, subject_id long, n long")
    plainer = facts.select("source_id", "n")
    paths = {"facts": str(tmp_path / "facts"), "queue": str(tmp_path / "queue")}
    changes.lay_out(facts, paths["facts"], 8)
    changes.lay_out(plainer, paths["queue"], 8)
    want = sorted(rows)
    for batch in range(3):
        events = [(batch * 100 + k, rng.choice(["deleted", "moved", "version", "odd"]), rng.choice([None, *range(45)]), rng.randrange(5, 9), rng.randrange(3)) for k in range(12)]
        df = spark.createDataFrame(events, changes.CHANGES)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = changes.change_stream(spark, str(tmp_path / "in"), str(tmp_path / "check"), paths, 8)
        query.awaitTermination(200)
        assert query.exception() is None
        want = plain(want, events)
        get = lambda: sorted(tuple(r) for r in changes.current(spark, paths["facts"]).select("source_id", "version", "subject_id", "n").collect())
        assert get() == want
        changes.apply(spark, df, paths, 8)  # the epoch once more
        assert get() == want
    # no row is left of a source that is gone
    left = {r["source_id"] for r in changes.current(spark, paths["queue"]).collect()}
    assert {r[0] for r in want} <= left and changes.effects(spark.createDataFrame([], changes.CHANGES)).count() == 0


def test_a_table_may_become_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    changes.lay_out(spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "source_id long, n long"), path, 4)
    gone = lambda s: spark.createDataFrame([(1, "deleted", s, None, None)], changes.CHANGES)
    changes.apply(spark, gone(1), {"t": path}, 4)
    assert [tuple(r) for r in changes.current(spark, path).collect()] == [(2, 3)]
