"""Trees as intervals against plain walks: deep, wide, broken and moved ones."""

import random

import pytest
from pyspark.sql import functions as F

from sparkweft.operators import catalog, intervals
from sparkweft.plans import registry
from sparkweft.scratch import Scratch

TREE = "id long, parent_subject_id long"


def plain_below(parent, root):
    kids = {}
    for i, p in parent.items():
        kids.setdefault(p, []).append(i)
    out, left = {root: 0}, [root]
    while left:
        at = left.pop()
        for k in kids.get(at, []):
            if k not in out:
                out[k] = out[at] + 1
                left.append(k)
    return out


def forest(rng, n, roots=3):
    parent = {}
    for i in range(n):
        parent[i * 3 + 1] = None if i < roots else rng.choice(list(parent))
    return parent


def checked(numbers, parent):
    """Intervals are nested as the tree is, and numbers are 0 to n - 1."""
    rows = {r["id"]: r for r in numbers.collect()}
    assert sorted(r["first"] for r in rows.values()) == list(range(len(rows)))
    at = {r["first"]: i for i, r in rows.items()}
    for i, r in rows.items():
        below = plain_below(parent, i)
        assert {at[k] for k in range(r["first"], r["last"] + 1)} == set(below)
        assert r["parent"] == parent[i] and all(rows[k]["depth"] == r["depth"] + d for k, d in below.items())
        assert (r["depth"] == 0) == (parent[i] is None)
    return rows


def test_forest_and_moves(spark):
    rng = random.Random(6)
    parent = forest(rng, 90)
    df = spark.createDataFrame(list(parent.items()), TREE).repartition(5)
    numbers = intervals.numbered(df)
    checked(numbers, parent)
    for i in (1, 10, 100, 12345):
        want = plain_below(parent, i) if i in parent else {}
        assert {r["id"]: r["depth"] for r in intervals.subtree(numbers, i).collect()} == want == {r["id"]: r["depth"] for r in catalog.subtree(df, i).collect()}
        up = {a: plain_below(parent, a)[i] for a in parent if i in parent and a != i and i in plain_below(parent, a)}
        assert {r["id"]: r["depth"] for r in intervals.ancestors(numbers, i).collect()} == up == {r["id"]: r["depth"] for r in catalog.ancestors(df, i).collect()}
    got = {(r["root"], r["id"]) for r in intervals.below(numbers, df.where("id % 2 = 1")).collect()}
    assert got == {(i, k) for i in parent if i % 2 for k in plain_below(parent, i)}
    moves = [(rng.choice(list(parent)), rng.choice(list(parent))) for _ in range(40)]
    bad = {(i, t) for i, t in moves if t in plain_below(parent, i)}
    assert {tuple(r) for r in intervals.refused(numbers, spark.createDataFrame(moves, "id long, to long")).collect()} == bad
    done = 0
    for i, t in [*moves, (moves[0][0], None), (1, None)]:
        if t is not None and t in plain_below(parent, i):
            with pytest.raises(ValueError):
                intervals.moved(numbers, i, t)
            continue
        if done < 8 or t is None:
            parent[i] = t
            rows = [tuple(r) for r in intervals.moved(numbers, i, t).collect()]
            numbers = spark.createDataFrame(rows, numbers.schema)
            checked(numbers, parent)
            done += 1


def test_broken_trees(spark):
    rows = [(1, None), (2, 1), (3, 99), (4, 5), (5, 6), (6, 4), (7, 6), (8, 8), (9, 3)]
    df = spark.createDataFrame(rows, TREE)
    numbers = intervals.numbered(df)
    assert {(r["id"], r["first"], r["last"], r["depth"]) for r in numbers.collect()} == {(1, 0, 1, 0), (2, 1, 1, 1), (3, 2, 3, 0), (9, 3, 3, 1)}
    assert {r["id"] for r in intervals.unreachable(df, numbers).collect()} == {4, 5, 6, 7, 8}
    assert {r["id"] for r in catalog.subtree(df, 4).collect()} == {4, 5, 6, 7}
    assert intervals.numbered(df.limit(0)).count() == 0


def test_deep_and_wide(spark):
    deep = spark.range(10_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_subject_id"))
    numbers = intervals.numbered(deep)
    assert numbers.where("first != id or last != 9999 or depth != id").count() == 0 and numbers.count() == 10_000
    assert intervals.ancestors(numbers, 9_000).count() == 9_000 and intervals.subtree(numbers, 9_000).count() == 1000
    star = spark.range(100_001).select("id", F.when(F.col("id") > 0, F.lit(0)).cast("long").alias("parent_subject_id"))
    numbers = intervals.numbered(star)
    assert numbers.where("first != id or depth != int(id > 0) or last != if(id = 0, 100000, id)").count() == 0 and numbers.count() == 100_001


def test_no_table_that_grows_goes_through_the_driver(spark, monkeypatch):
    """A tree's files are small for their rows; no join of what grows with it is a broadcast."""
    plans, save = [], Scratch.save
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(Scratch, "save", lambda self, df, *more: plans.append(plan(df)) or save(self, df, *more))
    tree = spark.range(3000).select("id", F.when(F.col("id") > 0, (F.col("id") - 1) / 4).cast("long").alias("parent_subject_id"))
    numbers = intervals.numbered(tree)
    pairs = intervals.below(numbers, numbers)
    assert pairs.count() == numbers.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0]
    plans += [plan(pairs), plan(intervals.refused(numbers, numbers.select("id", F.lit(0).cast("long").alias("to")))), plan(registry.Bound(spark, "/root/testdata/sf0.001").subjects)]
    assert len(plans) > 10 and not [p for p in plans if "_part" not in p and "BroadcastHashJoin" in p]
