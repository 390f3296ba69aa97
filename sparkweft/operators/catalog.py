"""Ownership catalogue: counts, lists, trees and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_counts(parents: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """Adds a count for each child table (frame, its foreign key), zeros kept.

    Children are counted before the join, so no join multiplies rows.
    """
    for name, (child, foreign) in children.items():
        counts = child.where(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
        parents = parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return parents


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def daily_counts(df: DataFrame, time: str, first_day: str, days: int) -> DataFrame:
    """day, n for every day from ``first_day`` on, zeros filled in."""
    spark = df.sparkSession
    start = F.lit(first_day).cast("date")
    calendar = spark.range(days).select(F.date_add(start, F.col("id").cast("int")).alias("day"))
    inside = df.where((F.col(time) >= start.cast("timestamp")) & (F.col(time) < F.date_add(start, days).cast("timestamp")))
    counts = inside.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def period_delta(df: DataFrame, time: str, start: str, days: int) -> DataFrame:
    """current, previous and delta_pct of two adjoining windows of equal length."""
    begin = F.lit(start).cast("date")
    inside = lambda a, b: (F.col(time) >= a.cast("timestamp")) & (F.col(time) < b.cast("timestamp"))
    both = df.agg(F.count_if(inside(begin, F.date_add(begin, days))).alias("current"), F.count_if(inside(F.date_sub(begin, days), begin)).alias("previous"))
    return both.withColumn("delta_pct", F.when(F.col("previous") > 0, F.round((F.col("current") - F.col("previous")) * 100.0 / F.col("previous"), 1)))


def storage_summary(sources: DataFrame) -> DataFrame:
    return sources.agg(
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"), F.coalesce(F.max("size_bytes"), F.lit(0)).alias("largest_bytes"),
        F.max("created_at").alias("newest"))


def totals(**frames: DataFrame) -> DataFrame:
    """One row with the number of rows of each frame."""
    counts = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in frames])


def source_detail(sources: DataFrame, tenants: DataFrame, applications: DataFrame, subjects: DataFrame, actors: DataFrame) -> DataFrame:
    """Sources with the names of their owners; the actor may be absent."""
    named = lambda df, key: df.select(F.col("id").alias(f"{key}_id"), F.col("name").alias(f"{key}_name"))
    out = sources
    for df, key in ((tenants, "tenant"), (applications, "application"), (subjects, "subject")):
        out = out.join(named(df, key), f"{key}_id")
    return out.join(named(actors, "actor"), "actor_id", "left")


def ancestors(subjects: DataFrame, subject_id) -> DataFrame:
    """id, depth of the folders above a subject, nearest first (depth 1)."""
    return _walk(subjects, subject_id, up=True).where("depth > 0")


def subtree(subjects: DataFrame, subject_id) -> DataFrame:
    """id, depth of a subject (0) and of all below it."""
    return _walk(subjects, subject_id, up=False)


def _walk(subjects: DataFrame, subject_id, up: bool) -> DataFrame:
    """A level at a time, each a written table: a frontier joins the tree once for each level it has.
    On a cycle it ends where it would come back. Deep trees are better numbered once (``intervals``)."""
    from ..scratch import Scratch

    scratch, depth = Scratch(subjects.sparkSession, "walk"), 0
    edges = subjects.where("parent_subject_id is not null").select(F.col("id" if up else "parent_subject_id").alias("id"), F.col("parent_subject_id" if up else "id").alias("to"))
    level = found = scratch.save(subjects.where(F.col("id") == subject_id).select("id", F.lit(0).alias("depth")), "level0")
    while not level.isEmpty():
        depth += 1
        step = level.select("id").join(edges, "id").select(F.col("to").alias("id")).distinct().join(found, "id", "left_anti")
        level = scratch.save(step.select("id", F.lit(depth).alias("depth")), f"level{depth}")
        found = found.unionByName(level)
    return found


def latest(df: DataFrame, by: str, version: str, *order: Column) -> DataFrame:
    """The row of the greatest version of each key (ties by the other columns given)."""
    rest = [c for c in df.columns if c != by]
    best = df.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(version, *order)).alias("_r"))
    return best.select(by, "_r.*")


def next_version(df: DataFrame, by: str, version: str) -> DataFrame:
    return df.groupBy(by).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))
