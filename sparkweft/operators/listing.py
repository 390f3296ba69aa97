"""Lists and reads of the catalogue, runs and strategies, in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import latest


def named(rows: DataFrame, *parents: tuple[DataFrame, str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``<key>_name`` of each parent (frame with id and name, key); rows without a parent go,
    except for the optional ones."""
    for df, key in parents:
        names = df.select(F.col("id").alias(f"{key}_id"), F.col("name").alias(f"{key}_name"))
        rows = rows.join(names, f"{key}_id", "left" if key in optional else "inner")
    return rows


def newest_first(rows: DataFrame, time: str = "created_at") -> DataFrame:
    """Newest rows first, ties by id; a list has no limit."""
    return rows.orderBy(F.col(time).desc_nulls_last(), "id")


def folders_first(folders: DataFrame, files: DataFrame) -> DataFrame:
    """kind, id, name of folders, then of files, each by name."""
    both = folders.select(F.lit("folder").alias("kind"), "id", "name").unionByName(files.select(F.lit("file").alias("kind"), "id", "name"))
    return both.orderBy((F.col("kind") == "file").cast("int"), "name", "id")


def folder_paths(subjects: DataFrame) -> DataFrame:
    """id, path: the names from the root to each folder. A level is a join; a cycle's folders, which
    no root reaches, aren't listed."""
    from ..scratch import Scratch

    scratch, depth = Scratch(subjects.sparkSession, "paths"), 0
    level = scratch.save(subjects.where("parent_subject_id is null").select("id", F.array("name").alias("path")), "level0")
    found = level
    while not level.isEmpty():
        depth += 1
        up = level.select(F.col("id").alias("parent_subject_id"), F.col("path").alias("above"))
        level = scratch.save(subjects.join(up, "parent_subject_id").select("id", F.array_append("above", F.col("name")).alias("path")), f"level{depth}")
        found = found.unionByName(level)
    return found


def latest_readable(runs: DataFrame, by: str = "source_id") -> DataFrame:
    """Each source's latest run that completed, in whole or in part."""
    return latest(runs.where(F.col("status").isin("completed", "partial")), by, "version")


def one_version(runs: DataFrame, usage: DataFrame, version: int | None = None) -> DataFrame:
    """A version of each source's runs, or the latest, with its calls and tokens (0 without)."""
    chosen = latest(runs, "source_id", "version") if version is None else runs.where(F.col("version") == version)
    spent = usage.groupBy(F.col("extraction_id").alias("id")).agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("calls", "prompt_tokens", "completion_tokens")}
    return chosen.join(spent, "id", "left").withColumns(zero)


def running(runs: DataFrame) -> DataFrame:
    """Sources that have a run going: another one would be in conflict."""
    return runs.where("status = 'processing'").groupBy("source_id").agg(F.count("*").alias("running"))


def run_totals(usage: DataFrame, by: str = "extraction_id") -> DataFrame:
    """Tokens and cost of each run, the cost to six places."""
    return usage.groupBy(by).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.coalesce(F.round(F.sum("cost_usd"), 6), F.lit(0.0)).alias("cost_usd"))


def strategy_reads(strategies: DataFrame, models: DataFrame) -> DataFrame:
    """Strategies with their model's columns beside their own, the oldest first."""
    own = models.select(F.col("id").alias("model_id"), *[F.col(c).alias(f"model_{c}") for c in models.columns if c != "id"])
    return strategies.join(own, "model_id").orderBy("created_at", "id")


def active_strategy(strategies: DataFrame) -> DataFrame:
    """The oldest active strategy, as a frame of one row or none."""
    rest = F.struct(*[F.col(c) for c in strategies.columns])
    return strategies.where("is_active").agg(F.min_by(rest, F.struct("created_at", "id")).alias("s")).where("s is not null").select("s.*")


def chunk_list(chunks: DataFrame, source_id, active_only: bool = True) -> DataFrame:
    own = chunks.where(F.col("source_id") == source_id)
    return (own.where("is_active") if active_only else own).orderBy(F.desc("version"), "chunk_index")


def chunk_versions(chunks: DataFrame, made: DataFrame) -> DataFrame:
    """The chunk table after a run: ``made`` (source_id, extraction_id, version, chunk_index, ...)
    takes the place of its extraction's rows, and other versions of its sources aren't active."""
    runs = made.select("source_id", "extraction_id").distinct()
    kept = chunks.join(runs, ["source_id", "extraction_id"], "left_anti")
    touched = runs.select("source_id").distinct().withColumn("_new", F.lit(True))
    kept = kept.join(touched, "source_id", "left").withColumn("is_active", F.col("is_active") & F.col("_new").isNull()).drop("_new")
    return kept.unionByName(made.withColumn("is_active", F.lit(True)).select(*kept.columns))


def live_candidates(embeddings: DataFrame, chunks: DataFrame, strategy_id) -> DataFrame:
    """Completed vectors of a strategy with their active chunks."""
    done = embeddings.where((F.col("embedding_status") == "completed") & (F.col("strategy_id") == strategy_id))
    return done.join(chunks.where("is_active"), "chunk_id")


def has_stored_content(uri: Column, prefix: str = "local://") -> Column:
    return F.coalesce(uri.startswith(prefix), F.lit(False))


def with_filenames(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(sources.select(F.col("id").alias("source_id"), "filename"), "source_id", "left")


def share_of_total(rows: DataFrame, value: str, out: str = "share_pct") -> DataFrame:
    """Each row's share of all in whole percent; null where the total is 0."""
    total = rows.agg(F.sum(value).alias("_total"))
    return rows.join(F.broadcast(total)).withColumn(out, F.when(F.col("_total") != 0, F.round(100.0 * F.col(value) / F.col("_total")).cast("long"))).drop("_total")


# checks of input: null where a value is fine, else what is wrong

#: fixed values: greatest lengths of texts
LONGEST = {"query": 4000, "graph_query": 1000, "instructions": 2000, "text": 1_000_000}


def wrong_text(value: Column, kind: str) -> Column:
    most = LONGEST[kind]
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", f"{kind} is empty").when(F.length(value) > most, f"{kind} is longer than {most}")


def wrong_slug(value: Column) -> Column:
    return F.when(~F.coalesce(value.rlike(r"\A[a-z0-9]+(-[a-z0-9]+)*\z"), F.lit(False)), "slug must be lower-case words joined by hyphens")


def email(value: Column) -> Column:
    """A trimmed lower-case address, or null if it is none."""
    plain = F.lower(F.trim(value))
    return F.when(plain.rlike(r"\A[^@\s]+@[^@\s]+\.[^@\s]+\z"), plain)
