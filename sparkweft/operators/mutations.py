"""Changes of the catalogue as new frames: rows in, rows out; what is refused comes back as rows.

A change reads whole tables and returns whole tables, so the caller writes a partition or a table
anew; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .listing import wrong_slug
from .scope import Scope


class NotFound(LookupError):
    """What a caller doesn't own looks to them as if it weren't there."""


def owned(rows: DataFrame, row_id, scope: Scope) -> DataFrame:
    """The row of an id within the caller's scope."""
    mine = scope.apply(rows.where(F.col("id") == row_id))
    if mine.isEmpty():
        raise NotFound(f"{row_id} not found")
    return mine


def owned_tenants(tenants: DataFrame, user_id) -> DataFrame:
    return tenants.where(F.col("user_owner_id") == user_id).select("id")


def created(rows: DataFrame, new: DataFrame, unique: tuple[str, ...], slug: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The table with ``new`` rows appended, and those refused with a reason: a slug that isn't
    one, a key that is taken, or the later of two new rows of one key (by id)."""
    key = list(unique)
    checked = new.withColumn("reason", wrong_slug(F.col(slug)) if slug else F.lit(None).cast("string"))
    taken = rows.select(*key).distinct().withColumn("_taken", F.lit(True))
    first = checked.where("reason is null").groupBy(*key).agg(F.min("id").alias("_first"))
    checked = checked.join(taken, key, "left").join(first, key, "left")
    clash = F.coalesce("_taken", F.lit(False)) | (F.col("id") != F.col("_first"))
    checked = checked.withColumn("reason", F.coalesce("reason", F.when(clash, F.concat_ws(" ", F.lit("already exists:"), *key)))).select(*new.columns, "reason")
    return rows.unionByName(checked.where("reason is null").drop("reason"), allowMissingColumns=True), checked.where("reason is not null")


def updated(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the values that ``changes`` gives for their key; a null leaves a value as it is."""
    cols = [c for c in changes.columns if c != key]
    given = changes.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return rows.join(given, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).select(*rows.columns)


def below(subjects: DataFrame, roots: DataFrame) -> DataFrame:
    """root, id: every subject of each root's subtree, the root included; ``roots`` has id.

    A level is a join for all roots at once; it ends on a cycle too.
    """
    from ..scratch import Scratch

    scratch, k = Scratch(subjects.sparkSession, "below"), 0
    edges = subjects.where("parent_subject_id is not null").select(F.col("parent_subject_id").alias("id"), F.col("id").alias("child"))
    level = scratch.save(roots.select(F.col("id").alias("root"), "id").distinct(), "level0")
    found = level
    while not level.isEmpty():
        k += 1
        step = level.join(edges, "id").select("root", F.col("child").alias("id")).distinct().join(found, ["root", "id"], "left_anti")
        level = scratch.save(step, f"level{k}")
        found = found.unionByName(level)
    return found


def moved(subjects: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subjects with new parents (``moves``: id, to; a null ``to`` makes a root), and the moves
    refused: to itself or into its own subtree, to an unknown parent, to another application.
    Moves are judged each on the tree as it is."""
    own = subjects.select("id", F.col("application_id").alias("_app"))
    to = subjects.select(F.col("id").alias("to"), F.col("application_id").alias("_to_app"))
    inside = below(subjects, moves.select("id")).select(F.col("root").alias("id"), F.col("id").alias("to"), F.lit(True).alias("_inside"))
    judged = moves.join(own, "id").join(to, "to", "left").join(inside, ["id", "to"], "left")
    reason = F.when(F.col("to").isNull(), None).when(F.col("id") == F.col("to"), "its own parent").when(F.coalesce("_inside", F.lit(False)), "inside its own subtree").when(
        F.col("_to_app").isNull(), "no such parent").when(F.col("_app") != F.col("_to_app"), "another application")
    judged = judged.select("id", "to", reason.alias("reason"))
    done = judged.where("reason is null").select("id", F.col("to").alias("_to"), F.lit(True).alias("_moved"))
    parent = F.when(F.col("_moved"), F.col("_to")).otherwise(F.col("parent_subject_id"))
    return subjects.join(done, "id", "left").withColumn("parent_subject_id", parent).select(*subjects.columns), judged.where("reason is not null")


def without_subjects(subjects: DataFrame, sources: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Subjects and sources that are left when subtrees go, and the sources that go with them,
    whose bytes and facts are to be removed afterwards."""
    gone = below(subjects, roots).select("id").distinct()
    lost = sources.join(gone.select(F.col("id").alias("subject_id")), "subject_id", "left_semi")
    return subjects.join(gone, "id", "left_anti"), sources.join(gone.select(F.col("id").alias("subject_id")), "subject_id", "left_anti"), lost


def cascaded(gone: DataFrame, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """What is left of each child table (frame, its foreign key) when parents (``gone``: id) go; each
    table's lost rows are the parents of the next."""
    out = []
    for child, foreign in children:
        parents = gone.select(F.col("id").alias(foreign))
        out.append(child.join(parents, foreign, "left_anti").select(*child.columns))
        gone = child.join(parents, foreign, "left_semi")
    return out


def held_by(parents: DataFrame, child: DataFrame, foreign: str) -> DataFrame:
    """Parents that may not go, as rows of ``child`` name them."""
    return parents.join(child.where(F.col(foreign).isNotNull()).select(F.col(foreign).alias("id")).distinct(), "id", "left_semi")


def forgotten(child: DataFrame, foreign: str, gone: DataFrame) -> DataFrame:
    """``child`` with a null where its parent is gone."""
    marks = gone.select(F.col("id").alias(foreign), F.lit(True).alias("_gone"))
    return child.join(marks, foreign, "left").withColumn(foreign, F.when(F.col("_gone").isNull(), F.col(foreign))).select(*child.columns)


# sources

def registered(subjects: DataFrame, new: DataFrame) -> DataFrame:
    """Sources from metadata alone: owners come from the subject; the status is pending."""
    owners = subjects.select(F.col("id").alias("subject_id"), "tenant_id", "application_id")
    return new.join(owners, "subject_id").withColumn("status", F.lit("pending"))


def text_filename(title: Column, kind: Column, markdown: Column, at: Column) -> Column:
    """The name of a source made of text: its title with the format's ending, else a stamp in UTC."""
    ending = F.when(markdown, ".md").otherwise(".txt")
    stamp = F.date_format(at, "yyyyMMdd-HHmmss")
    untitled = F.concat(F.when(kind == "chat", "chat").otherwise("note"), F.lit("-"), stamp, ending)
    return F.when(title.isNull(), untitled).when(F.lower(title).endswith(ending), title).otherwise(F.concat(title, ending))


def registered_texts(subjects: DataFrame, new: DataFrame) -> DataFrame:
    """Sources from texts (subject_id, type, title, text, format, at): name, MIME type, bytes."""
    markdown = F.col("format") == "markdown"
    own = new.withColumns({
        "filename": text_filename(F.col("title"), F.col("type"), markdown, F.col("at")), "mime_type": F.concat(F.when(markdown, "text/markdown").otherwise("text/plain"), F.lit("; charset=utf-8")),
        "size_bytes": F.octet_length("text").cast("long")})
    return registered(subjects, own)


def source_states(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources with the status that their latest run gives them: a run that goes on is processing,
    one that completed (in part, too) completed; a source without runs is pending."""
    from .catalog import latest

    state = F.when(F.col("run") == "processing", "processing").when(F.col("run").isin("completed", "partial"), "completed").when(F.col("run") == "failed", "failed").otherwise("pending")
    last = latest(runs.select("source_id", "version", F.col("status").alias("run")), "source_id", "version").select(F.col("source_id").alias("id"), "run")
    return sources.join(last, "id", "left").withColumn("status", state).drop("run").select(*sources.columns)


# runs and builds

def interrupted(runs: DataFrame, what: str) -> DataFrame:
    """Runs that a stopped process left going are failed."""
    going = F.col("status") == "processing"
    return runs.withColumns({"error": F.when(going, F.lit(f"Interrupted: the server restarted during this {what}")).otherwise(F.col("error")), "status": F.when(going, "failed").otherwise(F.col("status"))})


def outcome(parts: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """status, processed, failures of runs from their parts (``by``, index, ok): failed where no
    part is well, partial where some aren't. ``limit`` is the most parts that a run may have."""
    own = parts if limit is None else parts.where(F.col("index") < limit)
    counts = own.groupBy(by).agg(F.count_if("ok").alias("processed"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failures"))
    return counts.withColumn("status", F.when(F.col("processed") == 0, "failed").when(F.col("failures") > 0, "partial").otherwise("completed"))


def new_builds(extractions: DataFrame, settings: dict[str, int], scope: Scope, retried: DataFrame | None = None) -> DataFrame:
    """Build rows for extractions: going on, with the settings' sizes; a retry (``retried``: the
    builds that are retried) has those of the build that it retries."""
    rows = extractions.select("source_id", F.col("id").alias("extraction_id"), F.col("version").alias("extraction_version"))
    sizes = {k: F.lit(v) for k, v in settings.items()}
    if retried is None:
        rows = rows.withColumns({"retry_of_id": F.lit(None).cast("long")} | sizes)
    else:
        old = retried.select("extraction_id", F.col("id").alias("retry_of_id"), *[F.col(k).alias(f"_{k}") for k in settings])
        rows = rows.join(old, "extraction_id", "left").withColumns({k: F.coalesce(f"_{k}", v) for k, v in sizes.items()}).drop(*[f"_{k}" for k in settings])
    return rows.withColumns({"status": F.lit("processing")} | scope.triggered_by())


def failed_parts(parts: DataFrame, builds: DataFrame) -> DataFrame:
    """The parts that a retry does again: those of partial or failed builds that weren't well."""
    again = builds.where(F.col("status").isin("partial", "failed")).select(F.col("id").alias("build_id"))
    return parts.where(~F.coalesce("ok", F.lit(False))).join(again, "build_id", "left_semi")
