"""Per-page readings: merging into one text, and lenient validation of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import confidence, page_number, snake

def json_items(answer: Column, name: str) -> Column:
    """The items of a JSON answer's list as JSON texts; empty where there is no such list."""
    return F.coalesce(F.from_json(F.get_json_object(answer, f"$.{name}"), "array<string>"), F.array().cast("array<string>"))


def item_field(item: Column, name: str, kind: str = "string") -> Column:
    """A field of an item, null where the item has none or isn't an object."""
    text = F.get_json_object(item, f"$.{name}")
    return text if kind == "string" else F.coalesce(F.from_json(text, kind), F.array().cast(kind))


def merged_readings(readings: DataFrame) -> DataFrame:
    """doc, content, status: readings in order under ``<!-- kind n · difficulty · route -->``
    lines; failed if no reading has text, partial if one failed."""
    marker = F.concat(F.lit("<!-- "), "kind", F.lit(" "), "page", F.lit(" · "), "difficulty", F.lit(" · "), "route", F.lit(" -->\n"), F.coalesce("text", F.lit("")))
    parts = F.sort_array(F.collect_list(F.struct("reading", marker.alias("m"))))
    ok = F.count_if(F.col("status") == "completed")
    return readings.groupBy("doc").agg(F.array_join(F.transform(parts, lambda p: p["m"]), "\n\n").alias("content"), F.when(ok == 0, "failed").when(ok < F.count("*"), "partial").otherwise("completed").alias("status"))


def for_model(content: Column, most: int = 200_000) -> Column:
    """What the model sees of a long text; the stored text stays whole."""
    return F.substring(content, 1, most)


def blank_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", F.trim(x))


def validated(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Adds result: what is usable of a JSON answer, item by item.

    Fields need a key and a value, keys become snake case, confidences 0 to 1, pages positive;
    tables need columns or rows. What is no JSON object gives null.
    """
    answer = F.col(column)
    field = lambda name: blank_to_null(F.get_json_object(answer, f"$.{name}"))
    fields = F.transform(json_items(answer, "fields"), lambda x: F.struct(
        snake(item_field(x, "key")).alias("key"), blank_to_null(item_field(x, "value")).alias("value"), page_number(item_field(x, "page")).alias("page"), confidence(item_field(x, "confidence")).alias("confidence")))
    tables = F.transform(json_items(answer, "tables"), lambda x: F.struct(
        item_field(x, "title").alias("title"), page_number(item_field(x, "page")).alias("page"), item_field(x, "columns", "array<string>").alias("columns"), item_field(x, "rows", "array<array<string>>").alias("rows")))
    return answers.withColumn("result", F.when(F.get_json_object(answer, "$").startswith("{"), F.struct(
        F.coalesce(field("document_type"), F.lit("unknown")).alias("document_type"), field("title").alias("title"), field("language").alias("language"), F.coalesce(field("summary"), F.lit("")).alias("summary"),
        F.filter(fields, lambda x: (x["key"] != "") & x["value"].isNotNull()).alias("fields"), F.filter(tables, lambda t: (F.size(t["columns"]) > 0) | (F.size(t["rows"]) > 0)).alias("tables"))))


def markdown_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table: blank rows go, short ones are padded, pipes are
    escaped and line ends become spaces."""
    cell = lambda c: F.replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))
    clean = F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: cell(c))), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(clean, lambda r: F.size(r)))
    full = F.transform(clean, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(clean) > 0, F.array_join(F.concat(F.slice(full, 1, 1), F.array(rule), F.slice(full, 2, F.size(full))), "\n")).otherwise("")


def kept_images(images: DataFrame, most: int) -> DataFrame:
    """The first ``most`` images of each document by position; adds dropped, the rest's number."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("doc").orderBy("page", "position"))
    all_of = F.count("*").over(W.partitionBy("doc"))
    return images.withColumn("nth", nth).withColumn("dropped", F.greatest(all_of - most, F.lit(0))).where(F.col("nth") <= most).drop("nth")
