"""Readings to document units: lines are classified, then runs of lines become units.

Everything is line-level columns and windows over a document's lines, so documents of any number
spread over tasks and only one document's lines meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: LaTeX escapes and what they stand for, longest first
ESCAPES = ((r"\(", "("), (r"\)", ")"), (r"\&", "&"), (r"\%", "%"), (r"\$", "$"), (r"\#", "#"), (r"\_", "_"), (r"\cdot", "·"), (r"\ldots", "…"), (r"\dots", "…"))
# fixed values: patterns of the elements
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
ROW, RULE = r"^\|.*\|\s*$", r"^\|[\s:|-]+\|\s*$"
ITEM = r"^\s*([-*•◦▪‣]|\d+\.)\s+"
FIELD = r"^([A-Za-z][A-Za-z0-9 _/'-]{0,29}):\s*(.+)$"
FIGURE, CAPTION = r"(?i)^\[(Figure|Image)[^\]]*\]", r"(?i)^(Figure|Fig\.?)\s*\d+\b"
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+(.+)$"
TABULAR, END_TABULAR = r"^\s*\\begin\{tabular\}", r"^\s*\\end\{tabular\}"
RULES = (r"\hline", r"\toprule", r"\midrule", r"\bottomrule")


def unescaped(line: Column) -> Column:
    """Without LaTeX escapes and dashes; a table's rule stays, or its dashes would end the table."""
    out = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ESCAPES, line)
    dashed = F.regexp_replace(F.regexp_replace(out, r"(?<!\w)---(?!\w)", "—"), r"(?<!\w)--(?!\w)", "–")
    return F.when(F.trim(line).rlike(RULE), line).otherwise(dashed)


def _tabular_rows(lines: Column) -> Column:
    """The lines of a LaTeX table as those of a Markdown table."""
    bare = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & ~x.isin(*RULES) & ~x.rlike(TABULAR) & ~x.rlike(END_TABULAR))
    pieces = F.filter(F.flatten(F.transform(bare, lambda x: F.split(x, r"\\\\"))), lambda x: ~F.trim(x).isin(*RULES))
    cells = F.transform(pieces, lambda p: F.filter(F.transform(F.split(p, "&"), lambda c: F.trim(c)), lambda c: c != ""))
    rows = F.filter(cells, lambda r: F.size(r) > 0)
    width = F.array_max(F.transform(rows, F.size))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    head = F.transform(padded[0], lambda c, i: F.when(c == "", F.concat(F.lit("col"), i + 1)).otherwise(c))
    text = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    made = F.concat(F.array(text(head), text(F.array_repeat(F.lit("---"), width))), F.transform(F.slice(padded, 2, F.size(padded)), text))
    return F.when(F.size(rows) > 0, made).otherwise(F.array().cast("array<string>"))


def lines_of(readings: DataFrame) -> DataFrame:
    """doc, pos, page, line of readings (doc, reading, page, text), LaTeX tables rewritten."""
    split = lambda df: df.select("doc", "reading", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n")).alias("nth", "line"))
    latex = F.col("text").rlike("(?m)" + TABULAR)
    # a document without tables has nothing to rewrite; a table may end in a later reading
    with_tables = readings.where(F.coalesce(latex, F.lit(False))).select("doc").distinct()
    plain = split(readings.join(with_tables, "doc", "left_anti")).withColumn("sub", F.lit(0))
    raw = split(readings.join(with_tables, "doc", "left_semi"))
    order = W.partitionBy("doc").orderBy("reading", "nth")
    at = F.struct("reading", "nth")
    starts = F.col("line").rlike(TABULAR)
    # a table lasts from a begin to the first end after it, or to the document's end
    marked = raw.withColumn("ended", F.max(F.when(F.col("line").rlike(END_TABULAR), at)).over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("opened", F.max(F.when(starts, at)).over(order))
    inside = F.col("opened").isNotNull() & (F.col("ended").isNull() | (F.col("opened") > F.col("ended")))
    outside = marked.where(~inside).select("doc", "reading", "nth", F.lit(0).alias("sub"), "page", "line")
    tables = marked.where(inside).groupBy("doc", "ended").agg(
        F.min(at).alias("at"), F.max("page").alias("page"), F.transform(F.sort_array(F.collect_list(F.struct("reading", "nth", "line"))), lambda x: x["line"]).alias("lines"))
    tables = tables.select("doc", "at.*", "page", F.posexplode(_tabular_rows(F.col("lines"))).alias("sub", "line")).select("doc", "reading", "nth", "sub", "page", "line")
    text = plain.select(*outside.columns).unionByName(outside).withColumn("line", unescaped(F.col("line")))
    both = text.unionByName(tables)
    return both.select("doc", F.row_number().over(W.partitionBy("doc").orderBy("reading", "nth", "sub")).alias("pos"), "page", "line")


def units_of(readings: DataFrame) -> DataFrame:
    """doc, unit, kind, content, page, level: the document's elements in order.

    Kinds: heading, figure, table, list, key_value, text. A row of pipes without a rule under it
    is text. Lists and fields may have one blank line between their lines.
    """
    by = W.partitionBy("doc").orderBy("pos")
    t = F.trim("line")
    lines = lines_of(readings).withColumn("t", F.regexp_replace("line", r"^\s+|\s+$", ""))
    t = F.col("t")
    kind = (F.when(t == "", "blank").when(t.rlike(HEADING), "heading").when(t.rlike(FIGURE) | (t.rlike(CAPTION) & (F.length(t) < 200)), "figure")
            .when(t.rlike(ROW), "row").when(t.rlike(ITEM), "list").when(t.rlike(FIELD), "key_value").otherwise("text"))
    lines = lines.withColumn("kind", kind)
    # indented lines right under a list go on with it
    indented = F.col("line").startswith("  ") & ~F.col("kind").isin("blank", "list")
    lines = lines.withColumn("own", F.when(~indented, F.col("kind"))).withColumn("host", F.last("own", ignorenulls=True).over(by))
    lines = lines.withColumn("kind", F.when(indented & (F.col("host") == "list"), "list").otherwise(F.col("kind")))
    # a table starts at a row with a rule under it and takes the rows that follow
    lines = lines.withColumn("ruled", (F.col("kind") == "row") & F.coalesce(F.lead("t").over(by).rlike(RULE), F.lit(False)))
    lines = lines.withColumn("run", F.sum(F.when((F.col("kind") == "row") & (F.lag("kind", 1, "").over(by) == "row"), 0).otherwise(1)).over(by))
    begun = F.max(F.col("ruled").cast("int")).over(W.partitionBy("doc", "run").orderBy("pos"))
    lines = lines.withColumn("kind", F.when((F.col("kind") == "row") & (begun == 1), "table").when(F.col("kind") == "row", "text").otherwise(F.col("kind")))
    # pages carry forward; blanks only count
    lines = lines.withColumn("page", F.last("page", ignorenulls=True).over(by)).withColumn("blanks", F.sum((F.col("kind") == "blank").cast("int")).over(by))
    full = lines.where("kind != 'blank'")
    gap = F.col("blanks") - F.lag("blanks", 1, 0).over(by)
    allowed = F.when(F.col("kind").isin("list", "key_value"), 1).otherwise(0)
    same = (F.lag("kind").over(by) == F.col("kind")) & F.col("kind").isin("table", "list", "key_value", "text") & (gap <= allowed)
    full = full.withColumn("unit", F.sum(F.when(same, 0).otherwise(1)).over(by))
    rows = F.sort_array(F.collect_list(F.struct("pos", "t", "line")))
    grouped = full.groupBy("doc", "unit").agg(F.first("kind").alias("kind"), F.max_by("page", "pos").alias("page"), rows.alias("rows"))
    text = lambda field, sep: F.array_join(F.transform("rows", lambda r: r[field]), sep)
    first = F.col("rows")[0]["t"]
    content = (F.when(F.col("kind") == "heading", F.regexp_extract(first, HEADING, 2)).when(F.col("kind") == "list", F.regexp_replace(text("line", "\n"), r"^\s+|\s+$", ""))
               .when(F.col("kind") == "text", text("t", " ")).otherwise(text("t", "\n")))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(first, HEADING, 1)))
    return _promoted(grouped.select("doc", "unit", "kind", content.alias("content"), "page", level.alias("level")))


def _promoted(units: DataFrame) -> DataFrame:
    """Numbered lines become headings: dotted numbers, or a short line alone."""
    first = F.split("content", "\n")[0]
    number = F.regexp_extract(first, NUMBERED, 1)
    heads = F.col("kind").isin("text", "list") & (number != "") & (F.length(first) < 100) & (number.contains(".") | ~F.col("content").contains("\n"))
    return units.select(
        "doc", "unit", F.when(heads, "heading").otherwise(F.col("kind")).alias("kind"), F.when(heads, F.trim(F.regexp_extract(first, NUMBERED, 2))).otherwise(F.col("content")).alias("content"),
        "page", F.when(heads, F.size(F.split(number, r"\."))).otherwise(F.col("level")).alias("level"))


def with_paths(units: DataFrame) -> DataFrame:
    """Adds path, the titles of the headings that a unit stands under.

    A document's headings are folded in order over a stack: a heading drops those of its level
    or deeper; one without a number stays under a numbered one. Other units take the path of the
    last heading before them.
    """
    heads = units.where("kind = 'heading'").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("unit", "level", "content"))).alias("heads"))
    entry = "struct<level:int,title:string>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("stack"), F.array().cast("array<struct<unit:bigint,path:array<string>>>").alias("done"))

    def step(state: Column, h: Column) -> Column:
        top = F.try_element_at(state["stack"], F.lit(-1))
        demoted = top.isNotNull() & ~h["content"].rlike(NUMBERED) & F.coalesce(top["title"].rlike(NUMBERED), F.lit(False))
        level = F.when(demoted, top["level"] + 1).otherwise(h["level"]).cast("int")
        stack = F.concat(F.filter(state["stack"], lambda x: x["level"] < level), F.array(F.struct(level.alias("level"), h["content"].alias("title"))))
        path = F.transform(stack, lambda x: x["title"])
        return F.struct(stack.alias("stack"), F.concat(state["done"], F.array(F.struct(h["unit"].cast("bigint").alias("unit"), path.alias("path")))).alias("done"))

    made = heads.select("doc", F.explode(F.aggregate("heads", start, step, lambda s: s["done"])).alias("h")).select("doc", "h.unit", "h.path")
    joined = units.join(made, ["doc", "unit"], "left")
    carried = F.last("path", ignorenulls=True).over(W.partitionBy("doc").orderBy("unit"))
    return joined.withColumn("path", F.coalesce(carried, F.array().cast("array<string>")))
