"""Stored files as readings: text, Word, slides and sheets, with the standard library alone."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decoded, detected_format, safe_filename

SHEET_ROWS, SHEET_COLUMNS = 1000, 50


def stored(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length of the files under a path of any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", "length", "modificationTime")


def storage_key(tenant: Column, subject: Column, name: Column, unique: Column) -> Column:
    return F.concat_ws("/", tenant, subject, F.concat(F.regexp_replace(unique, "-", ""), F.lit("-"), safe_filename(name)))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")


def table_text(rows: list[list[str]]) -> str:
    rows = [[" ".join(c.split()).replace("|", "\\|") for c in r] for r in rows if any(c.strip() for c in r)]
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([*lines[:1], *(["| " + " | ".join(["---"] * width) + " |"] if lines else []), *lines[1:]])


def word(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    out = []
    for node in ElementTree.fromstring(archive.read("word/document.xml")).iter():
        kind = _local(node.tag)
        if kind == "body":
            for child in node:
                if _local(child.tag) == "p" and (text := _text(child)).strip():
                    style = next((v for x in child.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
                    level = re.search(r"(?i)heading\s*(\d+)", style)
                    out.append(("#" * min(6, int(level[1])) + " " if level else "") + text)
                elif _local(child.tag) == "tbl":
                    out.append(table_text([[_text(c) for c in row if _local(c.tag) == "tc"] for row in child if _local(row.tag) == "tr"]))
    return [("document", "\n\n".join(out))]


def _related(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """What a part's relations lead to, by their ids: names within the archive."""
    base, name = posixpath.split(part)
    rels = f"{base}/_rels/{name}.rels"
    if rels not in archive.namelist():
        return {}
    full = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"{base}/{t}")
    return {x.attrib["Id"]: full(x.attrib["Target"]) for x in ElementTree.fromstring(archive.read(rels)).iter() if _local(x.tag) == "Relationship" and "Id" in x.attrib}


def _shapes(node) -> Iterator[str]:
    """Paragraphs and tables under a node, in order; a table's paragraphs are its cells."""
    for child in node:
        kind = _local(child.tag)
        if kind == "tbl":
            yield table_text([[_text(c) for c in row if _local(c.tag) == "tc"] for row in child if _local(row.tag) == "tr"])
        elif kind == "p":
            yield _text(child)
        else:
            yield from _shapes(child)


def slides(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """A reading for each slide: its text and tables in order, then its notes."""
    names = sorted((n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    text = lambda n: [t for t in _shapes(ElementTree.fromstring(archive.read(n))) if t.strip()]
    notes = lambda n: [t for to in _related(archive, n).values() if "/notesSlides/" in to and to in archive.namelist() for t in text(to)]
    return [("slide", "\n\n".join([*text(n), *(["Notes: " + "\n".join(said)] if (said := notes(n)) else [])])) for n in names]


def sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """A reading for each sheet in the workbook's order; its relation says which file it is, and
    where there are no relations files come by number."""
    shared = [_text(x) for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")) if _local(x.tag) == "si"] if "xl/sharedStrings.xml" in archive.namelist() else []
    by_number = sorted((n for n in archive.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    related, listed = _related(archive, "xl/workbook.xml"), [x.attrib for x in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
    own = [next((related[v] for k, v in x.items() if _local(k) == "id" and v in related), None) for x in listed]
    names = [n or (by_number[k] if k < len(by_number) else None) for k, n in enumerate(own)]
    out = []
    for title, name in zip((x.get("name", "") for x in listed), names):
        if name not in archive.namelist():
            continue
        rows = []
        for row in ElementTree.fromstring(archive.read(name)).iter():
            if _local(row.tag) == "row" and len(rows) < SHEET_ROWS:
                cells = []
                for c in list(row)[:SHEET_COLUMNS]:
                    value = next((x.text or "" for x in c if _local(x.tag) == "v"), _text(c))
                    cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value.isdigit() else value)
                rows.append(cells)
        out.append(("sheet", f"## Sheet: {title}\n\n{table_text(rows)}"))
    return out


READERS = {"docx": word, "pptx": slides, "xlsx": sheets}


def readings(files: DataFrame, mime: Column | None = None) -> DataFrame:
    """doc (the path), reading, kind, page, text, status, error of files (path, content).

    Text decodes inside the engine; office archives are read a file at a time. A file that can't
    be read is a failed reading with its error; formats without a reader (PDF pages and images
    need models or libraries that aren't here) fail the same way.
    """
    known = files.withColumn("format", detected_format(mime if mime is not None else F.lit(None).cast("string"), F.col("path")))
    plain = known.where("format = 'text'").select(F.col("path").alias("doc"), F.lit(1).alias("reading"), F.lit("document").alias("kind"), F.lit(1).alias("page"), decoded(F.col("content")).alias("text"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, data, kind in pdf.itertuples(index=False):
                try:
                    if kind not in READERS:
                        raise ValueError(f"no reader for {kind or 'this file'}")
                    made = READERS[kind](zipfile.ZipFile(io.BytesIO(data)))
                    rows += [(path, k, what, k, text, "completed", None) for k, (what, text) in enumerate(made, 1)]
                except Exception as e:  # a damaged file is a failed reading, not a failed job
                    rows.append((path, 1, "document", 1, None, "failed", str(e)))
            yield pd.DataFrame(rows, columns=["doc", "reading", "kind", "page", "text", "status", "error"])

    rest = known.where("format is null or format != 'text'").select("path", "content", "format").mapInPandas(run, plain.schema)
    return plain.unionByName(rest)


def ontology(path_or_text: str) -> dict:
    """The tables of an ontology in JSON, checked: synonyms lead to types and relations it has."""
    data = json.loads(path_or_text) if path_or_text.lstrip().startswith("{") else json.load(open(path_or_text))
    out = {
        "types": list(data["entity_types"]), "type_synonyms": data.get("entity_type_synonyms", {}), "fallback_type": data["fallback_entity_type"], "relations": list(data["relation_types"]),
        "relation_synonyms": data.get("relation_synonyms", {}), "inverse_relations": data.get("inverse_relations", {}), "fallback_relation": data["fallback_relation"]}
    ends = [(out["type_synonyms"], out["types"]), (out["relation_synonyms"], out["relations"]), (out["inverse_relations"], out["relations"])]
    if any(v not in known for table, known in ends for v in table.values()) or out["fallback_type"] not in out["types"] or out["fallback_relation"] not in out["relations"]:
        raise ValueError("the ontology maps to something it lacks")
    return out
