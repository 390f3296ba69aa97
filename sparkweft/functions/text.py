"""Scalar text functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_count(text: Column) -> Column:
    """About four characters a token; at least one unless empty."""
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), F.floor(F.length(text) / 4))).otherwise(0).cast("long")


def embedding_text(path: Column, content: Column) -> Column:
    return F.when(F.size(path) > 0, F.concat(F.lit("Section: "), F.array_join(path, " > "), F.lit("\n\n"), content)).otherwise(content)


def render(template: Column, text: Column) -> Column:
    return F.replace(template, F.lit("{input}"), text)


def input_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by ``|``; nulls are empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def junk_ratio(text: Column) -> Column:
    """Share of unmapped glyphs ``(cid:n)``, replacement and control characters."""
    plain = F.regexp_replace(text, r"\(cid:\d+\)", "")
    clean = F.regexp_replace(plain, "[\x00-\x08\x0b\x0c\x0e-\x1f�]", "")
    return F.when(F.length(text) > 0, (F.length(text) - F.length(clean)) / F.length(text)).otherwise(0.0)


def difficulty(s: dict[str, Column], max_junk: float = 0.05, min_lines: int = 8, picture: float = 0.15, min_chars: int = 200, max_images: int = 2) -> Column:
    """easy, medium or hard from a page's signals; the first rule that holds decides."""
    blank = (s["text_chars"] == 0) & (s["image_count"] == 0) & (s["ruled_lines"] == 0)
    hard = (s["junk_ratio"] > max_junk) | (s["table_count"] > 0) | (s["ruled_lines"] >= min_lines) | (s["image_ratio"] >= picture)
    hard = hard | ((s["text_chars"] < min_chars) & ((s["image_count"] > 0) | (s["text_chars"] == 0))) | (s["image_count"] > max_images)
    return F.when(blank, "easy").when(hard, "hard").when(s["image_count"] > 0, "medium").otherwise("easy")


def route(level: Column) -> Column:
    return F.when(level == "easy", "text").when(level == "medium", "vision").otherwise("layout")


def safe_filename(name: Column) -> Column:
    """The base name with other characters than letters, digits, ``._-`` replaced."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/\\]*)$", 1)
    clean = F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(clean == "", "upload.bin").otherwise(F.substring(clean, 1, 200))


def label(raw: Column) -> Column:
    """UPPER_SNAKE of a camel-case or free label, 48 characters at most."""
    split = F.regexp_replace(F.coalesce(raw, F.lit("")), r"([a-z0-9])([A-Z])", "$1_$2")
    joined = F.regexp_replace(F.regexp_replace(split, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    return F.substring(F.upper(joined), 1, 48)


def acronym(key: Column) -> Column:
    """Initials of a snake key of two words or more, without of, and, the, for; else null."""
    words = F.filter(F.split(key, "_"), lambda w: (w != "") & ~w.isin("of", "and", "the", "for"))
    return F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def confidence(value: Column) -> Column:
    """0 to 1; over 1 counts as percent; what is no number is null."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(x > 1, x / 100).otherwise(x))))


def page_number(value: Column) -> Column:
    n = value.try_cast("int")
    return F.when(n > 0, n)


def snake(key: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(key), r"[^A-Za-z0-9]+", "_")), r"^_+|_+$", "")


def clean_reply(text: Column) -> Column:
    """A model's reply without think blocks and code fences."""
    no_think = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(no_think, r"(?im)^\s*```[a-z]*\s*$", ""))


def json_object(text: Column) -> Column:
    """The outermost braces of a reply as text, or null."""
    found = F.regexp_extract(clean_reply(text), r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def page_label(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), None).when(start == F.coalesce(end, start), F.concat(F.lit("page "), start)).otherwise(F.concat(F.lit("pages "), start, F.lit("-"), end))


def entity_uuid(tenant: Column, kind: Column, key: Column) -> Column:
    """The name-based (version 5) UUID of ``KIND:key`` in the tenant's namespace."""
    h = F.sha1(F.concat(F.unhex(F.regexp_replace(tenant, "-", "")), F.encode(F.concat_ws(":", kind, key), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def decoded(content: Column) -> Column:
    """Bytes to text: UTF-16 by its mark, else UTF-8 without mark, else Latin-1."""
    mark = F.hex(F.substring(content, 1, 3))
    utf8 = F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")
    return F.when(mark.startswith("FFFE") | mark.startswith("FEFF"), F.decode(content, "UTF-16")).when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(F.decode(content, "ISO-8859-1"))


def detected_format(mime: Column, filename: Column) -> Column:
    """text, pdf, docx, pptx, xlsx, image or null (not supported, old office formats included).

    The extension decides for all but listed and image/text MIME types.
    """
    ext = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"(\.[^./\\]+)$", 1))
    kind = F.lower(F.trim(F.split(F.coalesce(mime, F.lit("")), ";")[0]))
    # fixed values: MIME types and extensions by format
    by_mime = {
        "application/pdf": "pdf", "application/json": "text", "application/xml": "text", "application/csv": "text",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
        "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx"}
    by_ext = {
        "pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "xlsm": "xlsx"}
    by_ext |= dict.fromkeys("txt md markdown csv tsv json xml html htm log".split(), "text")
    by_ext |= dict.fromkeys("png jpg jpeg webp gif bmp tif tiff".split(), "image")
    listed = lambda table, at: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), at)
    prefix = F.when(kind.startswith("image/"), "image").when(kind.startswith("text/"), "text")
    return F.when(~ext.isin(".doc", ".ppt", ".xls"), F.coalesce(listed(by_mime, kind), listed(by_ext, F.substring(ext, 2, 20)), prefix))
