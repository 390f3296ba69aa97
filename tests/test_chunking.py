import random

from sparkweft.chunking import blocks, units

RECORD = "# Staff Record\n## Profile\nName: Dana Roe\nCity: Pune\n\n## Job\nEmployer: Northwind"


def readings(spark, *texts):
    return spark.createDataFrame([(1, k, k, t) for k, t in enumerate(texts, 1)], "doc int, reading int, page int, text string")


def parsed(spark, *texts):
    return units.with_paths(units.units_of(readings(spark, *texts))).orderBy("unit")


def test_record(spark):
    u = parsed(spark, RECORD)
    assert [(r["kind"], r["level"]) for r in u.collect()] == [("heading", 1), ("heading", 2), ("key_value", None), ("heading", 2), ("key_value", None)]
    b = blocks.blocks_of(u).collect()
    assert len(b) == 1 and b[0]["path"] == ["Staff Record", "Profile"] and b[0]["units"] == [2, 3, 4, 5, 1]
    c = blocks.chunks_of(blocks.blocks_of(u)).collect()
    assert len(c) == 1 and c[0]["content_type"] == "key_value" and c[0]["embedding_text"].startswith("Section: Staff Record > Profile") and c[0]["token_count"] == 25


def test_structure(spark):
    assert parsed(spark, "## 2. Scope\n## Notes").collect()[-1]["path"] == ["2. Scope", "Notes"]
    u = parsed(spark, "1.1 Terms").collect()[0]
    assert (u["kind"], u["level"], u["content"]) == ("heading", 2, "Terms")
    assert parsed(spark, "2024 was a good year").collect()[0]["content"] == "was a good year"
    assert blocks.blocks_of(parsed(spark, "# A\n## B")).count() == 1
    assert [r["kind"] for r in parsed(spark, "| a | b |\nplain").collect()] == ["text"]
    assert parsed(spark, "").count() == 0
    b = blocks.blocks_of(parsed(spark, "# T\none", "two")).collect()
    assert len(b) == 1 and (b[0]["page_start"], b[0]["page_end"]) == (1, 2)


def test_lists_figures_and_tables(spark):
    text = "- a\n\n- b\n  more\n\n\nafter\n[Figure: x]\n| h | i |\n|---|---|\n| 1 | 2 |"
    assert [(r["kind"], r["content"]) for r in parsed(spark, text).collect()] == [
        ("list", "- a\n- b\n  more"), ("text", "after"), ("figure", "[Figure: x]"), ("table", "| h | i |\n|---|---|\n| 1 | 2 |")]
    latex = "a \\& b\n\\begin{tabular}{ll}\nx & y \\\\ \\hline\n1 & 2 \\\\\n\\end{tabular}\nz"
    got = [(r["kind"], r["content"]) for r in parsed(spark, latex).collect()]
    assert got[0] == ("text", "a & b") and got[1][0] == "table" and got[1][1].startswith("| x | y |\n| --- | --- |") and got[-1] == ("text", "z")


def test_large_blocks_split(spark):
    rows = "\n".join(f"| row {k} | {'v' * 40} |" for k in range(100))
    chunks = blocks.chunks_of(blocks.blocks_of(parsed(spark, f"## Big\n| a | b |\n|---|---|\n{rows}"))).orderBy("chunk_index").collect()
    assert len(chunks) > 1 and all(c["content"].startswith("| a | b |\n|---|---|") and c["token_count"] <= 500 for c in chunks)
    text = "\n\n".join("word " * 60 for _ in range(30))
    chunks = blocks.chunks_of(blocks.blocks_of(parsed(spark, f"# T\n{text}"))).collect()
    assert sum(len(c["content"].split()) for c in chunks) == 1800
    assert sorted(c["chunk_index"] for c in chunks) == list(range(len(chunks)))


def strict(content, kind="mixed", prefix=0, target=50, soft=60, hard=120):
    got = blocks.split_block(content, kind, prefix, target, soft, hard, strict=True)
    assert all(len(c) <= 4 * hard + 3 - prefix for c, _ in got), [len(c) for c, _ in got]
    return [c for c, _ in got]


def test_strict_sizes():
    rng = random.Random(4)
    sentence = " ".join(f"w{k}" for k in range(6000))
    assert " ".join(strict(sentence)) == sentence and len(blocks.split_block(sentence, "mixed", 0, 50, 60, 120)) == 1
    assert "".join(strict("x" * 5000)) == "x" * 5000
    rows = [f"| {k} | {'long cell ' * (200 if k == 3 else 2)}|" for k in range(20)]
    table = strict("\n".join(["| a | b |", "|---|---|", *rows]), "table")
    assert all(c.startswith("| a | b |\n|---|---|\n") for c in table) and sum(c.count("cell") for c in table) == 19 * 2 + 200
    for kind in ("figure", "key_value"):
        text = "[Figure: " + "very " * 400 + "]\n" + "Name: " + "value " * 300
        assert [w for c in strict(text, kind) for w in c.split()] == text.split()
    for _ in range(60):
        text = "".join(rng.choice(["a", "bb ", "ccc. ", "dd! ", "\n", "\n\n", "e" * 300]) for _ in range(rng.randrange(0, 300)))
        assert "".join(w for c in strict(text, prefix=rng.randrange(0, 100)) for w in c.split()) == "".join(text.split())


def plain_packed(parts, sep, room, split=None):
    held = []
    for part in parts:
        if held and len(sep.join([*held, part])) > room:
            yield sep.join(held)
            held, pieces = [], split(part) if split else None
            if pieces is not None:
                yield from pieces
                continue
        held.append(part)
    if held:
        yield sep.join(held)


def test_packing_is_that_of_a_plain_scan():
    rng = random.Random(5)
    halves = lambda x: [x[:9], x[9:]] if len(x) > 9 else None
    for _ in range(400):
        parts = ["y" * rng.randrange(0, 15) for _ in range(rng.randrange(0, 12))]
        for split in (None, halves):
            assert list(blocks.packed(parts, ", ", 12, split)) == list(plain_packed(parts, ", ", 12, split))


def test_strict_chunks_with_a_long_path(spark):
    text = f"# {'title ' * 300}\n## {'more ' * 10}\n" + "word " * 3000
    made = blocks.blocks_of(parsed(spark, text))
    got = blocks.chunks_of(made, 50, 60, 120, strict=True).collect()
    assert max(r["token_count"] for r in got) <= 120 and sum(r["content"].count("word") for r in got) == 3000
    assert all(r["embedding_text"].startswith("Section: ") and len(r["path"][0]) > 1000 for r in got)
    assert max(r["token_count"] for r in blocks.chunks_of(made, 50, 60, 120).collect()) > 120
