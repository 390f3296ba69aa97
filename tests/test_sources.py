import io
import zipfile

from pyspark.sql import functions as F

from sparkweft.operators import extraction, readings
from sparkweft.sources import files

ONTOLOGY = """{"entity_types": {"COMPANY": "", "PERSON": "", "TECHNOLOGY": "", "LOCATION": "", "CONCEPT": ""}, "entity_type_synonyms": {"CORPORATION": "COMPANY"}, "fallback_entity_type": "CONCEPT",
"relation_types": {"OWNS": "", "USES": "", "PROVIDES_TO": "", "LOCATED_IN": "", "RELATED_TO": ""}, "relation_synonyms": {"LIVES_IN": "LOCATED_IN"}, "inverse_relations": {"OWNED_BY": "OWNS"}, "fallback_relation": "RELATED_TO"}"""


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "b.docx").write_bytes(archive(word__document_xml='<d><body><p><pPr><pStyle val="Heading2"/></pPr><r><t>Title</t></r></p><p><r><t>Text</t></r></p><tbl><tr><tc><p><t>x|y</t></p></tc><tc><p><t>z</t></p></tc></tr></tbl></body></d>'))
    (tmp_path / "c.xlsx").write_bytes(archive(xl__workbook_xml='<w><sheet name="S"/></w>', xl__sharedStrings_xml="<s><si><t>head</t></si></s>", xl__worksheets__sheet1_xml='<w><row><c t="s"><v>0</v></c><c><v>7</v></c></row></w>'))
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.docx").write_bytes(b"no archive")
    got = {r["doc"].rpartition("/")[2]: (r["text"], r["status"]) for r in files.readings(files.stored(spark, str(tmp_path))).collect()}
    assert got["a.txt"] == ("é", "completed")
    assert got["b.docx"][0] == "## Title\n\nText\n\n| x\\|y | z |\n| --- | --- |"
    assert got["c.xlsx"][0] == "## Sheet: S\n\n| head | 7 |\n| --- | --- |"
    assert got["d.pdf"] == (None, "failed") and got["e.docx"] == (None, "failed")


def test_answers(spark):
    answer = '{"document_type": "invoice", "fields": [{"key": "Due Date!", "value": 12, "confidence": 92, "page": 1}, {"key": "", "value": "x"}, 5], "tables": [{"rows": []}, {"columns": ["a"]}]}'
    r = readings.validated(spark.createDataFrame([(1, answer), (2, "nonsense")], "id int, answer string")).orderBy("id").collect()
    result = r[0]["result"]
    assert [(f["key"], f["value"], f["page"], f["confidence"]) for f in result["fields"]] == [("due_date", "12", 1, 0.92)]
    assert result["document_type"] == "invoice" and len(result["tables"]) == 1


def test_merge_and_tables(spark):
    rows = [(1, 2, "page", 2, "hard", "layout", "b", "failed"), (1, 1, "page", 1, "easy", "text", "a", "completed")]
    r = readings.merged_readings(spark.createDataFrame(rows, "doc int, reading int, kind string, page int, difficulty string, route string, text string, status string")).first()
    assert r["content"] == "<!-- page 1 · easy · text -->\na\n\n<!-- page 2 · hard · layout -->\nb" and r["status"] == "partial"
    t = spark.range(1).select(readings.markdown_table(F.array(F.array(F.lit("a|b"), F.lit("c\nd")), F.array(F.lit("")), F.array(F.lit("1")))).alias("t")).first()["t"]
    assert t == "| a\\|b | c d |\n| --- | --- |\n| 1 |  |"


def test_text_units():
    content = "<!-- page 1 · easy · text -->\n" + "\n\n".join(f"paragraph {k} " + "w" * 90 for k in range(12)) + "\n<!-- page 2 · easy · text -->\n" + "long " * 200
    units = extraction.text_units(content, 300, 60)
    assert all(len(u["text"]) <= 300 for u in units) and units[0]["page_start"] == 1 and units[-1]["page_end"] == 2
    assert {w for w in content.split() if w[0] in "pw"} - {"page"} <= {w for u in units for w in u["text"].split()}
    assert extraction.text_units("") == []


def test_resolution(spark):
    tenant = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    units = [
        (0, '{"entities": [{"name": "Orion", "type": "company"}, {"name": "Vela Corporation", "type": "COMPANY"}], "relationships": [{"source": "Orion", "relation": "PROVIDES_TO", "target": "Vela Corporation", "confidence": 90}]}'),
        (1, '{"entities": [{"name": "Vela Corp.", "type": "CORPORATION"}, {"name": "Lumen", "type": "TECHNOLOGY"}, {"name": " "}], "relationships": [{"source": "Vela Corp.", "relation": "uses", "target": "Lumen"}]}'),
        (2, '{"entities": [{"name": "Lumen", "type": "TECHNOLOGY"}, {"name": "Vela", "type": "COMPANY"}], "relationships": [{"source": "Lumen", "relation": "ownedBy", "target": "Vela"}, {"source": "Vela", "relation": "USES", "target": "vela"}]}'),
        (3, '{"entities": [{"name": "Ira", "type": "PERSON"}, {"name": "Oslo", "type": "LOCATION"}], "relationships": [{"source": "Ira", "relation": "LIVES_IN", "target": "Oslo"}]}')]
    df = spark.createDataFrame([(tenant, f"u{k}", f"s{k}", k, a) for k, a in units], "tenant_id string, id string, source_id string, index int, answer string")
    entities, mentions, facts = extraction.resolved(extraction.extractions(df), files.ontology(ONTOLOGY))
    names = {r["entity_id"]: r["display_name"] for r in entities.collect()}
    assert sorted(names.values()) == ["Ira", "Lumen", "Orion", "Oslo", "Vela Corporation"]
    got = {(names[r["a"]], r["relation"], names[r["b"]], r["raw_relation"]) for r in facts.collect()}
    assert got == {("Orion", "PROVIDES_TO", "Vela Corporation", None), ("Vela Corporation", "USES", "Lumen", None), ("Vela Corporation", "OWNS", "Lumen", "OWNED_BY"), ("Ira", "LOCATED_IN", "Oslo", "LIVES_IN")}
    assert mentions.count() == 8


def test_slides_with_tables_and_notes_and_sheets_by_relation():
    import io
    import zipfile

    def packed(parts):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, text in parts.items():
                z.writestr(name, text)
        return zipfile.ZipFile(data)

    p = lambda t: f"<p><r><t>{t}</t></r></p>"
    table = "<tbl>" + "".join("<tr>" + "".join(f"<tc><txBody>{p(c)}</txBody></tc>" for c in row) + "</tr>" for row in (["a", "b"], ["1", "2"])) + "</tbl>"
    deck = packed({
        "ppt/slides/slide1.xml": f"<sld>{p('Title')}<frame>{table}</frame>{p('after')}</sld>", "ppt/slides/slide2.xml": f"<sld>{p('Second')}</sld>",
        "ppt/slides/_rels/slide1.xml.rels": '<R><Relationship Id="r1" Target="../notesSlides/notesSlide7.xml"/></R>', "ppt/notesSlides/notesSlide7.xml": f"<n>{p('say this')}{p('and that')}</n>"})
    assert files.slides(deck) == [("slide", "Title\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\nafter\n\nNotes: say this\nand that"), ("slide", "Second")]
    sheet = lambda v: f"<w><row><c><v>{v}</v></c></row></w>"
    book = packed({
        "xl/workbook.xml": '<w xmlns:r="x"><sheet name="First" r:id="b"/><sheet name="Other" r:id="a"/><sheet name="Gone" r:id="z"/></w>', "xl/worksheets/sheet1.xml": sheet(1), "xl/worksheets/sheet2.xml": sheet(2),
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></R>'})
    assert [t.split("\n\n") for _, t in files.sheets(book)] == [["## Sheet: First", "| 2 |\n| --- |"], ["## Sheet: Other", "| 1 |\n| --- |"]]
