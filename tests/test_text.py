from pyspark.sql import functions as F

from sparkweft.functions import text as tx
from sparkweft.functions import vectors as vx
from sparkweft.operators import graph


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_tokens_and_embedding_text(spark):
    assert one(spark, tx.token_count(F.lit("")), tx.token_count(F.lit("ab")), tx.token_count(F.lit("a" * 101))) == (0, 1, 25)
    assert one(spark, tx.embedding_text(F.array(F.lit("A"), F.lit("B")), F.lit("x")), tx.embedding_text(F.array().cast("array<string>"), F.lit("x"))) == ("Section: A > B\n\nx", "x")


def test_junk_and_triage(spark):
    assert one(spark, tx.junk_ratio(F.lit("(cid:12)ab")), tx.junk_ratio(F.lit("a\x01\n"))) == (0.8, 1 / 3)
    base = {"text_chars": 1500, "image_count": 0, "image_ratio": 0.0, "table_count": 0, "ruled_lines": 0, "junk_ratio": 0.0}
    level = lambda **over: one(spark, tx.difficulty({k: F.lit(v) for k, v in (base | over).items()}))[0]
    assert level() == "easy" and level(image_count=1, image_ratio=0.05) == "medium" and level(image_count=1, image_ratio=0.4) == "hard"
    assert [level(table_count=1), level(ruled_lines=12), level(junk_ratio=0.3), level(text_chars=0, image_count=1, image_ratio=0.1), level(image_count=5, image_ratio=0.1)] == ["hard"] * 5
    assert level(text_chars=0) == "easy"


def test_names():
    cases = [("The Zenith Pvt. Ltd.", "COMPANY", "zenith"), ("N.A.S.A.", "ORGANIZATION", "nasa"), ("R&D Group", "COMPANY", "r_and_d_group"), ("Prof. Lin  Wei", "PERSON", "lin_wei"), ("Ltd", "COMPANY", "ltd"), (None, None, "")]
    assert [graph.name_key(n, k) for n, k, _ in cases] == [key for *_, key in cases]
    assert graph.indel_ratio("abc", "abc") == 100 and round(graph.indel_ratio("north", "nort"), 3) == round(100 * 8 / 9, 3)


def test_labels_acronyms_and_ids(spark):
    import uuid

    tenant = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    got = one(spark, tx.label(F.lit("worksFor ")), tx.acronym(F.lit("north_atlantic_treaty")), tx.acronym(F.lit("one")), tx.entity_uuid(F.lit(tenant), F.lit("COMPANY"), F.lit("zenith")))
    assert got == ("WORKS_FOR", "nat", None, str(uuid.uuid5(uuid.UUID(tenant), "COMPANY:zenith")))


def test_normalisers(spark):
    c = lambda v: one(spark, tx.confidence(F.lit(v)))[0]
    assert [c("92"), c("0.5"), c("-1"), c("no")] == [0.92, 0.5, 0.0, None]
    assert one(spark, tx.page_number(F.lit("3")), tx.page_number(F.lit("0")), tx.snake(F.lit(" Due Date! "))) == (3, None, "due_date")
    assert one(spark, tx.json_object(F.lit("<think>x</think>Sure:\n```json\n{\"a\": 1}\n```")))[0] == '{"a": 1}'


def test_formats(spark):
    f = lambda m, n: one(spark, tx.detected_format(F.lit(m).cast("string"), F.lit(n).cast("string")))[0]
    assert [f("application/pdf", None), f(None, "a.DOCX"), f("image/heic", "x"), f("text/html; charset=x", ""), f("application/pdf", "a.doc"), f(None, None)] == ["pdf", "docx", "image", "text", None, None]
    d = lambda b: one(spark, tx.decoded(F.lit(bytearray(b))))[0]
    assert [d("é".encode()), d("é".encode("latin-1")), d("é".encode("utf-16"))] == ["é", "é", "é"]


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, vx.cosine(v(1, 0), v(1, 0)), vx.cosine(v(0, 0), v(1, 0))) == (1.0, 0.0)
    assert one(spark, vx.l2_normalized(v(3, 4)), vx.l2_normalized(v(0, 0)), vx.parsed(vx.literal(v(1, 2)))) == ([0.6, 0.8], [0.0, 0.0], [1.0, 2.0])
