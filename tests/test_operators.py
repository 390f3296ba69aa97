import datetime as dt

import numpy as np
import pyarrow as pa
import pytest

from sparkweft.operators import answers, catalog, embedding, graph, ledger, retrieval
from sparkweft.operators.scope import Scope


def test_tree(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "id int, parent_subject_id int")
    assert sorted(map(tuple, catalog.ancestors(rows, 4).collect())) == [(1, 3), (2, 2), (3, 1)]
    assert catalog.ancestors(rows, 1).count() == 0
    assert sorted(r["id"] for r in catalog.subtree(rows, 2).collect()) == [2, 3, 4]


def test_scope_without_tenants_sees_nothing(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2)], "tenant_id int, application_id int")
    assert Scope(tenants=()).apply(rows).count() == 0
    assert Scope(tenants=(2,)).apply(rows).count() == 1
    assert Scope(tenant_id=1, application_id=2).apply(rows).count() == 0


def test_prices(spark):
    d = dt.date
    rates = ledger.price_table(spark, [
        (d(2024, 1, 1), "m", 0.2, 0.6, 0.01, 0.005, False), (d(2024, 1, 1), "*", 1.0, 1.0, 0.0, 0.0, False), (d(2024, 1, 1), "f", 9.0, 9.0, 9.0, 9.0, True),
        (d(2024, 10, 1), "x", 1.0, 1.0, 0.0, 0.0, False)])
    calls = spark.createDataFrame([
        (1, "m", "vision", 2_000_000, 500_000, dt.datetime(2024, 9, 1)), (2, "f", "graph", 5, 5, dt.datetime(2024, 9, 1)), (3, "other", "graph", 1_000_000, 0, dt.datetime(2024, 9, 1)),
        (4, "m", "graph", 1, 1, dt.datetime(2023, 12, 1)), (5, "m", "graph", 1, 1, dt.datetime(2024, 10, 1))], "id int, model string, role string, prompt_tokens long, completion_tokens long, created_at timestamp")
    got = {r["id"]: r["cost"] for r in ledger.priced(calls, rates).withColumn("cost", ledger.call_cost()).collect()}
    assert got == {1: 0.715, 2: 0.0, 3: 1.0, 4: None, 5: None}
    with pytest.raises(ValueError):
        ledger.price_table(spark, [(d(2024, 1, 1), "m", -1.0, 0.0, 0.0, 0.0, False)])
    with pytest.raises(ValueError):
        ledger.price_table(spark, [(d(2024, 1, 1), "m", 1.0, 0.0, 0.0, 0.0, False)] * 2)


def naive_mmr(sim, vectors, k, weight):
    cos = lambda a, b: 0.0 if not (n := np.linalg.norm(a) * np.linalg.norm(b)) else float(a @ b / n)
    left, out = list(range(len(sim))), []
    while left and len(out) < k:
        best = max(left, key=lambda i: (round(weight * sim[i] - (1 - weight) * max([cos(vectors[i], vectors[j]) for j in out], default=0.0), 12), -i))
        out.append(best)
        left.remove(best)
    return out


def test_mmr_equals_its_naive_form():
    assert retrieval.mmr_order(np.array([0.95, 0.94, 0.6]), np.array([[1.0, 0], [1, 0], [0, 1]]), 2, 0.7) == [0, 2]
    rng = np.random.default_rng(3)
    for weight in (0.0, 0.5, 0.7, 1.0):
        v = rng.normal(size=(12, 5))
        v[4], v[7] = v[2], 0
        sim = rng.random(12)
        got = retrieval.mmr_order(sim, v, 6, weight)
        assert got == naive_mmr(sim, v, 6, weight) or weight == 0.0 and len(set(got)) == 6


def test_nearest_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, size=(400, 3)).astype(float)
    ids = rng.permutation(400)
    v[:40] = v[0]
    chunks = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "chunk_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids[:30], v)], "query_id long, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in retrieval.nearest_chunks(chunks, asked, 5, query_block=8).collect())
    want = []
    for q, x in zip(ids[:30], v):
        size = np.linalg.norm(v, axis=1) * np.linalg.norm(x)
        sim = np.divide(v @ x, size, out=np.zeros(400), where=size > 0)
        want += [(int(q), n + 1, int(ids[k])) for n, k in enumerate(np.lexsort((ids, -sim))[:5])]
    assert got == sorted(want)


def test_nearest_over_many_batches_is_made_once(spark):
    """Batches after the first, ties across them and a vector that isn't a number; answers compare
    questions with chunks once, however many steps read the outcome."""
    rng = np.random.default_rng(2)
    best, sim, ids = retrieval._Best(300, 7), np.round(rng.standard_normal((300, 900)), 1), rng.permutation(900)
    sim[:, 5] = np.nan
    for x in range(0, 900, 150):
        own = np.sort(ids[x : x + 150])
        at = x + np.argsort(ids[x : x + 150])
        for q in (0, 256):
            best.add(q, sim[q : q + 256][:, at], pa.array(own))
    rows = best.rows
    low = np.where(np.isnan(sim), -np.inf, sim)
    for q in range(300):
        assert rows[rows["at"] == q]["chunk_id"].tolist() == [int(ids[c]) for c in np.lexsort((ids, -low[q]))[:7]]

    s = embedding.Strategy("s", "m", dimension=4)
    embed, made = embedding.hashing_embedder(4), spark.sparkContext.accumulator(0)

    def counted(texts):
        made.add(len(texts))
        return embed(texts)

    asked = spark.createDataFrame([(n, f"word{n} and more") for n in range(9)], "query_id long, question string").coalesce(1)
    chunks = spark.createDataFrame([(n, n % 2, embed([f"word{n}"])[0].tolist(), f"word{n}", f"word{n}", ["p"], 1, 1) for n in range(12)], "chunk_id long, source_id long, embedding array<double>, content string, embedding_text string, path array<string>, page_start int, page_end int")
    out, evidence = answers.answered(asked, chunks, spark.createDataFrame([(0, "f"), (1, "g")], "id long, filename string"), s, counted)
    assert out.count() == 9 and evidence.count() == 45 and made.value == 9


def test_odd_vectors_take_no_part(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [0.0, 0.0]), (6, [])], "chunk_id int, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [])], "query_id int, vector array<double>")
    assert sorted((r["query_id"], r["chunk_id"], r["similarity"]) for r in retrieval.nearest_chunks(chunks, asked, 5).collect()) == [(1, 1, 1.0), (1, 5, 0.0)]
    assert retrieval.nearest_chunks(chunks, asked.where("false"), 5).count() == 0


def test_merged_facts_and_details_with_texts(spark):
    facts = spark.createDataFrame([("a", "R", "b", 2, 0.5, ["c3", "c1"], "later"), ("a", "R", "b", 1, None, ["c1"], "first"), ("a", "R", "b", 0, 0.2, [], " ")], "a string, relation string, b string, source_id int, confidence double, chunk_ids array<string>, description string")
    row = graph.merged_facts(facts).first()
    assert (row["source_ids"], row["confidence"], row["edges"], row["chunk_ids"], row["description"]) == ([0, 1, 2], 0.5, 3, ["c1", "c3"], "first")
    mentions = spark.createDataFrame([("e", "c1", 1, "x"), ("e", "c2", 1, "x"), ("e", "c3", 2, "y")], "entity_id string, chunk_id string, source_id int, description string")
    assert graph.entity_details(mentions).first()["descriptions"] == ["x", "y"]
    assert graph.entity_details(mentions, sources=mentions.where("source_id = 2").select("source_id")).first()["chunk_ids"] == ["c3"]


def test_diverse_picks_of_all_queries(spark):
    from sparkweft.plans import registry

    assert {r["query_id"] for r in registry.queries()["mmr_top10"](spark, "/root/testdata/sf0.001").collect()} == set(range(0, 500, 100))


def test_rerank_fills_missing_scores(spark):
    pool = spark.createDataFrame([(1, i) for i in range(4)], "query_id int, index int")
    scores = spark.createDataFrame([(1, 0, 1.5), (1, 2, -0.5)], "query_id int, index int, score double")
    got = sorted((r["rank"], r["index"], r["score"]) for r in retrieval.reranked(pool, scores).collect())
    assert got == [(1, 0, 1.5), (2, 2, -0.5), (3, 1, -1.5), (4, 3, -1.5)]


def test_queue(spark):
    s = embedding.Strategy("s", "m", dimension=2)
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id int, embedding_text string")
    have = embedding.hashed(chunks.where("chunk_id = 1"), s).first()["input_hash"]
    queue = spark.createDataFrame([(1, "s", have, "completed", 1), (2, "s", "old", "completed", 1), (2, "s", "bad", "failed", 1)], "chunk_id int, strategy_id string, input_hash string, embedding_status string, attempt_count int")
    got = sorted((r["chunk_id"], r["embedding_status"]) for r in embedding.enqueue(chunks, queue, s).collect())
    assert got == [(1, "completed"), (2, "failed"), (2, "pending"), (2, "stale")]
    again = embedding.enqueue(chunks, queue, s, force=True)
    assert again.where("chunk_id = 1").first()["embedding_status"] == "pending"
    swept = embedding.sweep(embedding.hashed(chunks, s), s, lambda texts: np.array([[1.0, 0, 0]] * len(texts))).collect()
    assert {r["embedding_status"] for r in swept} == {"failed"}


def test_graph(spark):
    facts = spark.createDataFrame([("o", "PROVIDES_TO", "v", 1, 0.9), ("v", "USES", "l", 2, 0.5), ("v", "USES", "l", 3, 0.8), ("i", "LOCATED_IN", "z", 4, None)], "a string, relation string, b string, source_id int, confidence double")
    seeds = spark.createDataFrame([("o",)], "entity string")
    assert sorted(map(tuple, graph.reached(facts, seeds, 2).collect())) == [("l", 2), ("o", 0), ("v", 1)]
    merged = {(r["a"], r["b"]): (r["source_ids"], r["confidence"]) for r in graph.merged_facts(facts).collect()}
    assert merged["v", "l"] == ([2, 3], 0.8)
    asked = spark.createDataFrame([(1, "o"), (2, "o"), (2, "i")], "question_id int, entity string")
    met, taken = graph.budgeted_search(facts, asked, hops=1)
    assert sorted((r["question_id"], r["entity"], r["hop"]) for r in met.collect()) == [(1, "o", 0), (1, "v", 1), (2, "i", 0), (2, "o", 0), (2, "v", 1), (2, "z", 1)] and taken.count() == 3
    met, taken = graph.budgeted_search(facts, asked.where("question_id = 1"), hops=2, max_entities=2)
    assert {r["entity"] for r in met.collect()} == {"o", "v"} and [r["b"] for r in taken.collect()] == ["v"]
    assert graph.budgeted_search(facts, asked.where("question_id = 1"), hops=3, max_facts=2)[1].count() == 2
    mentions = facts.selectExpr("a as entity_id", "source_id as chunk_id", "source_id").union(facts.selectExpr("b", "source_id", "source_id"))
    assert sorted(r[0] for r in graph.without_source(facts, mentions, 4)[2].collect()) == ["i", "z"]


def test_aliases(spark):
    names = spark.createDataFrame([(1, "COMPANY", "international_business_machines", 0), (1, "COMPANY", "ibm", 1), (1, "COMPANY", "microsoft", 2), (1, "COMPANY", "microsofft", 3), (1, "PERSON", "microsoft", 4)], "tenant_id int, entity_type string, key string, first int")
    got = {(r["entity_type"], r["key"]): r["to"] for r in graph.aliases_of(names).collect()}
    assert got == {("COMPANY", "ibm"): "international_business_machines", ("COMPANY", "microsofft"): "microsoft"}
    asked = spark.createDataFrame([(1, "Who owns the Vela Corp?"), (2, "and the of"), (3, None)], "question_id int, question string")
    assert {(r["question_id"], r["key"]) for r in graph.question_keys(asked).collect()} == {(1, k) for k in ("owns", "owns_the_vela", "owns_the_vela_corp", "vela", "vela_corp", "corp")}
    assert [r[0] for r in asked.select(graph.fulltext_query("question")).collect()] == ["owns|vela|corp", "", None]


@pytest.mark.parametrize("name,kind,key", [
    ("The Vela Corp.", "COMPANY", "vela"), ("Inc Ltd", "COMPANY", "inc"), ("A.B.C. & Co", "COMPANY", "abc_and"), ("Dr. Mr Smith", "PERSON", "smith"), ("Mr", "PERSON", "mr"), ("O'Neil_x _", None, "oneil_x"), (None, "PERSON", "")])
def test_name_keys(name, kind, key):
    assert graph.name_key(name, kind) == key


def test_aliases_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    keys = ["abcdefghijklm", "bcdefghijklmn"]
    for n in (8, 13, 15, 16, 17, 18, 26, 40):
        for _ in range(4):
            key = "".join(rng.choice(list("abcd"), n))
            keys.append(key)
            for _ in range(3):
                at = sorted(rng.choice(n, 2, replace=False))
                keys += [key[: at[0]] + key[at[0] + 1 :], key[: at[0]] + "x" + key[at[0] :], "y" + key[:-1], key[: at[0]] + key[at[0] + 1 : at[1]] + "z" + key[at[1] :]]
    keys = list(dict.fromkeys(keys))
    got = {r["key"]: r["to"] for r in graph.aliases_of(spark.createDataFrame([(1, "CONCEPT", k, n) for n, k in enumerate(keys)], "tenant_id int, entity_type string, key string, first long")).collect()}
    want = {}
    for n, key in enumerate(keys):
        best = max(((graph.indel_ratio(key, k), -m) for m, k in enumerate(keys[:n])), default=(0, 0))
        if best[0] >= 92:
            want[key] = keys[-best[1]]
    assert want["bcdefghijklmn"] == "abcdefghijklm" and got == want


def test_hub_is_read_once_for_all_questions(spark):
    """Questions that meet one hub, with facts that repeat under several confidences, against a plain
    search; of the hub go on as many facts as a question may take."""
    rng = np.random.default_rng(5)
    facts = [("hub", "R", f"x{n:03d}", int(n % 3), float(rng.integers(1, 5)) / 10) for n in range(300) for _ in range(1 + n % 3)]
    facts += [(f"x{n:03d}", "S", f"y{n % 7}", 1, float(rng.integers(1, 9)) / 10) for n in range(300)] + [("hub", "R", "hub", 1, 0.9), ("y1", "T", "hub", 2, None)]
    seeds = [(q, "hub") for q in range(40)] + [(q, f"y{q % 5}") for q in range(20)]
    df = spark.createDataFrame(facts, "a string, relation string, b string, source_id long, confidence double")
    met, taken = graph.budgeted_search(df, spark.createDataFrame(seeds, "question_id int, entity string"), hops=2, max_entities=15, max_facts=20)
    own, got = {}, {}
    for q, e in seeds:
        own.setdefault(q, set()).add(e)
    for r in taken.collect():
        got.setdefault(r["question_id"], []).append((r["hop"], r["a"], r["relation"], r["b"], r["source_id"], r["confidence"]))

    def plain(start):
        ends, seen, out, keys = set(start), set(start), [], set()
        for hop in (1, 2):
            near = sorted({f for f in facts if (f[0] in ends or f[2] in ends) and f[:4] not in keys}, key=lambda f: (-(f[4] or 0.0), *f[:4]))[: 20 - len(out)]
            ends = set()
            for f in near:
                new = {f[0], f[2]} - seen
                if len(seen) + len(new) <= 15:
                    out.append((hop, *f))
                    seen, ends = seen | new, ends | new
            keys = {f[1:5] for f in out}
        return out

    for q, start in own.items():
        assert sorted(got[q], key=repr) == sorted(plain(start), key=repr)
    assert {r["question_id"] for r in met.collect()} == set(own)
    led = graph._leading(df, spark.createDataFrame([("hub",)], "entity string"), 20)
    assert led.select("a", "relation", "b", "source_id").distinct().count() == 20


def test_alike_keys_meet_without_pairs(spark, tmp_path):
    """Numbered names, all much alike, and keys about the length where grams take over: as brute force
    has it, also against known keys, with no more candidates than spellings."""
    from sparkweft.scratch import Scratch

    rng = np.random.default_rng(8)
    keys = [f"supplier_{n:09d}" for n in range(0, 4000, 11)]
    edges = []
    for n in range(17, 25):
        key = "".join(rng.choice(list("abc"), n))
        edges += [key] + [key[:k] + c + key[k + d :] for k, c, d in zip(rng.choice(n, 6), "xy zab", (0, 1, 2, 0, 1, 2))] + [key[:2] + key[4:], key + "ab"]
    rows = lambda some, at=0: spark.createDataFrame([(1, "CONCEPT", k, at + n) for n, k in enumerate(some)], "tenant_id int, entity_type string, key string, first long")

    def plain(old, new):
        out = {}
        for n, key in enumerate(new):
            best = max(((graph.indel_ratio(key, k), -m) for m, k in enumerate(old + new[:n])), default=(0, 0))
            if best[0] >= 92:
                out[key] = (old + new)[-best[1]]
        return out

    mixed = list(dict.fromkeys(keys[::5] + edges))
    assert {r["key"]: r["to"] for r in graph.aliases_of(rows(mixed)).collect()} == plain([], mixed)
    old, new = mixed[::2], mixed[1::2]
    index = graph.KeyIndex(spark, str(tmp_path))
    index.add(rows(old).selectExpr("*", "key as to"), 0)
    assert {r["key"]: r["to"] for r in graph.aliases_of(rows(new, len(old)), known=index).collect()} == plain(old, new)
    aged = rows(keys).selectExpr("*", "1 as age")
    assert graph._sharing(aged, 92.0).count() == 0 and graph._by_spelling(aged, 92.0, Scratch(spark, "t")).count() <= 18 * len(keys)
    assert {r["key"]: r["to"] for r in graph.aliases_of(rows(keys)).collect()} == plain([], keys)


def test_chains_of_aliases_are_followed(spark):
    steps = spark.createDataFrame([(1, "CONCEPT", k, k - 1) for k in range(1, 8)], "tenant_id int, entity_type string, key int, to int")
    assert {r["key"]: r["to"] for r in graph.rooted(steps).collect()} == dict.fromkeys(range(1, 8), 0)


def test_stream_embeds_each_chunk_once(spark, tmp_path):
    from sparkweft.streaming.queue import embed_stream

    s = embedding.Strategy("s", "m", dimension=4)
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "chunk_id int, embedding_text string").write.parquet(str(tmp_path / "in"))
    q = embed_stream(spark, str(tmp_path / "in"), "chunk_id int, embedding_text string", str(tmp_path / "out"), str(tmp_path / "cp"), s, embedding.hashing_embedder(4))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_text_units():
    from sparkweft.operators.extraction import text_units

    words = lambda n: " ".join(["word"] * n)
    assert text_units("") == [] and text_units(None) == [] and text_units("\n<!-- page 1 -->\n ") == []
    one = text_units("<!-- page 2 -->\nalpha\n\n<!-- page 3 -->\nbeta")
    assert one == [{"text": "alpha\n\nbeta", "char_start": 16, "char_end": 43, "page_start": 2, "page_end": 3}]
    # 49 characters a piece: four fit 200 with their gaps, the last one is repeated
    many = text_units("\n\n".join(words(10) for _ in range(9)), size=210, overlap=60)
    assert [u["text"].count("word") for u in many] == [40, 40, 30] and all(len(u["text"]) <= 210 for u in many)
    assert many[1]["char_start"] < many[0]["char_end"]
    # a long word is cut at the size, a long text at its last line or blank
    assert [len(u["text"]) for u in text_units("x" * 450, size=200, overlap=0)] == [200, 200, 50]
    assert [u["text"] for u in text_units("a" * 150 + "\n" + "b c" * 40, size=200, overlap=0)] == ["a" * 150, "b c" * 40]
    # a word-aligned tail where no whole piece is short enough
    tail = text_units(words(39) + "\n\n" + words(30), size=200, overlap=20)
    assert tail[1]["text"].startswith("word word") and tail[1]["text"].split("\n\n")[0].count("word") == 4


def test_text_units_lose_no_word():
    from sparkweft.operators.extraction import text_units

    rng = np.random.default_rng(4)
    for _ in range(60):
        parts = [["w%d " % k * int(rng.integers(1, 40)), "\n\n", "<!-- page %d -->\n" % k, "\n", "z" * int(rng.integers(1, 260))][int(rng.integers(5))] for k in range(int(rng.integers(1, 40)))]
        content = "\n".join(parts)
        units = text_units(content, 200, int(rng.integers(0, 90)))
        assert all(len(u["text"]) <= 200 and content[u["char_start"] : u["char_end"]].strip() for u in units)
        held = " ".join(u["text"] for u in units)
        assert all(w in held for w in content.split() if w[0] == "w") and sorted(u["char_end"] for u in units) == [u["char_end"] for u in units]


def test_extraction_caps(spark):
    from sparkweft.operators import extraction

    answer = '{"entities": [{"name": " A ", "type": "t", "aliases": "one"}, {"name": ""}, 7, {"name": "B", "aliases": [" x ", "", 5]}], "relationships": [{"source": "A", "target": "B", "relation": "r", "confidence": 90}, {"source": "A"}]}'
    row = extraction.extractions(spark.createDataFrame([(answer,), ("none",), (None,)], "answer string")).collect()
    assert [(e["name"], e["aliases"]) for e in row[0]["entities"]] == [("A", ["one"]), ("B", ["x", "5"])] and row[0]["skipped"] == 3 and len(row[0]["relationships"]) == 1
    assert [(r["entities"], r["skipped"]) for r in row[1:]] == [([], 0)] * 2


def test_resolution_of_variants_acronyms_and_chains(spark):
    """One entity for a name's variants, whichever way they are near, and its facts under it."""
    from sparkweft.operators import extraction
    from sparkweft.plans.registry import BOUND_ONTOLOGY

    names = ["International Business Machines", "IBM", "Internationale Business Machines Corp.", "Internationales Business Machines", "Vela Systems", "Vela System"]
    units = spark.createDataFrame([(f"u{k}", k, f'{{"entities": [{{"name": "{n}", "type": "company"}}], "relationships": [{{"source": "{n}", "relation": "based in", "target": "Oslo", "target_type": "location"}}]}}') for k, n in enumerate(names)], "id string, source_id int, answer string")
    units = units.withColumns({"tenant_id": units["id"].isNull().cast("string"), "index": units["source_id"]})
    from pyspark.sql import functions as F

    units = units.withColumn("tenant_id", F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8"))
    entities, _, facts = extraction.resolved(extraction.extractions(units), BOUND_ONTOLOGY)
    shown = {r["display_name"]: r["entity_id"] for r in entities.collect()}
    assert set(shown) == {"International Business Machines", "Vela Systems", "Oslo"}
    assert {(r["a"], r["source_id"]) for r in facts.collect()} == {(shown[names[0]], k) for k in range(4)} | {(shown["Vela Systems"], k) for k in (4, 5)}


def test_answers(spark):
    from sparkweft.operators import answers

    s = embedding.Strategy("s", "m", dimension=16)
    embed = embedding.hashing_embedder(16)
    rows = [(1, 1, "red apples", 1, 2), (2, 1, "green pears", 3, 3), (3, 2, "blue plums", None, None)]
    vectors = embed([r[2] for r in rows])
    chunks = spark.createDataFrame([(*r[:2], v.tolist(), r[2], None, ["Fruit"], *r[3:]) for r, v in zip(rows, vectors)], "chunk_id int, source_id int, embedding array<double>, content string, embedding_text string, path array<string>, page_start int, page_end int")
    asked = spark.createDataFrame([(1, " red apples "), (2, ""), (3, "x" * 4001)], "query_id int, question string")
    sources = spark.createDataFrame([(1, "a.txt")], "id int, filename string")
    seen = []
    out, final = answers.answered(asked, chunks, sources, s, embed, answer=lambda prompts: [p.splitlines()[2] for p in prompts], k=2)
    row = out.collect()
    assert [(r["query_id"], r["answer"], r["candidates"], r["final"], r["reranker_used"]) for r in row] == [(1, "[Chunk 1] Section: Fruit (page 1–2)", 3, 2, True)]
    assert [(r["rank"], r["chunk_id"], r["filename"]) for r in final.orderBy("rank").collect()][0] == (1, 1, "a.txt")
    none, _ = answers.answered(asked, chunks.where("false"), sources, s, embed)
    assert [r["answer"] for r in none.collect()] == [answers.NOTHING_FOUND]
    plain, order = answers.answered(asked, chunks, sources, s, embed, rerank=None)
    assert [(r["answer"], r["reranker_used"]) for r in plain.collect()] == [("", False)] and order.count() == 3 and not seen


def test_index_by_cells_finds_most(spark):
    from sparkweft.operators import ivf

    rng = np.random.default_rng(6)
    v = rng.normal(size=(12, 16))[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))
    chunks = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None)], "chunk_id int, embedding array<double>")
    centre = ivf.centres(chunks, 12)
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 900, 30)], "query_id int, vector array<double>")
    got = {(r["query_id"], r["chunk_id"]) for r in ivf.search(ivf.placed(chunks, "embedding", centre, 1), asked, centre, probes=5).collect()}
    want = {(r["query_id"], r["chunk_id"]) for r in retrieval.nearest_chunks(chunks.where("embedding is not null"), asked, 10).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_changes_refuse_what_they_must(spark):
    from sparkweft.operators import mutations

    rows = spark.createDataFrame([(1, 1, 1)], "id int, tenant_id int, application_id int")
    assert mutations.owned(rows, 1, Scope(tenants=(1,))).count() == 1
    with pytest.raises(mutations.NotFound):
        mutations.owned(rows, 1, Scope(tenants=(2,)))
    tree = spark.createDataFrame([(1, 1, None), (2, 1, 1), (3, 1, 2), (9, 2, None)], "id int, application_id int, parent_subject_id int")
    moves = spark.createDataFrame([(1, 3), (2, 2), (3, None), (2, 9), (1, 77)], "id int, to int")
    made, refused = mutations.moved(tree, moves.where("id = 3"))
    assert {(r["id"], r["parent_subject_id"]) for r in made.collect()} == {(1, None), (2, 1), (3, None), (9, None)} and refused.count() == 0
    assert {(r["id"], r["reason"]) for r in mutations.moved(tree, moves)[1].collect()} == {(1, "inside its own subtree"), (2, "its own parent"), (2, "another application"), (1, "no such parent")}


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from sparkweft.scratch import scratch_root

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError):
        scratch_root(far)
