"""Resolution against a plain scan in order; ties of position; batches one after another."""

import json
import random


from sparkweft.operators import extraction, graph
from sparkweft.plans.registry import BOUND_ONTOLOGY

TENANT = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
UNITS = "tenant_id string, id string, source_id int, index int, answer string"


def unit(source, index, *names):
    return (TENANT, f"s{source}u{index}", source, index, json.dumps({"entities": [{"name": n, "type": "company"} for n in names], "relationships": []}))


def test_two_sources_that_begin_alike(spark):
    """Both name one company in their first unit: one entity, whatever the units' numbers."""
    for second in (0, 1):
        df = spark.createDataFrame([unit(1, 0, "Acme Industries"), unit(2, second, "Acme Industriess")], UNITS)
        entities, mentions, _ = extraction.resolved(extraction.extractions(df), BOUND_ONTOLOGY)
        assert [r["display_name"] for r in entities.collect()] == ["Acme Industries"] and mentions.count() == 2


def variants(rng, n):
    """Names of few words with a letter changed, added or lost here and there."""
    words = ["northern", "harbour", "dynamics", "systems", "quantum", "meridian", "logistics", "global", "orchid", "industries"]
    base = [" ".join(rng.sample(words, rng.randrange(2, 4))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        name = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(name))
            name[at : at + rng.randrange(0, 2)] = rng.choice(["", "x", "zz"])
        out.append("".join(name))
    return out


def plain(names):
    """Each name's key joins the most similar earlier key, the earliest of equals, at 92 or more."""
    keys, to = [], {}
    for n in names:
        k = graph.name_key(n, "COMPANY")
        if k and k not in to:
            near = [(-graph.indel_ratio(k, o), at, o) for at, o in enumerate(keys) if len(k) >= 5 and len(o) >= 5 and graph.indel_ratio(k, o) >= 92]
            to[k] = min(near)[2] if near else k
            keys.append(k)
    def root(k):
        while to[k] != k:
            k = to[k]
        return k
    return {k: root(k) for k in to}


def test_no_link_is_lost_and_batches_are_as_one(spark, tmp_path):
    rng = random.Random(11)
    names = variants(rng, 90)
    rows = [unit(k // 6, k % 6 // 2, names[2 * k], names[2 * k + 1]) for k in range(45)]  # unit numbers repeat in every source
    read = extraction.extractions(spark.createDataFrame(rows, UNITS))
    # where units have one source and number, names are in order of place in the answer, then of key
    by = {}
    for r in rows:
        by.setdefault((r[2], r[3]), []).append([e["name"] for e in json.loads(r[4])["entities"]])
    order = [n for k in sorted(by) for place in zip(*by[k]) for n in sorted(place, key=lambda n: graph.name_key(n, "COMPANY"))]
    want = plain(order)
    *_, keys = extraction.resolved_keys(read, BOUND_ONTOLOGY)
    once = {r["key"]: r["to"] for r in keys.collect()}
    assert once == want and len(set(want.values())) < len(want)

    index = graph.KeyIndex(spark, str(tmp_path / "keys"))
    *_, first = extraction.resolved_keys(read.where("source_id < 3"), BOUND_ONTOLOGY)
    index.add(first, 0)
    ids = set()
    for batch, inside in ((1, "source_id between 3 and 5"), (2, "source_id > 5")):
        entities, _, _, more = extraction.resolved_keys(read.where(inside), BOUND_ONTOLOGY, known=index)
        ids |= {r["entity_id"] for r in entities.collect()}
        index.add(more, batch)
    seen = {r["key"]: r["to"] for r in index.keys.collect()}
    assert seen == want
    whole, *_ = extraction.resolved(read, BOUND_ONTOLOGY)
    assert ids <= {r["entity_id"] for r in whole.collect()}


def test_known_entities_take_acronyms_and_aliases(spark, tmp_path):
    index = graph.KeyIndex(spark, str(tmp_path / "keys"))
    one = spark.createDataFrame([unit(1, 0, "International Business Machines", "Vela Systems")], UNITS)
    index.add(extraction.resolved_keys(extraction.extractions(one), BOUND_ONTOLOGY)[3], 0)
    answer = json.dumps({"entities": [{"name": "IBM", "type": "company"}, {"name": "Quite Other", "type": "company", "aliases": ["Vela Systems"]}], "relationships": [{"source": "IBM", "relation": "based in", "target": "Vela System", "target_type": "company"}]})
    two = spark.createDataFrame([(TENANT, "s2u0", 2, 0, answer)], UNITS)
    entities, _, facts, keys = extraction.resolved_keys(extraction.extractions(two), BOUND_ONTOLOGY, known=index)
    to = {r["key"]: r["to"] for r in keys.collect()}
    assert to == {"ibm": "international_business_machines", "quite_other": "vela_systems", "vela_system": "vela_systems"}
    assert {r["canonical_key"] for r in entities.collect()} == {"international_business_machines", "vela_systems"} and facts.count() == 1
    nothing = spark.createDataFrame([], UNITS)
    assert all(df.count() == 0 for df in extraction.resolved_keys(extraction.extractions(nothing), BOUND_ONTOLOGY, known=index))


def test_indel_ratio_is_that_of_a_plain_table():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in "ab")
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                rows[i][j] = rows[i - 1][j - 1] + 1 if x == y else max(rows[i - 1][j], rows[i][j - 1])
        assert graph.indel_ratio(a, b) == (200.0 * rows[-1][-1] / (len(a) + len(b)) if a or b else 100.0)


def test_suppliers_all_alike_are_resolved_in_order(spark):
    """Numbered names, each near many others: the entities of a plain scan, and their links."""
    rows = [("t", f"u{k}", k, k, json.dumps({"entities": [{"name": f"Supplier#{7 * k:09d}", "type": "vendor"}, {"name": "NATION_3", "type": "Country"}], "relationships": [{"source": f"Supplier#{7 * k:09d}", "relation": "basedIn", "target": "NATION_3"}]})) for k in range(150)]
    rows = [(TENANT, *r[1:]) for r in rows]
    names = [f"Supplier#{7 * k:09d}" for k in range(150)]
    read = extraction.extractions(spark.createDataFrame(rows, UNITS))
    entities, _, facts, keys = extraction.resolved_keys(read, BOUND_ONTOLOGY)
    want = plain(names)
    assert {r["key"]: r["to"] for r in keys.where("entity_type = 'COMPANY'").collect()} == want
    assert entities.count() == len(set(want.values())) + 1 and facts.count() == 150
