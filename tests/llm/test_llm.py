"""Each operator against brute force, a round trip or a public library, and on awkward tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkweft.llm import ann, bpe, jaccard, mixing, ppm, recompression, simhash, toxicity, urls, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def words(rng, n):
    return [rng.choice(VOCAB) + str(rng.randrange(12)) for _ in range(n)]


def corpus(seed=1):
    """Copies, near copies, shared passages, empty, short and odd texts."""
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "one", "Two words", "a b c d", "日本語 のテキスト 😀 é", "x" * 3000, "w " * 300]
    passage = " ".join(words(rng, 70))
    for k in range(24):
        base = words(rng, rng.choice([20, 90, 240]))
        texts.append(" ".join(base))
        if k % 3 == 0:
            near = list(base)
            for _ in range(max(1, len(base) // rng.choice([20, 40, 60]))):
                near[rng.randrange(len(near))] = "edit"
            texts += [" ".join(base).upper(), " ".join(near)]
        if k % 4 == 0:
            texts.append(" ".join(base[:30]) + " " + passage + " " + " ".join(words(rng, 30)))
    return [(i, t, "en", None if i % 7 == 3 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# 1

@pytest.mark.parametrize("block_rows", [4096, 8])
def test_mixing(spark, docs, rows, nothing, block_rows):
    """One landing problem a source comes near its target; tiny blocks leave few documents to
    land with, so they may miss it by a document."""
    got = mixing.mix_sources(docs, block_rows=block_rows).collect()
    assert len(got) == len(rows)
    size = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    by = {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        t = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
        t[0] += r["taken"]
    assert abs(sum(t[1] for t in by.values()) - sum(size.values())) < 1e-6
    assert all(t[1] <= 3 * t[2] + 1e-9 and abs(t[0] - t[1]) <= (0.1 * t[1] + 20 if block_rows > 8 else max(size.values())) for t in by.values())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(docs, block_rows=block_rows).collect()))
    assert mixing.mix_sources(nothing).count() == 0


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Shares by weight of all sizes; what is over a source's limit is shared again among the rest."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, rest, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while rest > 1e-9 and open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        rest = 0.0
        for s, x in share.items():
            target[s] += x
            if target[s] > most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, None: 10}, {"a": 900, "b": 5, "c": 3, "d": 80, None: 1}, {"a": 0, "b": 7}, {"x": 4}])
def test_mixing_targets(spark, sizes):
    df = spark.createDataFrame([(k, " ".join(["w"] * n), s) for k, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string")
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.mix_sources(df).collect()}
    want = plain_targets(sizes)
    assert all(got[s][0] == n and abs(got[s][1] - want[s]) < 1e-6 for s, n in sizes.items())


def test_mixing_keeps_ids(spark):
    """Ids beyond doubles and a null id share a block."""
    ids = [2**60 + 1, 2**60 + 3, None, -(2**62) - 1]
    df = spark.createDataFrame([(i, "a b c", "s") for i in ids], "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert sorted(map(repr, (r["doc_id"] for r in got))) == sorted(map(repr, ids)) and {r["size"] for r in got} == {3}


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 900, 500).astype(float)
    out = mixing.flight(np.full(500, 0.37), size, rng, land=False)
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out.sum() - 185) < 1e-6 and abs(out @ size - 0.37 * size.sum()) < 1e-3
    out = mixing.flight(np.full(500, 0.37), size, rng, land=True)
    assert set(out) == {0.0, 1.0} and abs(out @ size - 0.37 * size.sum()) < 20


# 2

def brute_components(rows, size=5, percent=75):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().translate(jaccard.LOWER).split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("options", [{}, {"small": 2, "pivots": 2}])
def test_jaccard(docs, rows, options):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, **options).collect()}
    assert got == brute_components(rows)


def test_jaccard_of_many_near_copies(spark):
    rng = random.Random(5)
    base = words(rng, 60)
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            own[rng.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(own), "en", "s", 0))
    made = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA), small=4, pivots=3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in made.collect()} == brute_components(rows)


def test_jaccard_of_a_region_that_no_pivot_splits(spark, monkeypatch):
    """Sets that are near each other, but hardly linked: their chunks meet once, not by rounds of pivots."""
    rng = random.Random(6)
    base, rows = words(rng, 40), []
    for i in range(60):
        own = [*base, *(f"x{i}y{k}" for k in range(12))]
        rows.append((2 * i, " ".join(own), "en", "s", 0))
        if i % 20 == 0:
            rows.append((2 * i + 1, " ".join([*own, f"z{i}"]), "en", "s", 0))
    saved, save = [], jaccard.Scratch.save
    monkeypatch.setattr(jaccard.Scratch, "save", lambda self, df, name, *by: (saved.append(name), save(self, df, name, *by))[1])
    made = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA), small=8, pivots=2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in made.collect()} == brute_components(rows)
    assert sum(x.startswith("split-") for x in saved) == 1


def test_jaccard_of_nothing(nothing):
    assert jaccard.near_duplicates(nothing).count() == 0


# 3

def test_toxicity(spark, nothing):
    rng = random.Random(2)
    rows = [(i, " ".join([*words(rng, 30), *(["awful", "nasty"] if i % 5 == 0 else [])]), "en", "s", 0) for i in range(400)] + [(1000, None, None, None, None), (1001, "", "", "", 0)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    held = F.col("doc_id") % 4 == 2
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels, held).collect()}
    assert len(out) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert all(out[i]["predicted"] == int(i % 5 == 0) for i in range(400) if i % 4 == 2)
    shuffled = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))  # held-out labels change nothing
    assert {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, shuffled, held).collect()} == {i: r["score"] for i, r in out.items()}
    assert {r["score"] for r in toxicity.score_documents(docs, labels.where("false"), held).collect()} == {0.0}
    assert toxicity.score_documents(nothing, labels, held).count() == 0


def test_toxicity_equals_plain_ftrl(spark):
    """Coordinate by coordinate, on the same documents in the same order."""
    rng = random.Random(12)
    rows = [(i, " ".join([*words(rng, 12), *(["awful"] if i % 3 == 0 else [])])) for i in range(60)]
    labels = {i: int(i % 3 == 0) for i in range(50)}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    bits, alpha, beta, l1, l2 = 12, 0.5, 1.0, 0.4, 0.01
    out = toxicity.score_documents(docs, spark.createDataFrame([*labels.items()], "doc_id long, toxic int"), F.col("doc_id") % 4 == 2, bits=bits, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted((i for i in labels if i % 4 != 2), key=lambda i: (signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)), i))
    z, n = Counter(), Counter()

    def weight(k):
        shrink = 0.0 if k == 0 else l1
        return 0.0 if abs(z[k]) <= shrink else -(z[k] - np.sign(z[k]) * shrink) / ((beta + np.sqrt(n[k])) / alpha + l2)

    def score(text):
        return 1 / (1 + np.exp(-sum(weight(k) for k in set(toxicity.features(text, bits).tolist()))))

    texts = dict(rows)
    for _ in range(2):
        for i in order:
            g, at = score(texts[i]) - labels[i], set(toxicity.features(texts[i], bits).tolist())
            held = {k: weight(k) for k in at}
            for k in at:
                step = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha
                z[k] += g - step * held[k]
                n[k] += g * g
    assert all(abs(r["score"] - score(texts[r["doc_id"]])) < 1e-9 for r in out.collect())


# 4

def test_warc(spark):
    pages = [(0, "http://a/", "<p>é</p>"), (1, None, None), (2, "u\nv", "<p>é</p>"), (3, "", ""), (4, "http://b", "z" * 200_000), (None, "http://c", "q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(df).collect()}
    assert len(got) == 6
    for i, _, html in pages:
        data = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(data), warc.sha1_32(data))
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (0, 1, 2, 3, 4)] == [("response", None), ("response", None), ("revisit", 0), ("revisit", 1), ("response", None)]
    assert warc.round_trip(df.where("false")).count() == 0
    assert {r["record_type"] for r in warc.round_trip(df, min_revisit=100).collect()} == {"response"}


def test_warc_damage():
    good = warc.member(1, "u", b"abc", None, warc.sha1_32(b"abc"))
    assert warc.parse(next(warc.members(good + b"\0\0")))["payload"] == b"abc"
    record = next(warc.members(good))
    with pytest.raises(ValueError):
        warc.parse(record.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        next(warc.members(good[:-9]))


# 5

def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8)).round(3)
    v[50] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (1000, [None] * 8)]
    out = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0).collect()
    hits = 0
    for q in range(0, 400, 100):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        best = sorted((x, i) for i, x in enumerate(d) if i != q)[:10]
        assert [r for r, *_ in own] == list(range(1, 11)) and all(abs(s - d[i]) < 1e-12 for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in best})
    assert {r["query_id"] for r in out} == {0, 100, 200, 300} and hits >= 36
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert ann.nearest_neighbours(few, lambda i: i == 0).count() == 3
    assert ann.nearest_neighbours(few.where("false"), lambda i: i == 0).count() == 0


def test_graph_in_slices_is_the_same(spark):
    """Lists made in slices of few bytes give the graph that lists made at once give, and what they
    were made from is freed."""
    import glob

    from sparkweft.scratch import Scratch

    rng = np.random.default_rng(4)
    nodes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(rng.standard_normal((700, 6)))], "node long, v binary")
    made = []
    for most in (4 << 30, 200_000):
        scratch = Scratch(spark, "sliced")
        graph = ann.build_graph(nodes, scratch, degree=8, leaf_rows=20, trees=2, rounds=2, settled=0.0, slice_bytes=most)
        made.append(sorted((r["a"], r["b"], r["d"]) for r in graph.collect()))
        assert [x.rsplit("/", 1)[1] for x in glob.glob(f"{scratch.base}/*")] == ["graph2"]
    assert made[0] and made[0] == made[1]


def test_links_are_the_nearest(spark):
    graph = spark.createDataFrame([(0, b, float(100 - b)) for b in range(1, 33)] + [(b, 0, float(200 - b)) for b in range(33, 101)], "a long, b long, d float")
    to = {b for a, b in ann.nearest_links(graph).collect() if a == 0}
    assert to == set(sorted(range(1, 101), key=lambda b: 100 - b if b < 33 else 200 - b)[:64])


@pytest.mark.parametrize("case", ["huge", "near"])
def test_nearest_neighbours_in_double_precision(spark, case):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 8))
    if case == "huge":
        v[599, 3] = 1e12
    else:
        v[:500] = v[0] + 1e-6 * v[:500]
    out = ann.nearest_neighbours(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), lambda i: i % 100 == 0).collect()
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({r["vec_id"] for r in out if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    assert len(out) == 60 and hits >= 57


# 6

def plain_ppm(texts, order):
    """A function of a context and a byte: log10 of its probability, by dictionaries alone."""
    levels = [Counter() for _ in range(order + 1)]
    for t in texts:
        t = ppm.END * order + t
        levels[order].update(t[k - order : k + 1] for k in range(order, len(t)))
    for k in range(order, 0, -1):
        levels[k - 1].update(s[1:] for s in levels[k])
    contexts = [{} for _ in levels]
    for k, level in enumerate(levels):
        for s, n in level.items():
            contexts[k].setdefault(s[:-1], {})[s[-1]] = n
    j = lambda n: min(int(np.floor(np.log2(max(n, 1)) * 2)), 40)
    escape = []
    for level in contexts:
        gone, met = Counter(), Counter()
        for syms in level.values():
            n, d, once = sum(syms.values()), min(len(syms), 63), sum(c == 1 for c in syms.values())
            if n > 1:
                gone[max(d - 1, 0), j(n - 1)] += once
                met[max(d - 1, 0), j(n - 1)] += once
                met[d, j(n - 1)] += n - once
        escape.append(lambda d, n, gone=gone, met=met: min(0.98, max(1e-6, (gone[min(d, 63), j(n)] + 4 * min(0.95, min(d, 63) / (2 * 2 ** (j(n) / 2)))) / (met[min(d, 63), j(n)] + 4))))

    def probability(context, symbol):
        out, above = 0.0, set()
        for k in range(order, -1, -1):
            syms = contexts[k].get(context[len(context) - k :], {})
            rest = sum(n for x, n in syms.items() if x not in above)
            e = escape[k](len(syms), sum(syms.values()))
            if symbol in syms and symbol not in above:
                return out + np.log10((1 - e) * syms[symbol] / rest)
            out += np.log10(e) if rest else 0.0
            above = set(syms)
        return out - np.log10(256 - len(above))
    return probability


def test_ppm_is_a_probability(spark, tmp_path):
    """After any context the probabilities of all bytes sum to 1, and equal the plain form's."""
    texts = [b" ".join(ppm.normal(t)) + ppm.END for t in (b"abracadabra abra", b"banana band", b"cab")]
    plain = plain_ppm(texts, 3)
    counts = Counter(ppm.grams(texts, 3)[0].tolist())
    asked = [context + bytes([c]) for context in (b"\n\n\n", b"abr", b"ban", b"zzz", b"zab", b"and") for c in range(256)]
    rows = [(k, counts[k]) for k in {*counts, *(int.from_bytes(a, "big") for a in asked)}]
    got = dict(map(tuple, ppm.string_scores(spark.createDataFrame(rows, "s long, cnt long"), 3, ppm.Scratch(spark, "test")).collect()))
    assert len(got) == len(rows)
    for k in range(0, len(asked), 256):
        own = [got[int.from_bytes(a, "big")] for a in asked[k : k + 256]]
        assert abs(sum(10**x for x in own) - 1) < 1e-9 and np.allclose(own, [plain(a[:3], a[3]) for a in asked[k : k + 256]], atol=1e-9)


def test_ppm_scores(docs, rows, nothing):
    held = F.col("doc_id") % 5 == 2
    out = {r["doc_id"]: r for r in ppm.score_documents(docs, held).collect()}
    counts = Counter()
    for i, t, *_ in rows:
        if i % 5 != 2:
            counts.update([*ppm.normal((t or "").encode()), ppm.END])
    total, distinct = sum(counts.values()), len(counts)
    for i, t, *_ in rows:
        tokens = [*ppm.normal((t or "").encode()), ppm.END]
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i % 5 == 2, len(tokens), sum(counts[x] > 0 for x in tokens), total)
        assert abs(r["base_score"] - sum(np.log10((counts[x] + 1) / (total + distinct + 1)) for x in tokens)) < 1e-6
    plain = plain_ppm([b" ".join(ppm.normal((t or "").encode())) + ppm.END for i, t, *_ in rows if i % 5 != 2], 5)
    for i, t, *_ in rows:
        text = ppm.END * 5 + b" ".join(ppm.normal((t or "").encode())) + ppm.END
        assert abs(out[i]["score"] - sum(plain(text[k - 5 : k], text[k]) for k in range(5, len(text)))) < 1e-6
    assert ppm.score_documents(nothing, held).count() == 0
    alone = ppm.score_documents(docs, F.lit(True)).where("doc_id = 3").first()
    assert abs(alone["score"] + 4 * np.log10(256)) < 1e-9


def test_ppm_scores_documents_as_they_stream_by(docs):
    """A task never holds a block's documents or unpacked nodes as a whole."""
    assert "CoGroup" not in ppm.score_documents(docs, F.lit(False))._jdf.queryExecution().toString()
    text, read = b"one two", []
    key = np.concatenate([[ppm.word_key(b"one"), ppm.END_KEY], np.unique(ppm.grams([text + ppm.END], 5)[0])])
    value = np.concatenate([[3.0, 5.0], np.full(len(key) - 2, -0.5)])
    listed = [pa.RecordBatch.from_pydict({"block": np.full(len(key), b), "key": key, "value": value * (b + 1)}) for b in (0, 1)]
    packs = pa.Table.from_batches(ppm._pack_nodes(iter(listed))).to_pylist()
    kinds = pa.schema([("block", pa.int64()), ("trains", pa.int32()), ("doc_id", pa.int64()), ("raw", pa.binary()), ("n", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary())])

    def stream():
        for b in (0, 1):
            for k in range(4):
                read.append((b, k))
                rows = [x for x in packs if x["block"] == b] if k == 0 else [{"block": b, "trains": k % 2, "doc_id": 10 * b + k, "raw": text}]
                yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in kinds.names} for r in rows], schema=kinds)

    out = ppm._score_blocks(5, 100, 9)(stream())
    first = next(out).to_pylist()
    assert read == [(0, 0), (0, 1)] and first[0]["doc_id"] == 1
    rows = {r["doc_id"]: r for b in out for r in b.to_pylist()} | {1: first[0]}
    assert sorted(rows) == [1, 2, 3, 11, 12, 13] and [rows[k]["held_out"] for k in (1, 2, 3)] == [False, True, False]
    assert all(abs(r["score"] + 4.0 * (i // 10 + 1)) < 1e-9 and r["n_known"] == 2 and r["n_tokens"] == 3 for i, r in rows.items())


# 7

def test_bpe_equals_the_library(spark, docs, rows):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(spark, path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.encode_documents(docs, path, P.PATTERN, ids=True).collect():
        ids = enc.encode_ordinary(rows[r["doc_id"]][1] or "")
        packed = np.array(ids, "<u4").tobytes()
        assert bytes(r["ids"]) == packed and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((rows[r["doc_id"]][1] or "").encode()).hexdigest()


def test_bpe_of_long_pieces():
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.read_ranks(None, P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for piece in ("a" * 500, "".join(rng.choice("abcé日") for _ in range(400)), "Z" * 65):
        assert bpe.merge(piece.encode(), ranks) == enc.encode_ordinary(piece)


# 8

def brute_repeats(rows, window):
    first, out = {}, {}
    for i, t, *_ in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if first.setdefault(x, i) < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(a for a, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("window,levels,least", [(50, (3, 4), 4), (31, (2, 3), 2), (7, (1,), 2), (20, (1, 2, 3), 1)])
def test_repeats(docs, rows, window, levels, least):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in recompression.remove_repeats(docs, window, levels, least).collect()}
    assert got == brute_repeats(rows, window)


def test_repeats_of_runs_and_nothing(spark, nothing):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(["a " * 60, "b " + "a " * 55 + "c", "x y " * 40, "z " + "x y " * 35, "x " * 49, "q " + "a b a b a a " * 12, "a b a b a a " * 11])]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in recompression.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_repeats(rows, 50)
    assert recompression.remove_repeats(nothing).count() == 0


def test_inner_symbols_stand_in_every_occurrence():
    """Whatever stands around a window, its inner symbols are the same: small alphabets, so that
    runs and pairs cross the borders in every way."""
    rng = random.Random(8)
    for _ in range(400):
        inner = [rng.randrange(rng.choice([2, 3, 8])) for _ in range(40)]
        seen = []
        for _ in range(3):
            before, after = ([rng.randrange(3) for _ in range(rng.randrange(9))] for _ in "ab")
            names = recompression.mixed(np.array([*before, *inner, *after], np.uint64) + np.uint64(5))
            made = recompression.Parse(names, np.zeros(len(names), np.int64))
            for _ in range(3):
                made.up()
            own = range(int(made.low[len(before)]), int(made.high[len(before) + 40]))
            seen.append([(int(made.names[j]), int(made.begin[j]) - len(before)) for j in own])
        assert seen[0] == seen[1] == seen[2]


def test_repeats_of_shared_ids_and_hot_windows(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(words(rng, 70)) for _ in range(3))
    rows = [(3, a, "", "", 0), (5, a, "", "", 0), (5, b, "", "", 0), (None, a, "", "", 0), (None, None, "", "", 0), (7, c + " " + b, "", "", 0)]
    hot = " ".join(words(rng, 60))
    rows += [(20 + i, " ".join(words(rng, 8)) + f" p{i} " + hot, "", "", 0) for i in range(30)] + [(90, hot + " " + "long " * 30_000 + b, "", "", 0)]
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in recompression.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    want = [(-1, 0, 0), (-1, 70, 0), (3, 70, 0), (5, 70, 0), (5, 70, 70), (7, 140, 70), (20, 69, 0), *((20 + i, 69, 60) for i in range(1, 30)), (90, 30_130, 130)]
    assert got == sorted(want)


# 9

def test_urls(spark):
    pages = [(0, "http://a.Example.org/es/x?q#f"), (1, "https://org/x"), (2, "https://xorg/x"), (3, None), (4, "nothing"), (5, "ftp://b.com/fr/"), (6, "http://c.com/de/1#x"), (7, "http://example.org/en/12"), (8, "http://example.org/en/2"), (9, "http://org"), (9, "http://org")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    for limit in (8 << 20, 0):
        got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, urls.rule_table(spark, urls.RULES), broadcast_bytes=limit).orderBy("page_id").collect()]
        assert got == [
            (0, "a.example.org", "/es/x", "example.org/es/", "block"), (1, "org", "/x", "org/", "allow"), (2, "xorg", "/x", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
            (5, "b.com", "/fr/", "com/fr/", "allow"), (6, "c.com", "/de/1", "com/de/", "block"), (7, "example.org", "/en/12", "example.org/en/1", "block"), (8, "example.org", "/en/2", "org/", "allow"),
            (9, "org", "", None, "allow"), (9, "org", "", None, "allow")]
    assert urls.judge_urls(df, urls.rule_table(spark, urls.RULES).where("false")).where("verdict = 'allow'").count() == len(pages)
    assert urls.judge_urls(df.where("false"), urls.rule_table(spark, urls.RULES)).count() == 0


# 10

def xxh64_chain(parts):
    """A hash of several strings, each hashed with the last one's hash as seed, as the engine does."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), h)
    return h


def plain_simhash(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    terms = [w[k : k + 5] for k in range(max(1, len(w) - 4))] if w else []
    hashes = [xxh64_chain(t) for t in terms]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_ranges_keep_order_and_size(spark):
    df = spark.range(5000).select((F.col("id") * 7 - 900).alias("doc_id"))
    made = sorted(map(tuple, df.select("doc_id", simhash._buckets(df, "doc_id", 10, most=16).alias("b")).collect()))
    assert [b for _, b in made] == sorted(b for _, b in made) and max(Counter(b for _, b in made).values()) <= 25
    assert {r["b"] for r in df.where("false").select(simhash._buckets(df.where("false"), "doc_id", 10).alias("b")).collect()} == set()


def test_edited_fingerprints(docs, rows, nothing):
    out = {r["doc_id"]: r for r in simhash.edited_fingerprints(docs, bucket_rows=7).collect()}
    texts = [t or "" for _, t, *_ in rows]
    near = following = 0.0
    for i, t in enumerate(texts):
        q = len(t) // 4
        edited = t[: len(t) - q] + texts[(i + 1) % len(texts)][:q]
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_next"] == 1 - bin(int(r["fingerprint"], 16) ^ int(out[(i + 1) % len(texts)]["fingerprint"], 16)).count("1") / 64
        near += r["near_edited"]
        following += r["near_next"]
    assert near > following + 3
    fps = {i: int(r["fingerprint"], 16) for i, r in out.items()}
    assert fps == {i: plain_simhash(t) for i, t in enumerate(texts)}
    assert all(int(out[i]["edited_fingerprint"], 16) == plain_simhash(t[: len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][: len(t) // 4]) for i, t in enumerate(texts))
    assert {i: r["n_near"] for i, r in out.items()} == {i: sum(bin(x ^ y).count("1") <= 3 for j, y in fps.items() if j != i) for i, x in fps.items()}
    one = {r["doc_id"]: r["edited_sha256"] for r in simhash.edited_fingerprints(docs, bucket_rows=1).collect()}
    assert one == {i: r["edited_sha256"] for i, r in out.items()}
    assert simhash.edited_fingerprints(nothing).count() == 0


def test_near_fingerprints(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(40)]
    fps = base + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base] + base[:3]
    df = spark.createDataFrame([(x,) for x in fps] + [(None,)], "fp long")
    got = {(r["a"], r["b"], r["distance"]) for r in simhash.near_fingerprints(df).collect()}
    assert got == {(a, b, bin(a ^ b).count("1")) for a in set(fps) for b in set(fps) if a < b and bin(a ^ b).count("1") <= 3}


# extra columns and the pipeline's stages

def test_clashing_columns(spark, docs):
    names = ("size", "key", "node", "n", "h", "start", "raw", "comp", "block", "row", "names", "score", "_bucket", "pi", "k", "part", "a", "b", "c", "ids", "predicted", "toxic", "fp", "region")
    more = docs.withColumns({c: F.lit(1) for c in names})
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int").withColumns({"text": F.lit("x"), "score": F.lit(2)})
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    for made in (mixing.mix_sources(more), jaccard.near_duplicates(more), recompression.remove_repeats(more), simhash.edited_fingerprints(more), ppm.score_documents(more, F.lit(False)), recompression.remove_repeats(more, texts=True),
                 toxicity.score_documents(more, labels, F.lit(False)), bpe.encode_documents(more, path, P.PATTERN)):
        assert made.count() == docs.count()
    pages = spark.createDataFrame([(1, "http://org/a", "x"), (2, None, None)], "page_id long, url string, html string").withColumns({c: F.lit("1") for c in ("host", "path", "rule", "verdict", "payload", "payload_digest", "digest", "refers_to")})
    assert warc.round_trip(pages).count() == 2 and urls.judge_urls(pages, urls.rule_table(spark, urls.RULES)).count() == 2
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("q", "v", "node", "d", "rank", "i")})
    assert ann.nearest_neighbours(vectors, lambda i: i == 0).count() == 4


def test_ties_of_neighbours(spark):
    """Equal distances go to the smaller id, and copies of a vector count each."""
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)]
    out = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 10 == 0, k=3).collect()]
    assert sorted(out) == sorted((q, n + 1, v) for q in (0, 10, 20, 30) for n, v in enumerate([v for v in range(0, 40, 2) if v != q][:3]))


def test_long_texts_and_null_ids(spark):
    rng = random.Random(6)
    long = " ".join(words(rng, 60_000))
    rows = [(1, long, "", "s", 0), (2, long + " tail", "", "s", 0), (None, long, "", "s", 0), (None, None, "", None, 0), (3, "", "", "s", 0), (4, "lone words", "", "s", 0), (4, "lone words", "", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    made = sorted((r["doc_id"] or -1, r["n_shingles"] > 50_000, r["component_id"]) for r in jaccard.near_duplicates(df).collect() if r["component_id"] is not None)
    assert made == [(-1, True, 1), (1, True, 1), (2, True, 1), (3, False, 3), (4, False, 4), (4, False, 4)]
    assert {(r["doc_id"], r["n_removed"]) for r in recompression.remove_repeats(df).collect()} == {(1, 0), (2, 60_000), (None, 0), (3, 0), (4, 0)}
    scored = ppm.score_documents(df, F.lit(False)).collect()
    assert sorted(r["n_tokens"] for r in scored) == [1, 1, 3, 3, 60_001, 60_001, 60_002] and all(r["n_known"] == r["n_tokens"] for r in scored)
    assert simhash.edited_fingerprints(df).count() == len(rows)


def test_toxicity_of_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "bad", "", "", 0), (1, None, "", "", 0), (1, "bad", "", "", 0)], SCHEMA)
    labels = spark.createDataFrame([(None, 1), (1, 1), (1, 0), (2, None)], "doc_id long, toxic int")
    assert toxicity.score_documents(docs, labels, F.col("doc_id") == 9).count() == 3


def staged(spark, docs, path):
    from sparkweft.llm import stages

    out, made = {}, docs
    for name, stage in stages.STAGES:
        made = stage(spark, made, str(path))
        out[name] = made
    return out


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, int(i == 3)) for i in range(9)], "doc_id long, toxic int").write.parquet(str(path / "labels.parquet"))
    return path


def test_stages_equal_brute_force(spark, docs, rows, labels_dir):
    """Each stage's decisions on what its predecessor kept."""
    made = {k: v.collect() for k, v in staged(spark, docs, labels_dir).items()}
    for name in list(made)[:-1]:
        assert list(made[name][0].asDict()) == docs.columns, name
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    fine = {r["doc_id"] for r in toxicity.score_documents(docs, spark.read.parquet(str(labels_dir / "labels.parquet")), held).collect() if not r["predicted"]}
    left = [r for r in rows if r[0] in fine]
    assert {r["doc_id"] for r in made["toxicity"]} == fine and len(fine) > 20
    first = {i for i, (_, c) in brute_components(left).items() if i == c}
    left = [r for r in left if r[0] in first]
    assert {r["doc_id"] for r in made["near_duplicates"]} == first and len(first) < len(fine)
    cut = brute_repeats(left, 50)
    for r in made["substring_dedup"]:
        n, gone, digest = cut[r["doc_id"]]
        text = dict((i, t) for i, t, *_ in left)[r["doc_id"]]
        assert r["text"] == text if not gone else hashlib.sha256(r["text"].encode()).hexdigest() == digest
        assert r["n_chars"] == (len(r["text"]) if gone else len(text or ""))
    assert len(made["substring_dedup"]) == len(left) and sum(g > 0 for _, g, _ in cut.values()) > 3
    assert {r["doc_id"] for r in made["mixing"]} <= first and max(Counter(r["doc_id"] for r in made["mixing"]).values()) <= 3
    by = Counter(r["source"] for r in made["mixing"])
    assert set(by) == {r[3] for r in left}
    assert Counter(r["doc_id"] for r in made["byte_bpe"]) == Counter(r["doc_id"] for r in made["mixing"])
    texts = {r["doc_id"]: r["text"] for r in made["mixing"]}
    assert all(r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in made["byte_bpe"])


def test_stages_of_nothing_and_of_odd_rows(spark, nothing, labels_dir):
    assert {k: v.count() for k, v in staged(spark, nothing, labels_dir).items()} == dict.fromkeys(("toxicity", "near_duplicates", "substring_dedup", "mixing", "byte_bpe"), 0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (2, "w " * 60, "en", "s", 120), (None, "w " * 60, "en", "s", 120)], SCHEMA).withColumns({"row": F.lit(1), "starts": F.lit("x"), "_k": F.lit(2), "_times": F.lit(1), "size": F.lit(1)})
    made = staged(spark, odd, labels_dir)
    assert made["substring_dedup"].columns == odd.columns and made["substring_dedup"].count() == 5
    assert {(r["doc_id"], r["text"]) for r in made["mixing"].collect()} <= {(2, "w " * 60), (None, "w " * 60)}
