"""The full-text index against plain BM25, with blocks skipped and words that most texts have."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from sparkweft.operators import fulltext


def plain(texts, questions, k, prior=None):
    words = {i: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w] for i, t in texts}
    length = sum(map(len, words.values())) / len(words)
    df = Counter(w for x in words.values() for w in set(x))
    out = {}
    for q, asked in questions:
        score = {}
        for i, own in words.items():
            tf = Counter(own)
            s = sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + 1.2 * (0.25 + 0.75 * len(own) / length)) for w in set(asked) if tf[w])
            if s and (prior is None or i in prior):
                score[i] = round(s, 9)
        out[q] = sorted(score, key=lambda i: (-score[i], -(prior or {}).get(i, 0), i))[:k]
    return out


def test_search_is_exact_and_skips(spark, tmp_path):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(60)]
    texts = [(i, " ".join(["the"] * rng.randrange(0, 9) + rng.choices(vocab, [1 / (k + 1) for k in range(60)], k=rng.randrange(0, 40)))) for i in range(700)]
    texts += [(900, None), (901, ""), (902, "The Ünïcode wörd, the-end_x"), (903, "same text"), (904, "same text"), (905, "long " * 20_000)]
    df = spark.createDataFrame(texts, "id long, text string").withColumn("word", F.lit(1))
    index = fulltext.build(df, f"{tmp_path}/index", per_block=16)
    assert index.table("blocks").where("word = 'the'").count() > 20  # a hot word is many blocks
    questions = [(q, rng.sample(vocab, 3) + ["the"] * (q % 2)) for q in range(12)] + [(50, ["wörd"]), (51, ["unknown"]), (52, []), (53, ["same", "text", "same"]), (54, ["long"])]
    asked = spark.createDataFrame(questions, "query_id long, words array<string>")
    found, read = fulltext.search(index, asked, 5)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    want = plain(texts, questions, 5)
    assert got == {q: ids for q, ids in want.items() if ids} and got[53] == [903, 904] and 51 not in got
    total = read.agg(F.sum("blocks"), F.sum("read"), F.sum("ranges"), F.sum("ranges_read")).first()
    assert 0 < total[1] < total[0] and total[3] < total[2]
    prior = {i: i % 7 for i, _ in texts if i % 2}
    found, _ = fulltext.search(index, asked, 5, seeds=1, prior=spark.createDataFrame(list(prior.items()), "id long, prior long"))
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {q: ids for q, ids in plain(texts, questions, 5, prior).items() if ids}


def test_index_of_nothing(spark, tmp_path):
    index = fulltext.build(spark.createDataFrame([], "id long, text string"), f"{tmp_path}/index")
    found, read = fulltext.search(index, spark.createDataFrame([(1, ["a"])], "query_id long, words array<string>"))
    assert found.count() == 0 and read.count() == 0
