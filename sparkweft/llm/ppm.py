"""Language-model scoring by prediction by partial matching over bytes.

A document's symbols are its words, A-Z lower-cased and joined by single spaces, and one end
(a newline, which no word holds). The model is a byte-context trie: the strings of up to order + 1
symbols of the training documents. A symbol is looked for in the longest context; where it is
absent there the model escapes to the next shorter one, without the symbols that the longer one
had (symbol exclusion), and at last to a uniform choice of the bytes left.

Counts. The longest strings count as often as they occur, shorter ones as often as a different
symbol stands before them (update exclusion). Escapes are estimated from the trie itself: contexts
of an order with alike totals and numbers of symbols are a class, and a class's escape is how
often its contexts, with one occurrence left out, wouldn't know it, with method D's estimate as
four occurrences more. In a context the known symbols share the rest by their counts.

The trie grows with the corpus, so it is Spark tables, a level each, and never broadcast but for
contexts of at most one byte. Documents are dealt into blocks, ranges of doc_id. A block lists the
distinct longest strings and words that it holds, with their counts in its training documents; the
last symbol's probability is a property of a longest string, so it is computed once for each
distinct one, and a join takes each block those that it listed, packed. They stand before the
block's documents in a sorted partition, so these are scored as they stream by.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORD_HASHES, Scratch, raw, small
from .parts import heads
from .simhash import _buckets

END = b"\n"
SIGN = -(1 << 63)
PIECE = 1 << 19


def word_key(word: bytes) -> int:
    """A negative long; trie nodes have keys from 0."""
    return (WORD_HASHES[word] >> 1) + SIGN


END_KEY = word_key(END)


def normal(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of texts that end in END the string of order + 1 symbols up to it, as an
    integer, and each text's first symbol. Before a text stand END symbols."""
    pad = END * order
    joined = np.frombuffer(pad + pad.join(texts), np.uint8)
    size = np.array([len(x) for x in texts])
    starts = np.cumsum(size + order) - size
    out = np.zeros(len(joined) - order, np.int64)
    for k in range(order + 1):
        out |= joined[k : len(joined) - order + k].astype(np.int64) << 8 * (order - k)
    own = np.ones(len(out), bool)
    for j in range(order):
        own[starts[1:] - 2 * order + j] = False
    return out[own], np.cumsum(size) - size


def _sum_by_key(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts), len(key)).astype(np.int64)


def _merged(key: np.ndarray, n: np.ndarray, more: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of distinct ascending keys, with those of others, also distinct and ascending, added;
    what is there isn't sorted again."""
    at = np.searchsorted(key, more)
    known = at < len(key)
    known[known] = key[at[known]] == more[known]
    n[at[known]] += m[known]
    return np.insert(key, at[~known], more[~known]), np.insert(n, at[~known], m[~known])


def _pieces(texts: list[bytes]):
    """Runs of texts of about PIECE bytes."""
    begin, size = 0, 0
    for k, x in enumerate(texts):
        size += len(x)
        if size >= PIECE:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


class Listing:
    """The strings and words of a block, with their counts in training documents."""

    def __init__(self, order: int):
        self.order, self.words, self.texts, self.size = order, Counter(), ([], []), 0
        self.top = self.known = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, text: bytes, trains: bool) -> None:
        words = normal(text)
        found = Counter(words)
        found[END] += 1
        if trains:
            self.words.update(found)
        else:
            self.words.update(dict.fromkeys(found, 0))
        joined = b" ".join(words) + END
        self.texts[trains].append(joined)
        self.size += len(joined)
        if self.size >= PIECE:
            self._count()

    def _count(self) -> None:
        for trains, texts in enumerate(self.texts):
            if texts:
                key, n = np.unique(grams(texts, self.order)[0], return_counts=True)
                self.top = _merged(*self.top, key, n * trains)
                texts.clear()
        words = np.fromiter(map(word_key, self.words), np.int64, len(self.words))
        self.known = _merged(*self.known, *_sum_by_key([words], [np.fromiter(self.words.values(), np.int64, len(self.words))]))
        self.size, self.words = 0, Counter()

    def rows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and counts of the strings (from 0), then of the words (below 0)."""
        self._count()
        return [self.top, self.known]


def _list_blocks(order: int):
    def run(batches):
        held: dict[int, Listing] = {}

        def emit(block):
            for key, n in held.pop(block).rows():
                for k in range(0, len(key), 1 << 18):
                    part = slice(k, k + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), block, np.int64)), pa.array(key[part]), pa.array(n[part])], names=["block", "key", "n"])

        for batch in small(batches):
            for block, trains, text in zip(*(batch[c].to_pylist() for c in ("block", "trains", "raw"))):
                if block not in held:
                    while len(held) >= 2:  # ranges come in order in a sorted table; a block may also be listed in parts
                        yield from emit(next(iter(held)))
                    held[block] = Listing(order)
                held[block].add(text, trains)
        for block in [*held]:
            yield from emit(block)
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages
    return run


KINDS, TOTALS = 64, 41  # classes of escapes: numbers of symbols, and totals by half powers of two


def _contexts(strings: DataFrame) -> DataFrame:
    """ctx, tot, d, once, syms (sym, cnt) of strings (s, cnt): a context for each string without its
    last symbol; a string of count 0 is one to be judged and counts for nothing."""
    known = F.col("cnt") > 0
    return strings.groupBy(F.shiftright("s", 8).alias("ctx")).agg(
        F.sum("cnt").alias("tot"), F.count_if(known).alias("d"), F.count_if(F.col("cnt") == 1).alias("once"), F.collect_list(F.struct(F.col("s").bitwiseAND(F.lit(255)).cast("int").alias("sym"), "cnt")).alias("syms"))


def _kinds(d: Column) -> Column:
    return F.least(d, F.lit(KINDS - 1)).cast("int")


def _totals(n: Column) -> Column:
    return F.least(F.floor(F.log2(F.greatest(n, F.lit(1))) * 2), F.lit(TOTALS - 1)).cast("int")


def _escapes(contexts: DataFrame) -> np.ndarray:
    """The escape of each class of a level, by (kinds, totals); a bounded table."""
    counted = contexts.where("tot > 1").groupBy(_kinds(F.col("d")).alias("i"), _totals(F.col("tot") - 1).alias("j")).agg(
        F.sum("once").alias("once"), F.sum(F.col("tot") - F.col("once")).alias("more")).toArrow()
    escaped, met = np.zeros((KINDS, TOTALS)), np.zeros((KINDS, TOTALS))
    i, j, once, more = (counted[c].to_numpy().astype(int) for c in ("i", "j", "once", "more"))
    for at in (escaped, met):
        np.add.at(at, (np.maximum(i - 1, 0), j), once)  # left out, the context has a symbol less
    np.add.at(met, (i, j), more)
    method_d = np.minimum(0.95, np.arange(KINDS)[:, None] / (2 * 2 ** (np.arange(TOTALS) / 2)))
    return np.clip((escaped + 4 * method_d) / (met + 4), 1e-6, 0.98)


def _escape(table: np.ndarray, d: Column, tot: Column) -> Column:
    held = F.split(F.lit(",".join(map(repr, table.ravel().tolist()))), ",").cast("array<double>")
    return F.element_at(held, _kinds(d) * TOTALS + _totals(tot) + 1)


def string_scores(strings: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """s, value: log10 of the probability of each string's last symbol after the others.

    ``strings`` has distinct strings s of order + 1 symbols and cnt, their training count.
    """
    level = strings
    tables, escapes = [], []
    for length in range(order, -1, -1):
        # at the top the strings to be judged stand in their contexts; below, requests join them
        made = scratch.save(_contexts(level), f"contexts{length}")
        tables.append(made)
        escapes.append(_escapes(made))
        if length:
            level = level.where("cnt > 0").groupBy(F.col("s").bitwiseAND(F.lit((1 << 8 * length) - 1)).alias("s")).agg(F.count("*").alias("cnt"))
            level = scratch.save(level, f"level{length}")
    for length in range(1, order + 1):
        scratch.drop(f"level{length}")
    e = _escape(escapes[0], F.col("d"), F.col("tot"))
    seen = F.transform(F.filter("syms", lambda x: x["cnt"] > 0), lambda x: x["sym"])
    top = tables[0].select("ctx", "tot", "d", e.alias("e"), seen.alias("above"), F.explode("syms").alias("x"))
    s = F.call_function("shiftleft", F.col("ctx"), F.lit(8)).bitwiseOR(F.col("x.sym").cast("long"))
    found = top.where("x.cnt > 0").select(s.alias("s"), F.log10((1 - F.col("e")) * F.col("x.cnt") / F.col("tot")).alias("value"))
    none = F.array().cast("array<int>")
    left = top.where("x.cnt = 0").select(s.alias("s"), F.when(F.col("d") > 0, F.log10("e")).otherwise(0.0).alias("value"), "above")
    left = scratch.save(left, f"left{order}")
    for length in range(order - 1, -1, -1):
        table = tables[order - length].select("ctx", "tot", "d", _escape(escapes[order - length], F.col("d"), F.col("tot")).alias("e"), "syms")
        # contexts of at most one byte are 257 rows of 256 symbols at most
        table = F.broadcast(table) if length < 2 else table
        asked = left.withColumn("ctx", F.shiftright("s", 8).bitwiseAND(F.lit((1 << 8 * length) - 1)))
        both = asked.join(table, "ctx", "left").withColumn("open", F.filter(F.coalesce("syms", F.array().cast("array<struct<sym:int,cnt:bigint>>")), lambda x: ~F.array_contains("above", x["sym"])))
        own = F.filter("open", lambda x: x["sym"] == F.col("s").bitwiseAND(F.lit(255)).cast("int"))
        both = both.withColumns({"cnt": F.coalesce(F.try_element_at(own, F.lit(1))["cnt"], F.lit(0).cast("long")), "rest": F.aggregate("open", F.lit(0).cast("long"), lambda t, x: t + x["cnt"])})
        both = scratch.save(both.select(
            "s", "cnt", F.when(F.col("cnt") > 0, F.col("value") + F.log10((1 - F.col("e")) * F.col("cnt") / F.col("rest"))).when(F.col("rest") > 0, F.col("value") + F.log10("e")).otherwise(F.col("value")).alias("value"),
            F.coalesce(F.transform("syms", lambda x: x["sym"]), none).alias("above")), f"asked{length}")
        found = found.unionByName(both.where("cnt > 0").select("s", "value"))
        left = both.where("cnt = 0").select("s", "value", "above")
    return found.unionByName(left.select("s", (F.col("value") - F.log10(256 - F.size("above"))).alias("value")))


class Values:
    """Values of distinct integers, in an open hash table of ``room`` that is filled and looked up by arrays."""

    def __init__(self, room: int):
        bits = max(4, int(3 * room // 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, SIGN, np.int64), np.zeros(1 << bits)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        left, at = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = self.keys[at] == SIGN
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], at[~won] + 1 & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, 0 for unknown ones."""
        at = self._first(keys)
        out = self.values[at]
        met = self.keys[at]
        left = np.flatnonzero(met != keys)
        out[left] = 0
        left = left[met[left] != SIGN]
        at = at[left]
        while len(left):
            at = at + 1 & self.mask
            met = self.keys[at]
            hit = met == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (met != SIGN)
            left, at = left[on], at[on]
        return out


NODES = "block long, n int, keys binary, nodes binary"


def _pack_nodes(batches):
    """For each block of a task's nodes (block, key, value) how many there are, their keys and
    their values; compressed, as they are most of what the last shuffle moves."""
    held, size = [], 0

    def flush():
        nodes = pa.Table.from_batches(held)
        block, key, value = (nodes[c].to_numpy() for c in ("block", "key", "value"))
        held.clear()
        order = np.argsort(block, kind="stable")
        block = block[order]
        cuts = np.append(np.flatnonzero(heads(block)), len(block))
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = order[x:y]  # a join gives keys in order, whose differences are short
            keys, values = (pa.compress(k.tobytes(), codec="zstd", asbytes=True) for k in (np.diff(key[own], prepend=0), value[own]))
            yield pa.RecordBatch.from_arrays([pa.array([block[x]], pa.int64()), pa.array([y - x], pa.int32()), pa.array([keys], pa.binary()), pa.array([values], pa.binary())], names=["block", "n", "keys", "nodes"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 1 << 20:
            yield from flush()
            size = 0
    if size:
        yield from flush()
    pa.default_memory_pool().release_unused()


def _table(packs: list[tuple[int, bytes, bytes]]) -> Values:
    """Nodes of a block, packed; ``packs`` is emptied meanwhile."""
    made = Values(sum(n for n, _, _ in packs))
    while packs:
        n, keys, values = packs.pop()
        keys, values = (pa.decompress(x, 8 * n, codec="zstd") for x in (keys, values))
        made.add(np.cumsum(np.frombuffer(keys, np.int64)), np.frombuffer(values, np.float64))
    return made


def _scores(docs: pa.RecordBatch, nodes: Values, order: int, total: int, distinct: int) -> pa.RecordBatch:
    n_tokens, n_known, base, score = [], [], [], []
    raws = docs["raw"].to_pylist()
    for a, b in _pieces(raws):
        words = [normal(text) for text in raws[a:b]]
        sizes = np.array([len(x) + 1 for x in words])
        ends = np.cumsum(sizes) - 1
        hashes = np.full(int(sizes.sum()), WORD_HASHES[END], np.uint64)
        inner = np.ones(len(hashes), bool)
        inner[ends] = False
        hashes[inner] = np.fromiter((h for x in words for h in map(WORD_HASHES.__getitem__, x)), np.uint64, int(inner.sum()))
        seen = nodes.of((hashes >> np.uint64(1)).astype(np.int64) + np.int64(SIGN))
        first = ends - sizes + 1
        n_tokens += sizes.tolist()
        n_known += np.add.reduceat((seen > 0).astype(np.int64), first).tolist()
        base += np.add.reduceat(np.log10((seen + 1) / (total + distinct + 1)), first).tolist()
        strings, starts = grams([b" ".join(x) + END for x in words], order)
        score += np.add.reduceat(nodes.of(strings), starts).tolist()
    return pa.RecordBatch.from_arrays([
        docs["doc_id"], pa.array(docs["trains"].to_numpy() == 0), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
        pa.array([total] * len(raws), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _score_blocks(order: int, total: int, distinct: int):
    """Scores of documents that come block after block, each block's packed nodes before its
    documents. A task holds one block's table and few documents, never a block's texts."""
    def run(batches):
        now, packs, nodes = None, [], None
        for batch in small(batches):
            block, is_doc = batch["block"].to_numpy(), batch["trains"].is_valid().to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(heads(block, is_doc)), len(block))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(x, y - x)
                if block[x] != now:
                    now, packs, nodes = block[x], [], None
                if not is_doc[x]:
                    packs += zip(*(part[c].to_pylist() for c in ("n", "keys", "nodes")))
                    continue
                if nodes is None:
                    nodes = _table(packs)
                yield _scores(part, nodes, order, total, distinct)
        del nodes
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages
    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, held_out: Column, order: int = 5, block_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Rows where ``held_out`` is true don't train (null counts as false). Null and empty texts are
    an end alone. Repeated rows train and are scored as often as they stand. Without training
    rows every byte has 1/256. Only doc_id, text and what ``held_out`` needs are read.
    """
    if not 1 <= order <= 6:
        raise ValueError("order is 1 to 6")
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not size["n"]:
        return spark.createDataFrame([], SCORES)
    block = _buckets(docs, "doc_id", max(1, size["n"] // max(1, -(-(size["bytes"] or 0) // block_bytes))))
    dealt = docs.select("doc_id", raw("text").alias("raw"), (~F.coalesce(held_out, F.lit(False))).cast("int").alias("trains"), block.alias("block"))
    listed = scratch.save(dealt.select("block", "trains", "raw").mapInArrow(_list_blocks(order), "block long, key long, n long"), "listed")
    counts = scratch.save(listed.groupBy("key").agg(F.sum("n").alias("cnt")), "counts")
    words = counts.where("key < 0")
    known = words.where("cnt > 0").agg(F.sum("cnt").alias("total"), F.count("*").alias("n")).first()
    scored = string_scores(counts.where("key >= 0").select(F.col("key").alias("s"), "cnt"), order, scratch)
    values = words.select("key", F.col("cnt").cast("double").alias("value")).unionByName(scored.select(F.col("s").alias("key"), "value"))
    nodes = listed.select("block", "key").join(values, "key").select("block", "key", "value").mapInArrow(_pack_nodes, NODES)
    none = lambda kind: F.lit(None).cast(kind)
    both = nodes.select("block", none("int").alias("trains"), none("long").alias("doc_id"), none("binary").alias("raw"), "n", "keys", "nodes").unionByName(
        dealt.select("block", "trains", F.col("doc_id").cast("long").alias("doc_id"), "raw", none("int").alias("n"), none("binary").alias("keys"), none("binary").alias("nodes")))
    # nodes stand first, as they have no trains
    return both.repartition("block").sortWithinPartitions("block", F.asc_nulls_first("trains")).mapInArrow(_score_blocks(order, known["total"] or 0, known["n"]), SCORES)
