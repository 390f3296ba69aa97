"""Long repeats across documents by recompression, and their removal.

Words are symbols. A level names maximal runs of one symbol, then pairs: a bit of a symbol's name
and the level say whether it opens or closes a pair, so each symbol has one choice that doesn't
depend on where it stands. A name is a hash of what it stands for, so all documents give equal
strings equal names. A Spark round then settles what a level's names mean for the whole corpus:
names are dealt into parts, a part tells which of them stand in two texts, and only stretches of
text made of such names go to the next round, which names longer symbols in them.

Borders. A passage is parsed alike wherever it stands but for its borders. From a border inwards
a level leaves open the first run, as it may go on outside, and then the first symbol if it can
pair with one outside (a closer at the left border, an opener at the right one). Every position
carries how far this reaches, level by level, so the inner symbols of a window are exactly those
that each of its occurrences has.

1. Rounds: windows whose inner symbols are all shared stay; a window without one is one symbol.
2. What is left is verified by the words of whole windows: their hashes (at least 112 bits) are
   dealt into parts, and a part knows the smallest document in which each window starts.
3. Words under a window that starts in a smaller document go.

A text is analysed once, for the smallest document that has it; other copies are marked by its
digest. A window that very many documents have is known from a sample, its smallest document is
a minimum that tasks combine, and it isn't dealt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_HASHES, Scratch, raw, small
from .parts import DEALT, KEY, by_owner, deal, gathered, heads, held_twice, longs, packed, part_count, part_of, unpacked

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
BASES = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD1342543DE82EF95))
HELD = 1 << 19  # numbers that a task holds before it deals them out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M2
    x = (x ^ (x >> np.uint64(29))) * M3
    return x ^ (x >> np.uint64(32))


class Parse:
    """Symbols of some levels over texts that stand end to end.

    ``low[a]`` is the first symbol that is sure to be the same for whatever stands before word a,
    ``high[b]`` the one after the last that is for whatever stands from word b on.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        self.names, self.owner, self.level = words, owner, 0
        self.begin = np.arange(len(words))
        self.end = self.begin + 1
        self.low, self.high = np.arange(len(words) + 1), np.arange(len(words) + 1)

    def up(self) -> None:
        r, m = self.level, len(self.names)
        self.level += 1
        if not m:
            return
        # runs: maximal ones of one name become one symbol
        head = heads(self.names, self.owner)
        at = np.flatnonzero(head)
        group = np.append(np.cumsum(head) - 1, len(at))
        last = np.append(at[1:], m) - 1
        names = np.where(last > at, mixed(self.names[at] * M1 + np.uint64(2 * r + 1) + mixed((last - at).astype(np.uint64))), self.names[at])
        owner, begin, end = self.owner[at], self.begin[at], self.end[last]
        low = np.minimum(group[self.low] + 1, len(at))
        high = np.where(self.high > 0, group[np.maximum(self.high, 1) - 1], 0)
        # pairs: an opener before a closer
        opens = (mixed(names + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
        pair = np.flatnonzero(opens[:-1] & ~opens[1:] & (owner[1:] == owner[:-1]))
        keep = np.ones(len(names), bool)
        keep[pair + 1] = False
        place = np.append(np.cumsum(keep) - 1, int(keep.sum()))
        closes = np.append(~opens, False)
        self.low = place[low] + closes[low]
        before = np.maximum(high, 1) - 1
        self.high = np.where(high > 0, place[before] + closes[before], 0)
        names[pair] = mixed(names[pair] * M1 + mixed(names[pair + 1] + np.uint64(2 * r)))
        end[pair] = end[pair + 1]
        self.names, self.owner, self.begin, self.end = names[keep], owner[keep], begin[keep], end[keep]


def window_hashes(names: np.ndarray, window: int, bases: tuple = BASES) -> list[np.ndarray]:
    """64-bit hashes of the words of the window that starts at each position (if it fits).

    Windows are built by doubling: a hash of 2n words is made of two of n words.
    """
    if len(names) < window:
        return [np.zeros(0, np.uint64)] * len(bases)
    out = []
    for base in bases:
        power, done, made, span = mixed(names ^ base), 0, None, 1
        rest = window
        while rest:
            if rest & 1:
                part = power[done:]
                made = part if made is None else mixed(made[: len(part)] * M1 + part)
                done += span
            rest >>= 1
            if rest:
                power = mixed(power[:-span] * M3 + power[span:] * M1 + base)
                span *= 2
        out.append(made[: len(names) - window + 1])
    return out


class Batch:
    """Texts' words end to end; texts that are shorter than a window are left out of all results."""

    def __init__(self, texts: list[bytes], window: int):
        self.words, self.window = [text.split() for text in texts], window
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.owner = np.repeat(np.arange(len(texts)), self.size)
        self.base = np.fromiter((h for x in self.words for h in map(WORD_HASHES.__getitem__, x)), np.uint64, int(self.size.sum()))
        self.fits = np.arange(len(self.base)) <= np.repeat(self.first + self.size - window, self.size)

    def symbols(self, level: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names and texts of a level's symbols of at least ``least`` words; each window's start and
        which of these symbols are inside it (from, to). A window without any is one itself."""
        made = Parse(self.base, self.owner)
        while made.level < level:
            made.up()
        counts = (made.end - made.begin >= least) & (self.size[made.owner] >= self.window) if len(made.names) else np.zeros(0, bool)
        nth = np.concatenate([[0], np.cumsum(counts)])
        names, owner, starts = made.names[counts], made.owner[counts], np.flatnonzero(self.fits)
        low, high = nth[made.low[starts]], nth[made.high[starts + self.window]]
        alone = np.flatnonzero(high <= low)
        if len(alone):
            own = window_hashes(self.base, self.window, BASES[:1])[0][starts[alone]]
            low[alone] = len(names) + np.arange(len(alone))
            high[alone] = low[alone] + 1
            names, owner = np.concatenate([names, own]), np.concatenate([owner, self.owner[starts[alone]]])
        return names, owner, starts, low, high

    def kept(self, level: int, least: int, shared: np.ndarray) -> np.ndarray:
        """Which windows' inner symbols are all shared, by start."""
        names, _, starts, low, high = self.symbols(level, least)
        off = np.concatenate([[0], np.cumsum(~np.isin(name_keys(names), shared))])
        out = np.zeros(len(self.base), bool)
        out[starts] = off[high] == off[low]
        return out


def name_keys(names: np.ndarray) -> np.ndarray:
    """Names as they come back from their part."""
    return ((names >> np.uint64(1)) & np.uint64((1 << 8 * KEY) - 1)).astype(np.int64)


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie under a window that starts at one of ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return np.cumsum(change)[:n] > 0


def _runs_of(texts: list[bytes], size: int = 2 << 20):
    """Slices of about ``size`` bytes of texts."""
    begin, held = 0, 0
    for k, x in enumerate(texts):
        held += len(x)
        if held >= size:
            yield slice(begin, k + 1)
            begin, held = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _deal_names(window: int, level: int, least: int, parts: int):
    """The names of a level's symbols, by part; a text that a task meets again isn't dealt again."""
    def run(batches):
        met: set[int] = set()
        nodes, sets, held = [], [], 0

        def flush():
            flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            yield from deal(part_of(flat, parts), who, np.array(nodes, np.int64).view(np.uint8).reshape(-1, 8), packed(flat), 0)
            nodes.clear()
            sets.clear()

        for batch in small(batches):
            texts, keys, again = batch["raw"].to_pylist(), batch["k"].to_pylist(), batch["piece"].to_pylist()
            fresh = [j for j, x in enumerate(zip(keys, again)) if x not in met]
            met.update((keys[j], again[j]) for j in fresh)
            texts, keys = [texts[j] for j in fresh], [keys[j] for j in fresh]
            for part in _runs_of(texts):
                own = Batch(texts[part], window)
                names, who, *_ = own.symbols(level, least)
                flat = (names >> np.uint64(1)).astype(np.int64)
                order = np.lexsort((flat, who))
                order = order[heads(who[order], flat[order])]
                if len(order):
                    cuts = np.append(np.flatnonzero(heads(who[order])), len(order))
                    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        nodes.append(keys[part][who[order[x]]])
                        sets.append(flat[order[x:y]])
                    held += len(order)
                if held >= HELD:
                    yield from flush()
                    held = 0
        if sets:
            yield from flush()
    return run


def _shared_names(table: pa.Table) -> pa.Table:
    """k and the names of this part that stand in its text and in another."""
    owners, records = gathered(table, 8, KEY)
    node, key, _ = held_twice(longs(owners), longs(records))
    own, keys = by_owner(node, packed(key)) if len(node) else (node, [])
    return pa.table({"k": pa.array(own, pa.int64()), "names": pa.array(keys, pa.binary())})


def _stretches(window: int, level: int, least: int):
    """Pieces (words, with the place of the first in the document) under windows that stay."""
    def run(batches):
        for batch in small(batches):
            texts, ids, keys, at, names = (batch[c].to_pylist() for c in ("raw", "doc_id", "k", "at", "names"))
            for part in _runs_of(texts):
                own = Batch(texts[part], window)
                shared = np.unique(unpacked(b"".join(x for l in names[part] for x in l)))
                stay = own.kept(level, least, shared)
                cover = covered(len(stay), np.flatnonzero(stay), window)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (cover * (own.owner + 1)), [0]])) != 0)
                rows = []
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    if cover[x]:
                        doc = int(own.owner[x])
                        begin = x - int(own.first[doc])
                        rows.append((ids[part][doc], keys[part][doc], at[part][doc] + begin, b" ".join(own.words[doc][begin : begin + y - x])))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=["doc_id", "k", "at", "raw"])
    return run


PIECES = "doc_id long, k long, at int, raw binary"


def _each_window(batches, window: int):
    """Of pieces, in slices: ids, keys, and of each window its piece, hashes and place."""
    for batch in small(batches):
        texts, ids, keys, at = batch["raw"].to_pylist(), batch["doc_id"].to_numpy(), batch["k"].to_numpy(), batch["at"].to_numpy()
        for part in _runs_of(texts, 1 << 19):
            own = Batch(texts[part], window)
            start = np.flatnonzero(own.fits)
            if len(start):
                h, check = (x[start] for x in window_hashes(own.base, window))
                doc = own.owner[start]
                yield ids[part], keys[part], doc, (h >> np.uint64(1)).astype(np.int64), check.view(np.int64), (start - own.first[doc] + at[part][doc]).astype(np.int32)


def _sampled(window: int):
    def run(batches):
        for ids, _, doc, h, check, _ in _each_window(batches, window):
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(h), pa.array(check)], names=["doc_id", "h", "c"])
    return run


def _among(h: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in a sorted list, and whether they are there."""
    if not len(hot):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    return at, hot[at] == h


def _hot_least(window: int, hot):
    """h, c and the smallest doc_id of a task's hot windows."""
    def run(batches):
        least: dict[tuple[int, int], int] = {}
        for ids, _, doc, h, check, _ in _each_window(batches, window):
            there = _among(h, hot.value)[1]
            for x, c, d in zip(h[there].tolist(), check[there].tolist(), ids[doc[there]].tolist()):
                if least.get((x, c), d) >= d:
                    least[x, c] = d
        if least:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in least], pa.int64()), pa.array([c for _, c in least], pa.int64()), pa.array([*least.values()], pa.int64())], names=["h", "c", "lo"])
    return run


OWNER = np.dtype([("doc_id", "<i8"), ("k", "<i8")])
WINDOW = np.dtype([("h", "u1", KEY), ("c", "<i8"), ("start", "<i4")])
MARKS = "doc_id long, k long, starts binary"


def _deal_windows(window: int, parts: int, known):
    """Windows by part (kind 0). Hot ones are judged at once: a row of kind 1 has their starts."""
    def run(batches):
        hot, check_of, least = known.value
        owners, who, hashes, rest, held, base = [], [], [], [], 0, 0

        def flush():
            nonlocal base
            own = np.concatenate(owners).view(np.uint8).reshape(-1, OWNER.itemsize)
            records = np.concatenate(rest).view(np.uint8).reshape(-1, WINDOW.itemsize)
            yield from deal(part_of(np.concatenate(hashes), parts), np.concatenate(who), own, records, 0)
            for x in (owners, who, hashes, rest):
                x.clear()
            base = 0

        for ids, keys, doc, h, check, start in _each_window(batches, window):
            at, there = _among(h, hot)
            if there.any():
                same = np.flatnonzero(there)
                same = same[check_of[at[same]] == check[same]]  # another check: dealt as all others
                there = np.zeros(len(h), bool)
                there[same] = True
                gone = same[least[at[same]] < ids[doc[same]]]
                if len(gone):
                    which, starts = by_owner(doc[gone], start[gone])
                    m = len(which)
                    yield pa.RecordBatch.from_arrays([
                        pa.array((keys[which] % parts).astype(np.int32)), pa.array([1] * m, pa.int32()), pa.array([ids[k].tobytes() for k in which], pa.binary()),
                        pa.array([keys[k].tobytes() for k in which], pa.binary()), pa.array(starts, pa.binary())], names=["part", "kind", "a", "b", "c"])
            own = np.zeros(len(ids), OWNER)
            own["doc_id"], own["k"] = ids, keys
            row = np.zeros(int((~there).sum()), WINDOW)
            row["h"], row["c"], row["start"] = packed(h[~there]), check[~there], start[~there]
            owners.append(own)
            who.append(doc[~there] + base)
            hashes.append(h[~there])
            rest.append(row)
            base += len(ids)
            held += len(row)
            if held >= HELD:
                yield from flush()
                held = 0
        if held:
            yield from flush()
    return run


def _judge(table: pa.Table) -> pa.Table:
    """Starts of the windows that a smaller document has too."""
    kind = table["kind"].to_numpy()
    out = [pa.table({"doc_id": pa.array([], pa.int64()), "k": pa.array([], pa.int64()), "starts": pa.array([], pa.binary())})]
    known = table.filter(pa.array(kind == 1))
    if known.num_rows:
        a, b = (np.frombuffer(b"".join(known[x].to_pylist()), np.int64) for x in "ab")
        out.append(pa.table({"doc_id": pa.array(a), "k": pa.array(b), "starts": known["c"].combine_chunks()}))
    dealt = table.filter(pa.array(kind == 0))
    if dealt.num_rows:
        owners, records = gathered(dealt, OWNER.itemsize, WINDOW.itemsize)
        own, row = owners.reshape(-1).view(OWNER), records.reshape(-1).view(WINDOW)
        h = longs(row["h"])
        order = np.lexsort((own["doc_id"], row["c"], h))
        h, c, doc = h[order], row["c"][order], own["doc_id"][order]
        first = heads(h, c)
        least = doc[np.flatnonzero(first)][np.cumsum(first) - 1]
        gone = order[doc > least]
        if len(gone):
            order = np.lexsort((own["k"][gone], own["doc_id"][gone]))
            gone = gone[order]
            d, k, start = own["doc_id"][gone], own["k"][gone], row["start"][gone].astype("<i4")
            cuts = np.append(np.flatnonzero(heads(d, k)), len(gone))
            out.append(pa.table({"doc_id": pa.array(d[cuts[:-1]]), "k": pa.array(k[cuts[:-1]]), "starts": pa.array([start[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())}))
    return pa.concat_tables(out)


def _cut(window: int, kept_row: bool):
    def run(batches):
        for batch in small(batches):
            n_words, n_removed, digest, texts = [], [], [], []
            for text, starts, is_copy in zip(batch["raw"].to_pylist(), batch["starts"].to_pylist(), batch["is_copy"].to_pylist()):
                words = text.split()
                kept = words
                if is_copy and len(words) >= window:
                    kept = []
                elif starts:
                    at = np.frombuffer(b"".join(starts), "<i4")
                    gone = covered(len(words), at, window)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(joined).hexdigest())
                texts.append((joined if len(kept) < len(words) else text).decode())
            cols = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            cols = {"row": batch["row"]} | cols | {"kept": pa.array(texts, pa.string())} if kept_row else {"doc_id": batch["doc_id"]} | cols
            yield pa.RecordBatch.from_arrays([*cols.values()], names=[*cols])
    return run


def copies(docs: DataFrame) -> DataFrame:
    """doc_id and k of rows whose whole text a smaller doc_id has too."""
    marked = docs.select("doc_id", "k", F.md5("raw").alias("text_key"))
    first = marked.groupBy("text_key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("text_key", "lo")
    return marked.join(first, "text_key").where("doc_id > lo").select("doc_id", "k").distinct()


def repeated_windows(docs: DataFrame, scratch: Scratch, window: int, levels: tuple[int, ...], least: int, sample: int) -> DataFrame:
    """doc_id, k, starts (packed), is_copy: one row for each text that loses words.

    ``docs`` has doc_id (never null), k (a hash of the text) and raw.
    """
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    lows = docs.groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    pieces, parts = None, part_count(volume)
    for nth, level in enumerate(levels):
        named = (docs.select("k", "raw", F.lit(0).alias("piece")) if pieces is None else pieces.select("k", "raw", F.col("at").alias("piece"))).mapInArrow(_deal_names(window, level, least, parts), DEALT)
        shared = named.groupBy("part").applyInArrow(_shared_names, "k long, names binary").groupBy("k").agg(F.collect_list("names").alias("names"))
        if pieces is None:
            of = docs.join(shared.join(lows, "k"), ["doc_id", "k"]).select("doc_id", "k", F.lit(0).alias("at"), "raw", "names")
        else:
            of = pieces.join(shared, "k").select("doc_id", "k", "at", "raw", "names")
        pieces = scratch.save(of.mapInArrow(_stretches(window, level, least), PIECES), f"pieces{nth}")
    parts = part_count(pieces.agg(F.sum(F.octet_length("raw"))).first()[0] or 0, 8 << 20)
    some = pieces.where(F.pmod(F.xxhash64("doc_id"), F.lit(-(-max(1, pieces.count()) // sample))) == 0).mapInArrow(_sampled(window), "doc_id long, h long, c long")
    often = some.distinct().groupBy("h").agg(F.count("*").alias("n")).where("n >= 8").select("h").toArrow()["h"].to_numpy()
    hot = np.sort(often)
    if len(hot):
        made = pieces.mapInArrow(_hot_least(window, spark.sparkContext.broadcast(hot)), "h long, c long, lo long").groupBy("h", "c").agg(F.min("lo").alias("lo"))
        made = made.groupBy("h").agg(F.min_by(F.struct("c", "lo"), "c").alias("x")).select("h", "x.c", "x.lo").orderBy("h").toArrow()  # as many rows as the sample's hot windows
        known = tuple(made[x].to_numpy() for x in ("h", "c", "lo"))
    else:
        known = (np.zeros(0, np.int64),) * 3
    dealt = pieces.mapInArrow(_deal_windows(window, parts, spark.sparkContext.broadcast(known)), DEALT)
    found = scratch.save(dealt.groupBy("part").applyInArrow(_judge, MARKS), "found")
    for nth in range(len(levels)):
        scratch.drop(f"pieces{nth}")
    both = found.withColumn("is_copy", F.lit(False)).unionByName(copies(docs).withColumns({"starts": F.lit(None).cast("binary"), "is_copy": F.lit(True)}))
    return both.groupBy("doc_id", "k").agg(F.collect_list("starts").alias("starts"), F.max("is_copy").alias("is_copy"))


def remove_repeats(docs: DataFrame, window: int = 50, levels: tuple[int, ...] = (3, 4), least: int = 4, texts: bool = False, sample: int = 4096) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; with ``texts`` its row
    (without the text, but with text_is_null) and kept text, the text as it was where no word goes.

    A word goes if it lies under a window of ``window`` words of its document whose words also
    start in a document of a smaller doc_id; windows are judged on the input. Null and empty
    texts have no words; documents shorter than a window keep all. Rows of equal doc_id are judged
    each by its own text, and not against each other. A row without an id keeps all its words and
    removes none. No rows, no result. With ``texts`` the columns of ``docs`` come back as struct
    ``row``, so clashing names don't matter. ``levels`` are the rounds' levels and ``least`` the
    words of the shortest symbol that counts, ``sample`` from how many pieces hot windows are
    known; none of them changes results.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw("text").alias("raw")).withColumn("k", F.xxhash64("raw"))
    marks = repeated_windows(own.where("doc_id is not null"), Scratch(docs.sparkSession, "recompression"), window, levels, least, sample)
    if texts:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw("text").alias("raw"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").isNull().alias("text_is_null")).alias("row")).withColumn("k", F.xxhash64("raw"))
        kind = next(f.dataType.simpleString() for f in rows.schema if f.name == "row")
        return rows.join(marks, ["doc_id", "k"], "left").select("row", "raw", "starts", "is_copy").mapInArrow(_cut(window, True), f"row {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    return own.join(marks, ["doc_id", "k"], "left").select("doc_id", "raw", "starts", "is_copy").mapInArrow(_cut(window, False), "doc_id long, n_words long, n_removed long, kept_sha256 string")
