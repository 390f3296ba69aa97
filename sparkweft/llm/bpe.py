"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern and every piece is merged on its own: the pair of
neighbours with the lowest rank goes first, the leftmost of equals. A segment tree over byte
positions holds the minimum rank of the pair that starts at each live position; a merge takes
the root's leftmost minimum and updates the positions of its live neighbours, so a piece of n
bytes takes O(n log n) however long it is. Short pieces that a worker hasn't met go through
their trees side by side, as rows of one array; it keeps what they became, up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows

NONE = 1 << 40


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    width = 1 << max(0, (n - 1).bit_length())
    tree = [NONE] * (2 * width)
    get = ranks.get
    for k in range(n - 1):
        tree[width + k] = get(piece[k : k + 2], NONE)
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(k: int, rank: int) -> None:
        k += width
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while (low := tree[1]) < NONE:
        k = 1
        while k < width:
            k = 2 * k if tree[2 * k] == low else 2 * k + 1
        at = k - width
        gone = after[at]
        end = after[gone]
        after[at] = end
        if end < n:
            before[end] = at
            put(at, get(piece[at : after[end]], NONE))
        else:
            put(at, NONE)
        put(gone, NONE)
        if (left := before[at]) >= 0:
            put(left, get(piece[left:end], NONE))
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k : after[k]]])
        k = after[k]
    return out


class Coder(dict):
    """Piece to the bytes of its ids, little-endian; holds up to ``most`` short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 300_000, short: int = 64):
        super().__init__()
        self.ranks, self.split, self.most, self.short = ranks, regex.compile(pattern).findall, most, short
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        pairs = sorted((ranks[t[:k]] << 32 | ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.pairs = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.merged = np.array([r for _, r in pairs] or [NONE], np.int64)
        self.bytes = np.array([ranks.get(bytes([k]), 0) for k in range(256)], np.int64)

    def __missing__(self, piece: str) -> bytes:
        ids = merge(piece.encode(), self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of neighbouring ids, NONE where they don't merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], NONE)

    def learn(self, pieces: list[str]) -> None:
        """Merges short pieces side by side, by the width of their trees."""
        if len(self) + len(pieces) > self.most:
            self.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            if (whole := self.ranks.get(data)) is not None:
                self[piece] = struct.pack("<I", whole)
            elif len(data) <= self.short:
                by_width.setdefault(1 << (len(data) - 1).bit_length(), []).append((piece, data))
        for width, group in by_width.items():
            for k in range(0, len(group), 8192):
                part = group[k : k + 8192]
                self.update(zip((p for p, _ in part), self._side_by_side([d for _, d in part], width)))

    def _side_by_side(self, pieces: list[bytes], width: int) -> list[bytes]:
        m = len(pieces)
        text = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(m, width)
        size = np.array([len(x) for x in pieces])
        place = np.arange(width)
        ids, live = self.bytes[text], place < size[:, None]
        after, before = np.tile(place + 1, (m, 1)), np.tile(place - 1, (m, 1))
        tree = np.full((m, 2 * width), NONE, np.int64)
        tree[:, width : 2 * width - 1] = np.where(live[:, 1:], self.rank_of(ids[:, :-1], ids[:, 1:]), NONE)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(rows: np.ndarray, k: np.ndarray, rank) -> None:
            k = k + width
            tree[rows, k] = rank
            for _ in range(width.bit_length() - 1):
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            low, k = tree[rows, 1], np.ones(len(rows), np.int64)
            for _ in range(width.bit_length() - 1):
                k = 2 * k + (tree[rows, 2 * k] != low)
            at = k - width
            gone = after[rows, at]
            end = after[rows, gone]
            ids[rows, at], after[rows, at], live[rows, gone] = low, end, False
            put(rows, gone, NONE)
            more = end < size[rows]
            rank = np.full(len(rows), NONE, np.int64)
            r, a, e = rows[more], at[more], end[more]
            before[r, e] = a
            rank[more] = self.rank_of(ids[r, a], ids[r, e])
            put(rows, at, rank)
            left = before[rows, at]
            r, a, b = rows[left >= 0], at[left >= 0], left[left >= 0]
            put(r, b, self.rank_of(ids[r, b], ids[r, a]))
            rows = rows[tree[rows, 1] < NONE]
        flat, ends = ids[live].astype("<u4").tobytes(), np.cumsum(live.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cut = [self.split(text) for text in texts]
        new = {piece for pieces in cut for piece in pieces if piece not in self}
        if new:
            self.learn(list(new))
        return [b"".join(map(self.__getitem__, pieces)) for pieces in cut]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_coders: dict[tuple[str, str], Coder] = {}


def coder_of(path: str, pattern: str, held) -> Coder:
    """The coder of this Python worker; its tasks share what it has merged."""
    if (path, pattern) not in _coders:
        _coders.clear()
        _coders[path, pattern] = Coder(held.value, pattern)
    return _coders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` the ids as little-endian
    unsigned 32-bit integers.

    Null texts count as empty: no tokens. Repeated rows stay. The ranks, a file of fixed size
    that doesn't grow with the data, are broadcast once; texts that the pattern leaves gaps in
    lose those gaps, as with any tokenizer of that pattern.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(read_ranks(spark, path))

    def run(batch):
        coder = coder_of(path, pattern, held)
        out = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if ids else {})
        for packed in coder.encode_all(batch["text"].to_pylist()):
            out["n_tokens"].append(len(packed) // 4)
            out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(coder.decode(packed)).hexdigest())
            if ids:
                out["ids"].append(packed)
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if ids else "")
    return map_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), schema, run)
