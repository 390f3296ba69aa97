"""Numbers dealt by hash into parts of bounded size, packed as bytes, and found again in them.

A part is one group of a shuffle: which numbers two owners hold is answered there, for a few
bytes a number instead of a row. Parts are as many as the volume asks for, so none grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

DEALT = "part int, kind int, a binary, b binary, c binary"
KEY = 6  # bytes of a hash that are kept within a part


def part_count(volume: int, bytes_each: int = 16 << 20) -> int:
    """Parts for so many bytes of text; no fewer than 48 of a small table, for even tasks."""
    return max(1, -(-volume // bytes_each), min(48, volume >> 20))


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each 63-bit hash, by its upper half."""
    part = (hashes >> 31) * parts >> 32
    return part.astype(np.uint16) if parts < 1 << 16 else part


def packed(keys: np.ndarray, width: int = KEY) -> np.ndarray:
    """The low bytes of each integer, a row each."""
    return keys.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY, 8), np.uint8)
    out[:, :KEY] = np.frombuffer(data, np.uint8).reshape(-1, KEY)
    return out.view("<i8").ravel()


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    changed = np.zeros(len(keys[0]), bool)
    if len(changed):
        changed[0] = True
        for k in keys:
            changed[1:] |= k[1:] != k[:-1]
    return changed


def deal(part: np.ndarray, who: np.ndarray, owners: np.ndarray, records: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """A row for each part: its owners (a), how many records each has there (b), the records (c).

    ``who`` numbers the owner of each record, in ascending order; ``owners`` and ``records`` have
    a row of bytes for each.
    """
    order = np.argsort(part, kind="stable")
    part, who, records = part[order], who[order], records[order]
    cuts = np.append(np.flatnonzero(heads(part)), len(part))
    rows: list[tuple] = []
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = who[x:y]
        first = np.flatnonzero(heads(own))
        rows.append((int(part[x]), owners[own[first]].tobytes(), np.diff(np.append(first, len(own))).astype(np.int32).tobytes(), records[x:y].tobytes()))
        if len(rows) == 64 or y == len(part):
            k, a, b, c = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array([kind] * len(k), pa.int32()), *(pa.array(v, pa.binary()) for v in (a, b, c))], names=["part", "kind", "a", "b", "c"])
            rows = []


def gathered(table: pa.Table, owner_bytes: int, record_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """The owner and the record of everything that was dealt to a part, as rows of bytes."""
    a, b, c = (b"".join(table[x].to_pylist()) for x in "abc")
    owners = np.frombuffer(a, np.uint8).reshape(-1, owner_bytes)
    return np.repeat(owners, np.frombuffer(b, np.int32), axis=0), np.frombuffer(c, np.uint8).reshape(-1, record_bytes)


def longs(rows: np.ndarray) -> np.ndarray:
    """Rows of up to 8 bytes as integers."""
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view("<i8").ravel()


def held_twice(node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, key and how many nodes hold it, of the keys that two nodes hold; ordered by node."""
    order = np.lexsort((node, key))
    node, key = node[order], key[order]
    once = heads(key, node)  # a node may come from several tasks
    node, key = node[once], key[once]
    first = np.flatnonzero(heads(key))
    holders = np.diff(np.append(first, len(key)))
    many = np.repeat(holders, holders)
    node, key, many = node[many > 1], key[many > 1], many[many > 1]
    order = np.argsort(node, kind="stable")
    return node[order], key[order], many[order]


def by_owner(owner: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Each owner, and its records as bytes; owners are in ascending order."""
    cuts = np.append(np.flatnonzero(heads(owner)), len(owner))
    return owner[cuts[:-1]], [records[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
