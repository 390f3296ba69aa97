"""An object store as a Spark data source: keys and bytes, in packs that a commit makes visible.

Keys are dealt by hash into buckets, which are the partitions of a read. A task writes what it has
for a bucket into a pack of its own; the driver's commit is one small file that names the write, and
only packs of named writes are read. So a failed task or job leaves nothing that can be seen; what
it has left is removed when it fails or, where a task was killed, by ``vacuum``. The last write of a key counts; one without bytes deletes it.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import re
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: fixed value: no stored file is larger
MOST = 50 << 20
SCHEMA = "key string, content binary, size long, sha256 string"


def checked(key: str | None) -> str:
    """The key, if it stays inside the store: relative, of parts that are neither empty nor dots."""
    if not key or "\0" in key or "\\" in key or any(p in ("", ".", "..") for p in key.split("/")):
        raise ValueError(f"no key of a store: {key!r}")
    return key


def folder(path: str) -> str:
    """The local folder of a path; driver and executors see the same one (a shared mount)."""
    return re.sub(r"^file:(//)?(?=/)", "", path).rstrip("/")


def commits(root: str) -> list[dict]:
    """The writes to be read, oldest first; one that overwrites hides those before it."""
    out: list[dict] = []
    for name in sorted(glob.glob(f"{root}/_commits/*.json")):
        with open(name) as f:
            one = json.load(f)
        out = [one] if one["overwrites"] else [*out, one]
    return out


@dataclass
class Written(WriterCommitMessage):
    packs: list


@dataclass
class Bucket(InputPartition):
    number: int
    writes: list


class Reader(DataSourceReader):
    """A bucket is a task; it reads the packs' lists of keys and then the bytes of the last ones."""

    def __init__(self, root: str, buckets: int):
        self.root, self.buckets = root, buckets

    def partitions(self) -> list[InputPartition]:
        writes = [c["write"] for c in commits(self.root)]
        return [Bucket(b, writes) for b in range(self.buckets)]

    def read(self, partition: Bucket) -> Iterator[tuple]:
        last: dict[str, tuple] = {}
        for write in partition.writes:
            for name in sorted(glob.glob(f"{self.root}/b{partition.number:05d}/{write}-*.json")):
                with open(name) as f:
                    for line in f:
                        key, at, size, sha = json.loads(line)
                        last[key] = (f"{name[:-5]}.pack", at, size, sha)
        for key, (pack, at, size, sha) in sorted(last.items(), key=lambda x: x[1][:2]):
            if size is not None:
                with open(pack, "rb") as f:
                    f.seek(at)
                    content = f.read(size)
                if hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError(f"the bytes of {key} are damaged")
                yield key, content, size, sha


class Writer(DataSourceWriter):
    def __init__(self, root: str, buckets: int, overwrites: bool, names: list[str]):
        self.root, self.buckets, self.overwrites = root, buckets, overwrites
        self.write_id, self.key, self.content = uuid.uuid4().hex, names.index("key"), names.index("content")

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        task, open_packs = uuid.uuid4().hex, {}
        try:
            for row in iterator:
                key, content = checked(row[self.key]), row[self.content]
                if content is not None and len(content) > MOST:
                    raise ValueError(f"{key} has more than {MOST} bytes")
                b = zlib.crc32(key.encode()) % self.buckets
                if b not in open_packs:
                    os.makedirs(f"{self.root}/b{b:05d}", exist_ok=True)
                    base = f"{self.root}/b{b:05d}/{self.write_id}-{task}"
                    open_packs[b] = (base, open(f"{base}.pack", "wb"), open(f"{base}.json", "w"))
                _, pack, names = open_packs[b]
                at = pack.tell()
                if content is not None:
                    pack.write(content)
                names.write(json.dumps([key, at, None if content is None else len(content), None if content is None else hashlib.sha256(content).hexdigest()]) + "\n")
        except BaseException:
            for base, *files in open_packs.values():
                for f in files:
                    f.close()
                _remove(base)
            raise
        for _, *files in open_packs.values():
            for f in files:
                f.close()
        return Written([base for base, *_ in open_packs.values()])

    def commit(self, messages: list) -> None:
        """Packs of attempts that weren't the ones to count go; then the write is named."""
        good = {base for m in messages if m for base in m.packs}
        for name in glob.glob(f"{self.root}/b*/{self.write_id}-*.json"):
            if name[:-5] not in good:
                _remove(name[:-5])
        os.makedirs(f"{self.root}/_commits", exist_ok=True)
        number = len(glob.glob(f"{self.root}/_commits/*.json"))
        while True:  # two writes that end together get numbers of their own
            try:
                with open(f"{self.root}/_commits/{number:012d}.json", "x") as f:
                    json.dump({"write": self.write_id, "overwrites": self.overwrites}, f)
                return
            except FileExistsError:
                number += 1

    def abort(self, messages: list) -> None:
        for name in glob.glob(f"{self.root}/b*/{self.write_id}-*.json"):
            _remove(name[:-5])


def _remove(base: str) -> None:
    for end in (".pack", ".json"):
        try:
            os.remove(base + end)
        except FileNotFoundError:
            pass


def vacuum(path: str, older_s: float = 86_400) -> int:
    """Removes packs of writes that no commit names and that are older than a day, or so many
    seconds: those of killed tasks. Returns how many."""
    root, gone = folder(path), 0
    named = {json.load(open(name))["write"] for name in glob.glob(f"{root}/_commits/*.json")}
    for name in glob.glob(f"{root}/b*/*.pack"):
        if os.path.basename(name).split("-")[0] not in named and os.path.getmtime(name) <= time.time() - older_s:
            _remove(name[:-5])
            gone += 1
    return gone


class ObjectStore(DataSource):
    """``spark.dataSource.register(ObjectStore)``, then format ``sparkweft_store``.

    Options: path (a folder that all machines see) and buckets (64; the same for every use of a
    store). Read: key, content, size, sha256, the last write of each key, bytes verified. Write:
    key and content (null deletes); mode append adds, overwrite hides all before. A key that
    would leave the store, an empty one or more than 50 MiB fail the write, and nothing of it is seen.
    Of one key twice in a write either may count. An empty store has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "sparkweft_store"

    def schema(self) -> str:
        return SCHEMA

    def _where(self) -> tuple[str, int]:
        return folder(self.options["path"]), int(self.options.get("buckets", 64))

    def reader(self, schema) -> DataSourceReader:
        return Reader(*self._where())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(*self._where(), overwrite, schema.fieldNames())
