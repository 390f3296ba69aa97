"""The embedding queue as state: pending, processing under a lease, completed, failed, stale.

Events of a chunk (enqueued, claimed, done, failed, retried, gone) come as a stream, late, out of
order within a batch, or twice. A row of the queue knows the time of its last event, and one that
isn't later changes nothing; a lease that has run out before an event is given back first. So what
a key ends in depends on its events and their times only, not on how they were cut into batches,
and the same fold over a table of all events gives the same queue.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "chunk_id long, strategy_id string, kind string, input_hash string, at timestamp, error string"
CHANGES = "chunk_id long, strategy_id string, input_hash string, embedding_status string, attempt_count int, changed bigint, lease bigint, error string"
#: Events of one time are taken in this order.
ORDER = {"gone": 0, "enqueued": 1, "retried": 2, "claimed": 3, "failed": 4, "done": 5}


class Fold:
    """A key's rows: input_hash to [status, attempts, changed, lease, error]; times in milliseconds."""

    def __init__(self, rows: dict[str, list], lease: int, most: int):
        self.rows, self.lease, self.most, self.touched = rows, lease, most, set()

    def _set(self, name: str, status: str, at: int, attempts: int | None = None, until: int = 0, error: str | None = None) -> None:
        row = self.rows.setdefault(name, ["", 0, 0, 0, None])
        row[:] = [status, row[1] if attempts is None else attempts, at, until, error]
        self.touched.add(name)

    def expire(self, now: int) -> None:
        """Leases that end at ``now`` or before: the row is pending again, or failed after ``most`` attempts."""
        for name, (status, attempts, _, until, _) in list(self.rows.items()):
            if status == "processing" and until <= now:
                lost = attempts >= self.most
                self._set(name, "failed" if lost else "pending", until, error="lease lost" if lost else None)

    def apply(self, kind: str, name: str | None, at: int, error: str | None) -> None:
        self.expire(at)
        if kind == "gone":
            for each, row in list(self.rows.items()):
                if at > row[2]:
                    self._set(each, "gone", at)
            return
        if name is None:
            return
        status, attempts, changed = (self.rows.get(name) or ["", 0, -1])[:3]
        if at <= changed:
            return
        if kind == "enqueued" and status in ("", "gone", "stale"):
            self._set(name, "pending", at, attempts=0)
            for other, row in list(self.rows.items()):
                if other != name and row[0] == "completed" and at > row[2]:
                    self._set(other, "stale", at)
        elif kind == "retried" and status == "failed":
            self._set(name, "pending", at)
        elif kind == "claimed" and status == "pending":
            self._set(name, "processing", at, attempts=attempts + 1, until=at + self.lease)
        elif kind == "done" and status in ("pending", "processing"):  # a result is good though its lease was lost
            self._set(name, "completed", at)
        elif kind == "failed" and status == "processing":
            self._set(name, "failed", at, error=error)

    def changes(self, key: tuple) -> pd.DataFrame:
        rows = [(*key, n, r[0], r[1], r[2], r[3], r[4]) for n in sorted(self.touched) for r in [self.rows[n]]]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in CHANGES.split(", ")])


def _events(pdf: pd.DataFrame) -> list[tuple]:
    at = (pdf["at"].astype("datetime64[ns]").astype("int64") // 1_000_000).tolist()
    some = lambda c: [None if pd.isna(x) else x for x in pdf[c]]
    found = zip(at, some("kind"), some("input_hash"), some("error"))
    return sorted((x for x in found if x[1] in ORDER), key=lambda x: (x[0], ORDER[x[1]], x[2] or "", x[3] or ""))


class Leases(StatefulProcessor):
    """A key's rows as a map; a timer for each lease and for the time when a settled key is forgotten."""

    def __init__(self, lease: int, most: int, keep: int):
        self.lease, self.most, self.keep = lease, most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "input_hash string", "status string, attempts int, changed bigint, lease bigint, error string")

    def _load(self) -> Fold:
        return Fold({k[0]: list(v) for k, v in self.rows.iterator()}, self.lease, self.most)

    def _store(self, fold: Fold) -> None:
        for name in fold.touched:
            row = fold.rows[name]
            self.rows.updateValue((name,), tuple(row))
            self.handle.registerTimer(row[3] if row[0] == "processing" else row[2] + self.keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fold = self._load()
        for event in _events(pd.concat(list(rows))):  # a key's events of one batch
            fold.apply(event[1], event[2], event[0], event[3])
        self._store(fold)
        yield fold.changes(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold, now = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        fold.expire(now)
        self._store(fold)
        for name, row in fold.rows.items():
            if row[0] in ("completed", "stale", "gone") and row[2] + self.keep <= now:
                self.rows.removeKey((name,))
        yield fold.changes(key)

    def close(self) -> None:
        pass


def lease_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, lease_s: int = 600, most: int = 3, late: str = "1 hour", keep_s: int = 30 * 86_400):
    """Runs the queue over event files (``EVENTS``) in ``source`` until what is there is done; returns
    the query. Each batch's changes are a folder of ``sink``, which a replayed batch writes anew.

    A claim holds for ``lease_s``; a row whose ``most`` attempts have been lost fails. Events later
    than ``late`` behind the newest are dropped. A row that is settled for ``keep_s`` is forgotten,
    so state is as large as what is going on and what has ended in that time; a chunk that is
    enqueued again afterwards is pending again. Null keys, kinds or times change nothing.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    events = spark.readStream.schema(EVENTS).parquet(source).where("chunk_id is not null and strategy_id is not null and at is not null").withWatermark("at", late)
    changes = events.groupBy("chunk_id", "strategy_id").transformWithStateInPandas(Leases(lease_s * 1000, most, keep_s * 1000), CHANGES, "Update", "EventTime")

    def persist(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return changes.writeStream.foreachBatch(persist).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def queue_of(changes: DataFrame) -> DataFrame:
    """The queue that changes end in: each row's last one; what is gone is no row."""
    key = ["chunk_id", "strategy_id", "input_hash"]
    last = changes.withColumn("_nth", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("changed"), F.desc("epoch")))).where("_nth = 1")
    return last.where("embedding_status != 'gone'").select(*key, "embedding_status", "attempt_count", "changed", "lease", "error")


def replayed(events: DataFrame, now_ms: int | None = None, lease_s: int = 600, most: int = 3) -> DataFrame:
    """The queue after a table of events, leases that end by ``now_ms`` given back: the same fold by
    key. A key's events are those of one chunk and strategy."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fold = Fold({}, lease_s * 1000, most)
        for event in _events(pdf):
            fold.apply(event[1], event[2], event[0], event[3])
        if now_ms is not None:
            fold.expire(now_ms)
        return fold.changes(key)

    known = events.where("chunk_id is not null and strategy_id is not null and at is not null").select(*[x.split()[0] for x in EVENTS.split(", ")])
    made = known.groupBy("chunk_id", "strategy_id").applyInPandas(lambda key, pdf: run(key, pdf), CHANGES)
    return queue_of(made.withColumn("epoch", F.lit(0)))
