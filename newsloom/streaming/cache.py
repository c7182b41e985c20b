"""The analysis cache as keyed state of a stream: a value for the entry, a map for what became of its lookups.

Rows (key, at, seq, kind, content, relevant) are either set, which replaces a key's entry, or get, which
looks it up. An entry counts for TTL_DAYS of event time; one that is relevant but has no content is poor and is
thrown away when it is looked up. A timer clears an entry when it has expired, so state lasts no longer than
its entries. The state lives in RocksDB, with a checkpoint that a restarted query goes on from.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL_DAYS = 7
OUT = "key string, seq bigint, outcome string, hits bigint, misses bigint"
_DAY = 86_400_000_000
_STORE = "spark.sql.streaming.stateStore.providerClass"


def _micros(at) -> int:
    return int(at.timestamp() * 1_000_000)


class CacheProcessor(StatefulProcessor):
    """Outcome of each lookup in the order of (at, seq): hit, miss (no entry), expired or poor; with the key's hits and misses so far."""

    def __init__(self, days: int = TTL_DAYS):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "created bigint, good boolean")
        self.counts = handle.getMapState("counts", "outcome string", "n bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # each call of the state is a round trip to the executor: a key's is read once and written once for all its rows of a batch
        before = held = self.entry.get()
        counts = {outcome[0]: n[0] for outcome, n in self.counts.iterator()}
        counted = dict(counts)
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            at = _micros(r["at"])
            if r["kind"] == "set":
                held = (at, bool(not r["relevant"] or r["content"]))
                continue
            if held is None:
                outcome = "miss"
            else:
                outcome = "expired" if at - held[0] > self.days * _DAY else "hit" if held[1] else "poor"
                held = held if outcome == "hit" else None
            counts[outcome] = counts.get(outcome, 0) + 1
            hits = counts.get("hit", 0)
            yield Row(key=key[0], seq=r["seq"], outcome=outcome, hits=hits, misses=sum(counts.values()) - hits)
        for outcome, n in counts.items():
            if n != counted.get(outcome):
                self.counts.updateValue((outcome,), (n,))
        if held is None and before is not None:
            self.entry.clear()
        elif held is not None and held != before:
            self.entry.update(held)
            self.handle.registerTimer(held[0] // 1000 + self.days * _DAY // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.entry.get()
        if held is not None and held[0] + self.days * _DAY < timerValues.getCurrentWatermarkInMs() * 1000:
            self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def lookups(operations: DataFrame, days: int = TTL_DAYS, late: str = "1 hour") -> DataFrame:
    """(key, seq, outcome, hits, misses) of the stream's lookups."""
    keyed = operations.withWatermark("at", late).groupBy("key")
    return keyed.transformWithState(CacheProcessor(days), OUT, "Append", "eventtime")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Within it streaming state is kept in RocksDB, which this kind of state needs."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)
