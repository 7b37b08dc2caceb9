"""Decisions in event time: rows of a key wait until the watermark has passed them, then are decided in order.

Keys are dealt into buckets by hash, so state is read and written for many keys at once. The state of a bucket is the
list of its waiting rows and, key by key, the memory of the decisions so far. A timer stands at the earliest waiting
second; when the watermark passes it, the rows of all finished seconds are sorted and decided, whatever order they
arrived in. A memory that can't influence later rows ends by a timer too, so silent keys leave no state. Rows that
arrive when the watermark has reached them are dropped by the engine and counted in the stream's progress.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: microseconds of event time of a held row
AT = "at_micros"
BUCKETS = 1024


@dataclass(frozen=True)
class Decisions:
    """What a key remembers and how a row is decided.

    ``step(memory, row)`` returns the new memory and the output values or None; ``order`` sorts finished rows;
    ``ends(memory)`` is the event time in milliseconds from which the memory is as good as none (None: never).
    """

    start: tuple
    step: Callable[[tuple, Any], tuple[tuple, tuple | None]]
    order: Callable[[Any], tuple]
    ends: Callable[[tuple], int | None] = lambda memory: None


def _finished(at: int) -> int:
    """Millisecond at which the second of a row is over."""
    return (at // 1_000_000 + 1) * 1000


class InTimeOrder(StatefulProcessor):
    def __init__(
        self, rules: Decisions, keys: Sequence[str], held: T.StructType, memory: T.StructType, names: Sequence[str]
    ) -> None:
        self.rules, self.keys, self.held, self.kept, self.names = rules, list(keys), held, memory, list(names)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.held)
        self.memory = handle.getListState("memory", self.kept)

    def _wake(self, at: int) -> None:
        """One timer a bucket, the earliest that is needed."""
        standing = list(self.handle.listTimers())
        if standing and min(standing) <= at:
            return
        for late in standing:
            self.handle.deleteTimer(late)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        fields = self.held.names
        first, chunk = None, []
        for row in rows:
            end = _finished(row[AT])
            first = end if first is None else min(first, end)
            chunk.append(tuple(row[f] for f in fields))
            if len(chunk) >= 4096:
                self.waiting.appendList(chunk)
                chunk = []
        if chunk:
            self.waiting.appendList(chunk)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        named, told_row = Row(*self.held.names), Row(*self.names)
        at, n_keys = self.held.names.index(AT), len(self.keys)
        spots = [self.held.names.index(k) for k in self.keys]
        due, left = [], []
        for row in self.waiting.get():
            (due if _finished(row[at]) <= mark else left).append(tuple(row))
        memories = {tuple(m[:n_keys]): tuple(m[n_keys:]) for m in self.memory.get()}
        had = bool(memories)
        due = sorted((named(*row) for row in due), key=self.rules.order)
        for row in due:
            who = tuple(row[i] for i in spots)
            memory, told = self.rules.step(memories.get(who, self.rules.start), row)
            memories[who] = memory
            if told is not None:
                yield told_row(*who, *told)
        wakes, live = [], []
        for who, memory in memories.items():
            end = self.rules.ends(memory)
            if memory == self.rules.start or (end is not None and end <= mark):
                continue
            live.append((*who, *memory))
            if end is not None:
                wakes.append(end)
        if due:
            self._replace(self.waiting, left)
        if live or had:
            self._replace(self.memory, live)
        wakes.extend(_finished(row[at]) for row in left)
        if wakes:
            self.handle.registerTimer(min(wakes))

    @staticmethod
    def _replace(state, rows: list[tuple]) -> None:
        state.clear()
        for i in range(0, len(rows), 4096):
            state.appendList(rows[i : i + 4096])

    def close(self) -> None:
        pass


def needs_rocks(spark: SparkSession) -> None:
    """List states and timers need the RocksDB state store; the session's later streams use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def decide_in_order(
    rows: DataFrame,
    keys: Sequence[str],
    ts: str,
    delay: str,
    rules: Decisions,
    memory: T.StructType | str,
    out: T.StructType,
    waits: Column | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Apply ``rules`` to a stream by key. ``rows`` has the keys, the event time ``ts`` and what the rules look at.

    Rows for which ``waits`` does not hold move the watermark and are left out otherwise. ``out`` starts with the keys. Rows without a time can't be put in order and are left out. A task holds the waiting
    rows of one of ``buckets`` buckets at a time; the number is part of the state and stays for a stream's life.
    """
    needs_rocks(rows.sparkSession)
    timed = rows.withColumn("__time", F.col(ts).cast("timestamp")).withWatermark("__time", delay)
    # a filter that does not look at the event time would be pushed below the watermark
    timed = timed.where((F.col("__time") if waits is None else F.when(waits, F.col("__time"))).isNotNull())
    timed = timed.withColumn(AT, F.unix_micros("__time"))
    held = T.StructType([f for f in timed.schema.fields if f.name not in ("__time", ts) or f.name == AT])
    kind = memory if isinstance(memory, T.StructType) else T.StructType.fromDDL(memory)
    kept = T.StructType([*[timed.schema[k] for k in keys], *kind.fields])
    processor = InTimeOrder(rules, keys, held, kept, out.names)
    dealt = timed.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    return dealt.groupBy("__bucket").transformWithState(processor, out, "append", "EventTime")
