"""States, transitions and periods of a stream of machine readings, in event-time order.

Rows of a machine may come late and out of order, up to the watermark's delay.  They wait in the state store by
bucket of event time: each Arrow chunk's share of a bucket is one entry, so taking rows in neither reads nor rewrites
what is there, and a worker holds a chunk.  A timer at the end of a bucket fires when the watermark has passed it, that
is when all of its rows have come; then, and only then, a bucket is read, ordered by (timestamp, ordinal) and handed
to the tracker, bucket after bucket.  What stays of a machine is its latest reading of each state signal, its state
and when it was entered.  A worker's memory is that of one machine's bucket, whatever the size of a micro-batch.

The result equals the batch operators' over all rows that weren't too late.  Rows later than the watermark are
dropped by Spark, rows without a timestamp are not taken.  The rows of the last buckets come out when later rows move the
watermark on.  A machine's last open period isn't given out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import fold
from ..operators.state import STATE_SIGNALS

#: kind: state (one for each row), transition or period; a state's and a transition's moment is started_at.
OUTPUT = "machine_id string, kind string, previous_state string, state string, started_at timestamp, ended_at timestamp, ordinal bigint"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
_ROWS = "at array<bigint>, ordinal array<bigint>, state array<string>, slot array<int>, flag array<boolean>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKET_MINUTES = 60


def state_of(running: bool | None, idle: bool | None, fault: bool | None) -> str:
    return "Fault" if fault else "Running" if running else "Idle" if idle else "Unknown" if running is None else "Stopped"


class MachineTracker(StatefulProcessor):
    """Rows (machine_id, at, ordinal, state, slot, flag): a state, or a reading of the signal at that place of STATE_SIGNALS
    (-1: of another). kinds are what is given out."""

    def __init__(self, minutes: int, kinds: tuple[str, ...]):
        self.width, self.kinds = minutes * 60_000_000, set(kinds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint, chunk int", _ROWS)
        self.chunks = handle.getMapState("chunks", "bucket bigint", "n int")
        self.machine = handle.getValueState("machine", "state string, since bigint, flags array<boolean>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            chunk = chunk.sort_values(["at", "ordinal"], kind="stable")
            for bucket, own in chunk.groupby(chunk["at"] // self.width, sort=False):
                bucket = int(bucket)
                n = self.chunks.getValue((bucket,))[0] if self.chunks.containsKey((bucket,)) else 0
                columns = [own["at"].tolist(), own["ordinal"].tolist(), own["state"].tolist(), own["slot"].tolist(), [None if pd.isna(x) else bool(x) for x in own["flag"]]]
                self.waiting.updateValue((bucket, n), tuple(columns))
                self.chunks.updateValue((bucket,), (n + 1,))
                if n == 0:
                    self.handle.registerTimer((bucket + 1) * self.width // 1000)
        yield pd.DataFrame(columns=_COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bucket = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.width - 1
        parts = []
        for chunk in range(self.chunks.getValue((bucket,))[0]):
            parts.append(zip(*self.waiting.getValue((bucket, chunk))))
            self.waiting.removeKey((bucket, chunk))
        self.chunks.removeKey((bucket,))
        known = self.machine.get() if self.machine.exists() else ("Unknown", None, [None] * len(STATE_SIGNALS))
        state, since, flags = known[0], known[1], list(known[2])
        out = []
        for at, ordinal, given, slot, flag in heapq.merge(*parts, key=lambda r: r[:2]):
            if slot is not None and slot >= 0:
                flags[slot] = flag
            now = state_of(*flags) if given is None else given
            if "state" in self.kinds:
                out.append((key[0], "state", None, now, at, None, ordinal))
            if now == state:
                continue
            if since is not None and "period" in self.kinds:
                out.append((key[0], "period", None, state, since, at, ordinal))
            if "transition" in self.kinds:
                out.append((key[0], "transition", state, now, at, None, ordinal))
            state, since = now, at
        self.machine.update((state, since, flags))
        frame = pd.DataFrame(out, columns=_COLUMNS)
        for c in ("started_at", "ended_at"):
            frame[c] = pd.to_datetime(frame[c].astype("Int64"), unit="us")
        yield frame

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Stateful streams that are started inside keep their state in RocksDB, as timers and maps need it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _tracked(rows: DataFrame, delay: str, minutes: int, kinds: tuple[str, ...]) -> DataFrame:
    narrow = rows.filter(F.col("timestamp").isNotNull()).withWatermark("timestamp", delay)
    tracker = MachineTracker(minutes, kinds)
    return narrow.groupBy("machine_id").transformWithStateInPandas(tracker, outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def track_states(states: DataFrame, delay: str, minutes: int = BUCKET_MINUTES, kinds: tuple[str, ...] = ("transition", "period")) -> DataFrame:
    """A stream of states (machine_id, state, timestamp, ordinal) to transitions and periods."""
    at = F.unix_micros("timestamp").alias("at")
    return _tracked(states.select("machine_id", at, "ordinal", "state", F.lit(-1).alias("slot"), F.lit(None).cast("boolean").alias("flag"), "timestamp"), delay, minutes, kinds)


def track_signals(mapped: DataFrame, delay: str, minutes: int = BUCKET_MINUTES, kinds: tuple[str, ...] = ("state", "transition", "period")) -> DataFrame:
    """A stream of mapped observations to states (one for each), transitions and periods, in one stateful operator."""
    key = fold(F.col("signal_key"))
    slot = F.lit(-1)
    for i, k in enumerate(STATE_SIGNALS):
        slot = F.when(key == k, i).otherwise(slot)
    flag = F.when((F.col("quality") == "Good") & (F.col("type") == "Digital"), F.col("value.bool"))
    at = F.unix_micros("timestamp").alias("at")
    return _tracked(mapped.select("machine_id", at, "ordinal", F.lit(None).cast("string").alias("state"), slot.alias("slot"), flag.alias("flag"), "timestamp"), delay, minutes, kinds)
