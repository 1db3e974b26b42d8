"""Transitions and activity periods of a stream of states, with one state store entry for each machine."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "machine_id string, kind string, previous_state string, state string, started_at timestamp, ended_at timestamp, ordinal bigint"
DAY_US = 86_400_000_000
#: The day of rows without a timestamp, which come behind all others.
LAST = 1 << 62


class ActivityProcessor(StatefulProcessor):
    """Keeps a machine's last state and when it was entered; gives out its transitions and closed periods.

    Rows are taken in arrival order, which inside a micro-batch is (timestamp, ordinal); state never expires.  Where a
    micro-batch has more than one Arrow chunk of a machine, the chunks' rows wait in the state store by day until all
    have come, and are then read day by day: a worker holds a chunk, or one machine's day.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "state string, since timestamp")
        self.waiting = handle.getMapState("waiting", "day bigint, chunk int", "at array<bigint>, ordinal array<bigint>, state array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.open.get() if self.open.exists() else None
        self.state, self.since = (known[0], known[1]) if known else ("Unknown", None)
        before = self.since
        one = next(rows, None)
        more = next(rows, None)
        if more is None:
            if one is not None:
                yield self._passed(key[0], _sorted(one))
        else:
            days = self._parted(chain((one, more), rows))
            del one, more
            for day in sorted(days):
                parts = []
                for chunk in days[day]:
                    at, ordinal, state = self.waiting.getValue((day, chunk))
                    parts.append(pd.DataFrame({"timestamp": pd.Series(at, dtype="Int64"), "ordinal": pd.Series(ordinal, dtype="Int64"), "state": pd.Series(state, dtype=object)}))
                    self.waiting.removeKey((day, chunk))
                own = pd.concat(parts)
                own["timestamp"] = pd.to_datetime(own["timestamp"], unit="us")
                yield self._passed(key[0], _sorted(own))
        if self.since is not before:
            self.open.update((self.state, pd.Timestamp(self.since).to_pydatetime()))

    def _parted(self, chunks: Iterator[pd.DataFrame]) -> dict[int, list[int]]:
        """The chunks of each day that wait in the store; rows without a timestamp are of the last one."""
        days: dict[int, list[int]] = {}
        for n, chunk in enumerate(chunks):
            at = chunk["timestamp"].astype("datetime64[us]").astype("int64")
            day = (at // DAY_US).where(chunk["timestamp"].notna(), LAST)
            for d, own in chunk.groupby(day, sort=False):
                times = [None if d == LAST else t for t in at[own.index].tolist()]
                ordinals = [None if pd.isna(o) else int(o) for o in own["ordinal"]]
                self.waiting.updateValue((int(d), n), (times, ordinals, own["state"].tolist()))
                days.setdefault(int(d), []).append(n)
        return days

    def _passed(self, machine: str, frame: pd.DataFrame) -> pd.DataFrame:
        """What rows in order give out."""
        out = []
        for now, at, ordinal in zip(frame["state"], frame["timestamp"], frame["ordinal"]):
            if now == self.state:
                continue
            if self.since is not None:
                out.append((machine, "period", None, self.state, self.since, at, ordinal))
            out.append((machine, "transition", self.state, now, at, None, ordinal))
            self.state, self.since = now, at
        return pd.DataFrame(out, columns=["machine_id", "kind", "previous_state", "state", "started_at", "ended_at", "ordinal"])

    def close(self) -> None:
        pass


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values(["timestamp", "ordinal"], kind="stable")


def track_activity(states: DataFrame) -> DataFrame:
    """A stream of states (machine_id, state, timestamp, ordinal) to transitions and periods, to be started in rocks().

    The result equals the batch operators' for input that arrives in order.
    """
    return states.groupBy("machine_id").transformWithStateInPandas(ActivityProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
