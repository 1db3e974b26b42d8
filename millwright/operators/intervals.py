"""Which of many overlapping intervals is in force at a moment, by an ordered sweep.

Of the intervals that hold a moment the one that started last is in force; of those the first in the list
(least ordinal).  So the open intervals of a key, taken in the order of their starts, are a stack: a start puts
its interval on top, an end uncovers the one below, and an interval below one that lasts at least as long is never
seen again and goes.  ``timeline`` sweeps each key's intervals in slices of time.  What a slice must know of those
before it is the stack at its beginning, which is put together from each slice's own remaining stack, a small row
set by key.  The result, moments at which the interval in force changes, is met by requests in ``in_force``: both are
sorted once by key and day, and the change before a day is carried over from the days' last changes.  Work is linear
in intervals and requests (but for sorting), whatever overlaps; a key with a third of all rows is many slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds in a slice of intervals, and in a day, which is a slice of requests.
SLICE, DAY = 32 * 86_400_000_000, 86_400_000_000
#: No end.
OPEN = 2**63 - 1
#: Groups that requests without a key or a moment are dealt into.
LOST = 1024
_CARRIED, _OWN, _NEXT = 0, 1, 2


class _Stack:
    """Open intervals (until, ordinal); each lasts longer than the one above it."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int]] = []

    def start(self, since: int, until: int, ordinal: int) -> None:
        while self.rows and self.rows[-1][1] <= until:
            self.rows.pop()
        self.rows.append((since, until, ordinal))

    def end(self, at: int) -> Iterator[tuple[int, int | None]]:
        """The changes up to at by intervals that end: (moment, ordinal of what is uncovered)."""
        while self.rows and (ended := self.rows[-1][1]) <= at:
            self.rows.pop()
            yield ended, self.rows[-1][2] if self.rows else None


def _grouped(width: int, handle: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """handle for the runs of rows that agree in their first `width` columns; batches of sorted rows in and out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, group in groupby(rows(batches), lambda r: r[:width]):
            for r in handle(key, group):
                out.append(r)
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)
                    out = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in out], schema)

    return run


def _carry(n_keys: int) -> Callable[[tuple, Iterator[tuple]], Iterator[tuple]]:
    """Rows (keys, slice, since, until, ordinal) of one key: the stack that each slice begins with, and where the next begins."""

    def handle(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        stack, before = _Stack(), None
        for number, own in groupby(rows, lambda r: r[n_keys]):
            begins = number * SLICE
            if before is not None:
                yield (*key, before, _NEXT, begins, None, None)
            for _ in stack.end(begins):
                pass
            for since, until, ordinal in stack.rows:
                yield (*key, number, _CARRIED, since, until, ordinal)
            for r in own:
                if r[-1] is not None:
                    stack.start(*r[-3:])
            before = number

    return handle


def _sweep(n_keys: int) -> Callable[[tuple, Iterator[tuple]], Iterator[tuple]]:
    """Rows (keys, slice, kind, since, until, ordinal) of one slice: its changes (keys, moment, rank, ordinal).

    At one moment an end comes before a start (rank), and the start of the least ordinal last.
    """

    def handle(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        stack, until_next = _Stack(), OPEN - 1
        for *_, kind, since, until, ordinal in rows:
            if kind == _CARRIED:
                stack.start(since, until, ordinal)
                continue
            if kind == _NEXT:
                until_next = since
                break
            for at, uncovered in stack.end(since):
                yield (*key[:n_keys], at, 0, uncovered)
            stack.start(since, until, ordinal)
            yield (*key[:n_keys], since, 1, ordinal)
        for at, uncovered in stack.end(until_next):
            yield (*key[:n_keys], at, 0, uncovered)

    return handle


def timeline(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """intervals (keys: strings, since, until: microseconds, ordinal: bigint; until null has no end) to the
    moments at which another one is in force: keys, moment, rank, ordinal (null: none).  Of the changes of one moment
    the last by (rank, descending ordinal) holds.  Intervals without a key or a start, or that end before they begin, are left out.
    """
    n = len(keys)
    sound = intervals.select(*keys, F.col("since").cast("bigint").alias("since"), F.coalesce(F.col("until").cast("bigint"), F.lit(OPEN)).alias("until"), F.col("ordinal").cast("bigint").alias("ordinal"))
    sound = sound.dropna(subset=[*keys, "since"]).filter("since < until").withColumn("slice", F.floor(F.col("since") / SLICE))
    # what is left open at a slice's end: what no later start of the slice outlasts
    above = Window.partitionBy(*keys, "slice").orderBy(F.desc("since"), "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    seen = sound.withColumn("above", F.max("until").over(above))
    left = F.col("above").isNull() | (F.col("until") > F.col("above"))
    kept = [F.when(left & (F.col("until") > (F.col("slice") + 1) * SLICE), F.col(c)).alias(c) for c in ("since", "until", "ordinal")]
    # a row without an ordinal says that the slice is there
    own = seen.filter(left).select(*keys, "slice", *kept)
    text = [pa.field(k, pa.string()) for k in keys]
    number = lambda *names: [pa.field(c, pa.int64()) for c in names]
    ddl = ", ".join(f"{k} string" for k in keys)
    ordered = own.repartition(*keys).sortWithinPartitions(*keys, "slice", "since", F.desc("ordinal"))
    carried = ordered.mapInArrow(_grouped(n, _carry(n), pa.schema([*text, *number("slice", "kind", "since", "until", "ordinal")])), f"{ddl}, slice bigint, kind bigint, since bigint, until bigint, ordinal bigint")
    whole = sound.select(*keys, "slice", F.lit(_OWN).cast("bigint").alias("kind"), "since", "until", "ordinal").unionByName(carried)
    swept = whole.repartition(*keys, "slice").sortWithinPartitions(*keys, "slice", "kind", "since", F.desc("ordinal"))
    return swept.mapInArrow(_grouped(n + 1, _sweep(n), pa.schema([*text, *number("moment", "rank", "ordinal")])), f"{ddl}, moment bigint, rank bigint, ordinal bigint")


def in_force(requests: DataFrame, changes: DataFrame, keys: list[str], at: str, found: str, spread: str) -> DataFrame:
    """requests with what is in force: changes has keys, moment, rank, ordinal and a column found.

    One row for each request, repeated ones too; null where nothing is in force, or without a key or a moment (these
    are dealt by a hash of the column spread).
    """
    key_names = [f"__k{i}" for i in range(len(keys))]
    moment = F.unix_micros(F.col(at))
    day = F.coalesce(F.floor(moment / DAY), F.pmod(F.hash(spread), F.lit(LOST)).cast("bigint"))
    asked = requests.select(*[F.col(k).cast("string").alias(n) for k, n in zip(keys, key_names)], day.alias("__day"), moment.alias("__at"), F.struct(*requests.columns).alias("__request"))
    told = changes.select(
        *[F.col(k).alias(n) for k, n in zip(keys, key_names)], F.floor(F.col("moment") / DAY).alias("__day"), F.col("moment").alias("__at"), "rank", "ordinal", F.struct(F.col(found).alias("it")).alias("__found")
    )
    last = told.groupBy(*key_names, "__day").agg(F.max_by("__found", F.struct("__at", "rank", -F.coalesce("ordinal", F.lit(0)))).alias("__found"))
    days = asked.select(*key_names, "__day").distinct()
    before = Window.partitionBy(*key_names).orderBy("__day", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = last.withColumn("kind", F.lit(1)).unionByName(days.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    carried = marks.withColumn("__found", F.last("__found", ignorenulls=True).over(before)).filter("kind = 0 and __found is not null")
    together = (
        asked.withColumn("kind", F.lit(2))
        .unionByName(told.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        .unionByName(carried, allowMissingColumns=True)
    )
    so_far = Window.partitionBy(*key_names, "__day").orderBy(F.asc_nulls_first("__at"), "kind", "rank", F.desc("ordinal")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = together.withColumn("__found", F.last("__found", ignorenulls=True).over(so_far)).filter("kind = 2")
    known = F.col("__at").isNotNull()
    for n in key_names:
        known = known & F.col(n).isNotNull()
    return met.select("__request.*", F.when(known, F.col("__found.it")).alias(found))
