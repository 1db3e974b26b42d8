"""Sums by key that are kept up to date: each increment adds the partial sums of the facts that are new.

Facts carry a column that grows as they arrive (a time of recording, a sequence).  An increment takes those behind
the high-water mark, up to the new one, and writes their sums by key, which is as many rows as there are keys among
them; the mark is noted last.  An increment that broke off is done again under its own number and replaces what it
had written, so nothing counts twice.  A fact that arrives behind the mark is not seen: the column has to be the order
of arrival.  Reading adds the parts up; ``compact`` makes one part of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import table_or_empty

_NOTES = "increment bigint, first bigint, mark string"


class Totals:
    """sums (names and what is summed) by keys, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], sums: dict[str, Column]):
        self.spark, self.path, self.keys, self.sums = spark, path.rstrip("/"), list(keys), sums

    def _last(self) -> tuple[int, int, str | None]:
        """The last increment, the first one whose part is to be read, and the mark."""
        row = table_or_empty(self.spark, f"{self.path}/notes", _NOTES).orderBy(F.desc("increment")).first()
        return (row.increment, row.first, row.mark) if row else (0, 1, None)

    def _note(self, increment: int, first: int, mark: str | None) -> None:
        self.spark.createDataFrame([(increment, first, mark)], _NOTES).coalesce(1).write.mode("append").parquet(f"{self.path}/notes")

    def mark(self) -> str | None:
        """How far the facts have been taken in; None before the first increment."""
        return self._last()[2]

    def advance(self, facts: DataFrame, by: str) -> int:
        """Takes in the facts behind the mark; their number is that of the increment, or of the last one if there were none."""
        increment, first, mark = self._last()
        kind = facts.schema[by].dataType
        fresh = facts if mark is None else facts.filter(F.col(by) > F.lit(mark).cast(kind))
        upto = fresh.agg(F.max(by).cast("string")).first()[0]
        if upto is None:
            return increment
        taken = fresh.filter(F.col(by) <= F.lit(upto).cast(kind))
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in self.sums.items()]
        taken.groupBy(*self.keys).agg(*sums).write.mode("overwrite").parquet(f"{self.path}/parts/{increment + 1}")
        self._note(increment + 1, first, upto)
        return increment + 1

    def read(self) -> DataFrame | None:
        """Keys and sums over all increments; None before the first."""
        increment, first, _ = self._last()
        if not increment:
            return None
        parts = self.spark.read.parquet(*[f"{self.path}/parts/{n}" for n in range(first, increment + 1)])
        return parts.groupBy(*self.keys).agg(*[F.sum(n).cast("bigint").alias(n) for n in self.sums])

    def compact(self) -> None:
        """One part in place of those that there are; older ones are no longer read."""
        increment, _, mark = self._last()
        found = self.read()
        if found is not None:
            found.write.mode("overwrite").parquet(f"{self.path}/parts/{increment + 1}")
            self._note(increment + 1, increment + 1, mark)
