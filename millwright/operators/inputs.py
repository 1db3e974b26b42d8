"""Metric inputs of a scope: company, site, machine, shift and production date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCOPE
from .contract import refuse
from .incremental import Totals


def _time_sums() -> dict[str, Column]:
    """Of periods: what counts as running time, and as time in a known state."""
    us = F.col("duration_us")
    return {"apt_us": F.when(F.col("state") == "Running", us), "powered_us": F.when(F.col("state") != "Unknown", us)}


def _quantity_sums() -> dict[str, Column]:
    """Of entries: what was produced, and of that what is good."""
    produced, rejected = F.col("produced").cast("bigint"), F.col("rejected").cast("bigint")
    return {"produced": produced, "good": produced - rejected}


def period_totals(periods: DataFrame, keys: tuple[str, ...] = ("machine_id", "shift_id", "production_date")) -> DataFrame:
    """By keys, the time in running periods (apt_us) and in all known states (powered_us), whole as they are."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in _time_sums().items()]
    return periods.groupBy(*keys).agg(*sums)


def quantities(entries: DataFrame, keys: tuple[str, ...] = SCOPE) -> DataFrame:
    """produced and good, which is produced less what was rejected in process, by keys."""
    return entries.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in _quantity_sums().items()])


class IncrementalInputs:
    """Inputs of scopes that are kept up to date: periods come in by their end, entries by when they were recorded."""

    def __init__(self, spark: SparkSession, path: str):
        self.periods = Totals(spark, f"{path}/periods", ("machine_id", "shift_id", "production_date"), _time_sums())
        self.entries = Totals(spark, f"{path}/entries", SCOPE, _quantity_sums())

    def advance(self, periods: DataFrame, entries: DataFrame) -> None:
        self.periods.advance(periods, "ended_at")
        self.entries.advance(entries, "recorded_at")

    def inputs(self, schedules: DataFrame) -> DataFrame:
        """As derive_inputs gives them, of all that has been taken in."""
        found = schedules
        for totals in (self.periods, self.entries):
            sums = totals.read()
            found = found.withColumns({n: F.lit(0) for n in totals.sums}) if sums is None else found.join(sums, totals.keys, "left")
        return found.select(*SCOPE, "planned_us", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("apt_us", "produced", "good", "powered_us")])


def entries_out_of_scope(entries: DataFrame, schedules: DataFrame) -> DataFrame:
    """Production entries of no scheduled scope (E6)."""
    return entries.join(schedules.select(*SCOPE), list(SCOPE), "left_anti")


def derive_inputs(schedules: DataFrame, periods: DataFrame, entries: DataFrame, on_error: str = "quarantine", powered: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scope, planned_us, apt_us, produced and good, one row for each schedule; with powered also powered_us, and
    what is to be kept of the schedule's own columns.

    Both fact tables are summed before they meet the schedule.  In strict mode an entry outside every
    scheduled scope raises (E6); otherwise see entries_out_of_scope.  Periods need machine_id, shift_id
    and production_date; those of other machines are no error.
    """
    base = schedules
    if on_error == "strict":
        lost = entries_out_of_scope(entries, schedules).agg(F.count("*").alias("__lost"))  # one row
        base = refuse(schedules.join(F.broadcast(lost)), F.col("__lost") > 0, F.lit("E6: a production entry is out of scope")).drop("__lost")
    return (
        base.join(period_totals(periods), ["machine_id", "shift_id", "production_date"], "left")
        .join(quantities(entries), list(SCOPE), "left")
        .select(*SCOPE, *keep, "planned_us", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("apt_us", "produced", "good", *["powered_us"] * powered)])
    )
