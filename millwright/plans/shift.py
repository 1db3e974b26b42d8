"""From machine facts to shift metrics: the whole query, for all scopes at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.configuration import resolve_configurations
from ..operators.inputs import derive_inputs
from ..operators.metrics import POLICIES, Engine, Policy, metrics_long
from ..operators.policies import dictionary, evaluate_lists
from ..operators.state import activity_periods, evaluate_states, transitions
from ..schemas import SCOPE

DAY_STARTS_AT = 6 * 3600
SHIFT_SECONDS = 8 * 3600


def _second_of_day(at: Column) -> Column:
    return F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def shift_number(at: Column) -> Column:
    """0 from 06:00, 1 from 14:00, 2 from 22:00 overnight."""
    return F.floor(((_second_of_day(at) - DAY_STARTS_AT + 86400) % 86400) / SHIFT_SECONDS).cast("int")


def production_date(at: Column) -> Column:
    """The date on which the shift began: before 06:00 it is the day before."""
    return F.to_date(F.timestamp_add("SECOND", F.lit(-DAY_STARTS_AT), at))


def assign_shift(rows: DataFrame, at: str) -> DataFrame:
    """rows with shift_id and production_date, for three fixed shifts."""
    return rows.withColumns({"shift_id": shift_number(F.col(at)).cast("string"), "production_date": production_date(F.col(at))})


def assign_shifts(rows: DataFrame, at: str, shifts: DataFrame, site: str = "site_id") -> DataFrame:
    """The same for a table of shifts by site (starts_at and ends_at in seconds of the day); overnight shifts
    end before they start, and their production date is the day they started on.  Rows in no shift are dropped.
    """
    s = shifts.select(F.col("site_id").alias("__site"), "shift_id", "starts_at", "ends_at")
    second = _second_of_day(F.col(at))
    overnight = F.col("ends_at") < F.col("starts_at")
    inside = F.when(overnight, (second >= F.col("starts_at")) | (second < F.col("ends_at"))).otherwise((second >= F.col("starts_at")) & (second < F.col("ends_at")))
    early = overnight & (second < F.col("ends_at"))
    date = F.date_sub(F.to_date(F.col(at)), F.when(early, 1).otherwise(0))
    joined = rows.join(s, (F.col(site) == F.col("__site")) & inside)
    return joined.withColumn("production_date", date).drop("__site", "starts_at", "ends_at")


def shift_periods(snapshots: DataFrame) -> DataFrame:
    """Snapshots to activity periods of the shift and date in which they began, whole as they are."""
    return assign_shift(activity_periods(transitions(evaluate_states(snapshots))), "started_at")


def _hours(us: Column) -> Column:
    return us.cast("double") / F.lit(3.6e9)


def _shift_inputs() -> tuple[dict[str, Column], dict[str, Column]]:
    """Derived and additional inputs of a scope."""
    apt = _hours(F.col("apt_us"))
    inputs = {"apt": apt, "pot": _hours(F.col("planned_us")), "produced-quantity": F.col("produced"), "good-quantity": F.col("good")}
    additional = {
        "not": F.when(F.col("machine_id").cast("int") % 4 != 0, apt * F.lit(0.9)),
        "machine-power-on-time": _hours(F.col("powered_us")),
    }
    return inputs, additional


def evaluate_shifts(periods: DataFrame, schedules: DataFrame, entries: DataFrame, policies: Sequence[Policy] = POLICIES, engine: Engine | None = None) -> DataFrame:
    """Scope, inputs and metrics for every schedule.

    Additional inputs of the adapter: the reference time `not` is nine tenths of apt, for machines whose
    number isn't a multiple of four; power-on time is the time in known states.
    """
    base = derive_inputs(schedules, periods, entries, powered=True)
    return (engine or Engine()).evaluate(base, *_shift_inputs(), policies).select(*SCOPE, "inputs", "metrics")


def evaluate_in_force(periods: DataFrame, schedules: DataFrame, entries: DataFrame, configurations: DataFrame, engine: Engine | None = None) -> DataFrame:
    """Scope, version, inputs and metrics for every schedule, under the configuration that was in force when its
    production date began; without one there are no metrics, and version is null."""
    began = F.timestamp_add("SECOND", F.lit(DAY_STARTS_AT), F.col("production_date").cast("timestamp"))
    ruled = resolve_configurations(schedules.withColumn("__began", began), configurations, request_key="machine_id", at="__began")
    placed = derive_inputs(ruled, periods, entries, powered=True, keep=("configuration",))
    known = dictionary(configurations.filter("lifecycle = 'Published'"))
    found = evaluate_lists(placed, *_shift_inputs(), F.col("configuration.metric_policies"), known, engine)
    return found.select(*SCOPE, F.col("configuration.version").alias("version"), "inputs", "metrics")


def shift_metrics(snapshots: DataFrame, schedules: DataFrame, entries: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """One row for each scope and metric."""
    return metrics_long(evaluate_shifts(shift_periods(snapshots), schedules, entries, policies), *SCOPE)


def register_views(spark: SparkSession, **tables: DataFrame) -> None:
    """Tables as temporary views, so that they can be asked in SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
