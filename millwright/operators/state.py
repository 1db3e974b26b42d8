"""Machine states from signals, changes of state, and periods of activity.

A machine may have a third of all rows, so its history is cut into slices of arrival (days), which are sorted
and streamed apart; what a slice must know of its neighbours (the last state or reading before it, the
first event behind it) is one small row a machine and slice, carried over in a second, small window.  Slices and
their edges come from one exchange, so that an operator's input is computed once, however operators are chained: for
that, both sides need the same columns, and keys that can't be null (a join would filter one side otherwise); so
machine_id goes along beside its key, and in what is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ..functions.text import fold, microseconds
from ..schemas import SIGNAL

#: Ordinals in a slice, where arrival is by ordinal.
SLICE = 1_000_000
ORDER = ("timestamp", "ordinal")
STATE_SIGNALS = ("state.running", "state.idle", "state.fault")


def digital_signal(signals: Column, key: str) -> Column:
    """True or false of the first good signal of that key; null if there is none or it is no digital value.

    Signals that aren't good are passed over before the first is chosen; later ones never stand in for it.
    """
    first = F.try_element_at(F.filter(signals, lambda s: (s["quality"] == "Good") & (fold(s["key"]) == key)), F.lit(1))
    return F.when(first["type"] == "Digital", first["value"]["bool"])


def state_of(running: Column, idle: Column, fault: Column) -> Column:
    """Fault, then running, then idle; stopped if running is known to be false; else unknown."""
    return F.when(fault, "Fault").when(running, "Running").when(idle, "Idle").when(running.isNotNull(), "Stopped").otherwise("Unknown")


def evaluate_states(snapshots: DataFrame) -> DataFrame:
    """snapshots (machine_id, signals, timestamp, ordinal) with their state instead of signals."""
    state = state_of(*(digital_signal(F.col("signals"), k) for k in STATE_SIGNALS))
    return snapshots.withColumn("state", state).drop("signals")


#: Stands for a machine without an id in keys.
_NO_MACHINE = "\0"
_SLICE = ("__machine", "__slice")


def _edge(arrival: WindowSpec, behind: bool) -> Column:
    """Whether a row is the last of its slice, or the first (without a row number, which Spark would push below the exchange)."""
    return (F.lead(F.lit(1)) if behind else F.lag(F.lit(1))).over(arrival).isNull()


def _slices(df: DataFrame, order: tuple[str, ...]) -> tuple[DataFrame, WindowSpec]:
    """df by machine and slice of arrival, and the window of a slice in arrival order."""
    first = F.col(order[0])
    if isinstance(df.schema[order[0]].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        part = F.coalesce(F.to_date(first), F.lit("0001-01-01").cast("date"))
    else:
        part = F.coalesce(F.floor(first / SLICE), F.lit(-(2**62)))
    keyed = df.withColumns({"__machine": F.coalesce(F.col("machine_id"), F.lit(_NO_MACHINE)), "__slice": part})
    return keyed, Window.partitionBy(*_SLICE).orderBy(*order)


def _by_slice() -> WindowSpec:
    """Over a row for each slice."""
    return Window.partitionBy("__machine").orderBy("__slice")


def assemble_snapshots(mapped: DataFrame, keys: tuple[str, ...] = STATE_SIGNALS, order: tuple[str, ...] = ORDER) -> DataFrame:
    """One snapshot for each observation: the latest reading of each key so far, in the order of keys.

    A reading without a value counts as the latest: an unavailable signal isn't replaced by an older one.
    """
    sliced, arrival = _slices(mapped, order)
    so_far = arrival.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reading = F.struct(F.col("signal_key").alias("key"), "type", "value", "source", "quality", "timestamp")
    names = [f"__k{i}" for i in range(len(keys))]
    whole = F.struct(reading.alias("r"), "machine_id")
    latest = {n: F.last(F.when(fold(F.col("signal_key")) == k, whole), ignorenulls=True).over(so_far) for n, k in zip(names, keys)}
    marked = sliced.withColumns(latest | {"__end": _edge(arrival, True)}).select("machine_id", *_SLICE, *order, *names, "__end")
    before = _by_slice().rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.filter("__end").select(*_SLICE, *[F.last(n, ignorenulls=True).over(before).alias(f"{n}c") for n in names])
    joined = marked.join(carried, list(_SLICE), "left")
    return joined.select("machine_id", F.filter(F.array(*[F.coalesce(n, f"{n}c")["r"] for n in names]), lambda s: s.isNotNull()).alias("signals"), *order)


def transitions(states: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Changes of state for each machine in arrival order; before its first row a machine is unknown."""
    sliced, arrival = _slices(states, order)
    place = {"__before": F.lag("state").over(arrival), "__first": _edge(arrival, False), "__end": _edge(arrival, True)}
    marked = sliced.select("machine_id", *_SLICE, "state", *order).withColumns(place)
    carried = marked.filter("__end").select(*_SLICE, F.lag(F.struct("state", "machine_id")).over(_by_slice()).alias("__carried"))
    previous = F.coalesce(F.when(F.col("__first"), F.col("__carried.state")).otherwise(F.col("__before")), F.lit("Unknown"))
    joined = marked.join(carried, list(_SLICE), "left")
    return joined.select("machine_id", previous.alias("previous_state"), F.col("state").alias("current_state"), *order).filter("previous_state <> current_state")


def activity_periods(changes: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """From each event to the machine's next one; the last, still open, yields nothing.

    Events that repeat a state close a period too, and a period is negative if time runs backwards.
    """
    sliced, arrival = _slices(changes, order)
    event = F.struct("timestamp", "current_state", "machine_id")
    place = {"__next": F.lead(event).over(arrival), "__first": _edge(arrival, False), "__end": _edge(arrival, True)}
    marked = sliced.select("machine_id", *_SLICE, "current_state", *dict.fromkeys([*order, "timestamp"])).withColumns(place)
    carried = marked.filter("__first").select(*_SLICE, F.lead(event).over(_by_slice()).alias("__carried"))
    ended = F.when(F.col("__end"), F.col("__carried")).otherwise(F.col("__next"))["timestamp"]
    closed = marked.join(carried, list(_SLICE), "left").withColumn("ended_at", ended).filter("ended_at is not null")
    return closed.select(
        "machine_id", F.col("current_state").alias("state"), F.col("timestamp").alias("started_at"), "ended_at",
        microseconds(F.col("timestamp"), F.col("ended_at")).alias("duration_us"),
    )


def without_signals(machines: DataFrame) -> DataFrame:
    """A snapshot without signals for each row (machine_id), as of now: its state is unknown."""
    return machines.select("machine_id", F.array().cast(f"array<{SIGNAL}>").alias("signals"), F.current_timestamp().alias("timestamp"), F.lit(0).cast("bigint").alias("ordinal"))


def empty_snapshots(spark: SparkSession, machine_ids: list[str]) -> DataFrame:
    return without_signals(spark.createDataFrame([(m,) for m in machine_ids], "machine_id string"))
