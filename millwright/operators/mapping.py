"""Protocol addresses to canonical signals.

The mapping table is joined by equality on folded keys after it is made unique per key, so a join never
multiplies observations; whether it is broadcast is left to Spark's size estimates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .contract import Checked, check, mark

_OBSERVED = ("machine_id", "source", "address", "type", "value", "quality", "timestamp", "ordinal")


def _keyed(mappings: DataFrame) -> DataFrame:
    """One row for each machine, source and address: how many mappings it has, and one of them."""
    return mappings.groupBy(F.col("machine_id").alias("__m"), fold(F.col("source")).alias("__s"), fold(F.col("address")).alias("__a")).agg(
        F.count("*").alias("__n"), F.min(F.struct("ordinal", "signal_key", "type", "invert")).alias("__map")
    )


def _join(observations: DataFrame, mappings: DataFrame, how: str) -> DataFrame:
    keyed = _keyed(mappings)
    on = (
        (observations["machine_id"] == keyed["__m"])
        & (fold(observations["source"]) == keyed["__s"])
        & (fold(observations["address"]) == keyed["__a"])
    )
    return observations.join(keyed, on, how)


def map_observations(observations: DataFrame, mappings: DataFrame, on_error: str = "strict") -> Checked:
    """Observations with a mapping, as canonical signals that keep their provenance.

    Errors, in this order: several mappings for a key that is observed (E2), a mapping of another type
    (E3), an inversion of what is no digital true or false (E4).
    """
    return _map(observations, mappings, on_error, None)


def _rules(machine_id: str | None) -> list:
    foreign = [] if machine_id is None else [("E1", F.col("machine_id") != machine_id, "the observation belongs to another machine")]
    digital = (F.col("type") == "Digital") & F.col("value.bool").isNotNull()
    return [
        *foreign,
        ("E2", F.col("__n") > 1, "several mappings for one source and address"),
        ("E3", F.col("__map.type") != F.col("type"), "the mapping's type differs from the observation's"),
        ("E4", F.col("__map.invert") & ~F.coalesce(digital, F.lit(False)), "only a digital value can be inverted"),
    ]


def _canonical(rows: DataFrame, observed: DataFrame, *more: str) -> DataFrame:
    inverted = F.col("value").withField("bool", ~F.col("value.bool"))
    columns = [F.col(c) for c in _OBSERVED if c in observed.columns and c != "value"]
    value = F.when(F.col("__map.invert"), inverted).otherwise(F.col("value")).alias("value")
    return rows.select(*columns, F.col("__map.signal_key").alias("signal_key"), value, *more)


def _map(observations: DataFrame, mappings: DataFrame, on_error: str, machine_id: str | None) -> Checked:
    hit = _join(observations, mappings, "inner" if machine_id is None else "left")  # foreign rows must reach the check
    checked = check(hit, _rules(machine_id), on_error, F.col("__n").isNotNull())
    return Checked(_canonical(checked.rows, observations), checked.errors.select(*observations.columns, "error_code", "error"))


def mark_observations(observations: DataFrame, mappings: DataFrame) -> DataFrame:
    """Observations with a mapping as canonical signals, with error_code and error: both outcomes in one pass.

    A row in error keeps its value as it was observed, and has no signal.
    """
    marked = mark(_join(observations, mappings, "inner"), _rules(None))
    sound = F.when(F.col("error_code").isNull(), F.col("__map"))
    return _canonical(marked.withColumn("__map", sound), observations, "error_code", "error")


def unmapped_observations(observations: DataFrame, mappings: DataFrame) -> DataFrame:
    """Observations that no mapping names; they are left alone, never guessed."""
    return _join(observations, mappings, "left_anti")


def map_with_configuration(observations: DataFrame, mappings: DataFrame, machine_id: str, on_error: str = "strict") -> Checked:
    """Like map_observations with the mappings of one machine; an observation of another machine is an error (E1)."""
    return _map(observations, mappings.withColumn("machine_id", F.lit(machine_id)), on_error, machine_id)


def map_simple(observations: DataFrame, mappings: DataFrame, definitions: DataFrame) -> DataFrame:
    """The older form: a mapping's source is an address, names and types come from signal definitions.

    Rows without a match, or of another type, yield nothing; machine and protocol are not looked at.
    """
    by_address = mappings.select(fold(F.col("source")).alias("__a"), fold(F.col("signal_key")).alias("__k"))
    defined = definitions.select(fold(F.col("key")).alias("__k"), "key", F.col("type").alias("__type"))
    joined = observations.join(by_address, fold(observations["address"]) == F.col("__a")).join(defined, "__k").filter(F.col("type") == F.col("__type"))
    keep = [c for c in ("machine_id", "value", "source", "quality", "timestamp", "ordinal") if c in observations.columns]
    return joined.select(F.col("key").alias("signal_key"), F.col("__type").alias("type"), *keep)
