"""The plant's hierarchy and who was assigned where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(factories: DataFrame) -> DataFrame:
    """factories (name, lines) to one row for each production line."""
    return factories.select(F.col("name").alias("factory"), F.explode("lines").alias("l")).select("factory", F.col("l.id").alias("line_id"), F.col("l.name").alias("line"), "l.machines")


def machines(factories: DataFrame) -> DataFrame:
    """One row for each machine, with the signals and capabilities it is defined with."""
    return lines(factories).select("factory", "line_id", "line", F.explode("machines").alias("m")).select(
        "factory", "line_id", "line", F.col("m.id").alias("machine_id"), F.col("m.name").alias("machine"), "m.signals", "m.capabilities"
    )


def signal_definitions(factories: DataFrame) -> DataFrame:
    """One row for each signal of each machine."""
    return machines(factories).select("machine_id", F.explode("signals").alias("s")).select("machine_id", "s.*")


def capabilities(factories: DataFrame) -> DataFrame:
    return machines(factories).select("machine_id", F.explode("capabilities").alias("c")).select("machine_id", "c.*")


def is_assigned(at: Column, starts_at: Column, ends_at: Column) -> Column:
    """An assignment holds from its start until its end, or on without one."""
    return (starts_at <= at) & (ends_at.isNull() | (at < ends_at))


def operators_at(rows: DataFrame, assignments: DataFrame, at: str) -> DataFrame:
    """rows (with company_id, site_id, machine_id, shift_id) with each operator assigned at that time, or null."""
    keys = ["company_id", "site_id", "machine_id", "shift_id"]
    a = assignments.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("operator_id").alias("assigned_operator"), F.col("starts_at").alias("__from"), F.col("ends_at").alias("__to"))
    on = is_assigned(F.col(at), F.col("__from"), F.col("__to"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return rows.join(a, on, "left").drop(*[f"__{k}" for k in keys], "__from", "__to")
