"""Where a cursor stands behind each answer of an agent, over landed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cursor_trace(envelopes: DataFrame, by: str = "machine_id", order: str = "ordinal") -> DataFrame:
    """envelopes (by, order, instance_id, first_sequence, next_sequence) with requested, instance, next and error_code.

    A cursor takes its instance from the first answer and follows the next sequences of that instance; an answer
    of another one (the agent restarted, E13) leaves it where it was.
    """
    arrival = Window.partitionBy(by).orderBy(order)
    so_far, before = (arrival.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    known = envelopes.withColumn("instance", F.first("instance_id").over(so_far))
    moved = known.withColumn("__moved", F.when(F.col("instance_id") == F.col("instance"), F.col("next_sequence")))
    traced = moved.withColumns(
        {
            "requested": F.coalesce(F.last("__moved", ignorenulls=True).over(before), F.col("first_sequence")),
            "next": F.last("__moved", ignorenulls=True).over(so_far),
            "error_code": F.when(F.col("__moved").isNull(), "E13"),
        }
    )
    return traced.select(by, order, "requested", "instance", "next", "error_code")
