"""Global ordinals of a table in a given order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions

#: monotonically_increasing_id holds the partition above this many bits, and the row in it below.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[str], name: str, column: str = "ordinal") -> DataFrame:
    """df with its rows' places (0, 1, 2...) in ascending order, nulls first.

    Ranges are sorted apart and written with partition and row in it; the rows of the ranges before are added
    from a table of one row a range, which is all that is broadcast.  Ties in `order` are numbered arbitrarily,
    but once for all, as the numbers are written.
    """
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    written = materialise(ranged.withColumn(column, F.monotonically_increasing_id()), name)
    part = F.shiftright(column, ROW_BITS)
    sizes = written.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", (before - F.shiftleft("__part", ROW_BITS)).alias("__add"))
    return written.join(F.broadcast(offsets), part == F.col("__part")).withColumn(column, F.col(column) + F.col("__add")).drop("__part", "__add")
