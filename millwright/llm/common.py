"""What the training-data operators share: shared storage, text rules and column helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_root

SPACE = " \t\n\x0b\x0c\r"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/millwright/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut, lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows in an Arrow batch: texts are long, and workers hold a batch at a time.
BATCH_ROWS = 1000


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have BATCH_ROWS rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def partitions(spark: SparkSession, floor: int = 1) -> int:
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words(text: Column) -> Column:
    """Maximal runs without the six ASCII white-space characters; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


#: How the operators' own columns begin.
_OWN = "__"


def keeps_columns(form: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators that return the columns of docs: those of docs that are named as an operator's own columns may be
    go by other names meanwhile."""

    @wraps(form)
    def run(docs: DataFrame, *more, **options) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        names = {c: f"kept_{i}_{c.lstrip('_')}" for i, c in enumerate(docs.columns) if c.startswith(_OWN)}
        while taken & {n.lower() for n in names.values()}:
            names = {c: f"kept_{n}" for c, n in names.items()}
        if not names:
            return form(docs, *more, **options)
        return form(docs.withColumnsRenamed(names), *more, **options).withColumnsRenamed({n: c for c, n in names.items()})

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CACHES: list[dict] = []


def sole(cache: dict) -> dict:
    """For a bounded cache in a worker process that serves many operators' tasks: the one in use is the only one kept."""
    for other in _CACHES:
        if other is not cache:
            other.clear()
    _CACHES[:] = [cache]
    pa.default_memory_pool().release_unused()  # what earlier tasks' batches took
    return cache
