"""Streams into tables, one pass a batch: sound rows and quarantined ones, under the configuration of the moment.

A micro-batch is written once, as the folder of its number, partitioned by outcome; when Spark does a batch
again the folder is replaced, so either table holds each row once whatever was repeated.

Mappings are published as numbered versions.  A batch uses the newest version that there is when it is first
tried; the number is noted before anything is written, so a batch done again uses the same one, and rows carry it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mapping import mark_observations
from ..shared import table_or_empty
from ..sources import xml

SOUND, QUARANTINE = "sound", "quarantine"
_NOTES = "batch bigint, version bigint"


class VersionedTable:
    """A small table that is published as a whole, version after version, in a shared folder.

    A version is there once its number stands in the list, which is the last thing that publish writes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def newest(self) -> int | None:
        return table_or_empty(self.spark, f"{self.path}/published", "version bigint").agg(F.max("version")).first()[0]

    def publish(self, table: DataFrame) -> int:
        version = (self.newest() or 0) + 1
        table.write.mode("overwrite").parquet(f"{self.path}/versions/{version}")
        self.spark.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/published")
        return version

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/versions/{version}")


def _pinned(mappings: VersionedTable, notes: str, batch: int) -> int:
    """The version that a batch uses, noted when it is first asked for."""
    noted = table_or_empty(mappings.spark, notes, _NOTES).filter(F.col("batch") == batch).agg(F.min("version")).first()[0]
    if noted is not None:
        return noted
    version = mappings.newest()
    if version is None:
        raise ValueError("no mappings have been published")
    mappings.spark.createDataFrame([(batch, version)], _NOTES).coalesce(1).write.mode("append").parquet(notes)
    return version


def _put(rows: DataFrame, out: str, batch: int) -> None:
    """rows with error_code or error, by outcome, as the batch's own folder."""
    bad = F.col("error").isNotNull()
    rows.withColumn("outcome", F.when(bad, QUARANTINE).otherwise(SOUND)).write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/rows/batch={batch}")


def mapping_sink(mappings: VersionedTable, out: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of observations: canonical signals with mapping_version; E2 to E4 in quarantine."""

    def put(batch: DataFrame, number: int) -> None:
        version = _pinned(mappings, f"{out}/versions-used", number)
        marked = mark_observations(batch, mappings.read(version))
        _put(marked.withColumn("mapping_version", F.lit(version).cast("bigint")), out, number)

    return put


def document_sink(out: str, read: Callable[..., DataFrame] = xml.sample_rows) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of documents (payload_id, xml, machine_id, device_key): their rows; bad documents in quarantine."""

    def put(batch: DataFrame, number: int) -> None:
        _put(read(batch, on_error="quarantine"), out, number)

    return put


def outcome(spark: SparkSession, out: str, which: str) -> DataFrame:
    """The sound or the quarantined rows, with the number of their batch."""
    return spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").filter(F.col("outcome") == which).drop("outcome")


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], out: str) -> StreamingQuery:
    """What there is in the stream now, in batches; the place reached is kept in out."""
    run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return run
