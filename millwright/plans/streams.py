"""The provided tables as streams that arrive in several parts, run to their end, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapping import map_observations
from ..operators.state import evaluate_states
from ..shared import shared_root
from ..streaming import ingest, machines
from . import adapter

#: Parts in which the events arrive; an event comes up to LATE hours after its time, and DELAY is waited for it.
PARTS, LATE, DELAY = 3, 36, "2 days"
DAY_MINUTES = 24 * 60


def _folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/millwright/stream-{uuid.uuid4().hex}"


def _late_parts(rows: DataFrame, path: str) -> Iterator[None]:
    """Appends rows (timestamp, ordinal) to path in parts by their time of arrival; the last one has a row of no
    machine a month later, which moves the watermark past all others."""
    arrival = F.unix_seconds("timestamp") + (F.col("ordinal") % (LATE + 1)) * 3600
    first, last, final = rows.agg(F.min(arrival), F.max(arrival), F.max("timestamp")).first()
    for part in range(PARTS):
        edges = [first + (last + 1 - first) * k // PARTS for k in (part, part + 1)]
        rows.filter((arrival >= edges[0]) & (arrival < edges[1])).write.mode("append").parquet(path)
        if part == PARTS - 1:
            end = {c: F.lit(None).cast(t) for c, t in rows.dtypes} | {"machine_id": F.lit(""), "timestamp": F.lit(final) + F.expr("INTERVAL 30 DAYS"), "ordinal": F.lit(0).cast("bigint")}
            rows.sparkSession.range(1).select(*[end[c].alias(c) for c in rows.columns]).write.mode("append").parquet(path)
        yield


def _tracked(spark: SparkSession, rows: DataFrame, track) -> DataFrame:
    base = _folder(spark)
    for _ in _late_parts(rows, f"{base}/in"):
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        with machines.rocks(spark):
            run = track(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            run.awaitTermination()
    return spark.read.schema(machines.OUTPUT).parquet(f"{base}/out")


def streamed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that come late and out of order, mapped and assembled to states in one streaming job."""
    maps = adapter.signal_mappings(spark)

    def track(stream: DataFrame) -> DataFrame:
        return machines.track_signals(map_observations(stream, maps).rows, DELAY, DAY_MINUTES, ("state",))

    # the row that ends the stream has to be mapped too
    end = maps.filter("machine_id = '0' and address = 'click'").withColumn("machine_id", F.lit(""))
    maps = maps.union(end)
    observed = adapter.observations(spark, sf_dir)
    closing = {"source": F.coalesce("source", F.lit("events")), "address": F.coalesce("address", F.lit("click")), "type": F.coalesce("type", F.lit("Digital"))}
    found = _tracked(spark, observed, lambda s: track(s.withColumns(closing)))
    return found.select("machine_id", "state", F.col("started_at").alias("timestamp"), "ordinal")


def streamed_activity(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """States that come late and out of order, to transitions or periods."""
    states = evaluate_states(adapter.snapshots(spark, sf_dir))
    return _tracked(spark, states, lambda s: machines.track_states(s, DELAY, DAY_MINUTES, (kind,)))


def _halves(spark: SparkSession, rows: DataFrame, path: str) -> Iterator[None]:
    """Appends rows to path in two parts by ordinal."""
    middle = (rows.agg(F.max("ordinal")).first()[0] or 0) // 2
    for part in (F.col("ordinal") <= middle, F.col("ordinal") > middle):
        rows.filter(part).write.mode("append").parquet(path)
        yield


def mapped_under_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in two parts; between them mappings are published that know one kind of event more."""
    base = _folder(spark)
    observed = adapter.observations(spark, sf_dir)
    mappings = ingest.VersionedTable(spark, f"{base}/mappings")
    for n, _ in enumerate(_halves(spark, observed, f"{base}/in")):
        mappings.publish(adapter.signal_mappings(spark, signup=n == 1))
        stream = spark.readStream.schema(observed.schema).parquet(f"{base}/in")
        ingest.run_to_end(stream, ingest.mapping_sink(mappings, f"{base}/out"), f"{base}/out")
    return ingest.outcome(spark, f"{base}/out", ingest.SOUND)


def quarantined_observations(spark: SparkSession, sf_dir: str, mappings: DataFrame) -> DataFrame:
    """(error_code) of every observation that has a mapping, from both tables of the sink."""
    base = _folder(spark)
    observed = adapter.observations(spark, sf_dir)
    published = ingest.VersionedTable(spark, f"{base}/mappings")
    published.publish(mappings)
    for _ in _halves(spark, observed, f"{base}/in"):
        stream = spark.readStream.schema(observed.schema).parquet(f"{base}/in")
        ingest.run_to_end(stream, ingest.mapping_sink(published, f"{base}/out"), f"{base}/out")
    found = [ingest.outcome(spark, f"{base}/out", w).select("error_code") for w in (ingest.SOUND, ingest.QUARANTINE)]
    return found[0].union(found[1])


def quarantined_documents(spark: SparkSession, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of sound documents, and one row of error for each bad one, of a stream of documents in two parts."""
    base = _folder(spark)
    halves = _halves(spark, payloads.withColumn("ordinal", F.col("payload_id")), f"{base}/in")
    for _ in halves:
        stream = spark.readStream.schema(payloads.schema).parquet(f"{base}/in")
        ingest.run_to_end(stream, ingest.document_sink(f"{base}/out"), f"{base}/out")
    return ingest.outcome(spark, f"{base}/out", ingest.SOUND), ingest.outcome(spark, f"{base}/out", ingest.QUARANTINE)
