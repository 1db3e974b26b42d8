"""The events table written as agent documents, so that the document sources can be asked over all of it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import light_batches, written
from ..sources import xml
from .adapter import MACHINES, _events

BLOCK = 500
#: The machine whose agent restarts after its first block.
RESTARTED = "7"


def sample_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample document for each machine and block of event ids, latest readings first: payload_id, xml, machine_id, device_key."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    reading = F.format_string('<m:Value dataItemId="%s" sequence="%d" timestamp="%s">%s</m:Value>', F.col("event_type"), F.col("event_id"), at, F.round("value", 3).cast("decimal(20,3)").cast("string"))
    blocks = _events(spark, sf_dir).withColumn("block", F.floor(F.col("event_id") / BLOCK))
    grouped = blocks.groupBy("machine_id", "block").agg(
        F.reverse(F.sort_array(F.collect_list(F.struct("event_id", reading.alias("x"))))).alias("r"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi")
    )
    body = F.array_join(F.transform("r", lambda r: r["x"]), "")
    head = F.format_string('<m:Doc xmlns:m="urn:example"><m:Header instanceId="%d" firstSequence="%d" lastSequence="%d" nextSequence="%d"/><m:Streams><m:DeviceStream name="Machine-%s" uuid="u%s"><m:ComponentStream component="C" componentId="c"><m:Samples>', F.when((F.col("machine_id") == RESTARTED) & (F.col("block") >= 1), 43).otherwise(42), "lo", "hi", F.col("hi") + 1, "machine_id", "machine_id")
    return grouped.select(
        (F.col("block") * MACHINES + F.col("machine_id").cast("int")).cast("bigint").alias("payload_id"),
        F.concat(head, body, F.lit("</m:Samples></m:ComponentStream></m:DeviceStream></m:Streams></m:Doc>")).alias("xml"),
        "machine_id", F.concat(F.lit("MACHINE-"), "machine_id").alias("device_key"),
    )


def as_files(payloads: DataFrame, path: str) -> DataFrame:
    """payloads (payload_id, xml, machine_id, device_key) written as a file each: payload_id, path, machine_id, device_key.

    Workers write the files where they stay, an attempt into a folder of its own, and their list is a table: the driver
    neither moves nor lists them.  The list is dealt by number, as its few bytes tell nothing of the work behind it.
    """

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = f"{path}/{uuid.uuid4().hex}"
        store, own = xml.store_of(folder)
        store.create_dir(own)
        for frame in frames:
            for payload_id, text in zip(frame["payload_id"], frame["xml"]):
                with store.open_output_stream(f"{own}/{payload_id}.xml") as f:
                    f.write((text or "").encode())
            yield frame[["payload_id", "machine_id", "device_key"]].assign(path=[f"{folder}/{n}.xml" for n in frame["payload_id"]])

    listed = light_batches(payloads).mapInPandas(put, "payload_id bigint, path string, machine_id string, device_key string")
    return written(listed, "document-list").repartition(int(payloads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "payload_id")


def current_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current values of the same blocks: each event as an enumeration, unavailable where its k leaves 18 by 20."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    text = F.when(F.col("k") % 20 == 18, "Unavailable").otherwise(F.col("event_type"))
    reading = F.format_string('<Mode dataItemId="d%d" timestamp="%s"> %s </Mode>', F.col("event_id"), at, text)
    blocks = _events(spark, sf_dir).withColumn("block", F.floor(F.col("event_id") / BLOCK))
    grouped = blocks.groupBy("machine_id", "block").agg(F.sort_array(F.collect_list(F.struct("event_id", reading.alias("x")))).alias("r"))
    body = F.array_join(F.transform("r", lambda r: r["x"]), "")
    return grouped.select(
        (F.col("block") * MACHINES + F.col("machine_id").cast("int")).cast("bigint").alias("payload_id"),
        F.concat(F.format_string('<Doc><Streams><DeviceStream name="x" uuid="u%s"><Events>', "machine_id"), body, F.lit("</Events></DeviceStream></Streams></Doc>")).alias("xml"),
        "machine_id", F.concat(F.lit("U"), "machine_id").alias("device_key"),
    )


def probe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe for each machine with an item for each kind of event on a component, and one on the device."""
    kinds = _events(spark, sf_dir).groupBy("machine_id").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"))
    items = F.array_join(F.transform("kinds", lambda k: F.concat(F.lit('<DataItem id="'), k, F.lit('" type="EVENT" category="EVENT" units="COUNT"/>'))), "")
    return kinds.select(
        F.col("machine_id").cast("bigint").alias("payload_id"),
        F.concat(
            F.format_string('<Doc xmlns="urn:example"><Header instanceId="7" version="2.0"/><Devices><Device id="m%s" name="Machine-%s" uuid="u%s"><DataItems><DataItem id="avail" type="AVAILABILITY"/></DataItems><Components><Controller id="ctl" name="main"><DataItems>', "machine_id", "machine_id", "machine_id"),
            items, F.lit("</DataItems></Controller></Components></Device></Devices></Doc>"),
        ).alias("xml"),
    )
