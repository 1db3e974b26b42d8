"""Streams that come late, out of order and twice, against the batch operators."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millwright.operators.mapping import map_observations
from millwright.operators.state import activity_periods, assemble_snapshots, evaluate_states, transitions
from millwright.schemas import schema
from millwright.sources import xml
from millwright.streaming import ingest, machines

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def run(spark, track, ddl, parts, base):
    """Each part as a file of its own, run to its end before the next comes; then a row that ends the stream."""
    for part in parts:
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(ddl).parquet(f"{base}/in")
        with machines.rocks(spark):
            query = track(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.schema(machines.OUTPUT).parquet(f"{base}/out").filter("machine_id <> ''").collect()


@pytest.mark.parametrize("minutes", [1, 60])
def test_late_states_in_small_chunks(spark, tmp_path, minutes):
    rnd = random.Random(minutes)
    rows = [(rnd.choice("abc"), rnd.choice(["Running", "Idle", "Fault", "Stopped", "Unknown"]), at(rnd.randrange(300) / 2), n) for n in range(120)]
    # a row may come up to an hour after later ones
    arrived = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rnd.randrange(60)))
    parts = [arrived[:50], arrived[50:90], [*arrived[90:], ("", "Idle", at(10_000), 0), ("a", "Idle", None, 999)]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
    try:
        out = run(spark, lambda s: machines.track_states(s, "90 minutes", minutes), schema("states"), parts, tmp_path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    batch = transitions(spark.createDataFrame(rows, schema("states")))
    got = sorted((r.machine_id, r.previous_state, r.state, r.started_at, r.ordinal) for r in out if r.kind == "transition")
    assert got == sorted((r.machine_id, r.previous_state, r.current_state, r.timestamp, r.ordinal) for r in batch.collect())
    got = sorted((r.machine_id, r.state, r.started_at, r.ended_at) for r in out if r.kind == "period")
    assert got == sorted((r.machine_id, r.state, r.started_at, r.ended_at) for r in activity_periods(batch).collect())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") == provider


def test_signals_to_states_transitions_and_periods_in_one_stream(spark, tmp_path):
    rnd = random.Random(4)
    rows = []
    for n in range(90):
        value = rnd.choice([None, (True, None, None, None), (True, None, None, None), (False, None, None, None)])
        key = rnd.choice(["state.running", "State.Running", "state.idle", "state.fault", "energy.current"])
        rows.append((rnd.choice("ab"), "s", "x", key, rnd.choice(["Digital"] * 5 + ["Text"]), value, rnd.choice(["Good", "Good", "Good", "Bad"]), at(rnd.randrange(200)), n))
    arrived = sorted(rows, key=lambda r: r[7] + timedelta(minutes=rnd.randrange(30)))
    parts = [arrived[:40], [*arrived[40:], ("", "s", "x", "other", "Digital", None, "Good", at(10_000), 0)]]
    out = run(spark, lambda s: machines.track_signals(s, "40 minutes", 15), schema("mapped_observations"), parts, tmp_path)
    states = evaluate_states(assemble_snapshots(spark.createDataFrame(rows, schema("mapped_observations")))).cache()
    assert sorted((r.machine_id, r.state, r.started_at, r.ordinal) for r in out if r.kind == "state") == sorted((r.machine_id, r.state, r.timestamp, r.ordinal) for r in states.collect())
    changes = transitions(states)
    assert sorted((r.machine_id, r.previous_state, r.state, r.ordinal) for r in out if r.kind == "transition") == sorted((r.machine_id, r.previous_state, r.current_state, r.ordinal) for r in changes.collect())
    assert len([r for r in out if r.kind == "period"]) == activity_periods(changes).count()


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    parts = [[("a", "Running", at(0), 1), ("a", "Idle", at(500), 3)], [("a", "Fault", at(10), 2), ("", "Idle", at(9_000), 9)]]
    out = run(spark, lambda s: machines.track_states(s, "60 minutes", 60, ("transition",)), schema("states"), parts, tmp_path)
    assert sorted(r.ordinal for r in out) == [1, 3]


@pytest.mark.parametrize("flags", [(a, b, c) for a in (None, True, False) for b in (None, True) for c in (None, False, True)])
def test_the_streams_state_is_the_batchs(spark, flags):
    from millwright.operators.state import state_of

    named = spark.range(1).select(state_of(*(F.lit(f).cast("boolean") for f in flags)).alias("s"))
    assert machines.state_of(*flags) == named.first().s


def observed(address, n, kind="Digital"):
    return ("m", "P", address, kind, (True, None, None, None), "Good", at(n), n)


def mapping(address, key, kind="Digital", invert=False, ordinal=0):
    return ("m", "p", address, key, kind, invert, ordinal)


def feed(spark, rows, mappings, base):
    spark.createDataFrame(rows, schema("observations")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(schema("observations")).parquet(f"{base}/in")
    ingest.run_to_end(stream, ingest.mapping_sink(mappings, f"{base}/out"), f"{base}/out")


def undo_last_commit(base):
    folder = f"{base}/out/checkpoint/commits"
    last = max(int(n) for n in os.listdir(folder) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{folder}/{name}"):
            os.remove(f"{folder}/{name}")


def test_a_batch_done_twice_uses_its_own_mappings_and_leaves_each_row_once(spark, tmp_path):
    mappings = ingest.VersionedTable(spark, f"{tmp_path}/mappings")
    with pytest.raises(Exception, match="no mappings"):
        feed(spark, [observed("A", 1)], mappings, tmp_path)
    assert mappings.publish(spark.createDataFrame([mapping("a", "k1"), mapping("b", "k2", "Text"), mapping("c", "k3"), mapping("c", "k4")], schema("signal_mappings"))) == 1
    feed(spark, [observed(x, n) for n, x in enumerate("ABCD")], mappings, tmp_path)
    assert mappings.publish(spark.createDataFrame([mapping("a", "k9", invert=True), mapping("b", "k2")], schema("signal_mappings"))) == 2
    undo_last_commit(tmp_path)
    feed(spark, [observed("A", 10), observed("B", 11), observed("C", 12)], mappings, tmp_path)
    sound = ingest.outcome(spark, f"{tmp_path}/out", ingest.SOUND).collect()
    bad = ingest.outcome(spark, f"{tmp_path}/out", ingest.QUARANTINE).collect()
    found = sorted((r.ordinal, r.signal_key, r.value.bool, r.mapping_version) for r in sound)
    assert found == [(0, "k1", True, 1), (1, "k1", True, 1), (10, "k9", False, 2), (11, "k2", True, 2)]
    assert sorted((r.error_code, r.mapping_version) for r in bad) == [("E2", 1), ("E3", 1)]
    assert {r.signal_key for r in bad} == {None} and len({r.batch for r in [*sound, *bad]}) >= 2


def test_marked_rows_are_the_checked_ones(spark):
    from millwright.operators.mapping import mark_observations

    maps = spark.createDataFrame([mapping("a", "k1"), mapping("b", "k2", "Text"), mapping("c", "k3"), mapping("c", "k4"), mapping("d", "k5", "Text", True)], schema("signal_mappings"))
    rows = spark.createDataFrame([observed("A", 1), observed("B", 2), observed("C", 3), observed("D", 4, "Text"), observed("E", 5)], schema("observations"))
    checked, marked = map_observations(rows, maps, "quarantine"), mark_observations(rows, maps)
    assert sorted(map(str, checked.rows.collect())) == sorted(map(str, marked.filter("error is null").drop("error_code", "error").collect()))
    assert sorted((r.ordinal, r.error_code, r.error) for r in checked.errors.collect()) == sorted((r.ordinal, r.error_code, r.error) for r in marked.filter("error is not null").collect())


def test_documents_done_twice(spark, tmp_path):
    good = '<D><Header instanceId="1" firstSequence="1" lastSequence="2" nextSequence="3"/><S><DeviceStream name="x"><Events><E dataItemId="i" sequence="1" timestamp="2024-01-01T00:00:00Z">on</E></Events></DeviceStream></S></D>'
    ddl = "payload_id bigint, xml string, machine_id string, device_key string"
    rows = [(1, good, "m", "X"), (2, "<D>", "m", "X"), (3, good.replace('sequence="1"', ""), "m", "X"), (4, good, "m", " ")]
    for part in (rows[:2], rows[2:], []):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ddl).parquet(f"{tmp_path}/in")
        ingest.run_to_end(stream, ingest.document_sink(f"{tmp_path}/out"), f"{tmp_path}/out")
        undo_last_commit(tmp_path)
    assert [(r.payload_id, r.value.text, int(r.sequence)) for r in ingest.outcome(spark, f"{tmp_path}/out", ingest.SOUND).collect()] == [(1, "on", 1)]
    assert sorted((r.payload_id, r.error[:3]) for r in ingest.outcome(spark, f"{tmp_path}/out", ingest.QUARANTINE).collect()) == [(2, "E15"), (3, "E9:"), (4, "E16")]
    assert xml.sample_rows(spark.createDataFrame(rows[:1], ddl)).count() == 1
