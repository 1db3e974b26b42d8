import random
import weakref
from datetime import datetime, timedelta

import pandas as pd
import pytest

from millwright.operators.state import activity_periods, assemble_snapshots, empty_snapshots, evaluate_states, transitions
from millwright.schemas import schema
from millwright.streaming.machines import rocks
from millwright.streaming.state import ActivityProcessor, track_activity

T0 = datetime(2026, 1, 1, 10)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def value(flag=None, num=None, text=None):
    return (flag, num, text, None)


def signal(key, flag, quality="Good", kind="Digital"):
    return (key, kind, None if flag is None else value(flag), "s", quality, T0)


@pytest.mark.parametrize(
    "signals, state",
    [
        ([("state.running", True), ("state.idle", True), ("state.fault", True)], "Fault"),
        ([("state.running", True), ("state.idle", False), ("state.fault", False)], "Running"),
        ([("state.running", False), ("state.idle", True), ("state.fault", False)], "Idle"),
        ([("state.running", False), ("state.idle", False), ("state.fault", False)], "Stopped"),
        ([("state.idle", False), ("state.fault", False)], "Unknown"),
        ([("state.running", True, "Bad")], "Unknown"),
        ([("state.running", True, "Uncertain"), ("State.Running", True)], "Running"),
        # the first good signal decides, even if it is no digital value
        ([("state.running", True, "Good", "Analog"), ("state.running", True)], "Unknown"),
        ([("state.running", None), ("state.running", True)], "Unknown"),
        ([], "Unknown"),
    ],
)
def test_state_priority(spark, signals, state):
    df = spark.createDataFrame([("m", [signal(*s) for s in signals], T0, 1)], schema("snapshots"))
    assert evaluate_states(df).first()["state"] == state


def test_transitions_and_periods(spark):
    rows = [("a", "Unknown", 0), ("a", "Running", 1), ("a", "Running", 2), ("a", "Idle", 13), ("b", "Idle", 5), ("b", "Running", 20), ("b", "Fault", 19)]
    states = spark.createDataFrame([(m, s, at(t), i) for i, (m, s, t) in enumerate(rows)], schema("states"))
    changes = transitions(states, order=("ordinal",)).withColumnsRenamed({})
    found = sorted((r.machine_id, r.previous_state, r.current_state) for r in changes.collect())
    assert found == [("a", "Running", "Idle"), ("a", "Unknown", "Running"), ("b", "Idle", "Running"), ("b", "Running", "Fault"), ("b", "Unknown", "Idle")]
    full = transitions(states)
    periods = {(r.machine_id, r.state): r.duration_us // 60_000_000 for r in activity_periods(full).collect()}
    assert periods == {("a", "Running"): 12, ("b", "Idle"): 14, ("b", "Fault"): 1}


def test_periods_close_on_equal_states_and_may_be_negative(spark):
    rows = [("m", "Unknown", "Running", at(10), 1), ("m", "Running", "Running", at(5), 2), ("m", "Running", "Idle", at(6), 3)]
    changes = spark.createDataFrame(rows, schema("transitions"))
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    found = [(r.state, r.duration_us) for r in activity_periods(changes).collect()]
    assert len(found) == 2
    by_arrival = changes.withColumn("e", F.lead("timestamp").over(Window.partitionBy("machine_id").orderBy("ordinal"))).filter("e is not null").count()
    assert by_arrival == 2


def test_an_unavailable_reading_resets_a_signal(spark):
    rows = [("m", "s", "a", "state.running", "Digital", value(True), "Good", at(0), 1), ("m", "s", "a", "state.running", "Digital", None, "Uncertain", at(1), 2)]
    states = evaluate_states(assemble_snapshots(spark.createDataFrame(rows, schema("mapped_observations")))).orderBy("ordinal").collect()
    assert [r.state for r in states] == ["Running", "Unknown"]


def test_slices_are_one_history(spark):
    """Changes, periods and readings carry over days, and over days without rows."""
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), rnd.choice(["Running", "Idle", "Fault"]), T0 + timedelta(hours=rnd.randrange(24 * 20)), i) for i in range(60)]
    rows = [r for r in rows if r[2].day % 3]
    expected, closed = [], []
    for m in "ab":
        last, since = "Unknown", None
        for _, state, when, i in sorted((r for r in rows if r[0] == m), key=lambda r: (r[2], r[3])):
            if state != last:
                expected.append((m, last, state, i))
                if since is not None:
                    closed.append((m, last, since, when))
                last, since = state, when
    changes = transitions(spark.createDataFrame(rows, schema("states")))
    assert sorted((r.machine_id, r.previous_state, r.current_state, r.ordinal) for r in changes.collect()) == sorted(expected)
    assert sorted((r.machine_id, r.state, r.started_at, r.ended_at) for r in activity_periods(changes).collect()) == sorted(closed)
    readings = [(m, "s", "a", f"state.{s.lower()}", "Digital", value(i % 2 == 0), "Good", t, i) for m, s, t, i in rows]
    latest, states = {}, []
    for m, _, _, key, _, v, _, t, i in sorted(readings, key=lambda r: (r[0], r[7], r[8])):
        latest[m, key] = v[0]
        now = [latest.get((m, f"state.{k}")) for k in ("fault", "running", "idle")]
        states.append((i, "Fault" if now[0] else "Running" if now[1] else "Idle" if now[2] else "Stopped" if now[1] is not None else "Unknown"))
    found = evaluate_states(assemble_snapshots(spark.createDataFrame(readings, schema("mapped_observations")))).collect()
    assert sorted((r.ordinal, r.state) for r in found) == sorted(states)


def test_empty_snapshots_are_unknown(spark):
    assert [r.state for r in evaluate_states(empty_snapshots(spark, ["a", "b"])).collect()] == ["Unknown"] * 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(m, s, at(t), t) for t, (m, s) in enumerate([("a", "Running"), ("b", "Unknown"), ("a", "Running"), ("a", "Idle"), ("b", "Fault"), ("b", "Running"), ("a", "Running")])]
    for i in (0, 1):
        part = spark.createDataFrame(rows[4 * i : 4 * i + 4], schema("states"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema("states")).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with rocks(spark):
        run = track_activity(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = transitions(spark.createDataFrame(rows, schema("states")))
    got = sorted((r.machine_id, r.previous_state, r.state, r.started_at) for r in out.filter("kind = 'transition'").collect())
    assert got == sorted((r.machine_id, r.previous_state, r.current_state, r.timestamp) for r in batch.collect())
    got = sorted((r.machine_id, r.state, r.started_at, r.ended_at) for r in out.filter("kind = 'period'").collect())
    assert got == sorted((r.machine_id, r.state, r.started_at, r.ended_at) for r in activity_periods(batch).collect())


class _Held:
    """State of one machine in memory, as the store has it."""

    def __init__(self):
        self.value, self.map = None, {}

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]


def test_a_large_batch_of_a_machine_is_taken_chunk_by_chunk():
    frame = pd.DataFrame([(n, ("Idle", "Running", "Fault")[n * n % 7 % 3], pd.Timestamp("2024-01-01") + pd.Timedelta(hours=n * 29 % 240)) for n in range(400)], columns=["ordinal", "state", "timestamp"])
    alive = []

    def chunks():
        for n in range(0, 400, 10):
            assert sum(r() is not None for r in alive) <= 3
            chunk = frame[n : n + 10].copy()
            alive.append(weakref.ref(chunk))
            yield chunk
            del chunk

    tracker = ActivityProcessor()
    tracker.open, tracker.waiting = _Held(), _Held()
    found = pd.concat(tracker.handleInputRows(("m",), chunks(), None))
    state, expected = "Unknown", []
    for r in frame.sort_values(["timestamp", "ordinal"]).itertuples():
        if r.state != state:
            expected.append((state, r.state, r.timestamp, r.ordinal))
            state = r.state
    got = found[found["kind"] == "transition"]
    assert list(zip(got["previous_state"], got["state"], got["started_at"], got["ordinal"])) == expected
    assert not tracker.waiting.map and tracker.open.value == (state, expected[-1][2].to_pydatetime())


def test_a_stream_in_small_chunks_equals_batch(spark, tmp_path):
    rows = [("ab"[n % 2], ("Idle", "Running", "Fault")[n * n % 7 % 3], at(n * 997 % 9000), n) for n in range(60)]
    spark.createDataFrame(rows, schema("states")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema("states")).parquet(str(tmp_path / "in"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        with rocks(spark):
            run = track_activity(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        spark.conf.set(key, before)
    ordered = sorted(rows, key=lambda r: (r[0], r[2], r[3]))
    expected, state = [], {}
    for m, s, t, n in ordered:
        if s != state.get(m, "Unknown"):
            expected.append((m, state.get(m, "Unknown"), s, n))
            state[m] = s
    out = spark.read.parquet(str(tmp_path / "out")).filter("kind = 'transition'")
    assert sorted((r.machine_id, r.previous_state, r.state, r.ordinal) for r in out.collect()) == sorted(expected)


def test_assembly_of_the_plant(spark):
    from millwright.operators import catalog

    machine = ("m1", "Mill", "l1", [("state.running", "run", "Digital", "State", None, True)], [("milling", "Milling")])
    df = spark.createDataFrame([("f", [("l1", "Line", [machine, ("m2", "Lathe", "l1", [], [])])])], schema("factories"))
    assert [(r.factory, r.line, r.machine_id) for r in catalog.machines(df).orderBy("machine_id").collect()] == [("f", "Line", "m1"), ("f", "Line", "m2")]
    assert [(r.machine_id, r.key) for r in catalog.signal_definitions(df).collect()] == [("m1", "state.running")]
    assert [(r.machine_id, r.key) for r in catalog.capabilities(df).collect()] == [("m1", "milling")]


def test_operators_change_in_mid_shift(spark):
    from millwright.operators.catalog import operators_at

    a = spark.createDataFrame([("c", "s", "m", "1", "ann", at(0), at(60)), ("c", "s", "m", "1", "bob", at(60), None)], schema("operator_assignments"))
    rows = spark.createDataFrame([("c", "s", "m", "1", at(t)) for t in (-1, 0, 59, 60, 500)], "company_id string, site_id string, machine_id string, shift_id string, t timestamp")
    assert [r.assigned_operator for r in operators_at(rows, a, "t").orderBy("t").collect()] == [None, "ann", "ann", "bob", "bob"]
