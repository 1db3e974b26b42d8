"""Many agents over HTTP: scans with failing agents, and a stream through restarts, failures and replays."""

import http.server
import json
import os
import re
import threading
import time
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.plans import documents, queries
from millwright.sources.agents import GROUPS, SAMPLE, Agent, AgentsSource, agents_option

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
EMPTY = '<Doc><Header instanceId="{0}" firstSequence="1" lastSequence="1" nextSequence="{1}"/><Streams/></Doc>'


class Plant:
    """Agents by the first part of the path. samples: by agent (instance, next, document) in order; broken: agents
    that answer 500; gone: sequences below this are no longer in the buffers, by agent."""

    def __init__(self):
        self.samples, self.current, self.probe, self.broken, self.gone, self.asked = {}, {}, {}, set(), {}, []

    def answer(self, path):
        parts = urlsplit(path)
        _, agent, what = parts.path.split("/")
        if agent in self.broken:
            return 500, "broken"
        if what != "sample":
            return 200, getattr(self, what)[agent]
        since = int(parse_qs(parts.query)["from"][0])
        self.asked.append((agent, since))
        if since < self.gone.get(agent, 0):
            return 404, "out of range"
        ahead = next((s for s in self.samples[agent] if s[1] > since), None)
        return 200, ahead[2] if ahead else EMPTY.format(self.samples[agent][-1][0], since)


@pytest.fixture
def plant():
    found = Plant()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            status, body = found.answer(self.path)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    found.url = f"http://127.0.0.1:{server.server_port}"
    yield found
    server.shutdown()


def serve_events(spark, plant):
    """The events as agents' answers: one agent a machine, of which machine 7's restarts after its first block."""
    for r in documents.sample_documents(spark, SF).orderBy("payload_id").collect():
        instance, ahead = (int(re.search(f'{n}="([0-9]+)"', r.xml)[1]) for n in ("instanceId", "nextSequence"))
        plant.samples.setdefault(r.machine_id, []).append((instance, ahead, r.xml))
    return [Agent(f"{plant.url}/{m}", m, f"MACHINE-{m}", 0) for m in sorted(plant.samples)]


def run_until(spark, options, folder, done, seconds=120):
    """The stream with a sink that is idempotent by batch, until done() or it ends."""

    def put(df, n):
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    stream = spark.readStream.format("machine_agents").options(**options).load()
    run = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(processingTime="300 milliseconds").start()
    until = time.time() + seconds
    while time.time() < until and run.isActive and not done():
        time.sleep(0.2)
    run.stop()
    return run


def committed(folder):
    return max((int(n) for n in os.listdir(f"{folder}/state/commits") if n.isdigit()), default=-1)


@needs_tables
def test_stream_of_many_agents_with_a_restart_and_a_replay(spark, plant, tmp_path):
    spark.dataSource.register(AgentsSource)
    agents = serve_events(spark, plant)
    plant.samples["silent"] = [(1, 5, EMPTY.format(1, 5))]
    plant.broken.add("silent")
    agents.append(Agent(f"{plant.url}/silent", "silent", "x"))
    options = {"agents": agents_option(agents), "landing": f"{tmp_path}/landing", "on_error": "quarantine", "on_restart": "resume"}
    run_until(spark, options, tmp_path, lambda: os.path.isdir(f"{tmp_path}/state/commits") and committed(tmp_path) >= 1)
    # the last batch is done again: what it read is in no agent's buffer any longer
    last = committed(tmp_path)
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{tmp_path}/state/commits/{name}"):
            os.remove(f"{tmp_path}/state/commits/{name}")
    plant.gone = {agent: since for agent, since in plant.asked if agent != "7"}
    asked = len(plant.asked)
    finals = {m: s[-1][1] for m, s in plant.samples.items() if m != "silent"}
    run_until(spark, options, tmp_path, lambda: all((m, n) in plant.asked[asked:] for m, n in finals.items()))
    rows = spark.read.parquet(f"{tmp_path}/out").cache()
    got = rows.filter("error_code is null").select("machine_id", F.col("sequence").cast("bigint"), "address", F.col("value.num").cast("double"), F.col("timestamp").cast("timestamp_ntz"), "position")
    expected = queries.queries()["s9_sample_rows"](spark, SF).select("machine_id", "sequence", "address", "number", "timestamp", "position")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    errors = {(r.machine_id, r.error_code) for r in rows.filter("error_code is not null").collect()}
    restarted = {("7", "E13")} if len({s[0] for s in plant.samples["7"]}) > 1 else set()
    assert errors == {("silent", "E15")} | restarted
    per_group = [n.split("-")[0] for n in os.listdir(f"{tmp_path}/landing")]
    assert max(map(per_group.count, per_group)) <= 2  # what is committed goes


def test_a_restart_ends_a_strict_stream_and_is_waited_out_otherwise(spark, plant, tmp_path):
    spark.dataSource.register(AgentsSource)
    plant.samples["a"] = [(1, 5, EMPTY.format(1, 5)), (2, 9, EMPTY.format(2, 9))]
    listed = agents_option([Agent(f"{plant.url}/a", "a", "x", 4)])
    run = run_until(spark, {"agents": listed, "landing": f"{tmp_path}/l1"}, tmp_path / "strict", lambda: False, 60)
    assert "E13" in str(run.exception())
    plant.asked.clear()
    run_until(spark, {"agents": listed, "landing": f"{tmp_path}/l2", "on_error": "quarantine"}, tmp_path / "stay", lambda: plant.asked.count(("a", 5)) > 2)
    codes = [r.error_code for r in spark.read.parquet(f"{tmp_path}/stay/out").collect()]
    assert set(codes) == {"E13"} and len(codes) >= 2  # the cursor stays where it was


def test_the_driver_plans_from_footers_alone(spark, tmp_path):
    """A stream's reader whose driver side must not fetch: agents without a landed file start at their own sequence."""
    from millwright.sources.agents import _AgentsStream, _settings

    def no_fetch(url):
        raise AssertionError("a fetch on the driver")

    agents = [Agent("http://h/a", "a", "x", 7), Agent("http://h/b", "b", "x")]
    settings = _settings({"agents": agents_option(agents), "landing": str(tmp_path), "groups": "1"}, T.StructType.fromDDL(SAMPLE))
    driver = _AgentsStream(settings, no_fetch)
    end = driver.latestOffset()
    assert end == {"tick": 1, "since": {agents[0].key: {"instance": None, "next": 7}, agents[1].key: {"instance": None, "next": 1}}}
    (part,) = driver.partitions(driver.initialOffset(), end)
    asked = []
    worker = _AgentsStream(settings, lambda url: asked.append(url) or EMPTY.format(3, 20))
    assert list(worker.read(part)) == [] and list(worker.read(part)) == []
    assert asked == ["http://h/a/sample?from=7", "http://h/b/sample?from=1"]  # the second time it was there
    later = driver.latestOffset()
    assert later["tick"] == 2 and {c["next"] for c in later["since"].values()} == {20}
    driver.commit(later)
    assert os.listdir(tmp_path) == []  # older than what was committed


def test_scans_of_many_agents(spark, plant):
    spark.dataSource.register(AgentsSource)
    kept = '<Doc><Streams><DeviceStream name="x{0}"><Events><M dataItemId="d" timestamp="2024-01-01T00:00:00Z">v{0}</M></Events></DeviceStream></Streams></Doc>'
    probe = '<Doc><Header instanceId="7" version="2"/><Devices><Device id="m{0}"><DataItems><DataItem id="i{0}" type="T"/></DataItems></Device></Devices></Doc>'
    for m in "abcd":
        plant.current[m], plant.probe[m] = kept.format(m), probe.format(m)
    plant.broken.add("c")
    plant.current["d"] = "<Doc>"
    agents = [Agent(f"{plant.url}/{m}", m, f"X{m}") for m in "abcd"]
    read = spark.read.format("machine_agents").option("on_error", "quarantine")
    listed = agents_option([*agents, Agent("ftp://nowhere", "e", "x")])
    rows = read.options(agents=listed, mode="current").load()
    assert 1 < rows.rdd.getNumPartitions() <= min(5, GROUPS)
    found = {(r.machine_id, r.error_code, r.value and r.value.text, r.doc_ordinal) for r in rows.collect()}
    assert found == {("a", None, "va", 0), ("b", None, "vb", 0), ("c", "E15", None, None), ("d", "E15", None, None), ("e", "E14", None, None)}
    items = read.options(agents=agents_option(agents), mode="probe").load().collect()
    assert {(r.machine_id, r.error_code, r.item_id, r.agent_instance_id) for r in items} == {("a", None, "ia", "7"), ("b", None, "ib", "7"), ("c", "E15", None, None), ("d", None, "id", "7")}
    with pytest.raises(Exception, match="500"):
        spark.read.format("machine_agents").options(agents=agents_option(agents[:3]), mode="current").load().collect()
    with pytest.raises(Exception, match="E14"):
        spark.read.format("machine_agents").options(agents=listed, mode="current").load().collect()


def test_large_and_exact_numbers(spark, plant):
    spark.dataSource.register(AgentsSource)
    body = '<Doc><Streams><DeviceStream name="x"><Samples><M dataItemId="d" timestamp="2024-01-01T00:00:00Z">{}</M></Samples></DeviceStream></Streams></Doc>'
    for m, text in {"a": "79228162514264337593543950335", "b": "-0.1234567895", "c": "unavailable", "d": "1e-12"}.items():
        plant.current[m] = body.format(text)
    agents = [Agent(f"{plant.url}/{m}", m, "x") for m in "abcd"]
    rows = spark.read.format("machine_agents").options(agents=agents_option(agents), mode="current").load().orderBy("machine_id").collect()
    assert [r.value and str(r.value.num) for r in rows] == ["79228162514264337593543950335.000000000", "-0.123456790", None, "0E-9"]
    assert json.loads(agents_option(agents))[0][1] == "a"
