import http.server
import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millwright.functions.text import folded_map, hours, is_blank, parse_instant, parse_number, parse_u64, same_key, trimmed
from millwright.sources import xml
from millwright.sources.agent import AgentSource, Endpoint, InstanceChanged, Session, discover, read_current, read_sample
from millwright.sources.cursor import cursor_trace

HEAD = '<Header instanceId="42" firstSequence="1" lastSequence="104" nextSequence="105"/>'


def sample(body, head=HEAD, device='name="Mill" uuid="U-1"'):
    return f'<d:Doc xmlns:d="urn:x">{head}<Streams><DeviceStream {device}><ComponentStream>{body}</ComponentStream></DeviceStream></Streams></d:Doc>'


def value(item, text, sequence=101, at="2026-01-01T10:00:00Z", tag="V"):
    return f'<{tag} dataItemId="{item}" timestamp="{at}" sequence="{sequence}">{text}</{tag}>'


def test_samples_are_ordered_and_typed():
    body = f"<Samples>{value('load', '4.25e1', 101)}{value('x', '1', 104)}</Samples><Events>{value('exec', ' ACTIVE ', 102)}{value('avail', 'unavailable', 103)}</Events><Condition>{value('c', 'hot<b>!</b>', 101, tag='Fault')}</Condition>"
    found = xml.parse_sample(sample(body), "m", "mill")
    assert [(r["sequence"], r["address"], r["type"]) for r in found["observations"]] == [(101, "load", "Numeric"), (101, "c", "Text"), (102, "exec", "Enumeration"), (103, "avail", "Enumeration"), (104, "x", "Numeric")]
    by = {r["address"]: r for r in found["observations"]}
    assert by["load"]["value"]["num"] == Decimal("42.5") and by["exec"]["value"]["text"] == "ACTIVE" and by["c"]["value"]["text"] == "hot!"
    assert by["avail"]["value"] is None and by["avail"]["quality"] == "Uncertain"
    assert (found["instance_id"], found["first_sequence"], found["last_sequence"], found["next_sequence"]) == (42, 1, 104, 105)


def test_unknown_device_keeps_the_header():
    assert xml.parse_sample(sample(value("a", "bad")), "m", "lathe") == {"instance_id": 42, "first_sequence": 1, "last_sequence": 104, "next_sequence": 105, "observations": []}
    assert xml.parse_current(sample(""), "m", "lathe") == []


@pytest.mark.parametrize(
    "document, code",
    [
        (" ", "E16"), ("<a>", "E15"), (sample("", head=""), "E9"), (sample("", head=HEAD * 2), "E9"), (sample("", head=HEAD.replace("105", "+105")), "E9"),
        (sample("", head=HEAD.replace("105", "18446744073709551616")), "E9"), (sample(f"<Events>{value('a', 'x', sequence='x')}</Events>"), "E9"),
        (sample(f"<Samples>{value('a', 'invalid')}</Samples>"), "E11"), (sample(f"<Samples>{value('a', '1,000')}</Samples>"), "E11"), (sample(f"<Samples>{value('a', 'NaN')}</Samples>"), "E11"),
        (sample(f"<Events>{value(' ', 'x')}</Events>"), "E11"), (sample(f"<Events>{value('a', 'x', at='soon')}</Events>"), "E11"), (sample(value("a", "x")), "E11"),
        (f'<D>{HEAD}<DeviceStream name="mill"/><DeviceStream uuid="MILL"/></D>', "E10"),
    ],
)
def test_bad_samples(document, code):
    with pytest.raises(xml.InvalidDocument, match=code):
        xml.parse_sample(document, "m", "mill")


@pytest.mark.parametrize("document, code", [(sample("", head=""), "E16"), ("<a>", "E16"), (" ", "E16")])
def test_a_blank_key_comes_before_the_document(document, code):
    for parse in (xml.parse_sample, xml.parse_current):
        with pytest.raises(xml.InvalidDocument, match=code):
            parse(document, "m", " ")


def test_large_sequences():
    head = HEAD.replace("105", "18446744073709551615")
    assert xml.parse_sample(sample("", head=head), "m", "mill")["next_sequence"] == 2**64 - 1


def test_nearest_section_counts():
    body = f"<Events><Samples>{value('a', '1')}</Samples>{value('b', 'x', 102)}</Events>"
    assert [r["type"] for r in xml.parse_current(sample(body), "m", "u-1")] == ["Numeric", "Enumeration"]


PROBE = """<p:Devices xmlns:p="urn:y"><p:Header instanceId="7" version="2.1"/><p:Device id="d1" name="Mill" uuid="u1"><p:DataItems><p:DataItem id="avail" type="AVAILABILITY"/></p:DataItems>
<p:Components><p:Controller id="c1" name="main"><p:DataItems><p:DataItem id="exec" type="EXECUTION" category="EVENT" subType="s" units="u" name="n"/></p:DataItems></p:Controller></p:Components></p:Device>
<p:Device id="d2"/></p:Devices>"""


def test_probe():
    found = xml.parse_probe(PROBE)
    assert (found["agent_instance_id"], found["agent_version"], [d["id"] for d in found["devices"]]) == ("7", "2.1", ["d1", "d2"])
    avail, exe = found["devices"][0]["data_items"]
    assert avail["component_id"] is None and avail["component_type"] is None
    assert (exe["component_id"], exe["component_name"], exe["component_type"], exe["sub_type"]) == ("c1", "main", "Controller", "s")
    with pytest.raises(xml.InvalidDocument, match="E12"):
        xml.parse_probe(PROBE.replace('id="exec" ', ""))


def test_payloads_in_spark(spark):
    good, bad = sample(f"<Samples>{value('a', '2', 2)}{value('b', '1', 1)}</Samples>"), sample(f"<Samples>{value('a', 'x')}</Samples>")
    df = spark.createDataFrame([(1, good, "m", "mill"), (2, bad, "m", "mill"), (3, None, "m", "mill")], "payload_id long, xml string, machine_id string, device_key string")
    rows = xml.sample_rows(df, on_error="quarantine").orderBy("payload_id", "position").collect()
    assert [(r.payload_id, r.address, r.error and r.error[:3]) for r in rows] == [(1, "b", None), (1, "a", None), (2, None, "E11"), (3, None, "E16")]
    assert xml.sample_envelopes(df.limit(1)).first().next_sequence == Decimal(105)
    with pytest.raises(Exception, match="E11"):
        xml.sample_rows(df.filter("payload_id = 2")).collect()


def test_endpoint():
    e = Endpoint("http://host:5000/mtconnect")
    assert (e.probe, e.current, e.sample(2**63)) == ("http://host:5000/mtconnect/probe", "http://host:5000/mtconnect/current", f"http://host:5000/mtconnect/sample?from={2**63}")
    for bad in ("host/x", "ftp://host", "", "/a"):
        with pytest.raises(ValueError, match="E14"):
            Endpoint(bad)


def test_clients_ask_the_right_address():
    asked = []

    def get(url):
        asked.append(url)
        return PROBE if url.endswith("probe") else sample("")

    e = Endpoint("http://h/")
    discover(e, get), read_current(e, "m", "mill", get), read_sample(e, "m", "mill", 9, get)
    assert asked == ["http://h/probe", "http://h/current", "http://h/sample?from=9"]


def test_session_moves_after_success_alone():
    answers = iter([(42, 111), OSError("down"), (42, 121), (43, 5), (42, 131)])
    asked = []

    def read(since):
        asked.append(since)
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return {"instance_id": a[0], "next_sequence": a[1]}

    s = Session(read, 101)
    s.next()
    with pytest.raises(OSError):
        s.next()
    s.next()
    with pytest.raises(InstanceChanged):
        s.next()
    s.next()
    assert asked == [101, 111, 111, 121, 121] and s.cursor == {"instance": 42, "next": 131}


@pytest.fixture
def agent():
    class Agent(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/probe":
                body = PROBE
            else:
                since = int(self.path.rpartition("=")[2]) if "=" in self.path else 1
                ahead = min(since + 2, 7)
                rows = "".join(value("load", str(n), n) for n in range(since, ahead))
                body = sample(f"<Samples>{rows}</Samples>", head=f'<Header instanceId="42" firstSequence="1" lastSequence="6" nextSequence="{ahead}"/>')
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Agent)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_data_source(spark, agent, tmp_path):
    spark.dataSource.register(AgentSource)
    options = {"url": agent, "machine_id": "m", "device_key": "mill", "landing": str(tmp_path / "landing")}
    assert spark.read.format("machine_agent").options(mode="current", **options).load().count() == 2
    assert spark.read.format("machine_agent").options(mode="probe", **options).load().count() == 2
    stream = spark.readStream.format("machine_agent").options(**options).load()
    run = stream.select("sequence", "value.num").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    got = [int(r.sequence) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("sequence").collect()]
    assert got == [1, 2, 3, 4, 5, 6]
    assert len(list((tmp_path / "landing").iterdir())) <= 1  # what is committed goes
    probe = spark.read.format("machine_agent").options(mode="probe", **options).load().orderBy("doc_ordinal").collect()
    assert (probe[1].item_component_name, probe[1].item_component_type, probe[1].item_sub_type, probe[1].agent_instance_id, probe[1].agent_version) == ("main", "Controller", "s", "7", "2.1")
    assert [r.doc_ordinal for r in spark.read.format("machine_agent").options(mode="current", **options).load().collect()] == [0, 1]


def test_cursor_trace_is_the_sessions(spark):
    answers = [(42, 111), (42, 121), (43, 5), (42, 131)]
    rows = [("m", i, a, 101, n) for i, (a, n) in enumerate(answers)]
    df = spark.createDataFrame(rows, "machine_id string, ordinal int, instance_id bigint, first_sequence bigint, next_sequence bigint")
    given, expected = iter(answers), []
    session = Session(lambda since: dict(zip(("instance_id", "next_sequence"), next(given))), 101)
    for _ in answers:
        asked, code = session.cursor["next"], None
        try:
            session.next()
        except InstanceChanged:
            code = "E13"
        expected.append((asked, session.cursor["instance"], session.cursor["next"], code))
    assert [tuple(r)[2:] for r in cursor_trace(df).orderBy("ordinal").collect()] == expected


def test_scalar_rules(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert [one(parse_u64(F.lit(x))) for x in ("0012", " 12", "1e3", "18446744073709551615", "18446744073709551616", "", "-1")] == [12, None, None, 2**64 - 1, None, None, None]
    assert [one(parse_number(F.lit(x))) for x in ("42.5", "-.5e1", "1,0", "x", "5.")] == [Decimal("42.5"), -5, None, None, 5]
    assert one(is_blank(F.lit("  \t"))) and not one(is_blank(F.lit("a"))) and one(trimmed(F.lit("\n a b　"))) == "a b"
    assert one(same_key(F.lit("Ab"), F.lit("aB"))) and not one(same_key(F.lit("straße"), F.lit("STRASSE")))
    assert one(hours(F.lit(1_800_000_000))) == Decimal("0.5")
    assert one(parse_instant(F.lit("nope"))) is None and one(parse_instant(F.lit("2026-01-01T00:00:00+05:30"))) is not None
    assert one(folded_map(F.create_map(F.lit("A"), F.lit(1)))) == {"a": 1}


def test_identities_and_moments(spark):
    from millwright.functions.text import new_identity, observed_now

    rows = spark.range(50).select(new_identity().alias("id"), observed_now().alias("at")).collect()
    assert len({r.id for r in rows}) == 50 and len({r.at for r in rows}) == 1
