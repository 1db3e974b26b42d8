"""Documents read piece by piece: size, depth, order and errors."""

import os
import tracemalloc

import pandas as pd
import pytest

from millwright import shared
from millwright.plans import documents
from millwright.sources import xml

HEAD = '<Header instanceId="1" firstSequence="1" lastSequence="9" nextSequence="10"/>'


def reading(n, text="1", more="", at="2024-01-01T00:00:00Z"):
    return f'<V dataItemId="d{n}" sequence="{n}" timestamp="{at}">{text}{more}</V>'


def document(body, head=HEAD, key="x"):
    return f'<m:D xmlns:m="urn:m">{head}<m:S><m:DeviceStream name="{key}">{body}</m:DeviceStream></m:S></m:D>'


def rows(text, sample=True, piece=7):
    encoded = text.encode()
    reader = xml.DocumentReader("m", "X", sample)
    return list(reader.rows(encoded[i : i + piece] for i in range(0, len(encoded), piece)))


@pytest.mark.parametrize("piece", [1, 7, 10**6])
def test_pieces_make_no_difference(piece):
    text = document(f"<Samples>{reading(3)}{reading(1, '2.5é')[:0]}{reading(2, ' -4e2 ')}</Samples><Events>{reading(9, 'añb &amp; <i>c</i> d')}</Events>")
    found = [(r["doc_ordinal"], r["sequence"], r["type"], r["value"]["num"], r["value"]["text"]) for r in rows(text, piece=piece)]
    assert [(a, b, c, d and float(d), e) for a, b, c, d, e in found] == [(0, 3, "Numeric", 1.0, None), (1, 2, "Numeric", -400.0, None), (2, 9, "Enumeration", None, "añb & c d")]


def test_depth_is_no_matter():
    deep = 20_000
    text = document("<Events>" + "<c>" * deep + reading(1, "in") + "</c>" * deep + "</Events>")
    assert [r["value"]["text"] for r in rows(text, piece=4096)] == ["in"]
    assert [r["value"]["text"] for r in xml.parse_current(text, "m", "x")] == ["in"]


def test_readings_in_readings_keep_the_order_of_their_beginnings():
    inner = f"<Condition>{reading(2, 'low')}</Condition>"
    found = xml.parse_current(document(f"<Events>{reading(1, 'a', inner)}{reading(3, 'c')}</Events>"), "m", "x")
    assert [(r["address"], r["type"], r["value"]["text"]) for r in found] == [("d1", "Enumeration", "alow"), ("d2", "Text", "low"), ("d3", "Enumeration", "c")]


def test_sections_of_other_devices_and_outside_count_for_nothing():
    outside = document(f"{reading(1)}")
    with pytest.raises(xml.InvalidDocument, match="E11.*outside"):
        rows(f"<Samples>{outside}</Samples>")
    assert rows(document(f"<Samples>{reading(1)}</Samples>", key="other")) == []


FIRST, SECOND = reading(1, at="never"), reading(2, "word")


@pytest.mark.parametrize(
    "text, code",
    [
        (document(f"<Samples>{FIRST}{SECOND}</Samples>"), "E11.*never"),
        (document(f"<Samples>{SECOND}{FIRST}</Samples>"), "E11.*word"),
        (document(f"<Samples>{SECOND}</Samples>", head=HEAD + HEAD), "E9: 2 headers"),
        (document(f"<Samples>{SECOND}</Samples>" + '</m:DeviceStream><m:DeviceStream uuid="x">'), "E10"),
        (document(f"<Samples>{SECOND}</Samples>") + "<more/>", "E15"),
        (document(f"<Samples>{reading(1).replace('sequence=', 'other=')}</Samples>"), "E9: V has no valid sequence"),
        (" \n ", "E16"),
    ],
)
def test_which_error_is_told(text, code):
    with pytest.raises(xml.InvalidDocument, match=code):
        rows(text)


def test_memory_does_not_grow_with_the_document():
    """8 MB: what is held is a piece and its readings."""
    block = "".join(reading(n, "12.5") for n in range(2_000)).encode()

    def pieces():
        yield document("<Samples>|</Samples>").split("|")[0].encode()
        for _ in range(8_000_000 // len(block)):
            yield block
        yield document("<Samples>|</Samples>").split("|")[1].encode()

    tracemalloc.start()
    n = sum(1 for _ in xml.DocumentReader("m", "x", True).rows(pieces()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 8_000_000 // len(block) * 2_000 and peak < 6_000_000


def test_files(spark, tmp_path):
    files = {1: document(f"<Samples>{reading(5)}{reading(2)}{reading(5, '7')}</Samples>"), 2: document(f"<Samples>{reading(1)}{SECOND}</Samples>"), 3: "<D>", 4: ""}
    for n, text in files.items():
        with open(f"{tmp_path}/{n}.xml", "w", encoding="utf-8") as f:
            f.write(text)
    listed = spark.createDataFrame([(n, f"file:{tmp_path}/{n}.xml", "m", "x") for n in files], "payload_id bigint, path string, machine_id string, device_key string")
    found = xml.sample_files(listed, on_error="quarantine").collect()
    assert [(r.position, int(r.sequence), float(r.value.num)) for r in sorted(found, key=lambda r: r.position or 0) if r.payload_id == 1] == [(0, 2, 1.0), (1, 5, 1.0), (2, 5, 7.0)]
    assert sorted((r.payload_id, r.error[:3], r.address) for r in found if r.error) == [(2, "E11", None), (3, "E15", None), (4, "E16", None)] and len(found) == 6
    assert xml.current_files(listed.filter("payload_id = 1")).count() == 3
    with pytest.raises(Exception, match="E1[156]"):
        xml.sample_files(listed).collect()
    assert os.path.exists(f"{tmp_path}/1.xml")


def test_a_worker_gives_out_rows_before_it_has_read_all_documents(spark, monkeypatch):
    monkeypatch.setattr(xml, "ROWS", 10)
    sizes = []
    frame = xml._frame

    def noted(rows, names):
        sizes.append(len(rows))
        return frame(rows, names)

    monkeypatch.setattr(xml, "_frame", noted)
    text = document("<Samples>" + "".join(reading(n) for n in range(1, 8)) + "</Samples>")
    payloads = pd.DataFrame([(n, text if n % 5 else " ", "m", "x") for n in range(20)], columns=["payload_id", "xml", "machine_id", "device_key"])
    monkeypatch.setattr(xml, "light_batches", lambda df: df)

    class Payloads:
        def mapInPandas(self, run, schema):
            return list(run(iter([payloads[:15], payloads[15:]])))

    found = pd.concat(xml.sample_rows(Payloads(), on_error="quarantine"))
    assert max(sizes) <= 10 and sum(sizes) == len(found) == 16 * 7 + 4
    assert found["payload_id"].tolist() == [n for n in range(20) for _ in range(7 if n % 5 else 1)]


def test_documents_come_to_workers_in_batches_of_bounded_bytes(spark):
    ddl = "payload_id bigint, xml string, machine_id string, device_key string"
    xml.sample_rows(spark.createDataFrame([], ddl))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= shared.BATCH_BYTES
    long = spark.range(40).selectExpr("id as payload_id", f"repeat('x', {1 << 20}) as xml")
    sizes = long.coalesce(1).mapInPandas(lambda frames: (f[["payload_id"]].assign(payload_id=len(f))[:1] for f in frames), "payload_id bigint").collect()
    assert sum(r[0] for r in sizes) == 40 and max(r[0] for r in sizes) <= 20


def test_documents_are_written_where_they_stay(spark, tmp_path):
    rows = [(n, document(f"<Samples>{reading(n + 1)}</Samples>") if n else None, "m", "x") for n in range(50)]
    payloads = spark.createDataFrame(rows, "payload_id bigint, xml string, machine_id string, device_key string").repartition(3)
    listed = documents.as_files(payloads, str(tmp_path / "in"))
    found = sorted(listed.collect())
    assert listed.columns == ["payload_id", "path", "machine_id", "device_key"] and [r.payload_id for r in found] == list(range(50))
    assert [open(r.path, encoding="utf-8").read() for r in found] == [r[1] or "" for r in rows]
    assert listed.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len({os.path.dirname(r.path) for r in found}) <= 3
    assert [r.sequence for r in xml.sample_files(listed.filter("payload_id > 0")).orderBy("sequence").collect()] == list(range(2, 51))
