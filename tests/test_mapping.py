from datetime import datetime

import pytest
from pyspark.errors import PySparkException

from millwright.operators.mapping import map_observations, map_simple, map_with_configuration, unmapped_observations
from millwright.schemas import schema

T0 = datetime(2026, 1, 1)


def observed(spark, *rows):
    made = [(m, s, a, k, None if v is None else ((v, None, None, None) if isinstance(v, bool) else (None, None, v, None)), "Good", T0, i) for i, (m, s, a, k, v) in enumerate(rows)]
    return spark.createDataFrame(made, schema("observations"))


def mappings(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema("signal_mappings"))


def test_maps_with_provenance_and_case(spark):
    o = observed(spark, ("m1", "bus-V", "PLC.7.IN.2", "Digital", True), ("m2", "bus-v", "PLC.7.IN.2", "Digital", True))
    m = mappings(spark, ("m1", "BUS-v", "plc.7.in.2", "state.power-on", "Digital", False), ("m2", "bus-v", "plc.7.in.2", "state.running", "Digital", True))
    rows = {r.machine_id: r for r in map_observations(o, m).rows.collect()}
    assert (rows["m1"].signal_key, rows["m1"].source, rows["m1"].address, rows["m1"].value.bool) == ("state.power-on", "bus-V", "PLC.7.IN.2", True)
    assert (rows["m2"].signal_key, rows["m2"].value.bool) == ("state.running", False)


def test_unmapped_rows_are_left_alone(spark):
    o = observed(spark, ("m1", "s", "DIN.3", "Digital", True), ("M1", "s", "DIN.1", "Digital", True))
    m = mappings(spark, ("m1", "s", "DIN.1", "k", "Digital", False))
    assert map_observations(o, m).rows.count() == 0
    assert unmapped_observations(o, m).count() == 2  # machine ids keep their case


@pytest.mark.parametrize(
    "row, maps, code",
    [
        (("m", "s", "A", "Digital", True), [("m", "s", "A", "k", "Digital", False), ("m", "S", "a", "j", "Text", False)], "E2"),
        (("m", "s", "A", "Digital", True), [("m", "s", "A", "k", "Text", True)], "E3"),
        (("m", "s", "A", "Text", "x"), [("m", "s", "A", "k", "Text", True)], "E4"),
        (("m", "s", "A", "Digital", None), [("m", "s", "A", "k", "Digital", True)], "E4"),
    ],
)
def test_errors(spark, row, maps, code):
    o, m = observed(spark, row), mappings(spark, *maps)
    checked = map_observations(o, m, on_error="quarantine")
    assert checked.rows.count() == 0
    assert [r.error_code for r in checked.errors.collect()] == [code]
    strict = map_observations(o, m).rows
    for ask in (strict.collect, strict.count, strict.select("signal_key").collect, lambda: strict.filter("machine_id = 'm'").count(), lambda: strict.groupBy("source").count().collect()):
        with pytest.raises(PySparkException, match=code):
            ask()


def test_duplicates_nobody_observes_are_no_error(spark):
    m = mappings(spark, ("m", "s", "A", "k", "Digital", False), ("m", "s", "B", "k", "Digital", False), ("m", "s", "B", "j", "Digital", False))
    assert map_observations(observed(spark, ("m", "s", "A", "Digital", True)), m).rows.count() == 1


def test_one_machines_configuration(spark):
    m = mappings(spark, ("m", "s", "A", "k", "Digital", False))
    o = observed(spark, ("m", "s", "A", "Digital", True), ("other", "s", "A", "Digital", True))
    checked = map_with_configuration(o, m, "m", on_error="quarantine")
    assert checked.rows.count() == 1 and [r.error_code for r in checked.errors.collect()] == ["E1"]
    with pytest.raises(PySparkException, match="E1"):
        map_with_configuration(o, m, "m").rows.count()


def test_simple_mapping(spark):
    o = observed(spark, ("m", "s", "Exec", "Text", "on"), ("m", "s", "load", "Text", "x"), ("m", "s", "none", "Text", "x"))
    simple = spark.createDataFrame([("A.key", "EXEC"), ("b.key", "load")], schema("simple_mappings"))
    defined = spark.createDataFrame([("a.KEY", "n", "Text", "State", None, False), ("b.key", "n", "Numeric", "State", None, False)], schema("signal_definitions"))
    assert [(r.signal_key, r.type, r.value.text) for r in map_simple(o, simple, defined).collect()] == [("a.KEY", "Text", "on")]
