"""Sums that are kept up to date, against sums over everything."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millwright.operators.incremental import Totals
from millwright.operators.inputs import IncrementalInputs, derive_inputs

START = datetime(2024, 1, 1)


def facts(spark, rows):
    return spark.createDataFrame(rows, "k string, v bigint, seq bigint")


def sums(totals):
    found = totals.read()
    return None if found is None else sorted(map(tuple, found.collect()), key=str)


def test_increments(spark, tmp_path):
    t = Totals(spark, str(tmp_path), ["k"], {"v": F.col("v")})
    assert t.read() is None and t.mark() is None and t.advance(facts(spark, []), "seq") == 0
    rows = [("a", 1, 1), ("b", 2, 2), ("a", None, 3), (None, 5, 3)]
    assert t.advance(facts(spark, rows), "seq") == 1 and t.mark() == "3"
    assert sums(t) == sorted([("a", 1), ("b", 2), (None, 5)], key=str)
    rows += [("a", 10, 4), ("c", -1, 9)]
    assert t.advance(facts(spark, rows), "seq") == 2  # what was there before isn't taken again
    assert t.advance(facts(spark, rows), "seq") == 2
    expected = sorted([("a", 11), ("b", 2), ("c", -1), (None, 5)], key=str)
    assert sums(t) == expected
    t.compact()
    assert sums(t) == expected and t.mark() == "9"
    assert t.advance(facts(spark, [*rows, ("c", 1, 10)]), "seq") == 4
    assert ("c", 0) in sums(t)


def test_an_increment_that_broke_off_counts_once(spark, tmp_path, monkeypatch):
    t = Totals(spark, str(tmp_path), ["k"], {"v": F.col("v")})
    t.advance(facts(spark, [("a", 1, 1)]), "seq")

    def broken(*_):
        raise RuntimeError("lost")

    note = t._note
    monkeypatch.setattr(t, "_note", broken)
    try:
        t.advance(facts(spark, [("a", 1, 1), ("a", 2, 2)]), "seq")
    except RuntimeError:
        pass
    monkeypatch.setattr(t, "_note", note)
    assert sums(t) == [("a", 1)] and t.mark() == "1"
    t.advance(facts(spark, [("a", 1, 1), ("a", 2, 2), ("a", 4, 3)]), "seq")
    assert sums(t) == [("a", 7)]


def test_inputs_are_those_of_everything(spark, tmp_path):
    at = lambda h: START + timedelta(hours=h)
    scope = ("c", "s", "m", "1", START.date())
    schedules = spark.createDataFrame([(*scope, 100), ("c", "s", "m", "2", START.date(), 50)], "company_id string, site_id string, machine_id string, shift_id string, production_date date, planned_us bigint")
    periods = spark.createDataFrame([("m", s, at(h), at(h + 1), 3_600_000_000, "1", START.date()) for h, s in enumerate(["Running", "Idle", "Unknown", "Running", "Fault"])], "machine_id string, state string, started_at timestamp, ended_at timestamp, duration_us bigint, shift_id string, production_date date")
    entries = spark.createDataFrame([(*scope, 10 * h, h, at(h)) for h in range(6)], "company_id string, site_id string, machine_id string, shift_id string, production_date date, produced int, rejected int, recorded_at timestamp")
    kept = IncrementalInputs(spark, str(tmp_path))
    columns = [*schedules.columns, "apt_us", "produced", "good", "powered_us"]
    assert {r.produced for r in kept.inputs(schedules).collect()} == {0}
    for upto in (2, 2, 4, 9):
        kept.advance(periods.filter(F.col("ended_at") <= at(upto)), entries.filter(F.col("recorded_at") <= at(upto)))
    expected = derive_inputs(schedules, periods, entries, powered=True).select(*columns).collect()
    assert sorted(kept.inputs(schedules).select(*columns).collect()) == sorted(expected)
