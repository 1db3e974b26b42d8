"""The configuration in force: the sweep against a plain search."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millwright.operators import intervals
from millwright.operators.configuration import resolve_configurations
from millwright.schemas import schema

START = datetime(2024, 1, 1)


def day(n):
    return None if n is None else START + timedelta(days=n)


def configuration(site, ordinal, since, until, lifecycle="Published"):
    return ("C", site, f"v{ordinal}", lifecycle, day(since), day(until), [], ordinal)


def expected(requests, versions):
    for r in requests:
        _, company, site, at = r
        held = [v for v in versions if None not in (company, site, at, v[4]) and v[:2] == (company, site) and v[3] == "Published" and v[4] <= at and (v[5] is None or at < v[5])]
        yield (*r, min(held, key=lambda v: (-v[4].timestamp(), v[7]))[2] if held else None)


REQUEST = "request_id bigint, company_id string, site_id string, at timestamp"


def resolved(spark, requests, versions):
    found = resolve_configurations(spark.createDataFrame(requests, REQUEST).repartition(3), spark.createDataFrame(versions, schema("site_configurations")).repartition(4))
    return [tuple(r) for r in found.select(*found.columns[:4], "configuration.version").collect()]


key = lambda r: tuple((x is not None, str(x)) for x in r)


@pytest.mark.parametrize("slice_days", [1, 7, 32, 100_000])
def test_against_a_plain_search(spark, monkeypatch, slice_days):
    """One site has most of the versions; ends, starts and requests meet in the same moments; requests repeat."""
    monkeypatch.setattr(intervals, "SLICE", slice_days * intervals.DAY)
    rnd = random.Random(slice_days)
    versions = []
    for i in range(260):
        since = rnd.randrange(-50, 200)
        until = rnd.choice([None, since + rnd.choice([-3, 0, 1, 2, 10, 40, 300])])
        versions.append(configuration(rnd.choice(["hot", "hot", "hot", "a", "b"]), rnd.randrange(10**6), since, until, rnd.choice(["Published"] * 5 + ["Draft", "Superseded"])))
    requests = [(i, "C", rnd.choice(["hot", "hot", "a", "b", "none"]), day(rnd.randrange(-60, 600))) for i in range(300)]
    requests += [*requests[:40], *requests[:40], (1, "C", None, day(3)), (2, None, "hot", day(3)), (3, "C", "hot", None), (3, "C", "hot", None), (4, "D", "hot", day(3))]
    assert sorted(resolved(spark, requests, versions), key=key) == sorted(expected(requests, versions), key=key)


def test_what_is_uncovered(spark):
    """Nested and chained intervals over many slices, with nothing starting in most of them."""
    versions = [configuration("s", 1, 0, None), configuration("s", 2, 10, 700), configuration("s", 3, 20, 300), configuration("s", 4, 30, 250), configuration("s", 5, 40, 240), configuration("s", 6, 690, 2000), configuration("s", 7, 690, None)]
    requests = [(i, "C", "s", day(t)) for i, t in enumerate([-1, 0, 9, 10, 239, 240, 249, 250, 299, 300, 689, 690, 699, 1999, 2000, 9_999])]
    found = {r[3]: r[4] for r in resolved(spark, requests, versions)}
    assert [found[day(t)] for t in (-1, 9, 10, 239, 240, 250, 300, 689, 690, 1999, 2000)] == [None, "v1", "v2", "v5", "v4", "v3", "v2", "v2", "v6", "v6", "v7"]


def test_empty_tables(spark):
    versions, requests = [configuration("s", 1, 0, None)], [(1, "C", "s", day(5))]
    assert resolved(spark, requests, []) == [(*requests[0], None)]
    assert resolved(spark, [], versions) == []


def test_requests_keep_their_columns(spark):
    asked = spark.createDataFrame([(1, "C", "s", day(5))], REQUEST).withColumns({c: F.lit("own") for c in ("kind", "rank", "ordinal", "moment", "__found", "version")})
    found = resolve_configurations(asked, spark.createDataFrame([configuration("s", 1, 0, None)], schema("site_configurations")))
    row = found.first()
    assert found.columns == [*asked.columns, "configuration"] and row.kind == row["__found"] == "own" and row.configuration.version == "v1"


def test_the_stack_stays_small():
    """Intervals that never end cover each other: one of them is kept."""
    stack = intervals._Stack()
    for i in range(1000):
        stack.start(i, intervals.OPEN, i)
    assert len(stack.rows) == 1
