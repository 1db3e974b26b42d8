"""Compiled lists of policies against the fold over a row's own list."""

import random

import pytest
from pyspark.sql import functions as F

from millwright.operators.metrics import Engine, Strategy
from millwright.operators.policies import code, dictionary, evaluate_lists

POLICIES = "array<struct<metric_key:string,strategy_key:string,parameters:map<string,string>>>"
METRICS = ("availability", "Availability", "performance", "quality", "oee", "house", "apt")
RULES = ("apt-over-pot", "APT-over-pot", "good-over-produced", "reference-time-over-apt", "availability-performance-quality", "unknown", "scaled")


def scaled():
    """A strategy with a parameter."""

    def calculate(inputs, parameters):
        by = F.try_element_at(parameters, F.lit("by")).cast("double")
        return inputs("apt") * by, F.when(by.isNull(), "No scale.")

    return Strategy("scaled", calculate)


def engine():
    e = Engine()
    e.strategies["scaled"] = scaled()
    return e


def made(spark, seed, lists=12, rows=150, twice=False):
    rnd = random.Random(seed)
    listed = []
    while len(listed) < lists:
        own = [(rnd.choice(METRICS), rnd.choice(RULES), rnd.choice([{}, {"by": "2"}, {"by": "3", "of": "x"}, {"of": "x", "by": "3"}, None])) for _ in range(rnd.randrange(6))]
        if len({m.lower() for m, *_ in own}) == len(own) or twice:
            listed.append(own)
    number = lambda: rnd.choice([None, 0.0, 1.5, 4.0, -2.0])
    data = [(i, number(), number(), number(), number(), rnd.choice([*listed, None])) for i in range(rows)]
    return spark.createDataFrame(data, f"id int, apt double, pot double, made double, good double, policies {POLICIES}").cache()


def compiled(df, known):
    inputs = {"apt": F.col("apt"), "POT": F.col("pot"), "produced-quantity": F.col("made"), "good-quantity": F.col("good")}
    return evaluate_lists(df, inputs, {"not": F.col("apt") * 0.9}, F.col("policies"), known, engine())


def folded(df):
    pairs = {"apt": F.col("apt"), "pot": F.col("pot"), "produced-quantity": F.col("made"), "good-quantity": F.col("good"), "not": F.col("apt") * 0.9}
    given = F.map_filter(F.create_map(*[x for k, c in pairs.items() for x in (F.lit(k), c)]), lambda _, v: v.isNotNull())
    own = F.transform("policies", lambda p: p.withField("parameters", F.coalesce(p["parameters"], F.create_map().cast("map<string,string>"))))
    return df.select("id", engine().fold_policies(given, own, "double").alias("metrics"))


@pytest.mark.parametrize("limit", [256, 4, 0])
def test_compiled_lists_are_the_folded_ones(spark, limit):
    df = made(spark, 1 + limit)
    known = dictionary(df, "policies", limit)
    assert known.whole == (limit == 256) and len(known.lists) <= limit
    found = {r.id: r.metrics for r in compiled(df, known).collect()}
    for r in folded(df).collect():
        assert found[r.id] == (r.metrics or []), r.id


def test_order_of_parameters_makes_no_other_list(spark):
    df = spark.createDataFrame([([("m", "s", {"a": "1", "b": "2"})],), ([("m", "s", {"b": "2", "a": "1"})],), ([("m", "s", {"a": "1"})],)], f"policies {POLICIES}")
    assert df.select(code(F.col("policies"))).distinct().count() == 2 == len(dictionary(df, "policies").lists)


def test_a_metric_named_twice_raises_for_its_rows_alone(spark):
    twice, once = [("quality", "apt-over-pot", {}), ("Quality", "apt-over-pot", {})], [("quality", "apt-over-pot", {})]
    df = spark.createDataFrame([(1, 1.0, 2.0, 0.0, 0.0, twice), (2, 1.0, 2.0, 0.0, 0.0, once)], f"id int, apt double, pot double, made double, good double, policies {POLICIES}")
    known = dictionary(df, "policies")
    assert compiled(df.filter("id = 2"), known).first().metrics[0].value == 0.5
    with pytest.raises(Exception, match="E8"):
        compiled(df, known).collect()
    with pytest.raises(ValueError, match="E7"):
        evaluate_lists(df, {"apt": F.col("apt")}, {"APT": F.col("pot")}, F.col("policies"), known)


def test_no_lists_at_all(spark):
    df = made(spark, 9, rows=5).withColumn("policies", F.lit(None).cast(POLICIES))
    assert {tuple(r.metrics) for r in compiled(df, dictionary(df, "policies")).collect()} == {()}
