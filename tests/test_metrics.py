from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millwright.operators.configuration import policy_of, policy_of_column, resolve_configurations
from millwright.operators.inputs import derive_inputs, entries_out_of_scope
from millwright.operators.metrics import POLICIES, STRATEGIES, Engine, Policy, Strategy, check_scopes, merge_inputs, metrics_long
from millwright.plans.shift import assign_shifts, production_date, shift_number
from millwright.schemas import schema

HOUR = 3_600_000_000
SCOPE = ("c", "s", "m", "1", date(2026, 8, 21))
FULL = {"apt": 5, "pot": 8, "produced-quantity": 100, "good-quantity": 95, "not": 4, "machine-power-on-time": 6}


def evaluated(spark, inputs, additional=None, policies=POLICIES, number="decimal(18,6)"):
    df = spark.range(1)
    columns = {k: F.lit(v) for k, v in inputs.items()}
    more = {k: F.lit(v) for k, v in (additional or {}).items()}
    rows = metrics_long(Engine().evaluate(df, columns, more, policies, number), "id").orderBy("position").collect()
    return {r.metric_key: r for r in rows}


def test_six_metrics(spark):
    found = evaluated(spark, FULL)
    expected = {"availability": 5 / 8, "performance": 4 / 5, "quality": 95 / 100, "oee": 5 / 8 * 0.8 * 0.95, "utilization.elr": 5 / 8, "utilization.elre": 5 / 6}
    assert {k: round(float(r.value), 12) for k, r in found.items()} == {k: round(v, 12) for k, v in expected.items()}
    assert found["utilization.elre"].value == Decimal("0.83333333333333333333")


def test_missing_inputs_are_named_and_spread(spark):
    found = evaluated(spark, {k: FULL[k] for k in ("apt", "pot", "produced-quantity", "good-quantity")})
    reasons = {k: r.reason for k, r in found.items() if not r.is_available}
    assert reasons == {"performance": "Missing input 'not'.", "oee": "Missing input 'performance'.", "utilization.elre": "Missing input 'machine-power-on-time'."}
    assert all(r.value is None for r in found.values() if not r.is_available)


@pytest.mark.parametrize(
    "change, metric, reason",
    [
        ({"pot": 0}, "availability", "Planned operating time must be greater than zero."),
        ({"apt": 0}, "performance", "Actual production time must be greater than zero."),
        ({"produced-quantity": 0}, "quality", "Produced quantity must be greater than zero."),
        ({"machine-power-on-time": -1}, "utilization.elre", "Machine power-on time must be greater than zero."),
    ],
)
def test_denominators(spark, change, metric, reason):
    assert evaluated(spark, FULL | change)[metric].reason == reason


def test_order_and_feedback(spark):
    first = evaluated(spark, FULL, policies=[POLICIES[3], *POLICIES[:3]])
    assert first["oee"].reason == "Missing input 'availability'."
    # a metric named like an input takes its place for later ones
    after = evaluated(spark, {"apt": 6, "pot": 3}, policies=[Policy("APT", "apt-over-pot"), Policy("availability", "apt-over-pot")], number="double")
    assert after["availability"].value == pytest.approx(2 / 3)
    # an unavailable one leaves the input of its name usable
    kept = evaluated(spark, {"pot": 8, "quality": 0.5, "availability": 1, "performance": 1}, policies=[Policy("quality", "good-over-produced"), POLICIES[3]], number="double")
    assert kept["quality"].value is None and kept["oee"].value == 0.5


def test_unknown_and_mismatched_policies(spark):
    assert evaluated(spark, FULL, policies=[Policy("x", "custom")])["x"].reason == "Metric strategy 'custom' is not registered."
    _, reason = Engine().calculate("a", lambda k: F.lit(1), Policy("b", "apt-over-pot"))
    assert spark.range(1).select(reason.alias("r")).first().r == "Metric policy 'b' does not match calculation context 'a'."


def test_driver_side_errors():
    with pytest.raises(ValueError, match="twice"):
        Engine([*STRATEGIES, STRATEGIES[0]])
    with pytest.raises(ValueError, match="E7"):
        Engine().evaluate(None, {"apt": F.lit(1)}, {"APT": F.lit(2)})
    with pytest.raises(ValueError, match="E8"):
        Engine().evaluate(None, {"apt": F.lit(1)}, None, [Policy("a", "apt-over-pot"), Policy("A", "apt-over-pot")])


def test_policies_as_data(spark):
    inputs = F.create_map(*[x for k, v in FULL.items() for x in (F.lit(k), F.lit(Decimal(v)))]).cast("map<string,decimal(18,6)>")
    listed = F.array(*[F.struct(F.lit(p.metric_key).alias("metric_key"), F.lit(p.strategy_key.upper()).alias("strategy_key"), F.create_map().cast("map<string,string>").alias("parameters")) for p in POLICIES])
    found = {r.metric_key: r.value for r in spark.range(1).select(Engine().fold_policies(inputs, listed).alias("m")).first().m}
    assert {k: round(float(v), 10) for k, v in found.items()} == {k: round(float(r.value), 10) for k, r in evaluated(spark, FULL).items()}
    with pytest.raises(PySparkException, match="E8"):
        spark.range(1).select(Engine().fold_policies(inputs, F.concat(listed, F.slice(listed, 1, 1)))).collect()


def test_merge_of_inputs(spark):
    a = F.create_map(F.lit("apt"), F.lit(Decimal(1))).cast("map<string,decimal(18,6)>")
    b = F.create_map(F.lit("not"), F.lit(Decimal(2))).cast("map<string,decimal(18,6)>")
    assert set(spark.range(1).select(merge_inputs(a, b).alias("m")).first().m) == {"apt", "not"}
    with pytest.raises(PySparkException, match="E7"):
        spark.range(1).select(merge_inputs(a, a)).collect()


def facts(spark, periods, entries):
    s = spark.createDataFrame([(*SCOPE, 8 * HOUR)], schema("schedules"))
    p = spark.createDataFrame([(m, "1", SCOPE[4], state, h * HOUR) for m, state, h in periods], "machine_id string, shift_id string, production_date date, state string, duration_us bigint")
    e = spark.createDataFrame([(*scope, "p", None, None, a, b, datetime(2026, 8, 21)) for scope, a, b in entries], schema("production_entries"))
    return s, p, e


@pytest.mark.parametrize("hours", ["20000", "0.5", "99999999"])
def test_a_large_result_that_becomes_an_input(spark, hours):
    """A metric named as an input replaces it, in decimals of any size the input may have."""
    doubled = Strategy("doubled", lambda inputs, _: (inputs("apt") * 2, F.lit(None).cast("string")))
    inputs = {"apt": F.lit(Decimal(hours)), "pot": F.lit(Decimal(hours))}
    df = Engine((*STRATEGIES, doubled)).evaluate(spark.range(1), inputs, policies=[Policy("apt", "doubled"), Policy("availability", "apt-over-pot")], number="decimal(18,6)")
    assert [m.value for m in df.first().metrics] == [2 * Decimal(hours), 2]


def test_bad_scopes_are_set_apart(spark):
    df = spark.createDataFrame([(1, {"A": 1.0}, {"b": 1.0}, ["q", "o"]), (2, {"A": 1.0}, {"a": 1.0}, ["q"]), (3, {"A": 1.0}, {}, ["q", "Q"])], "id int, d map<string,double>, x map<string,double>, p array<string>")
    policies = F.transform("p", lambda k: F.struct(k.alias("metric_key")))
    checked = check_scopes(df, F.col("d"), F.col("x"), policies)
    assert [r.id for r in checked.rows.collect()] == [1]
    assert sorted((r.id, r.error_code) for r in checked.errors.collect()) == [(2, "E7"), (3, "E8")]
    with pytest.raises(PySparkException, match="E[78]"):
        check_scopes(df, F.col("d"), F.col("x"), policies, on_error="strict").rows.count()


def test_requests_are_not_joined_to_versions(spark):
    """They are swept with the moments of change."""
    c = configurations(spark, ("S1", "v1", "Published", "2026-08-01", "2026-09-01"))
    r = spark.createDataFrame([(1, "c", "S1", datetime(2026, 8, 2))], "request_id int, company_id string, site_id string, at timestamp")
    plan = resolve_configurations(r, c)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join " not in plan and "Window" in plan


def test_derivation(spark):
    s, p, e = facts(spark, [("m", "Running", 2), ("m", "Idle", 1), ("m", "Running", 9), ("other", "Running", 5)], [(SCOPE, 60, 2), (SCOPE, 40, 3)])
    r = derive_inputs(s, p, e, on_error="strict").first()
    assert (r.apt_us, r.planned_us, r.produced, r.good) == (11 * HOUR, 8 * HOUR, 100, 95)  # not clipped to the shift
    r = derive_inputs(*facts(spark, [], []), on_error="strict").first()
    assert (r.apt_us, r.produced, r.good) == (0, 0, 0)


def test_foreign_entries(spark):
    s, p, e = facts(spark, [], [(SCOPE, 1, 2), (("c", "s", "m2", "1", SCOPE[4]), 1, 0)])
    assert entries_out_of_scope(e, s).count() == 1
    assert derive_inputs(s, p, e).first().good == -1
    strict = derive_inputs(s, p, e, on_error="strict")
    for ask in (strict.collect, strict.count, strict.select("produced").collect):
        with pytest.raises(PySparkException, match="E6"):
            ask()


def configurations(spark, *rows):
    made = [("c", site, v, life, datetime.fromisoformat(a), b and datetime.fromisoformat(b), [("Quality", v, {}), ("quality", "later", {})], i) for i, (site, v, life, a, b) in enumerate(rows)]
    return spark.createDataFrame(made, schema("site_configurations"))


@pytest.mark.parametrize(
    "at, site, version",
    [("2026-08-21", "S1", "v1"), ("2026-08-31T23:59:59", "S1", "v1"), ("2026-09-01", "S1", "v2"), ("2026-07-31", "S1", None), ("2026-08-21", "S2", "v9"), ("2026-08-21", "s1", None), ("2026-11-01", "S1", "v3")],
)
def test_configuration_in_force(spark, at, site, version):
    c = configurations(
        spark, ("S1", "v1", "Published", "2026-08-01", "2026-09-01"), ("S1", "v2", "Published", "2026-09-01", None), ("S1", "draft", "Draft", "2026-08-02", None), ("S2", "v9", "Published", "2026-08-01", None),
        ("S1", "v3", "Published", "2026-10-01", None), ("S1", "v4", "Published", "2026-10-01", None),
    )
    r = spark.createDataFrame([(1, "c", site, datetime.fromisoformat(at))], "request_id int, company_id string, site_id string, at timestamp")
    found = resolve_configurations(r, c).first().configuration
    assert (found and found.version) == version


def test_policy_lookup(spark):
    c = configurations(spark, ("S1", "first", "Published", "2026-08-01", None))
    assert c.select(policy_of(F.col("metric_policies"), "QUALITY")["strategy_key"].alias("k")).first().k == "first"
    assert c.select(policy_of(F.col("metric_policies"), "oee").alias("k")).first().k is None
    with pytest.raises(ValueError):
        policy_of(F.col("x"), " ")
    with pytest.raises(PySparkException, match="E16"):
        c.select(policy_of_column(F.col("metric_policies"), F.lit(""))).collect()


def test_shifts(spark):
    times = ["2026-08-21T05:59:59", "2026-08-21T06:00:00", "2026-08-21T14:00:00", "2026-08-21T22:00:00", "2026-08-22T05:00:00"]
    df = spark.createDataFrame([(datetime.fromisoformat(t), "S") for t in times], "at timestamp, site_id string")
    fixed = df.select(shift_number(F.col("at")).cast("string").alias("s"), production_date(F.col("at")).alias("d")).collect()
    shifts = spark.createDataFrame([(str(i), "S", "n", a * 3600, b * 3600) for i, (a, b) in enumerate([(6, 14), (14, 22), (22, 6)])], schema("shifts"))
    table = assign_shifts(df, "at", shifts).orderBy("at").collect()
    assert [(r.s, r.d.day) for r in fixed] == [("2", 20), ("0", 21), ("1", 21), ("2", 21), ("2", 21)]
    assert [(r.shift_id, r.production_date.day) for r in table] == [(r.s, r.d.day) for r in fixed]
