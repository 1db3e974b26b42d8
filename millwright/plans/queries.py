"""The registered queries over the provided tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import microseconds
from ..operators import catalog
from ..operators.configuration import is_effective, policy_of, resolve_configurations
from ..operators.contract import Checked
from ..operators.inputs import IncrementalInputs, derive_inputs, entries_out_of_scope, quantities
from ..operators.mapping import map_observations, map_simple, map_with_configuration, unmapped_observations
from ..operators.metrics import POLICIES, Engine, check_scopes, metrics_long
from ..operators.state import activity_periods, assemble_snapshots, evaluate_states, transitions, without_signals
from ..schemas import SCOPE, schema
from ..shared import shared_root
from ..sources import xml
from ..sources.cursor import cursor_trace
from ..streaming.machines import rocks
from ..streaming.state import track_activity
from . import adapter, documents, shift, streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_EV = "ev AS (SELECT event_id, ts, (user_id % 10)::VARCHAR AS machine_id, event_type, value, regexp_extract(props, '([0-9]+)', 1)::INTEGER AS k FROM events)"
_QUALITY = "CASE WHEN k % 20 = 19 THEN 'Bad' WHEN k % 20 = 18 THEN 'Uncertain' ELSE 'Good' END"
_ST = f"""{_EV}, st AS (SELECT event_id, ts, machine_id, k, CASE WHEN k % 20 >= 18 THEN 'Unknown' WHEN event_type = 'error' THEN 'Fault'
  WHEN event_type IN ('click', 'view') THEN 'Running' WHEN event_type = 'purchase' THEN 'Idle' ELSE 'Stopped' END AS state FROM ev)"""
_TR = f"""{_ST}, tr AS (SELECT * FROM (SELECT machine_id, coalesce(lag(state) OVER (PARTITION BY machine_id ORDER BY ts, event_id), 'Unknown') AS previous_state,
  state AS current_state, ts, event_id FROM st) WHERE previous_state <> current_state)"""
_PE = f"""{_TR}, pe AS (SELECT machine_id, current_state AS state, ts AS started_at, ended_at, date_diff('microsecond', ts, ended_at)::BIGINT AS duration_us,
  (((hour(ts) + 18) % 24) // 8)::INTEGER::VARCHAR AS shift_id, (ts - INTERVAL 6 HOUR)::DATE AS production_date
  FROM (SELECT *, lead(ts) OVER (PARTITION BY machine_id ORDER BY ts, event_id) AS ended_at FROM tr) WHERE ended_at IS NOT NULL)"""
_IN = f"""{_PE}, days AS (SELECT DISTINCT (ts - INTERVAL 6 HOUR)::DATE AS production_date FROM events),
sched AS (SELECT 'C1' AS company_id, 'S1' AS site_id, m::VARCHAR AS machine_id, s::VARCHAR AS shift_id, production_date, ((16 - s) * 1800000000)::BIGINT AS planned_us
  FROM days, (SELECT unnest(range(10)) AS m), (SELECT unnest(range(3)) AS s)),
rt AS (SELECT machine_id, shift_id, production_date, sum(CASE WHEN state = 'Running' THEN duration_us ELSE 0 END)::BIGINT AS apt_us,
  sum(CASE WHEN state <> 'Unknown' THEN duration_us ELSE 0 END)::BIGINT AS power_us FROM pe GROUP BY ALL),
en AS (SELECT machine_id, (((hour(ts) + 18) % 24) // 8)::INTEGER::VARCHAR AS shift_id, (ts - INTERVAL 6 HOUR)::DATE AS production_date,
  sum(floor(value)::INTEGER)::BIGINT AS produced, sum(floor(value)::INTEGER - floor(value * (k % 5) / 100)::INTEGER)::BIGINT AS good
  FROM ev WHERE event_type = 'purchase' GROUP BY ALL),
inp AS (SELECT sched.*, coalesce(apt_us, 0)::BIGINT AS apt_us, coalesce(power_us, 0)::BIGINT AS power_us, coalesce(produced, 0)::BIGINT AS produced, coalesce(good, 0)::BIGINT AS good
  FROM sched LEFT JOIN rt USING (machine_id, shift_id, production_date) LEFT JOIN en USING (machine_id, shift_id, production_date))"""
_ME = f"""{_IN}, h AS (SELECT *, apt_us::DOUBLE / 3.6e9::DOUBLE AS apt, planned_us::DOUBLE / 3.6e9::DOUBLE AS pot, power_us::DOUBLE / 3.6e9::DOUBLE AS pw FROM inp),
n AS (SELECT *, CASE WHEN machine_id::INTEGER % 4 <> 0 THEN apt * 0.9::DOUBLE END AS nt FROM h),
v AS (SELECT *, apt / pot AS a, CASE WHEN nt IS NOT NULL AND apt > 0 THEN nt / apt END AS p, CASE WHEN produced > 0 THEN good::DOUBLE / produced::DOUBLE END AS q,
  CASE WHEN pw > 0 THEN apt / pw END AS e FROM n),
me AS (
  SELECT company_id, site_id, machine_id, shift_id, production_date, 0 AS position, 'availability' AS metric_key, a AS value, NULL AS reason FROM v
  UNION ALL SELECT company_id, site_id, machine_id, shift_id, production_date, 1, 'performance', p,
    CASE WHEN nt IS NULL THEN 'Missing input ''not''.' WHEN apt <= 0 THEN 'Actual production time must be greater than zero.' END FROM v
  UNION ALL SELECT company_id, site_id, machine_id, shift_id, production_date, 2, 'quality', q, CASE WHEN q IS NULL THEN 'Produced quantity must be greater than zero.' END FROM v
  UNION ALL SELECT company_id, site_id, machine_id, shift_id, production_date, 3, 'oee', a * p * q,
    CASE WHEN p IS NULL THEN 'Missing input ''performance''.' WHEN q IS NULL THEN 'Missing input ''quality''.' END FROM v
  UNION ALL SELECT company_id, site_id, machine_id, shift_id, production_date, 4, 'utilization.elr', a, NULL FROM v
  UNION ALL SELECT company_id, site_id, machine_id, shift_id, production_date, 5, 'utilization.elre', e, CASE WHEN e IS NULL THEN 'Machine power-on time must be greater than zero.' END FROM v)"""
_CFG = """cfg AS (SELECT o_orderkey AS ordinal, o_orderkey::VARCHAR AS version, o_custkey::VARCHAR AS site_id,
  CASE o_orderstatus WHEN 'P' THEN 'Published' WHEN 'O' THEN 'Draft' ELSE 'Superseded' END AS lifecycle, o_orderdate AS since,
  CASE WHEN o_orderpriority[1] IN ('1', '2', '3') THEN o_orderdate + INTERVAL 365 DAY END AS until FROM orders)"""


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _naive(df: DataFrame) -> DataFrame:
    """Instants as plain timestamps, which SQL engines compare alike."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


_MAPPED = "machine_id, 'events' AS source, event_type AS address, CASE WHEN event_type = 'error' THEN 'state.fault' WHEN event_type = 'purchase' THEN 'state.idle' ELSE 'state.running' END AS signal_key, 'Digital' AS type"


@_query(f"WITH {_EV} SELECT {_MAPPED}, TRUE AS flag, {_QUALITY} AS quality, ts AS timestamp, event_id AS ordinal FROM ev WHERE event_type <> 'signup'")
def m1_mapped_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = map_observations(adapter.observations(spark, sf_dir), adapter.signal_mappings(spark, signup=False)).rows
    return _naive(mapped.withColumn("flag", F.col("value.bool")).drop("value"))


@_query(
    f"""WITH {_EV} SELECT {_MAPPED}, event_type <> 'signup' AS flag, {_QUALITY} AS quality, ts AS timestamp, event_id AS ordinal,
  CASE WHEN event_id <= (SELECT max(event_id) // 2 FROM events) THEN 1 ELSE 2 END::BIGINT AS mapping_version FROM ev
  WHERE event_type <> 'signup' OR event_id > (SELECT max(event_id) // 2 FROM events)"""
)
def m1_streaming_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of observations, with new mappings published between two of its batches."""
    rows = streams.mapped_under_versions(spark, sf_dir)
    return _naive(rows.withColumn("flag", F.col("value.bool")).select("machine_id", "source", "address", "signal_key", "type", "flag", "quality", "timestamp", "ordinal", "mapping_version"))


@_query(f"WITH {_EV} SELECT machine_id, event_type AS address, event_id AS ordinal FROM ev WHERE event_type = 'signup'")
def m1_unmapped_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmapped_observations(adapter.observations(spark, sf_dir), adapter.signal_mappings(spark, signup=False)).select("machine_id", "address", "ordinal")


@_query(f"WITH {_EV} SELECT {_MAPPED}, event_type <> 'signup' AS flag, {_QUALITY} AS quality, ts AS timestamp, event_id AS ordinal FROM ev")
def m2_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = map_observations(adapter.observations(spark, sf_dir), adapter.signal_mappings(spark)).rows
    return _naive(mapped.withColumn("flag", F.col("value.bool")).drop("value"))


@_query(f"WITH {_EV} SELECT machine_id, 'State.Running' AS signal_key, 'Digital' AS type, 'events' AS source, TRUE AS flag, event_id AS ordinal FROM ev WHERE event_type = 'click'")
def m3_simple_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    mappings = spark.createDataFrame([("state.running", "CLICK"), ("state.fault", "error")], schema("simple_mappings"))
    definitions = spark.createDataFrame([("State.Running", "running", "Digital", "State", None, True), ("state.fault", "fault", "Text", "State", None, False)], schema("signal_definitions"))
    mapped = map_simple(adapter.observations(spark, sf_dir), mappings, definitions)
    return mapped.select("machine_id", "signal_key", "type", "source", F.col("value.bool").alias("flag"), "ordinal")


@_query(f"WITH {_ST} SELECT machine_id, state, ts AS timestamp, event_id AS ordinal FROM st")
def t1_state_per_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(evaluate_states(adapter.snapshots(spark, sf_dir)))


@_query(f"WITH {_ST} SELECT {_QUALITY} AS quality, state, count(*)::BIGINT AS n FROM st GROUP BY ALL")
def t2_quality_filtered_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = adapter.snapshots(spark, sf_dir).withColumn("quality", F.col("signals")[0]["quality"])
    return evaluate_states(marked).groupBy("quality", "state").agg(F.count("*").alias("n"))


_LATEST = "last_value(CASE WHEN {} THEN {{'f': event_type <> 'signup', 'g': k % 20 < 18}} END IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


_ASSEMBLED = (
    f"""WITH {_EV}, l AS (SELECT machine_id, ts, event_id, {_LATEST.format("event_type IN ('click', 'view', 'signup')")} AS run, {_LATEST.format("event_type = 'purchase'")} AS idle,
  {_LATEST.format("event_type = 'error'")} AS fault FROM ev)
SELECT machine_id, ts AS timestamp, event_id AS ordinal, CASE WHEN fault.g AND fault.f THEN 'Fault' WHEN run.g AND run.f THEN 'Running' WHEN idle.g AND idle.f THEN 'Idle'
  WHEN run.g THEN 'Stopped' ELSE 'Unknown' END AS state FROM l"""
)


@_query(_ASSEMBLED)
def t2_assembled_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = map_observations(adapter.observations(spark, sf_dir), adapter.signal_mappings(spark)).rows
    return _naive(evaluate_states(assemble_snapshots(mapped)))


@_query(_ASSEMBLED)
def t2_streaming_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of observations that come in parts, late and out of order: mapping, assembly and state in one stream."""
    return _naive(streams.streamed_states(spark, sf_dir))


_TRANSITIONS = f"WITH {_TR} SELECT machine_id, previous_state, current_state, ts AS timestamp, event_id AS ordinal FROM tr"


@_query(_TRANSITIONS)
def t3_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(transitions(evaluate_states(adapter.snapshots(spark, sf_dir))))


@_query(f"WITH {_TR} SELECT previous_state, current_state, count(*)::BIGINT AS n FROM tr GROUP BY ALL")
def t3_transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions(evaluate_states(adapter.snapshots(spark, sf_dir))).groupBy("previous_state", "current_state").agg(F.count("*").alias("n"))


@_query(_TRANSITIONS)
def t3_streaming_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed stream over the events table as a file stream, run to its end."""
    # a bounded number of files a batch: a machine's rows of a batch are sorted in one worker's memory
    events = spark.readStream.schema(adapter.table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may name a file or a folder
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    state = F.when(k % 20 >= 18, "Unknown").when(kind == "error", "Fault").when(kind.isin("click", "view"), "Running").when(kind == "purchase", "Idle").otherwise("Stopped")
    states = events.select((F.col("user_id") % 10).cast("string").alias("machine_id"), state.alias("state"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id").alias("ordinal"))
    base = f"{shared_root(spark)}/millwright/stream-{uuid.uuid4().hex}"
    with rocks(spark):
        run = track_activity(states).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    done = spark.read.parquet(f"{base}/out").filter("kind = 'transition'")
    return _naive(done.select("machine_id", "previous_state", F.col("state").alias("current_state"), F.col("started_at").alias("timestamp"), "ordinal"))


@_query(_TRANSITIONS)
def t3_streaming_late_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States that come in parts, late and out of order, put in order by event time."""
    found = streams.streamed_activity(spark, sf_dir, "transition")
    return _naive(found.select("machine_id", "previous_state", F.col("state").alias("current_state"), F.col("started_at").alias("timestamp"), "ordinal"))


_PERIODS = f"WITH {_PE} SELECT machine_id, state, started_at, ended_at, duration_us FROM pe"


@_query(_PERIODS)
def t4_streaming_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.streamed_activity(spark, sf_dir, "period")
    return _naive(found.select("machine_id", "state", "started_at", "ended_at", microseconds(F.col("started_at"), F.col("ended_at")).alias("duration_us")))


@_query(_PERIODS)
def t4_activity_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(activity_periods(transitions(evaluate_states(adapter.snapshots(spark, sf_dir)))))


@_query(f"WITH {_PE} SELECT machine_id, state, count(*)::BIGINT AS n, sum(duration_us)::BIGINT AS total_us FROM pe GROUP BY ALL")
def t4_duration_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = activity_periods(transitions(evaluate_states(adapter.snapshots(spark, sf_dir))))
    return periods.groupBy("machine_id", "state").agg(F.count("*").alias("n"), F.sum("duration_us").alias("total_us"))


@_query(f"WITH {_CFG} SELECT version, lifecycle = 'Published' AND since <= TIMESTAMP '1996-06-01' AND (until IS NULL OR TIMESTAMP '1996-06-01' < until) AS effective FROM cfg")
def k1_effective_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("1996-06-01").cast("timestamp")
    return adapter.site_configurations(spark, sf_dir).select("version", is_effective(at, F.col("lifecycle"), F.col("effective_from"), F.col("effective_to")).alias("effective"))


_ASOF = """SELECT request_id, site_id, version FROM (SELECT r.request_id, r.site_id, c.version,
    row_number() OVER (PARTITION BY r.request_id ORDER BY c.since DESC, c.ordinal) AS rank
  FROM r LEFT JOIN cfg c ON r.site_id = c.site_id AND c.lifecycle = 'Published' AND c.since <= r.at AND (c.until IS NULL OR r.at < c.until)) WHERE rank = 1"""


@_query(f"WITH {_CFG}, r AS (SELECT o_orderkey AS request_id, o_custkey::VARCHAR AS site_id, o_orderdate + INTERVAL 100 DAY AS at FROM orders) {_ASOF}")
def k2_config_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration in force 100 days after every order, for its customer as the site."""
    requests = adapter.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.lit("C1").alias("company_id"), F.col("o_custkey").cast("string").alias("site_id"), F.timestamp_add("DAY", F.lit(100), F.col("o_orderdate").cast("timestamp")).alias("at")
    )
    return resolve_configurations(requests, adapter.site_configurations(spark, sf_dir)).select("request_id", "site_id", "configuration.version")


@_query(f"WITH {_CFG}, r AS (SELECT min(ordinal) AS request_id, site_id, since AS at FROM cfg WHERE lifecycle = 'Published' GROUP BY site_id, since HAVING count(*) > 1) {_ASOF}")
def k2_config_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with two published configurations of one start: the earlier in the list wins."""
    configurations = adapter.site_configurations(spark, sf_dir)
    tied = configurations.filter("lifecycle = 'Published'").groupBy("company_id", "site_id", "effective_from").agg(F.min("ordinal").alias("request_id"), F.count("*").alias("n"))
    requests = tied.filter("n > 1").select("request_id", "company_id", "site_id", F.col("effective_from").alias("at"))
    return resolve_configurations(requests, configurations).select("request_id", "site_id", "configuration.version")


@_query(
    f"""WITH {_CFG}, asked AS (SELECT l_orderkey AS order_id, o_custkey::VARCHAR AS site_id, l_shipdate AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT row_number() OVER () AS request_id, * FROM asked), found AS ({_ASOF})
SELECT r.order_id, found.site_id, found.version, count(*)::BIGINT AS n FROM found JOIN r USING (request_id) GROUP BY ALL"""
)
def k2_config_of_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configuration in force when each line was shipped; lines of one order and day ask the same."""
    orders = adapter.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = adapter.table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    requests = lines.select(F.col("l_orderkey").alias("order_id"), F.lit("C1").alias("company_id"), F.col("o_custkey").cast("string").alias("site_id"), F.col("l_shipdate").cast("timestamp").alias("at"))
    found = resolve_configurations(requests, adapter.site_configurations(spark, sf_dir), request_key="order_id")
    return found.groupBy("order_id", "site_id", "configuration.version").agg(F.count("*").alias("n"))


@_query("SELECT o_orderkey::VARCHAR AS version, CASE WHEN o_orderkey % 2 = 0 THEN 'apt-over-pot' ELSE 'apt-over-machine-power-on-time' END AS strategy_key FROM orders")
def k3_policy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.site_configurations(spark, sf_dir).select("version", policy_of(F.col("metric_policies"), "AVAILABILITY")["strategy_key"].alias("strategy_key"))


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return shift.shift_periods(adapter.snapshots(spark, sf_dir)), adapter.schedules(spark, sf_dir), adapter.production_entries(spark, sf_dir)


_INPUTS = f"WITH {_IN} SELECT company_id, site_id, machine_id, shift_id, production_date, planned_us, apt_us, produced, good FROM inp"


@_query(_INPUTS)
def x1_incremental_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments: what had come by the middle of the events' time, and then the rest."""
    first, last = adapter.table(spark, sf_dir, "events").agg(F.min(F.col("ts").cast("timestamp")), F.max(F.col("ts").cast("timestamp"))).first()
    kept = IncrementalInputs(spark, f"{shared_root(spark)}/millwright/inputs-{uuid.uuid4().hex}")
    for upto in ([first + (last - first) / 2, last] if first else []):
        come = adapter.snapshots(spark, sf_dir).filter(F.col("timestamp") <= upto)
        kept.advance(shift.shift_periods(come), adapter.production_entries(spark, sf_dir).filter(F.col("recorded_at") <= upto))
    return kept.inputs(adapter.schedules(spark, sf_dir)).drop("powered_us")


@_query(_INPUTS)
def x1_inputs_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods, schedules, entries = _facts(spark, sf_dir)
    return derive_inputs(schedules, periods, entries, on_error="strict")


@_query(
    """SELECT 'C1' AS company_id, 'S1' AS site_id, l_suppkey::VARCHAR AS machine_id, (l_linenumber % 3)::VARCHAR AS shift_id, l_shipdate::DATE AS production_date,
  sum(l_quantity::INTEGER)::BIGINT AS produced, sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 0 ELSE l_quantity::INTEGER END)::BIGINT AS good FROM lineitem GROUP BY ALL"""
)
def x1_quantities_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantities(adapter.bulk_entries(spark, sf_dir))


def _metrics(spark: SparkSession, sf_dir: str, policies=POLICIES) -> DataFrame:
    periods, schedules, entries = _facts(spark, sf_dir)
    return metrics_long(shift.evaluate_shifts(periods, schedules, entries, policies), *SCOPE)


@_query(f"WITH {_ME} SELECT company_id, site_id, machine_id, shift_id, production_date, position, metric_key, value, reason IS NULL AS is_available, reason FROM me")
def x13_shift_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir)


def _one(name: str, metric: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _metrics(spark, sf_dir).filter(F.col("metric_key") == metric).select(*SCOPE, "value", "is_available", "reason")

    query.__name__ = name
    _query(f"WITH {_ME} SELECT company_id, site_id, machine_id, shift_id, production_date, value, reason IS NULL AS is_available, reason FROM me WHERE metric_key = '{metric}'")(query)


for _name, _metric in (("x7_availability", "availability"), ("x8_elre", "utilization.elre"), ("x9_performance", "performance"), ("x10_quality", "quality"), ("x11_oee", "oee")):
    _one(_name, _metric)


@_query(f"WITH {_ME} SELECT metric_key, reason, count(*)::BIGINT AS n FROM me WHERE reason IS NOT NULL GROUP BY ALL")
def x6_unavailable_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).filter("not is_available").groupBy("metric_key", "reason").agg(F.count("*").alias("n"))


@_query(f"WITH {_ME} SELECT machine_id, shift_id, production_date, 'oee' AS metric_key, NULL::DOUBLE AS value, 'Missing input ''availability''.' AS reason FROM v UNION ALL SELECT machine_id, shift_id, production_date, 'availability', a, NULL FROM v")
def x15_policy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OEE before its parts has nothing to work with."""
    found = _metrics(spark, sf_dir, [POLICIES[3], POLICIES[0]])
    return found.select("machine_id", "shift_id", "production_date", "metric_key", "value", "reason")


_INPUT = "SELECT machine_id, shift_id, production_date, '{}' AS input_key, {} AS value FROM v"


@_query(
    f"WITH {_ME} SELECT * FROM ("
    + " UNION ALL ".join(_INPUT.format(k, c) for k, c in (("apt", "apt"), ("pot", "pot"), ("produced-quantity", "produced::DOUBLE"), ("good-quantity", "good::DOUBLE"), ("not", "nt"), ("machine-power-on-time", "pw")))
    + ") WHERE value IS NOT NULL"
)
def x17_inputs_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs as given: metrics that became inputs of later ones aren't among them."""
    periods, schedules, entries = _facts(spark, sf_dir)
    evaluated = shift.evaluate_shifts(periods, schedules, entries)
    return evaluated.select("machine_id", "shift_id", "production_date", F.explode("inputs").alias("input_key", "value"))


@_query(
    """SELECT 'm' || m AS device_id, item AS item_id, type AS item_type, comp AS component_id, CASE WHEN comp IS NULL THEN NULL ELSE 'Controller' END AS component_type FROM (
  SELECT DISTINCT (user_id % 10)::VARCHAR AS m, event_type AS item, 'EVENT' AS type, 'ctl' AS comp FROM events UNION ALL
  SELECT DISTINCT (user_id % 10)::VARCHAR, 'avail', 'AVAILABILITY', NULL FROM events)"""
)
def s5_probe_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xml.probe_items(documents.probe_documents(spark, sf_dir)).select("device_id", "item_id", "item_type", "item_component_id", "item_component_type").toDF(
        "device_id", "item_id", "item_type", "component_id", "component_type"
    )


@_query(
    f"""WITH {_EV} SELECT machine_id, 'd' || event_id AS address, 'Enumeration' AS type, CASE WHEN k % 20 = 18 THEN NULL ELSE event_type END AS text,
  CASE WHEN k % 20 = 18 THEN 'Uncertain' ELSE 'Good' END AS quality, ts AS timestamp FROM ev"""
)
def s7_current_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = xml.current_rows(documents.current_documents(spark, sf_dir))
    return _naive(rows.select("machine_id", "address", "type", F.col("value.text").alias("text"), "quality", "timestamp"))


_SAMPLES = (
    f"""WITH {_EV} SELECT machine_id, event_id AS sequence, event_type AS address, round(value, 3) AS number, ts AS timestamp,
  (row_number() OVER (PARTITION BY machine_id, event_id // 500 ORDER BY event_id) - 1)::INTEGER AS position FROM ev"""
)


def _numbers(rows: DataFrame) -> DataFrame:
    return _naive(rows.select("machine_id", F.col("sequence").cast("bigint").alias("sequence"), "address", F.col("value.num").cast("double").alias("number"), "timestamp", "position"))


@_query(_SAMPLES)
def s9_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbers(xml.sample_rows(documents.sample_documents(spark, sf_dir)))


@_query(_SAMPLES)
def s9_sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents as files, which are read piece by piece."""
    files = documents.as_files(documents.sample_documents(spark, sf_dir), f"{shared_root(spark)}/millwright/documents-{uuid.uuid4().hex}")
    return _numbers(xml.sample_files(files))


@_query(f"WITH {_EV} SELECT (event_id // 500 * 10 + machine_id::INTEGER)::BIGINT AS payload_id, min(event_id) AS first_sequence, max(event_id) AS last_sequence, max(event_id) + 1 AS next_sequence FROM ev GROUP BY ALL")
def s9_sample_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = xml.sample_envelopes(documents.sample_documents(spark, sf_dir))
    return found.select("payload_id", *[F.col(c).cast("bigint").alias(c) for c in ("first_sequence", "last_sequence", "next_sequence")])


_DOCS = f"""{_EV}, d AS (SELECT machine_id, event_id // {documents.BLOCK} AS block, (event_id // {documents.BLOCK} * 10 + machine_id::INTEGER)::BIGINT AS payload_id, min(event_id) AS lo, max(event_id) + 1 AS next,
  CASE WHEN machine_id = '{documents.RESTARTED}' AND event_id // {documents.BLOCK} >= 1 THEN 43 ELSE 42 END AS instance_id FROM ev GROUP BY ALL)"""


@_query(
    f"""WITH {_DOCS}, f AS (SELECT *, first_value(instance_id) OVER (PARTITION BY machine_id ORDER BY block) AS instance FROM d),
m AS (SELECT *, CASE WHEN instance_id = instance THEN next END AS moved FROM f)
SELECT machine_id, payload_id, coalesce(last_value(moved IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS requested, instance,
  last_value(moved IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS next, CASE WHEN moved IS NULL THEN 'E13' END AS error_code FROM m"""
)
def s10_cursor_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor for each machine over all of its sample documents; one machine's agent restarts."""
    found = xml.sample_envelopes(documents.sample_documents(spark, sf_dir))
    machine = (F.col("payload_id") % adapter.MACHINES).cast("string")
    traced = cursor_trace(found.withColumn("machine_id", machine), order="payload_id")
    return traced.select("machine_id", "payload_id", *[F.col(c).cast("bigint").alias(c) for c in ("requested", "instance", "next")], "error_code")


@_query("SELECT r_name AS factory, n_name AS line, s_suppkey::VARCHAR AS machine_id, s_name AS machine, 'state.running' AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def d19_machine_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    plants = adapter.factories(spark, sf_dir)
    return catalog.machines(plants).select("factory", "line", "machine_id", "machine", F.explode("signals").alias("s")).select("factory", "line", "machine_id", "machine", "s.key")


@_query(
    f"""WITH {_EV}, a AS (SELECT machine_id, (((hour(ts) + 18) % 24) // 8)::INTEGER AS s, event_id, ts FROM ev WHERE event_type = 'purchase')
SELECT event_id AS ordinal, machine_id, CASE WHEN s = 2 THEN NULL WHEN ts < TIMESTAMP '2024-01-15' THEN 'op_a' || s ELSE 'op_b' || s END AS assigned_operator FROM a"""
)
def d22_operators_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two operators hand over a machine's first two shifts at one moment; the third shift has none."""
    change = datetime(2024, 1, 15)
    rows = [("C1", "S1", str(m), str(s), f"op_{who}{s}", start, end) for m in range(adapter.MACHINES) for s in (0, 1) for who, start, end in (("a", datetime(1970, 1, 1), change), ("b", change, None))]
    assignments = spark.createDataFrame(rows, schema("operator_assignments"))
    events = adapter._events(spark, sf_dir).filter("event_type = 'purchase'").select(
        F.lit("C1").alias("company_id"), F.lit("S1").alias("site_id"), "machine_id", shift.shift_number(F.col("ts")).cast("string").alias("shift_id"), "ts", F.col("event_id").alias("ordinal")
    )
    return catalog.operators_at(events, assignments, "ts").select("ordinal", "machine_id", "assigned_operator")


_SPOILED = f"""WITH {_EV} SELECT error_code, count(*)::BIGINT AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'E2' WHEN 'purchase' THEN 'E3' END AS error_code FROM ev WHERE event_type <> 'signup') GROUP BY ALL"""


def _spoiled_mappings(spark: SparkSession) -> DataFrame:
    """Views have two mappings and purchases one of another type."""
    maps = adapter.signal_mappings(spark, signup=False)
    return maps.withColumn("type", F.when(F.col("address") == "purchase", "Text").otherwise(F.col("type"))).union(maps.filter("address = 'view'").withColumn("signal_key", F.lit("state.idle")))


@_query(_SPOILED)
def e_mapping_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passes has no code."""
    return _codes(map_observations(adapter.observations(spark, sf_dir), _spoiled_mappings(spark), on_error="quarantine"))


@_query(_SPOILED)
def e_streaming_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a stream, whose sound and quarantined rows are written in one pass."""
    return streams.quarantined_observations(spark, sf_dir, _spoiled_mappings(spark)).groupBy("error_code").agg(F.count("*").alias("n"))


@_query("SELECT s_suppkey::VARCHAR AS machine_id, 'Unknown' AS state FROM supplier")
def f13_machines_without_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every machine of the plant before anything has been heard of it."""
    machines = catalog.machines(adapter.factories(spark, sf_dir)).select("machine_id")
    return evaluate_states(without_signals(machines)).select("machine_id", "state")


@_query(
    """SELECT l_suppkey::VARCHAR AS machine_id, (count(*) * 2000000000)::BIGINT AS produced, sum(2000000000 + l_quantity::INTEGER::BIGINT)::BIGINT AS good FROM lineitem GROUP BY ALL"""
)
def e17_sums_beyond_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities near the largest int: neither their sums nor a difference of two of them overflows."""
    entries = adapter.bulk_entries(spark, sf_dir).withColumns({"produced": F.lit(2_000_000_000), "rejected": -F.col("produced")})
    return quantities(entries, ("machine_id",))


def _codes(checked: Checked) -> DataFrame:
    codes = checked.errors.select("error_code").union(checked.rows.select(F.lit(None).cast("string").alias("error_code")))
    return codes.groupBy("error_code").agg(F.count("*").alias("n"))


@_query(f"WITH {_EV} SELECT CASE WHEN machine_id <> '3' THEN 'E1' END AS error_code, count(*)::BIGINT AS n FROM ev WHERE machine_id <> '3' OR event_type <> 'signup' GROUP BY ALL")
def e1_foreign_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All machines' observations under the configuration of one."""
    maps = adapter.signal_mappings(spark, signup=False).filter("machine_id = '3'")
    return _codes(map_with_configuration(adapter.observations(spark, sf_dir), maps, "3", on_error="quarantine"))


@_query(f"WITH {_EV} SELECT CASE WHEN event_type = 'signup' THEN 'E4' END AS error_code, count(*)::BIGINT AS n FROM ev GROUP BY ALL")
def e4_inverted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups come as text, and their mapping inverts."""
    text = F.col("address") == "signup"
    value = F.struct(F.lit(None).cast("boolean").alias("bool"), F.lit(None).cast("decimal(38,9)").alias("num"), F.lit("on").alias("text"), F.lit(None).cast("timestamp").alias("ts"))
    observed = adapter.observations(spark, sf_dir).withColumns({"type": F.when(text, "Text").otherwise(F.col("type")), "value": F.when(text, value).otherwise(F.col("value"))})
    maps = adapter.signal_mappings(spark).withColumn("type", F.when(text, "Text").otherwise(F.col("type")))
    return _codes(map_observations(observed, maps, on_error="quarantine"))


@_query(f"WITH {_EV} SELECT machine_id, count(*)::BIGINT AS n FROM ev WHERE event_type = 'purchase' AND machine_id::INTEGER % 2 = 1 GROUP BY ALL")
def e6_entries_out_of_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of machines that no schedule has."""
    scheduled = adapter.schedules(spark, sf_dir).filter("cast(machine_id as int) % 2 = 0")
    return entries_out_of_scope(adapter.production_entries(spark, sf_dir), scheduled).groupBy("machine_id").agg(F.count("*").alias("n"))


@_query(
    f"""WITH {_ME} SELECT machine_id, CASE WHEN machine_id::INTEGER % 3 = 0 THEN 'E7' WHEN machine_id::INTEGER % 3 = 1 THEN 'E8' END AS error_code, count(*)::BIGINT AS n FROM v GROUP BY ALL"""
)
def e7_e8_bad_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some machines' additional inputs name a derived one, and some list a metric twice; the others pass (null)."""
    scopes = adapter.schedules(spark, sf_dir)
    kind = F.col("machine_id").cast("int") % 3
    derived, additional = F.create_map(F.lit("APT"), F.lit(1.0)), F.create_map(F.when(kind == 0, "apt").otherwise("not"), F.lit(2.0))
    listed = F.array(*[F.struct(F.lit(k).alias("metric_key")) for k in ("quality", "oee")])
    policies = F.when(kind == 1, F.concat(listed, F.array(F.struct(F.lit("Quality").alias("metric_key"))))).otherwise(listed)
    checked = check_scopes(scopes, derived, additional, policies)
    passed = checked.rows.select("machine_id", F.lit(None).cast("string").alias("error_code"))
    return checked.errors.select("machine_id", "error_code").union(passed).groupBy("machine_id", "error_code").agg(F.count("*").alias("n"))


_BAD_DOCUMENTS = "CASE payload_id % 5 WHEN 0 THEN 'E9' WHEN 1 THEN 'E10' WHEN 2 THEN 'E11' WHEN 3 THEN 'E16' END"


def _spoiled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a bad header, two streams of one device, a bad time, or a blank device key; a fifth is sound."""
    kind, body = F.col("payload_id") % 5, F.col("xml")
    twice = F.concat(F.lit('<m:Streams><m:DeviceStream name="'), F.col("device_key"), F.lit('"/>'))
    spoiled = F.when(kind == 0, F.regexp_replace(body, "firstSequence=\"", "firstSequence=\"+")).when(kind == 1, F.replace(body, F.lit("<m:Streams>"), twice))
    spoiled = spoiled.when(kind == 2, F.regexp_replace(body, " timestamp=\"", " timestamp=\"x")).otherwise(body)
    return documents.sample_documents(spark, sf_dir).withColumns({"xml": spoiled, "device_key": F.when(kind == 3, " ").otherwise(F.col("device_key"))})


@_query(f"WITH {_DOCS} SELECT {_BAD_DOCUMENTS} AS error_code, count(*)::BIGINT AS n FROM d GROUP BY ALL")
def e9_e16_bad_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is sound has no code."""
    code = F.regexp_extract("error", "^E[0-9]+", 0)
    return xml.sample_envelopes(_spoiled_documents(spark, sf_dir), on_error="quarantine").select(code.alias("error_code")).groupBy("error_code").agg(F.count("*").alias("n"))


@_query(
    f"""WITH {_DOCS}, n AS (SELECT machine_id, event_id // {documents.BLOCK} AS block, count(*) AS readings FROM ev GROUP BY ALL)
SELECT {_BAD_DOCUMENTS} AS error_code, sum(CASE WHEN payload_id % 5 < 4 THEN 1 ELSE readings END)::BIGINT AS n FROM d JOIN n USING (machine_id, block) GROUP BY ALL"""
)
def e9_e16_streaming_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of documents: the readings of the sound ones, and a row of error for each of the others."""
    sound, bad = streams.quarantined_documents(spark, _spoiled_documents(spark, sf_dir))
    code = F.regexp_extract("error", "^E[0-9]+", 0)
    codes = sound.select(F.lit(None).cast("string").alias("error_code")).union(bad.select(code))
    return codes.groupBy("error_code").agg(F.count("*").alias("n"))


@_query(f"WITH {_EV} SELECT machine_id, CASE WHEN machine_id::INTEGER % 2 = 1 THEN 'E12' END AS error_code, CASE WHEN machine_id::INTEGER % 2 = 1 THEN 1 ELSE count(DISTINCT event_type) + 1 END::BIGINT AS n FROM ev GROUP BY machine_id")
def e12_probes_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other machine's probe has a data item without an id."""
    payloads = documents.probe_documents(spark, sf_dir)
    spoiled = F.when(F.col("payload_id") % 2 == 1, F.replace(F.col("xml"), F.lit('id="avail" '), F.lit(""))).otherwise(F.col("xml"))
    rows = xml.probe_items(payloads.withColumn("xml", spoiled), on_error="quarantine")
    code = F.regexp_extract("error", "^E[0-9]+", 0)
    return rows.groupBy(F.col("payload_id").cast("string").alias("machine_id"), code.alias("error_code")).agg(F.count("*").alias("n"))


@_query(
    f"""WITH {_ME} SELECT machine_id, shift_id, production_date, metric_key, value, reason FROM (
  SELECT machine_id, shift_id, production_date, 'availability' AS metric_key, a AS value, NULL AS reason, 0 AS odd FROM v
  UNION ALL SELECT machine_id, shift_id, production_date, 'quality', q, CASE WHEN q IS NULL THEN 'Produced quantity must be greater than zero.' END, 0 FROM v
  UNION ALL SELECT machine_id, shift_id, production_date, 'oee', NULL, 'Missing input ''availability''.', 1 FROM v
  UNION ALL SELECT machine_id, shift_id, production_date, 'availability', e, CASE WHEN e IS NULL THEN 'Machine power-on time must be greater than zero.' END, 1 FROM v
  UNION ALL SELECT machine_id, shift_id, production_date, 'custom', NULL, 'Metric strategy ''house-rule'' is not registered.', 1 FROM v) WHERE machine_id::INTEGER % 2 = odd"""
)
def x15_policies_as_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines bring their own lists of policies, which are folded row by row."""

    def listed(*pairs: tuple[str, str]) -> Column:
        return F.array(*[F.struct(F.lit(m).alias("metric_key"), F.lit(s).alias("strategy_key"), F.create_map().cast("map<string,string>").alias("parameters")) for m, s in pairs])

    even = listed(("availability", "apt-over-pot"), ("quality", "good-over-produced"))
    odd = listed(("oee", "availability-performance-quality"), ("availability", "apt-over-machine-power-on-time"), ("custom", "house-rule"))
    periods, schedules, entries = _facts(spark, sf_dir)
    evaluated = shift.evaluate_shifts(periods, schedules, entries, policies=())
    policies = F.when(F.col("machine_id").cast("int") % 2 == 0, even).otherwise(odd)
    folded = evaluated.select("machine_id", "shift_id", "production_date", F.explode(Engine().fold_policies(F.col("inputs"), policies, "double")).alias("m"))
    return folded.select("machine_id", "shift_id", "production_date", "m.metric_key", "m.value", "m.reason")


_IN_FORCE = f"""{_ME}, plant AS (SELECT o_orderkey AS ordinal, 'S' || (o_custkey % 4) AS site_id, o_orderkey % 5 AS list, o_orderstatus = 'P' AS published,
  TIMESTAMP '2023-12-20' + to_days((o_orderkey % 45)::INTEGER) AS since,
  CASE WHEN o_orderpriority[1] IN ('1', '2', '3') THEN TIMESTAMP '2023-12-20' + to_days((o_orderkey % 45 + o_orderkey % 9 + 1)::INTEGER) END AS until FROM orders),
ruled AS (SELECT * FROM (SELECT v.machine_id, v.shift_id, v.production_date, list, ordinal,
    row_number() OVER (PARTITION BY v.machine_id, v.shift_id, v.production_date ORDER BY since DESC NULLS LAST, ordinal) AS rank
  FROM v LEFT JOIN plant ON site_id_of(v.machine_id) = plant.site_id AND published AND since <= v.production_date + INTERVAL 6 HOUR AND (until IS NULL OR v.production_date + INTERVAL 6 HOUR < until)) WHERE rank = 1)""".replace(
    "site_id_of(v.machine_id)", "'S' || (v.machine_id::INTEGER % 3)"
)


def _in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods, schedules, entries = _facts(spark, sf_dir)
    site = F.concat(F.lit("S"), (F.col("machine_id").cast("int") % 3).cast("string"))
    return shift.evaluate_in_force(periods, schedules.withColumn("site_id", site), entries.withColumn("site_id", site), adapter.plant_configurations(spark, sf_dir))


@_query(
    f"""WITH {_IN_FORCE} SELECT machine_id, shift_id, production_date, position, metric_key, value, reason FROM (
  SELECT list, machine_id, shift_id, production_date, position, metric_key, value, reason FROM ruled JOIN me USING (machine_id, shift_id, production_date) WHERE list = 2 AND position < 4
  UNION ALL SELECT list, machine_id, shift_id, production_date, position // 2, metric_key, value, reason FROM ruled JOIN me USING (machine_id, shift_id, production_date) WHERE list = 0 AND position IN (0, 2)
  UNION ALL SELECT list, machine_id, shift_id, production_date, 0, 'oee', NULL, 'Missing input ''availability''.' FROM ruled WHERE list = 1
  UNION ALL SELECT list, machine_id, shift_id, production_date, 1, 'availability', value, reason FROM ruled JOIN me USING (machine_id, shift_id, production_date) WHERE list = 1 AND position = 5
  UNION ALL SELECT list, machine_id, shift_id, production_date, 2, 'custom', NULL, 'Metric strategy ''house-rule'' is not registered.' FROM ruled WHERE list = 1
  UNION ALL SELECT list, machine_id, shift_id, production_date, 0, 'Availability', value, reason FROM ruled JOIN me USING (machine_id, shift_id, production_date) WHERE list = 3 AND position = 5)"""
)
def k2_k3_x13_metrics_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scope's metrics by the policies of the configuration that was in force at its site."""
    found = metrics_long(_in_force(spark, sf_dir), "machine_id", "shift_id", "production_date")
    return found.drop("is_available")


@_query(f"WITH {_IN_FORCE} SELECT machine_id, ordinal::VARCHAR AS version, count(*)::BIGINT AS n FROM ruled GROUP BY ALL")
def k2_versions_of_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a machine's scopes were ruled by which version; null where there was none."""
    return _in_force(spark, sf_dir).groupBy("machine_id", "version").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
