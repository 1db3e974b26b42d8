"""The provided tables read as machine data: deterministic views, which SQL can define as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import VALUE
from .shift import production_date, shift_number

MACHINES = 10
HALF_HOUR_US = 1_800_000_000
EVENT_SIGNALS = (
    ("error", "state.fault", False), ("click", "state.running", False), ("view", "state.running", False),
    ("purchase", "state.idle", False), ("signup", "state.running", True),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _machine(number: Column) -> Column:
    return (number % MACHINES).cast("string")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), _machine(F.col("user_id")).alias("machine_id"), "event_type", "value", k.alias("k"))


def _quality(k: Column) -> Column:
    return F.when(k % 20 == 19, "Bad").when(k % 20 == 18, "Uncertain").otherwise("Good")


def _digital(flag: Column) -> Column:
    none = [F.lit(None).cast(t).alias(n) for n, t in (("num", "decimal(38,9)"), ("text", "string"), ("ts", "timestamp"))]
    return F.struct(flag.alias("bool"), *none).cast(VALUE)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        "machine_id", F.lit("events").alias("source"), F.col("event_type").alias("address"), F.lit("Digital").alias("type"),
        _digital(F.lit(True)).alias("value"), _quality(F.col("k")).alias("quality"), F.col("ts").alias("timestamp"), F.col("event_id").alias("ordinal"),
    )


def signal_mappings(spark: SparkSession, signup: bool = True) -> DataFrame:
    """For every machine; without signup one kind of event has no mapping."""
    rows = [(str(m), "EVENTS", a, key, "Digital", invert, i) for m in range(MACHINES) for i, (a, key, invert) in enumerate(EVENT_SIGNALS) if signup or a != "signup"]
    return spark.createDataFrame(rows, "machine_id string, source string, address string, signal_key string, type string, invert boolean, ordinal int")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each event, with running, idle and fault as the event's type has them."""
    kind = F.col("event_type")

    def signal(key: str, flag: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.lit("Digital").alias("type"), _digital(flag).alias("value"), F.lit("events").alias("source"), _quality(F.col("k")).alias("quality"), F.col("ts").alias("timestamp"))

    signals = F.array(signal("state.running", kind.isin("click", "view")), signal("state.idle", kind == "purchase"), signal("state.fault", kind == "error"))
    return _events(spark, sf_dir).select("machine_id", signals.alias("signals"), F.col("ts").alias("timestamp"), F.col("event_id").alias("ordinal"))


def _scope(machine: Column, shift: Column, date: Column) -> list[Column]:
    return [F.lit("C1").alias("company_id"), F.lit("S1").alias("site_id"), machine.alias("machine_id"), shift.cast("string").alias("shift_id"), date.alias("production_date")]


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every machine on every production date in every shift: 8 hours less half an hour for each shift number."""
    days = table(spark, sf_dir, "events").select(production_date(F.col("ts").cast("timestamp")).alias("d")).distinct()
    slots = days.withColumn("m", F.explode(F.array(*[F.lit(str(m)) for m in range(MACHINES)]))).withColumn("s", F.explode(F.array(*map(F.lit, range(3)))))
    planned = (F.lit(8 * 2) - F.col("s")).cast("bigint") * HALF_HOUR_US
    return slots.select(*_scope(F.col("m"), F.col("s"), F.col("d")), planned.alias("planned_us"))


def production_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, k = F.col("ts"), F.col("k")
    return _events(spark, sf_dir).filter("event_type = 'purchase'").select(
        *_scope(F.col("machine_id"), shift_number(at), production_date(at)),
        F.concat(F.lit("part_"), k.cast("string")).alias("part_id"),
        F.when(k % 3 == 0, F.concat(F.lit("op_"), k.cast("string"))).alias("operator_id"),
        F.lit(None).cast("string").alias("job_reference"),
        F.floor("value").cast("int").alias("produced"), F.floor(F.col("value") * (k % 5) / 100).cast("int").alias("rejected"), at.alias("recorded_at"),
    )


def bulk_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    produced = F.col("l_quantity").cast("int")
    lost = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    return table(spark, sf_dir, "lineitem").select(
        *_scope(F.col("l_suppkey").cast("string"), F.col("l_linenumber") % 3, F.col("l_shipdate").cast("date")),
        produced.alias("produced"), F.when(lost, produced).otherwise(0).alias("rejected"),
    )


def site_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = F.col("o_orderdate").cast("timestamp")
    policies = [("availability", "apt-over-pot"), ("Availability", "apt-over-machine-power-on-time"), ("quality", "good-over-produced")]
    listed = F.array(*[F.struct(F.lit(m).alias("metric_key"), F.lit(s).alias("strategy_key"), F.create_map().cast("map<string,string>").alias("parameters")) for m, s in policies])
    return table(spark, sf_dir, "orders").select(
        F.lit("C1").alias("company_id"), F.col("o_custkey").cast("string").alias("site_id"), F.col("o_orderkey").cast("string").alias("version"),
        F.when(F.col("o_orderstatus") == "P", "Published").when(F.col("o_orderstatus") == "O", "Draft").otherwise("Superseded").alias("lifecycle"),
        since.alias("effective_from"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2", "3"), F.timestamp_add("DAY", F.lit(365), since)).alias("effective_to"),
        F.when(F.col("o_orderkey") % 2 == 0, listed).otherwise(F.slice(listed, 2, 2)).alias("metric_policies"), F.col("o_orderkey").alias("ordinal"),
    )


#: Lists of policies (metric, strategy) that plant configurations have, by the order's key.
PLANT_LISTS = (
    (("availability", "apt-over-pot"), ("quality", "good-over-produced")),
    (("oee", "availability-performance-quality"), ("availability", "apt-over-machine-power-on-time"), ("custom", "house-rule")),
    (("availability", "apt-over-pot"), ("performance", "reference-time-over-apt"), ("quality", "good-over-produced"), ("oee", "availability-performance-quality")),
    (("Availability", "APT-over-machine-power-on-time"),),
    (),
)


def plant_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as configurations of four sites in the time of the events, some with an end."""
    kind = "array<struct<metric_key:string,strategy_key:string,parameters:map<string,string>>>"
    policy = lambda m, s: F.struct(F.lit(m).alias("metric_key"), F.lit(s).alias("strategy_key"), F.create_map().cast("map<string,string>").alias("parameters"))
    lists = [F.array(*[policy(m, s) for m, s in own]).cast(kind) for own in PLANT_LISTS]
    key = F.col("o_orderkey")
    since = F.timestamp_add("DAY", (key % 45).cast("int"), F.lit("2023-12-20").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(
        F.lit("C1").alias("company_id"), F.concat(F.lit("S"), (F.col("o_custkey") % 4).cast("string")).alias("site_id"), key.cast("string").alias("version"),
        F.when(F.col("o_orderstatus") == "P", "Published").when(F.col("o_orderstatus") == "O", "Draft").otherwise("Superseded").alias("lifecycle"),
        since.alias("effective_from"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2", "3"), F.timestamp_add("DAY", (key % 9 + 1).cast("int"), since)).alias("effective_to"),
        F.element_at(F.array(*lists), (key % len(lists) + 1).cast("int")).alias("metric_policies"), key.alias("ordinal"),
    )


def factories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as factories, their nations as lines, the nations' suppliers as machines."""
    signal = F.struct(
        F.lit("state.running").alias("key"), F.lit("running").alias("name"), F.lit("Digital").alias("type"), F.lit("State").alias("category"),
        F.lit(None).cast("string").alias("unit"), F.lit(True).alias("is_required"),
    )
    capability = F.struct(F.lit("milling").alias("key"), F.lit("Milling").alias("name"))
    machine = F.struct(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("n_nationkey").cast("string").alias("line_id"),
        F.array(signal).alias("signals"), F.array(capability).alias("capabilities"),
    )
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    supplied = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    per_line = supplied.groupBy("n_nationkey", "n_name", "n_regionkey").agg(F.sort_array(F.collect_list(machine)).alias("machines"))
    line = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), "machines")
    per_factory = per_line.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return per_factory.select(F.col("r_name").alias("name"), "lines")
