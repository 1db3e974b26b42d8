"""Tables, names and enums of the machine-data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Names that data and configuration refer to.
MACHINE_STATES = {"Unknown": 0, "Stopped": 1, "Idle": 2, "Running": 3, "Fault": 4}
SIGNAL_TYPES = {"Digital": 0, "Analog": 1, "Counter": 2, "WholeNumber": 3, "Numeric": 4, "Text": 5, "Enumeration": 6, "Timestamp": 7}
SIGNAL_CATEGORIES = {"State": 0, "Production": 1, "Process": 2, "Condition": 3, "Energy": 4, "Custom": 5}
QUALITIES = {"Good": 0, "Uncertain": 1, "Bad": 2}
LIFECYCLES = {"Draft": 0, "Published": 1, "Superseded": 2}
SIGNAL_KEYS = (
    "state.power-on", "state.running", "state.idle", "state.fault", "energy.current", "production.part-count",
    "production.cycle-count", "process.spindle-speed", "process.feed-rate", "condition.alarm",
)
METRIC_KEYS = ("availability", "performance", "quality", "oee", "utilization.elr", "utilization.elre")
INPUT_KEYS = ("apt", "pot", "not", "machine-power-on-time", "produced-quantity", "good-quantity", "availability", "performance", "quality")

U64 = "decimal(20,0)"
U64_MAX_TEXT = "18446744073709551615"
AMOUNT = "decimal(18,6)"
VALUE = "struct<bool:boolean,num:decimal(38,9),text:string,ts:timestamp>"
SIGNAL = f"struct<key:string,type:string,value:{VALUE},source:string,quality:string,timestamp:timestamp>"
SCOPE = ("company_id", "site_id", "machine_id", "shift_id", "production_date")
_SCOPE = "company_id string, site_id string, machine_id string, shift_id string, production_date date"
_DATA_ITEM = "struct<id:string,name:string,type:string,category:string,sub_type:string,units:string,component_id:string,component_name:string,component_type:string>"
_DEFINITION = "struct<key:string,name:string,type:string,category:string,unit:string,is_required:boolean>"

#: DDL of every table; ordinals stand for arrival or list order and are ours.
TABLES = {
    "observations": f"machine_id string, source string, address string, type string, value {VALUE}, quality string, timestamp timestamp, ordinal bigint",
    "mapped_observations": f"machine_id string, source string, address string, signal_key string, type string, value {VALUE}, quality string, timestamp timestamp, ordinal bigint",
    "snapshots": f"machine_id string, signals array<{SIGNAL}>, timestamp timestamp, ordinal bigint",
    "states": "machine_id string, state string, timestamp timestamp, ordinal bigint",
    "transitions": "machine_id string, previous_state string, current_state string, timestamp timestamp, ordinal bigint",
    "activity_periods": "machine_id string, state string, started_at timestamp, ended_at timestamp, duration_us bigint",
    "schedules": f"{_SCOPE}, planned_us bigint",
    "production_entries": f"{_SCOPE}, part_id string, operator_id string, job_reference string, produced int, rejected int, recorded_at timestamp",
    "metric_policies": "metric_key string, strategy_key string, parameters map<string,string>",
    "site_configurations": "company_id string, site_id string, version string, lifecycle string, effective_from timestamp, effective_to timestamp,"
    " metric_policies array<struct<metric_key:string,strategy_key:string,parameters:map<string,string>>>, ordinal int",
    "signal_mappings": "machine_id string, source string, address string, signal_key string, type string, invert boolean, ordinal int",
    "simple_mappings": "signal_key string, source string",
    "signal_definitions": "key string, name string, type string, category string, unit string, is_required boolean",
    "shifts": "shift_id string, site_id string, name string, starts_at int, ends_at int",
    "operator_assignments": "company_id string, site_id string, machine_id string, shift_id string, operator_id string, starts_at timestamp, ends_at timestamp",
    "operators": "operator_id string, company_id string, code string, name string",
    "parts": "part_id string, company_id string, code string, name string, operation string",
    "factories": f"name string, lines array<struct<id:string,name:string,machines:array<struct<id:string,name:string,line_id:string,signals:array<{_DEFINITION}>,capabilities:array<struct<key:string,name:string>>>>>>",
    "probe": f"agent_instance_id string, agent_version string, devices array<struct<id:string,name:string,uuid:string,data_items:array<{_DATA_ITEM}>>>",
    "sample_envelopes": f"instance_id {U64}, first_sequence {U64}, last_sequence {U64}, next_sequence {U64}",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
