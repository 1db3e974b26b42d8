"""Metric policies as column expressions.

A strategy turns named inputs into a value and, where there is none, a reason.  Policies are evaluated in
their order; an available result becomes an input of the policies behind it.  Lists of policies that the
driver knows become plain columns, one level for each policy; lists that are data are folded per row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, lookup, with_entry
from .contract import Checked, check

RATIO = "decimal(24,12)"
_NO_METRICS = "array<struct<metric_key:string,value:double,is_available:boolean,reason:string>>"


@dataclass(frozen=True)
class Policy:
    metric_key: str
    strategy_key: str
    parameters: Mapping[str, str] = field(default_factory=dict)


#: Looks an input up by key: its column, null where it is missing.
Inputs = Callable[[str], Column]


@dataclass(frozen=True)
class Strategy:
    """key names it in policies; calculate gives (value, reason) for (inputs, parameters as a map column)."""

    key: str
    calculate: Callable[[Inputs, Column], tuple[Column, Column]]


def _missing(inputs: Inputs, *keys: str) -> Column:
    """The reason for the first of keys that has no value, else null."""
    reason = F.lit(None).cast("string")
    for k in reversed(keys):
        reason = F.when(inputs(k).isNull(), F.lit(f"Missing input '{k}'.")).otherwise(reason)
    return reason


def ratio(key: str, over: str, under: str, what: str) -> Strategy:
    """over / under, with under more than zero."""

    def calculate(inputs: Inputs, parameters: Column) -> tuple[Column, Column]:
        reason = F.coalesce(_missing(inputs, over, under), F.when(inputs(under) <= 0, F.lit(f"{what} must be greater than zero.")))
        return F.when(reason.isNull(), inputs(over) / inputs(under)), reason

    return Strategy(key, calculate)


def product(key: str, *factors: str) -> Strategy:
    def calculate(inputs: Inputs, parameters: Column) -> tuple[Column, Column]:
        value = inputs(factors[0])
        for f in factors[1:]:
            value = value * inputs(f)
        reason = _missing(inputs, *factors)
        return F.when(reason.isNull(), value), reason

    return Strategy(key, calculate)


# Strategy keys, the inputs they read in the order they are missed, and what must exceed zero.
STRATEGIES = (
    ratio("apt-over-pot", "apt", "pot", "Planned operating time"),
    ratio("apt-over-machine-power-on-time", "apt", "machine-power-on-time", "Machine power-on time"),
    ratio("reference-time-over-apt", "not", "apt", "Actual production time"),
    ratio("good-over-produced", "good-quantity", "produced-quantity", "Produced quantity"),
    product("availability-performance-quality", "availability", "performance", "quality"),
)

POLICIES = (
    Policy("availability", "apt-over-pot"),
    Policy("performance", "reference-time-over-apt"),
    Policy("quality", "good-over-produced"),
    Policy("oee", "availability-performance-quality"),
    Policy("utilization.elr", "apt-over-pot"),
    Policy("utilization.elre", "apt-over-machine-power-on-time"),
)


class Engine:
    """A registry of strategies, by key without case."""

    def __init__(self, strategies: Sequence[Strategy] = STRATEGIES):
        self.strategies: dict[str, Strategy] = {}
        for s in strategies:
            if s.key.lower() in self.strategies:
                raise ValueError(f"strategy {s.key} is registered twice")
            self.strategies[s.key.lower()] = s

    def calculate(self, metric_key: str, inputs: Inputs, policy: Policy) -> tuple[Column, Column]:
        """(value, reason) of one metric under one policy."""
        none = F.lit(None).cast("double")
        if policy.metric_key.lower() != metric_key.lower():
            return none, F.lit(f"Metric policy '{policy.metric_key}' does not match calculation context '{metric_key}'.")
        strategy = self.strategies.get(policy.strategy_key.lower())
        if strategy is None:
            return none, F.lit(f"Metric strategy '{policy.strategy_key}' is not registered.")
        flat = [F.lit(x) for pair in policy.parameters.items() for x in pair]
        return strategy.calculate(inputs, F.create_map(*flat) if flat else F.create_map().cast("map<string,string>"))

    def evaluate(
        self, df: DataFrame, inputs: Mapping[str, Column], additional: Mapping[str, Column] | None = None, policies: Sequence[Policy] = POLICIES, number: str = "double"
    ) -> DataFrame:
        """df with inputs (a map, as given) and metrics: an array of (metric_key, value, is_available, reason).

        An additional input that names a derived one raises (E7), as does a metric that comes twice (E8).
        number is the type metrics are computed in: double, or decimal(18,6) for exact input values.
        """
        known: dict[str, Column] = {k.lower(): c for k, c in inputs.items()}
        for k, c in (additional or {}).items():
            if k.lower() in known:
                raise ValueError(f"E7: additional input '{k}' would replace another input")
            known[k.lower()] = c
        keys = [p.metric_key.lower() for p in policies]
        if len(set(keys)) < len(keys):
            raise ValueError("E8: a metric policy is duplicated")
        out = df.withColumns({f"__in_{i}": c.cast(number) for i, c in enumerate(known.values())})
        working = {k: f"__in_{i}" for i, k in enumerate(known)}
        frozen = dict(working)
        absent = F.lit(None).cast(number)

        def find(key: str) -> Column:
            name = working.get(key.lower())
            return F.col(name) if name else absent

        kept = []
        for i, p in enumerate(policies):
            value, reason = self.calculate(p.metric_key, find, p)
            out = out.withColumns({f"__v_{i}": value, f"__r_{i}": reason})
            # what an available result is called becomes that input; an unavailable one leaves it as it was
            # decimals leave room for a product of three results; what replaces an input has the input's size
            before = working.get(p.metric_key.lower())
            shape = ("decimal(28,12)" if before else "decimal(20,12)") if number.startswith("decimal") else number
            result = F.col(f"__v_{i}").cast(shape)
            out = out.withColumn(f"__w_{i}", F.coalesce(result, F.col(before).cast(shape)) if before else result)
            working[p.metric_key.lower()] = f"__w_{i}"
            kept.append(
                F.struct(
                    F.lit(p.metric_key).alias("metric_key"), F.col(f"__v_{i}").cast("double" if number == "double" else "decimal(38,20)").alias("value"),
                    F.col(f"__r_{i}").isNull().alias("is_available"), F.col(f"__r_{i}").alias("reason"),
                )
            )
        pairs = [x for k, c in frozen.items() for x in (F.lit(k), F.col(c))]
        given = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
        return out.select(*df.columns, given.alias("inputs"), (F.array(*kept) if kept else F.array().cast(_NO_METRICS)).alias("metrics"))

    def fold_policies(self, inputs: Column, policies: Column, number: str = RATIO) -> Column:
        """The same per row: inputs is a map with folded keys, policies an array of (metric_key, strategy_key, parameters).

        A metric that comes twice raises (E8), after the policies before it.
        """
        kind = f"array<struct<metric_key:string,value:{number},is_available:boolean,reason:string>>"
        start = F.struct(inputs.cast(f"map<string,{number}>").alias("known"), F.array().cast(kind).alias("done"))

        def step(state: Column, policy: Column) -> Column:
            value, reason = F.lit(None).cast(number), F.concat(F.lit("Metric strategy '"), policy["strategy_key"], F.lit("' is not registered."))
            for key, s in self.strategies.items():
                own_value, own_reason = s.calculate(lambda k: lookup(state["known"], F.lit(k)), policy["parameters"])
                mine = fold(policy["strategy_key"]) == key
                value, reason = F.when(mine, own_value.cast(number)).otherwise(value), F.when(mine, own_reason).otherwise(reason)
            again = F.exists(state["done"], lambda d: fold(d["metric_key"]) == fold(policy["metric_key"]))
            reason = F.when(again, F.raise_error(F.lit("E8: a metric policy is duplicated")).cast("string")).otherwise(reason)
            result = F.struct(policy["metric_key"].alias("metric_key"), value.alias("value"), reason.isNull().alias("is_available"), reason.alias("reason"))
            known = F.when(reason.isNull(), with_entry(state["known"], policy["metric_key"], value)).otherwise(state["known"])
            return F.struct(known.alias("known"), F.concat(state["done"], F.array(result)).alias("done"))

        return F.aggregate(policies, start, step, lambda s: s["done"])


def check_scopes(df: DataFrame, derived: Column, additional: Column, policies: Column | None = None, on_error: str = "quarantine") -> Checked:
    """Scopes whose additional inputs (a map) would replace derived ones (E7), or whose policies name a metric twice (E8).

    In quarantine mode they are set apart, so that one bad scope doesn't end the job.
    """
    folded = [F.transform(F.map_keys(m), fold) for m in (derived, additional)]
    rules = [("E7", F.arrays_overlap(*folded), "additional input would replace another input")]
    if policies is not None:
        keys = F.transform(policies, lambda p: fold(p["metric_key"]))
        rules.append(("E8", F.size(F.array_distinct(keys)) < F.size(keys), "a metric policy is duplicated"))
    return check(df, rules, on_error)


def merge_inputs(derived: Column, additional: Column) -> Column:
    """Two maps with folded keys as one; a key in both raises (E7)."""
    clash = F.arrays_overlap(F.map_keys(derived), F.map_keys(additional))
    return F.when(clash, F.raise_error(F.lit("E7: additional input would replace another input")).cast("map<string,decimal(18,6)>")).otherwise(F.map_concat(derived, additional))


def metrics_long(evaluated: DataFrame, *keys: str) -> DataFrame:
    """One row for each metric: keys, position, metric_key, value, is_available, reason."""
    exploded = evaluated.select(*keys, F.posexplode("metrics").alias("position", "m"))
    return exploded.select(*keys, "position", "m.metric_key", "m.value", "m.is_available", "m.reason")
