"""Metrics where the list of policies is data: the lists are a dictionary, and each is compiled once.

``dictionary`` takes the distinct lists of a table of configurations, the most frequent first, and no more than
``LISTS``.  ``evaluate_lists`` compiles them into one plan: a level for each position in a list, whose column says
for each list what the policy there does; lists that agree so far share a branch.  A row costs its own list's policies
and some comparisons of a number, not a fold over all strategies.  A row whose list isn't in the dictionary is folded
(``Engine.fold_policies``), with the same result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import _NO_METRICS, Engine, Policy

#: Lists that are compiled at most; the others are folded row by row.
LISTS = 256


@dataclass(frozen=True)
class Dictionary:
    """lists by their code; whole says that there were no more."""

    lists: dict[str, tuple[Policy, ...]]
    whole: bool


def code(policies: Column) -> Column:
    """A list of policies as text: equal for equal lists."""
    entry = lambda p: F.struct(p["metric_key"].alias("m"), p["strategy_key"].alias("s"), F.array_sort(F.map_entries(p["parameters"])).alias("p"))
    return F.to_json(F.transform(policies, entry))


def dictionary(configurations: DataFrame, column: str = "metric_policies", limit: int = LISTS) -> Dictionary:
    found = configurations.select(code(F.col(column)).alias("code"), F.col(column).alias("policies")).filter("code is not null")
    counted = found.groupBy("code").agg(F.count("*").alias("n"), F.any_value("policies").alias("policies"))
    rows = counted.orderBy(F.desc("n"), "code").limit(limit + 1).collect()
    lists = {r.code: tuple(Policy(p.metric_key, p.strategy_key, dict(p.parameters or {})) for p in r.policies) for r in rows[:limit]}
    return Dictionary(lists, len(rows) <= limit)


def _by_list(branches: Mapping[tuple, tuple[list[int], Column]], otherwise: Column) -> Column:
    """The column of the branch that a row's list is in."""
    of = F.col("__list")
    return reduce(lambda rest, b: F.when(of.isin(b[0]) if len(b[0]) > 1 else of == b[0][0], b[1]).otherwise(rest), reversed(list(branches.values())), otherwise)


def evaluate_lists(
    df: DataFrame, inputs: Mapping[str, Column], additional: Mapping[str, Column], policies: Column, known: Dictionary, engine: Engine | None = None
) -> DataFrame:
    """df with inputs (a map) and metrics (an array), as Engine.evaluate gives them, by the row's own list of policies.

    A null list has no metrics.  A list that names a metric twice raises (E8) where a row has it; an additional
    input that names a derived one raises at once (E7).
    """
    engine = engine or Engine()
    given = {k.lower(): c for k, c in inputs.items()}
    for k, c in additional.items():
        if k.lower() in given:
            raise ValueError(f"E7: additional input '{k}' would replace another input")
        given[k.lower()] = c
    lists = list(known.lists.values())
    numbers = df.sparkSession.createDataFrame([(c, n) for n, c in enumerate(known.lists)], "__code string, __list int")
    out = df.withColumns({"__policies": policies, "__code": code(policies), **{f"__in_{i}": c.cast("double") for i, c in enumerate(given.values())}})
    out = out.join(F.broadcast(numbers), "__code", "left")  # LISTS rows at most
    start = {k: f"__in_{i}" for i, k in enumerate(given)}
    working = [dict(start) for _ in lists]
    none = F.lit(None).cast("double")
    levels = []
    for level in range(max(map(len, lists), default=0)):
        branches: dict[tuple, list[int]] = {}
        for n, own in enumerate(lists):
            if level < len(own):
                p = own[level]
                branches.setdefault((p.metric_key, p.strategy_key.lower(), tuple(sorted(p.parameters.items())), tuple(sorted(working[n].items()))), []).append(n)
        values, reasons, names, results = {}, {}, {}, {}
        for key, members in branches.items():
            p, seen = lists[members[0]][level], working[members[0]]
            find = lambda k, seen=seen: F.col(seen[k.lower()]) if k.lower() in seen else none
            value, reason = engine.calculate(p.metric_key, find, p)
            values[key], reasons[key], names[key] = (members, value), (members, reason), (members, F.lit(p.metric_key))
            before = seen.get(p.metric_key.lower())
            results[key] = (members, F.coalesce(F.col(f"__v_{level}"), F.col(before)) if before else F.col(f"__v_{level}"))
        out = out.withColumns({f"__v_{level}": _by_list(values, none), f"__r_{level}": _by_list(reasons, F.lit(None).cast("string"))})
        out = out.withColumn(f"__w_{level}", _by_list(results, none))
        for key, members in branches.items():
            for n in members:
                working[n][key[0].lower()] = f"__w_{level}"
        reason = F.col(f"__r_{level}")
        levels.append(F.struct(_by_list(names, F.lit(None).cast("string")).alias("metric_key"), F.col(f"__v_{level}").alias("value"), reason.isNull().alias("is_available"), reason.alias("reason")))
    lengths: dict[tuple, list[int]] = {}
    for n, own in enumerate(lists):
        lengths.setdefault((len(own),), []).append(n)
    length = _by_list({k: (members, F.lit(k[0])) for k, members in lengths.items()}, F.lit(0))
    nothing = F.array().cast(_NO_METRICS)
    metrics = F.slice(F.array(*levels), F.lit(1), length) if levels else nothing
    twice = [n for n, own in enumerate(lists) if len({p.metric_key.lower() for p in own}) < len(own)]
    if twice:
        metrics = F.when(F.col("__list").isin(twice), F.raise_error(F.lit("E8: a metric policy is duplicated")).cast(_NO_METRICS)).otherwise(metrics)
    as_given = F.map_filter(F.create_map(*[x for k, c in start.items() for x in (F.lit(k), F.col(c))]), lambda _, v: v.isNotNull())
    rest = nothing if known.whole else F.when(F.col("__policies").isNotNull(), engine.fold_policies(as_given, F.col("__policies"), "double").cast(_NO_METRICS)).otherwise(nothing)
    return out.select(*df.columns, as_given.alias("inputs"), F.when(F.col("__list").isNotNull(), metrics).otherwise(rest).alias("metrics"))
