"""Effective-dated site configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, is_blank
from ..shared import written
from .intervals import in_force, timeline


def is_effective(at: Column, lifecycle: Column, since: Column, until: Column) -> Column:
    """Published, and at is in [since, until), or in [since, ...) without an end."""
    return (lifecycle == "Published") & (since <= at) & (until.isNull() | (at < until))


def resolve_configurations(requests: DataFrame, configurations: DataFrame, request_key: str = "request_id", at: str = "at") -> DataFrame:
    """Each request (request_key, company_id, site_id, at) with the configuration in force, or null; equal requests
    keep their rows.

    The latest start wins; equal starts go to the one earlier in the list (ordinal, unique in a site).  The moments at
    which another one is in force are written first, as requests are met with them in two ways.
    """
    site = ["company_id", "site_id"]
    published = configurations.filter(F.col("lifecycle") == "Published")
    intervals = published.select(*site, F.unix_micros("effective_from").alias("since"), F.unix_micros("effective_to").alias("until"), "ordinal")
    whole = published.select(*site, F.col("ordinal").cast("bigint").alias("ordinal"), F.struct(*configurations.columns).alias("configuration"))
    changes = written(timeline(intervals, site).join(whole, [*site, "ordinal"], "left"), "configurations")
    return in_force(requests, changes, site, at, "configuration", request_key)


def policy_of(policies: Column, metric_key: str) -> Column:
    """The first policy for a metric, or null."""
    if not metric_key or not metric_key.strip():
        raise ValueError("a metric key is required")
    return F.try_element_at(F.filter(policies, lambda p: fold(p["metric_key"]) == metric_key.lower()), F.lit(1))


def policy_of_column(policies: Column, metric_key: Column) -> Column:
    """The same with the key in a column; a blank key raises."""
    found = F.try_element_at(F.filter(policies, lambda p: fold(p["metric_key"]) == fold(metric_key)), F.lit(1))
    return F.when(is_blank(metric_key), F.raise_error(F.lit("E16: a metric key is required"))).otherwise(found)
