"""Scalar rules for keys, text and numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64_MAX = 2**64 - 1


def fold(key: Column) -> Column:
    """Keys (sources, addresses, signal, metric and strategy keys) compare without case; identifiers don't."""
    return F.lower(key)


def same_key(a: Column, b: Column) -> Column:
    return fold(a) == fold(b)


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"(?U)^\s*$")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def parse_u64(text: Column) -> Column:
    """Decimal digits only, at most 2^64 - 1; anything else is null."""
    number = F.expr("null").cast("decimal(20,0)")
    digits = F.regexp_replace(text, "^0+(?=[0-9])", "")
    fits = text.rlike("^[0-9]+$") & (F.length(digits) <= 20)
    parsed = F.when(fits, digits).otherwise(F.lit(None)).try_cast("decimal(20,0)")
    return F.when(parsed <= F.lit(str(U64_MAX)).cast("decimal(20,0)"), parsed).otherwise(number)


def parse_number(text: Column) -> Column:
    """Sign, digits, point and exponent; no thousands separators. Null if it is none or doesn't fit."""
    ok = trimmed(text).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(ok, trimmed(text)).otherwise(F.lit(None)).try_cast("decimal(38,9)")


def parse_instant(text: Column) -> Column:
    """Null if it is no timestamp; without an offset it is read in the session's zone (UTC)."""
    return F.try_to_timestamp(text)


def lookup(entries: Column, key: Column) -> Column:
    """A map's value under a folded key, null if there is none. Maps carry folded keys."""
    return F.try_element_at(entries, fold(key))


def with_entry(entries: Column, key: Column, value: Column) -> Column:
    """A map with an entry put in, over any of the same folded key."""
    return F.map_concat(F.map_filter(entries, lambda k, _: k != fold(key)), F.create_map(fold(key), value))


def folded_map(entries: Column) -> Column:
    """A map with folded keys; keys that differ in case alone raise (Spark's duplicate-key rule)."""
    return F.map_from_entries(F.transform(F.map_entries(entries), lambda e: F.struct(fold(e["key"]).alias("key"), e["value"].alias("value"))))


def microseconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def hours(us: Column) -> Column:
    """Microseconds as hours, DECIMAL(18,6)."""
    return (us.cast("decimal(20,0)") / F.lit(3_600_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")


def new_identity() -> Column:
    """An identity for a row that has none of its own; another one each time the row is computed, so write it first."""
    return F.uuid()


def observed_now() -> Column:
    """The moment for what carries none: one for all rows of a query (of a micro-batch, in a stream)."""
    return F.current_timestamp()
