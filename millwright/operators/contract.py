"""How operators treat rows that break a rule: strict raises, quarantine sets them apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("strict", "quarantine")


@dataclass
class Checked:
    """rows: what passed. errors: what didn't, with error_code and error (empty in strict mode)."""

    rows: DataFrame
    errors: DataFrame


def refuse(df: DataFrame, failed: Column, message: Column, keep: Column | None = None) -> DataFrame:
    """df, or the rows of it to keep; a row that failed raises, whatever columns are asked for.

    A filter isn't pruned as a column is, and as one expression neither half of it moves in front of the other.
    """
    return df.filter(F.when(failed, F.raise_error(message).cast("boolean")).otherwise(F.lit(True) if keep is None else keep))


def mark(df: DataFrame, rules: list[tuple[str, Column, Column | str]]) -> DataFrame:
    """df with error_code and error of the first rule (code, condition of failure, message) that holds, else null."""
    return df.withColumns(dict(zip(("error_code", "error"), _first(rules))))


def _first(rules: list[tuple[str, Column, Column | str]]) -> tuple[Column, Column]:
    code = message = F.lit(None).cast("string")
    for name, failed, text in reversed(rules):
        text = F.lit(text) if isinstance(text, str) else text
        code = F.when(failed, F.lit(name)).otherwise(code)
        message = F.when(failed, text).otherwise(message)
    return code, message


def check(df: DataFrame, rules: list[tuple[str, Column, Column | str]], on_error: str, keep: Column | None = None) -> Checked:
    """Applies rules (code, condition of failure, message) in order; the first that holds names the error.

    Of the rows that pass, those to keep are given out.
    """
    if on_error not in MODES:
        raise ValueError(f"on_error must be one of {MODES}")
    code, message = _first(rules)
    if on_error == "quarantine":
        marked = mark(df, rules)
        passed = F.col("error_code").isNull() if keep is None else F.col("error_code").isNull() & keep
        return Checked(marked.filter(passed).drop("error_code", "error"), marked.filter("error_code is not null"))
    rows = refuse(df, code.isNotNull(), F.concat_ws(": ", code, message), keep)
    return Checked(rows, df.withColumns({"error_code": code, "error": message}).filter(F.lit(False)))
