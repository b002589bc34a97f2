"""Data-quality gates: each gives one row (check, value, passed) and never collects data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(rows: DataFrame, name: str, value: Column, passed) -> DataFrame:
    """One aggregate ``value`` of ``rows`` and whether it satisfies ``passed`` (a function of the value's column)."""
    return rows.agg(value.cast("double").alias("value")).select(F.lit(name).alias("check"), "value", F.coalesce(passed(F.col("value")), F.lit(False)).alias("passed"))


def unique_key(rows: DataFrame, keys: Sequence[str], name: str = "unique key") -> DataFrame:
    again = rows.groupBy(*keys).count().where("count > 1")
    return gate(again, name, F.count("*"), lambda v: v == 0)


def not_all_null(rows: DataFrame, column: str) -> DataFrame:
    return gate(rows, f"{column} has values", F.count(column), lambda v: v > 0)


def known_members(rows: DataFrame, dimension: DataFrame, key: Sequence[str], name: str = "known members") -> DataFrame:
    unknown = rows.select(*key).distinct().join(dimension.select(*key), list(key), "left_anti")
    return gate(unknown, name, F.count("*"), lambda v: v == 0)


def share_at_least(rows: DataFrame, condition: Column, least: float, name: str) -> DataFrame:
    return gate(rows, name, F.avg(condition.cast("double")), lambda v: v >= least)


def band(rows: DataFrame, condition: Column, low: float, high: float, name: str) -> DataFrame:
    return gate(rows, name, F.avg(condition.cast("double")), lambda v: (v >= low) & (v <= high))


def non_constant(rows: DataFrame, column: str) -> DataFrame:
    return gate(rows, f"{column} varies", F.stddev_samp(column), lambda v: v > 0)


def no_shrink(old: DataFrame, new: DataFrame, name: str = "no shrink") -> DataFrame:
    before = old.agg(F.count("*").alias("a")).crossJoin(new.agg(F.count("*").alias("b")))
    return gate(before, name, F.max(F.col("b") - F.col("a")), lambda v: v >= 0)


def expected_counts(rows: DataFrame, by: Sequence[str], expected: DataFrame, name: str = "expected counts") -> DataFrame:
    """``expected`` has the columns ``by`` and ``n``; every group must have that many rows."""
    have = rows.groupBy(*by).agg(F.count("*").alias("have"))
    wrong = expected.join(have, list(by), "full").where("n is distinct from have")
    return gate(wrong, name, F.count("*"), lambda v: v == 0)


def columns_present(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(rows.columns))
    return rows.limit(0).agg(F.count("*").alias("_n")).select(
        F.lit("required columns").alias("check"), F.lit(float(len(missing))).alias("value"), F.lit(not missing).alias("passed")
    )


def fresh(rows: DataFrame, day: Column, today: Column, most: int, name: str = "fresh") -> DataFrame:
    """The newest ``day`` lies at most ``most`` days before ``today``; an empty table fails."""
    return gate(rows, name, F.datediff(today, F.max(day)), lambda v: v <= most)


def reconciles(rows: DataFrame, a: Column, b: Column, name: str) -> DataFrame:
    """No row in which two totals differ."""
    return gate(rows, name, F.count(F.when(~a.eqNullSafe(b), 1)), lambda v: v == 0)


def changed_rows(before: DataFrame, after: DataFrame, keys: Sequence[str], numbers: Sequence[str], others: Sequence[str] = (), tolerance: float = 1e-6) -> DataFrame:
    """One row (rows, changed): the rows that two builds share by ``keys``, and those of which a value differs. Numbers may
    differ by ``tolerance``; null equals null only."""
    twin = after.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*numbers, *others)])
    same = F.lit(True)
    for c in numbers:
        near = F.abs(F.col(c).cast("double") - F.col(f"_{c}").cast("double")) <= tolerance
        same = same & F.coalesce(near, F.col(c).isNull() & F.col(f"_{c}").isNull())
    for c in others:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return before.join(twin, list(keys)).agg(F.count("*").alias("rows"), F.count(F.when(~same, 1)).alias("changed"))
