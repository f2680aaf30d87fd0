"""Ordered, formatted and plot-ready tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import ordered_rank


def ordered(df: DataFrame, orders: dict[str, Sequence[str]]) -> DataFrame:
    """Sorted by preferred orders, column by column; values not listed come last by name."""
    keys = [k for name, order in orders.items() for k in (ordered_rank(F.col(name), order), F.col(name))]
    return df.orderBy(*keys)


def percent(column: str, digits: int = 1):
    return F.format_string(f"%.{digits}f%%", 100 * F.col(column))


def blank_repeats(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """A label only where it differs from the row above; for small presentation tables."""
    above = F.lag(column).over(W.partitionBy(F.lit(0)).orderBy(*order))
    return df.withColumn(column, F.when(above.eqNullSafe(F.col(column)), "").otherwise(F.col(column)))


def strict_pivot(df: DataFrame, rows: str, columns: str, value: str, order: Sequence[str]) -> DataFrame:
    """Cells by row and column; a cell with two values is an error."""
    lone = F.when(F.count(value) > 1, F.raise_error(F.lit("a cell has two values")).cast("double")).otherwise(F.first(value))
    cells = df.groupBy(rows, columns).agg(lone.alias(value))
    return cells.groupBy(rows).pivot(columns, list(order)).agg(F.first(value))


def with_average(wide: DataFrame, rows: str, label: str = "Average") -> DataFrame:
    """A last row with each column's mean over known cells."""
    columns = [c for c in wide.columns if c != rows]
    means = wide.agg(*[F.avg(c).alias(c) for c in columns]).select(F.lit(label).alias(rows), *columns)
    return wide.unionByName(means)


def most_common(df: DataFrame, column: str, n: int = 1) -> DataFrame:
    return df.groupBy(column).count().orderBy(F.desc("count"), column).limit(n)


def framing_table(summary: DataFrame, value: str) -> DataFrame:
    """Compactors by the four framings."""
    label = F.concat_ws(" ", F.when(F.col("explicit"), "explicit").otherwise("implicit"), F.when(F.col("hard"), "hard").otherwise("soft"))
    return summary.withColumn("framing", label).groupBy("dataset", "compactor").pivot("framing", ["explicit hard", "explicit soft", "implicit hard", "implicit soft"]).agg(F.avg(value))


def plot_table(df: DataFrame, x: str, y: str, series: str | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """What a figure shows: x, y, its series and interval."""
    return df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), (F.col(series) if series else F.lit("all")).alias("series"), *[F.col(c).cast("double").alias(n) for c, n in ((low, "low"), (high, "high")) if c])
