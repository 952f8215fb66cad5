"""Grouped aggregates over any table; columns are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.cells import exact_percentiles, same_keys


def sum_of(value: Column, scale: int | None = None) -> Column:
    """Sum as a double. With a scale, of values rounded to so many decimals, which doesn't depend on the order of rows; they must be below 10**(30 - scale)."""
    return F.sum(value) if scale is None else F.sum(value.cast(f"decimal(30,{scale})")).cast("double")


def sum_avg_count(df: DataFrame, keys: list[str], value: str, names: tuple[str, str, str] = ("total_points", "avg_points", "games"), scale: int | None = None) -> DataFrame:
    """Sum, mean and count of a value by key. Null values count in none; a group of nulls has null sum and mean and count 0. `scale` as in sum_of."""
    total = sum_of(F.col(value), scale)
    return df.groupBy(*keys).agg(total.alias(names[0]), F.try_divide(total, F.count(value)).alias(names[1]), F.count(value).alias(names[2]))


def share_over(df: DataFrame, keys: list[str], value: str, threshold: float, names: tuple[str, str, str] = ("high", "total", "pct")) -> DataFrame:
    """Rows whose value reaches a threshold, all rows, and the percentage to three digits. A null value doesn't reach it but counts."""
    high = F.sum(F.when(F.col(value) >= threshold, 1).otherwise(0)).cast("long")
    grouped = df.groupBy(*keys).agg(high.alias(names[0]), F.count(F.lit(1)).alias(names[1]))
    return grouped.withColumn(names[2], F.round(100.0 * F.col(names[0]) / F.col(names[1]), 3))


def first_known(df: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """For each key the first non-null of each value, in the order of a column."""
    picked = [F.min_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*picked)


def count_where(df: DataFrame, keys: list[str], conditions: list[Column], name: str) -> DataFrame:
    """Rows by key that meet all conditions; keys without any are left out."""
    for c in conditions:
        df = df.where(c)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def win_share(df: DataFrame, keys: list[str], own: str, other: str, digits: int = 4) -> DataFrame:
    """Part of rows with own > other (a null counts as no win), mean difference, and rows."""
    won = F.avg(F.when(F.col(own) > F.col(other), 1.0).otherwise(0.0))
    return df.groupBy(*keys).agg(F.round(won, digits).alias("win_pct"), F.round(F.avg(F.col(own) - F.col(other)), digits).alias("avg_margin"), F.count(F.lit(1)).alias("games"))


def rounded_mean(df: DataFrame, keys: list[str], value: str, name: str, count: str, scale: int | None = None) -> DataFrame:
    """Mean of the known values, rounded to an integer (null beyond 32 bits), and their number. `scale` as in sum_of."""
    mean = sum_of(F.col(value), scale) / F.count(value)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.round(mean).try_cast("int").alias(name), F.count(value).alias(count))


def latest_by(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The row of each key that is last in an order."""
    row = F.max_by(F.struct(*columns), F.struct(*order)).alias("r")
    return df.groupBy(key).agg(row).select(key, "r.*")


def statistics(df: DataFrame, keys: list[str], value: str, digits: int = 6, means: tuple[str, ...] = ()) -> DataFrame:
    """mean, median, p95, min, max, std, count and cv of a value; cv is null for a single value or mean 0. Also the `means` of other columns, as `<name>_mean`, not rounded.

    Median and p95 are exact, by ranks: see `exact_percentiles`.
    """
    v = F.col(value)
    std = F.when(F.count(v) > 1, F.stddev_samp(v))
    stats = {"mean": F.avg(v), "min": F.min(v), "max": F.max(v), "std": std, "cv": F.try_divide(std, F.avg(v))}
    others = [F.avg(m).alias(f"{m}_mean") for m in means]
    table = df.groupBy(*keys).agg(*[F.round(c, digits).alias(k) for k, c in stats.items()], F.count(v).alias("count"), *others)
    names = {k: f"__p{i}" for i, k in enumerate(keys)}
    ranks = exact_percentiles(df, keys, value, {"median": 0.5, "p95": 0.95}).withColumnsRenamed(names)
    joined = table.join(ranks, same_keys(names), "left").withColumns({c: F.round(c, digits) for c in ("median", "p95")})
    return joined.select(*keys, "mean", "median", "p95", "min", "max", "std", "cv", "count", *[f"{m}_mean" for m in means])


def pivoted(df: DataFrame, key: str, column: str, values: list[str], value: Column, complete: bool = True) -> DataFrame:
    """One column for each of the given values; keys that lack one are dropped if `complete`."""
    out = df.groupBy(key).pivot(column, values).agg(value)
    return out.dropna(subset=values) if complete else out
