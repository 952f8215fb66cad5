"""Statistics of benchmark logs: (seq, tool, query, wall_ms, rows, fmt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import ratio_or_infinity, round_scaled
from tessera.operators.aggregates import pivoted, statistics
from tessera.operators.cells import exact_percentiles, with_previous


def run_statistics(log: DataFrame, keys: list[str], wall: str = "wall_ms", rows: str = "rows") -> DataFrame:
    """Statistics of the wall time by key, mean rows, and throughput: mean rows a mean second."""
    spent = log.withColumn("__wall", F.col(wall))
    stats = statistics(spent, keys, wall, means=(rows, "__wall"))
    throughput = F.round(F.try_divide(F.col(f"{rows}_mean"), F.col("__wall_mean") / 1000.0), 6)
    return stats.withColumn("throughput", throughput).withColumn("rows_mean", F.round(f"{rows}_mean", 6)).drop("__wall_mean", *({f"{rows}_mean"} - {"rows_mean"}))


def speedup(log: DataFrame, key: str, column: str, slow: str, fast: str, wall: str = "wall_ms") -> DataFrame:
    """Ratio slow / fast of mean and of median times for each key that has both; medians by ranks."""
    means = pivoted(log, key, column, [slow, fast], F.avg(wall)).select(key, F.try_divide(F.col(slow), F.col(fast)).alias("speedup_mean"))
    medians = exact_percentiles(log.where(F.col(column).isin(slow, fast)), [key, column], wall, {"median": 0.5})
    medians = pivoted(medians, key, column, [slow, fast], F.max("median")).select(key, F.try_divide(F.col(slow), F.col(fast)).alias("speedup_median"))
    return means.join(medians, key).select(key, F.round("speedup_mean", 6).alias("speedup_mean"), F.round("speedup_median", 6).alias("speedup_median"))


def overall_speedup(log: DataFrame, key: str, column: str, slow: str, fast: str, wall: str = "wall_ms") -> DataFrame:
    """Sum of the slow tool's means over the sum of the fast tool's, over keys that have both."""
    means = pivoted(log, key, column, [slow, fast], F.avg(wall))
    return means.agg(F.round(F.try_divide(F.sum(slow), F.sum(fast)), 6).alias("overall"))


def throughput_trend(log: DataFrame, keys: list[str], order: str, rows: Column, wall: Column) -> DataFrame:
    """Each run's index and throughput, and its change from the run before; a tool's runs are cut into cells of their order.

    A run that took no time has an infinite throughput, or NaN without rows.
    """
    own = log.withColumn("throughput", round_scaled(ratio_or_infinity(rows, wall / 1000.0), 6))
    own = with_previous(own, keys, [order], {"__then": F.col("throughput")}, number="run")
    return own.withColumn("change", round_scaled(F.col("throughput") - F.col("__then"), 6)).drop("__then")
