"""Ranks, shares, standings and pages; no window here has a whole table or a group of any size to itself, see `cells`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.cells import CELL, last_streaks, same_keys, with_cells


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; each task keeps n of a key before the shuffle."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(by)).where(F.col(rank) <= n)


def with_group_total(df: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Adds aggregates of each row's group, null keys being keys like any other.

    They are aggregated in every task first and joined to the rows, so a group of any size is split like any skewed join.
    """
    names = {k: f"__k{i}" for i, k in enumerate(keys)}
    sums = df.groupBy(*[F.col(k).alias(n) for k, n in names.items()]).agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(sums, same_keys(names), "left").drop(*names.values())


def share_of_group(df: DataFrame, keys: list[str], value: str, name: str, digits: int = 1) -> DataFrame:
    """A value's percentage of its group's sum; null where that is 0."""
    share = F.round(F.try_divide(100.0 * F.col(value), F.col("__total")), digits)
    return with_group_total(df, keys, {"__total": F.sum(value)}).withColumn(name, share).drop("__total")


def page(df: DataFrame, order: list[Column], number: int, size: int, total: str | None = None) -> DataFrame:
    """Rows of one page (from 1). The sort stops at the page's end, so no more rows than that are kept anywhere.

    With `total` a column of that name has the number of all rows, from a count of its own. A page after the last one is empty.
    """
    rows = df.orderBy(*order).limit(number * size).offset((number - 1) * size)
    return rows if total is None else rows.withColumn(total, df.agg(F.count(F.lit(1))).scalar())


def page_by_rank(df: DataFrame, order: list[str | Column], number: int, size: int, rank: str = "rank", total: str | None = None, n_cells: int | None = None) -> DataFrame:
    """Rows of one page (from 1) of any depth, with their `rank` from 1; only the cells of the order that the page touches are sorted.

    Counts of all cells tell which ranks each holds; there are at most `n_cells` of them, so they are broadcast. `order`: ascending
    keys that tell rows apart (`cells.descending` turns a number around). `total` as in `page`.
    """
    first, last = (number - 1) * size, number * size
    rows = with_cells(df, order, n_cells)
    cells = rows.groupBy(CELL).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of a row a cell
    cells = cells.withColumn("__before", before)
    touched = cells.where((F.col("__before") < last) & (F.col("__before") + F.col("__n") > first)).select(CELL, "__before")
    local = F.row_number().over(Window.partitionBy(CELL).orderBy(*order))
    found = rows.join(F.broadcast(touched), CELL).withColumn(rank, F.col("__before") + local).where((F.col(rank) > first) & (F.col(rank) <= last))
    found = found.select(*df.columns, rank).orderBy(rank)
    return found if total is None else found.withColumn(total, df.agg(F.count(F.lit(1))).scalar())


def standings(results: DataFrame, group: str, team: str, order: list[str], won: str, cell: Column | None = None) -> DataFrame:
    """w, l, games behind the leader and the current streak (`W3`, `L1`) of each team in a group.

    `results`: one row for each team and game, `won` 1 or 0. Behind: ((leader's w - w) + (l - leader's l)) / 2, the leader
    being the team with the greatest w - l. A team's games are folded by cells of the order, or by `cell`, a column that grows with it.
    """
    table = last_streaks(results, [group, team], order, won, {"w": F.col(won)}, cell).withColumn("l", F.col("n") - F.col("w"))
    leader = F.max(F.col("w") - F.col("l")).over(Window.partitionBy(group))  # a row a team
    streak = F.concat(F.when(F.col(won) == 1, "W").otherwise("L"), F.col("streak").cast("string"))
    return table.select(group, team, F.col("w").cast("long").alias("w"), F.col("l").cast("long").alias("l"), ((leader - (F.col("w") - F.col("l"))) / 2.0).alias("gb"), streak.alias("streak"))
