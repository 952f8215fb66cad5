"""Joins that the planner can't make from one condition: disjunctions, fallbacks, ranges, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def either_key_join(left: DataFrame, right: DataFrame, first: str, second: str, right_key: str, on: list[str], values: list[str]) -> DataFrame:
    """Left join on (first = key or second = key) and the `on` columns, as two equi joins; the match by `first` wins as a whole.

    `right` has one row for each key and `on` columns. No left row is multiplied.
    """
    record = F.struct(*values)
    by_first = right.select(F.col(right_key).alias(first), *on, record.alias("__a"))
    by_second = right.select(F.col(right_key).alias(second), *on, record.alias("__b"))
    joined = left.join(by_first, [first, *on], "left").join(by_second, [second, *on], "left")
    chosen = F.coalesce(F.col("__a"), F.col("__b"))
    return joined.select(*left.columns, *[chosen[v].alias(v) for v in values])


def last_of_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last in the order."""
    by = Window.partitionBy(*keys).orderBy(*[F.col(o).desc_nulls_last() for o in order])
    return df.withColumn("__k", F.row_number().over(by)).where("__k = 1").drop("__k")


def fallback_lookup(left: DataFrame, right: DataFrame, keys: list[str], varied: str, fallback: str, values: list[str]) -> DataFrame:
    """Record of `right` under the row's keys, or else under `fallback` in place of column `varied`, or else nulls.

    `right` has one row for each key. The fallback is for the record, not for single fields.
    """
    record = F.struct(*values)
    own = right.select(*keys, record.alias("__a"))
    rest = [k for k in keys if k != varied]
    other = right.where(F.col(varied) == fallback).select(*rest, record.alias("__b"))
    joined = left.join(own, keys, "left").join(other, rest, "left")
    chosen = F.coalesce(F.col("__a"), F.col("__b"))
    return joined.select(*left.columns, *[chosen[v].alias(v) for v in values])


def mapped(df: DataFrame, mapping: DataFrame, key: Column, name: str, fallback: Column) -> DataFrame:
    """Adds what a small lookup (key, value) says of a key, or the fallback.

    The lookup is a fixed list of codes, so it is broadcast.
    """
    own = mapping.select(F.col(mapping.columns[0]).alias("__key"), F.col(mapping.columns[1]).alias("__value"))
    return df.join(F.broadcast(own), key == F.col("__key"), "left").withColumn(name, F.coalesce("__value", fallback)).drop("__key", "__value")


def excluded(df: DataFrame, ids: DataFrame | None, names: DataFrame | None, id_column: str, name_column: str) -> DataFrame:
    """Without rows whose id or lower-cased name is on a list. Null ids and names are on no list."""
    if ids is not None:
        df = df.join(ids.select(F.col(ids.columns[0]).alias(id_column)), id_column, "left_anti")
    if names is not None:
        listed = names.select(F.lower(F.col(names.columns[0])).alias("__name"))
        df = df.join(listed, F.lower(F.col(name_column)) == F.col("__name"), "left_anti")
    return df


def seasons_of_range(df: DataFrame, start: str, end: str, season: str = "season") -> DataFrame:
    """One row for each year of a short range: a range join becomes an equi join."""
    return df.where(F.col(start) <= F.col(end)).withColumn(season, F.explode(F.sequence(F.col(start), F.col(end))))


def dyadic_cover(first: Column, last: Column) -> Column:
    """The fewest aligned blocks that make up the whole numbers from `first` to `last`: an array of (level, block).

    A block of a level has 2**level numbers. There are at most two blocks a level, 40 for a million numbers; none if last < first or a bound is null.
    """
    block = lambda level, at: F.struct(level.cast("int").alias("level"), at.alias("block"))
    empty = F.array().cast("array<struct<level: int, block: bigint>>")
    start = F.struct(first.cast("long").alias("lo"), (last.cast("long") + 1).alias("hi"), empty.alias("out"))
    odd = lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1

    def climb(acc: Column, level: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        taken = lambda test, at: F.when((lo < hi) & test, F.array(block(level, at))).otherwise(empty)
        up = F.when(odd(lo), lo + 1).otherwise(lo)
        down = F.when(odd(hi), hi - 1).otherwise(hi)
        out = F.concat(acc["out"], taken(odd(lo), lo), taken(odd(hi) & (hi - 1 >= up), hi - 1))
        return F.when(lo >= hi, acc).otherwise(F.struct(F.shiftright(up, 1).alias("lo"), F.shiftright(down, 1).alias("hi"), out.alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), start, climb, lambda acc: acc["out"])


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, first: str, last: str) -> DataFrame:
    """Inner join where `at` lies from `first` to `last` (whole numbers, both included) and the `on` columns are equal, as one equi join.

    An interval becomes a row for each block of its dyadic cover, a point one for each level that any cover has, 63 at most; they
    meet in exactly one block. Ranges may be long: a million steps make 40 rows at most. A null bound is open: it reaches to the
    least or greatest point. A null point is in no interval. Columns but `on` must have different names on both sides.
    """
    reach = points.agg(F.min(at).cast("long").alias("lo"), F.max(at).cast("long").alias("hi"))
    low, high = F.coalesce(F.col(first).cast("long"), reach.select("lo").scalar()), F.coalesce(F.col(last).cast("long"), reach.select("hi").scalar())
    bounded = intervals.withColumn("__low", low).withColumn("__high", high)
    covered = bounded.withColumn("__b", F.explode(dyadic_cover(F.col("__low"), F.col("__high")))).drop("__low", "__high")
    covered = covered.select(*intervals.columns, F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block"))
    levels = covered.agg(F.collect_set("__level")).scalar()
    leveled = points.where(F.col(at).isNotNull()).withColumn("__levels", levels).withColumn("__level", F.explode("__levels")).drop("__levels")
    leveled = leveled.withColumn("__block", F.expr(f"shiftright(cast(`{at}` as bigint), __level)"))
    return leveled.join(covered, [*on, "__level", "__block"]).drop("__level", "__block")


def list_members(df: DataFrame, listed: str, member: str, separator: str = ",") -> DataFrame:
    """One row for each member of a delimited list, without white space around it."""
    parts = F.filter(F.transform(F.split(F.col(listed), separator), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn(member, F.explode(parts))
