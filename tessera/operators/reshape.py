"""Rows out of paired records and ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_sides(df: DataFrame, common: dict[str, Column], sides: dict[str, dict[str, Column]], tag: str) -> DataFrame:
    """One row for each side of a record, in one scan: `common` columns, `tag` (the side's name), and the side's own."""
    rows = [F.struct(F.lit(name).alias(tag), *[c.alias(k) for k, c in own.items()]) for name, own in sides.items()]
    return df.select(*[c.alias(k) for k, c in common.items()], F.inline(F.array(*rows)))


def ordered_members(df: DataFrame, listed: Column, member: str, ordinal: str, size: str) -> DataFrame:
    """One row for each member of an array: the member, its ordinal from 1, and the array's size. Other columns are kept."""
    out = df.withColumn("__list", listed).where(F.size("__list") > 0)
    return out.select(*df.columns, F.size("__list").alias(size), F.posexplode("__list").alias("__at", member)).withColumn(ordinal, F.col("__at") + 1).drop("__at")


def even_segment(start: Column, end: Column, ordinal: Column, n: Column) -> tuple[Column, Column]:
    """First and last year of the ordinal-th of n even segments of a tenure; a segment may be empty (last < first)."""
    length = (end - start + 1).cast("long")
    first = start + F.floor((ordinal - 1) * length / n)
    last = start + F.floor(ordinal * length / n) - 1
    return first.cast("int"), last.cast("int")
