"""Data quality: lost rows, duplicate and null keys, differences between tables, required columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lowered(df: DataFrame) -> DataFrame:
    """Column names in lower case."""
    return df.toDF(*[c.lower() for c in df.columns])


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    have = {c.lower() for c in df.columns}
    return [c for c in required if c.lower() not in have]


def duplicate_keys(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Keys that more than one row has, and how many; null is a key like any other."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def key_report(name: str, base: DataFrame | None, view: DataFrame, keys: list[str]) -> DataFrame:
    """One row: view_name, base_distinct, gav_rows, lost_vs_base (may be negative), gav_duplicates, gav_null_keys.

    Rows with a null key are no distinct key of the base. Without a base its figures are null.
    """
    any_null = F.lit(False)
    for k in keys:
        any_null |= F.col(k).isNull()
    grouped = view.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    seen = grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("gav_rows"),
        F.count(F.when(F.col("n") > 1, 1)).alias("gav_duplicates"),
        F.coalesce(F.sum(F.when(any_null, F.col("n")).otherwise(0)), F.lit(0)).cast("long").alias("gav_null_keys"),
    )
    if base is None:
        seen = seen.withColumn("base_distinct", F.lit(None).cast("long"))
    else:
        seen = seen.crossJoin(base.dropna(subset=keys).select(*keys).distinct().agg(F.count(F.lit(1)).alias("base_distinct")))  # one row each
    lost = F.col("base_distinct") - F.col("gav_rows")
    return seen.select(F.lit(name).alias("view_name"), "base_distinct", "gav_rows", lost.alias("lost_vs_base"), "gav_duplicates", "gav_null_keys")


def require_unique(df: DataFrame, keys: list[str]) -> None:
    """Raises if two rows share a key."""
    found = duplicate_keys(df, keys).limit(5).collect()
    if found:
        raise ValueError(f"keys {keys} are not unique: {found}")


def _digested(df: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """Adds a row's bucket and two hashes. A null has a hash of its own; maps can't be hashed."""
    marked = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    first, second = F.xxhash64(F.lit(1), *marked), F.xxhash64(F.lit(2), *marked)
    return df.withColumns({"__bucket": F.pmod(F.xxhash64(F.lit(3), *marked), F.lit(buckets)).cast("int"), "__x": first, "__y": F.shiftrightunsigned(second, 28)})


def differing_buckets(a: DataFrame, b: DataFrame, buckets: int = 4096) -> DataFrame:
    """(__bucket): of both tables' rows dealt by a hash, the buckets whose counts, sums or exclusive ors of hashes differ.

    Every task sums up its rows first, so only digests are shuffled, at most one for each task and bucket. Tables that differ in a bucket are
    taken for equal there with a chance of about 2**-100.
    """
    side = lambda df, sign: _digested(df, a.columns, buckets).select("__bucket", "__x", (sign * F.col("__y")).alias("__y"), F.lit(sign).cast("long").alias("__n"))
    sums = side(a, 1).unionByName(side(b, -1)).groupBy("__bucket").agg(F.bit_xor("__x").alias("x"), F.sum("__y").alias("y"), F.sum("__n").alias("n"))
    return sums.where("x != 0 or y != 0 or n != 0").select("__bucket")


def difference_by_digest(a: DataFrame, b: DataFrame, buckets: int = 4096) -> DataFrame:
    """As `difference`, for tables that mostly agree: rows are shuffled only of the buckets whose digests differ, none if there are none.

    The list of buckets has at most `buckets` numbers, so it is broadcast.
    """
    b = b.select(*a.columns)
    found = F.broadcast(differing_buckets(a, b, buckets))
    kept = lambda df: _digested(df, a.columns, buckets).join(found, "__bucket", "left_semi").select(*a.columns)
    return difference(kept(a), kept(b))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, counting repeats, with `side` a or b. Columns go by name.

    Both are counted in one aggregation, and a row comes as often as its counts differ.
    """
    both = a.withColumn("__n", F.lit(1)).unionByName(b.withColumn("__n", F.lit(-1)))
    net = both.groupBy(*a.columns).agg(F.sum("__n").alias("__n")).where("__n != 0")
    side = F.when(F.col("__n") > 0, "a").otherwise("b")
    return net.withColumn("side", side).withColumn("__k", F.explode(F.sequence(F.lit(1), F.abs("__n").cast("int")))).drop("__k", "__n")
