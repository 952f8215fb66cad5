"""Helpers that several operators need: a folder all executors see, and ranks without one big window."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster names in spark.checkpoint.dir.

    Where none is set a local master gets a folder of its own; on a cluster that is an error, since no local folder is shared there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.gettempdir() + f"/tessera-{spark.sparkContext.applicationId}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again, so that its lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables that only intermediate steps read; `drop` removes them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Call it when nothing that is still to run reads these tables."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths.clear()
        self.release()

    def release(self) -> None:
        """Asks the driver's JVM to collect its garbage: Spark removes the shuffle files of DataFrames that are gone only when it does."""
        self.spark.sparkContext._jvm.System.gc()


_BLOCK = 1 << 16  #: bits of a bitmap that are made in one group


def may_be_among(ids: DataFrame, cells_each: int = 16, most_bits: int = 26) -> Callable[[Column], Column]:
    """A test whether a long may be among `ids` (one column without nulls, cheap to read twice): true for all that are, and for few others.

    It reads a broadcast bitmap of `cells_each` cells for each id, at most 2**most_bits (8 MB); beyond, more of the others are let pass.
    """
    spark = ids.sparkSession
    bits = min(most_bits, max(16, (cells_each * ids.count()).bit_length()))
    place = lambda c: F.xxhash64(c).bitwiseAND((1 << bits) - 1)

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(_BLOCK, bool)
        own[rows["cell"].to_numpy() % _BLOCK] = True
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    cells = ids.select(place(F.col(ids.columns[0])).alias("cell")).distinct().withColumn("block", F.shiftright("cell", _BLOCK.bit_length() - 1))
    out = np.zeros((1 << bits) // 8, np.uint8).reshape(-1, _BLOCK // 8)
    for r in cells.groupBy("block").applyInPandas(block, "block long, bits binary").collect():  # at most 2**most_bits bits in all
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    held = spark.sparkContext.broadcast(out.ravel())

    @F.arrow_udf("boolean")
    def among(cells: pa.Array) -> pa.Array:
        at = cells.to_numpy(zero_copy_only=False)
        return pa.array((held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return lambda c: among(place(c))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose `key`, a long, is not among `gone` (one column of that name). Only the rows whose key may be there are shuffled."""
    among = may_be_among(gone)
    passed, asked = rows.where(~among(F.col(key))), rows.where(among(F.col(key)))
    return passed.unionByName(asked.join(gone, key, "left_anti").select(*rows.columns))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from all learning: crc32 of its id as text, mod 4, is 2 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def in_training(doc_id: Column) -> Column:
    """Whether labels of this document may be learnt; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def ranked(df: DataFrame, group: list[str], order: list[str], size: Column, rank: str, n_cells: int) -> DataFrame:
    """Adds `rank`: the sum of `size` over the rows before this one in its group.

    A group may hold most rows, so no window spans it: rows are dealt to `n_cells` cells by a hash of
    their order columns, summed within a cell, and shifted by the totals of the cells before (a table of
    at most groups x n_cells rows). The order is a fixed permutation: cell, then the order columns.
    Nulls in group or order columns are values like any other; equal rows get ranks in any order.
    """
    cell, part, base = "__cell", "__size", "__base"
    rows = df.withColumn(cell, F.pmod(F.xxhash64(F.lit("cell"), *order), F.lit(n_cells))).withColumn(part, size)
    keys = [f"__g{i}" for i in range(len(group))]
    totals = rows.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col(cell).alias("__c")).agg(F.sum(part).alias("__t"))
    over = Window.partitionBy(*keys or [F.lit(0)]).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn(base, F.coalesce(F.sum("__t").over(over), F.lit(0))).drop("__t")
    within = Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum(part).over(within), F.lit(0)))
    match = F.col(cell) == F.col("__c")
    for g, k in zip(group, keys):
        match &= F.col(g).eqNullSafe(F.col(k))
    return rows.join(bases, match, "left").withColumn(rank, F.col("__before") + F.col(base)).drop(cell, part, "__before", "__c", base, *keys)
