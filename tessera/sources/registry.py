"""Sources under logical names: files of several formats, JDBC tables, fallbacks, and named views."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.scalars import typed
from tessera.sources.schemas import SCHEMAS

Reader = Callable[[SparkSession], DataFrame]


def json_lines(path: str, schema: StructType) -> Reader:
    """Documents, one a line; blank lines are skipped and what doesn't fit a type is null."""
    return lambda spark: spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def parquet(path: str, schema: StructType | None = None) -> Reader:
    """With a schema, partition columns keep their types (a season stays text)."""
    return lambda spark: (spark.read.schema(schema) if schema else spark.read).parquet(path)


def delimited(path: str, schema: StructType, separator: str = "\t") -> Reader:
    """Delimited text without a header, columns in order of the schema; a field that doesn't parse is null."""
    return lambda spark: spark.read.schema(schema).option("sep", separator).option("mode", "PERMISSIVE").csv(path)


def headed_csv(path: str, schema: StructType) -> Reader:
    """CSV with a header, columns by name; a column that the file lacks is null, and numbers are read tolerantly."""

    def read(spark: SparkSession) -> DataFrame:
        raw = spark.read.option("header", True).csv(path)
        have = {c.lower(): c for c in raw.columns}
        named = [F.col(f"`{have[f.name.lower()]}`").alias(f.name) if f.name.lower() in have else F.lit(None).cast("string").alias(f.name) for f in schema.fields]
        return raw.select(*named).select(*typed(schema))

    return read


def of_format(kind: str, path: str, schema: StructType) -> Reader:
    """The same logical table as parquet, tsv, csv (with a header) or json."""
    readers = {"parquet": lambda: parquet(path, schema), "tsv": lambda: delimited(path, schema), "csv": lambda: headed_csv(path, schema), "json": lambda: json_lines(path, schema)}
    if kind not in readers:
        raise ValueError(f"format {kind!r} is none of {sorted(readers)}")
    return readers[kind]()


def jdbc(table: str, url: str | None = None, user: str | None = None, password: str | None = None, driver: str = "org.postgresql.Driver", **partitioning: str | int) -> Reader:
    """A database table. Url, user and password default to JDBC_URL, JDBC_USER and JDBC_PASSWORD of the environment.

    `partitioning`: Spark's options for a parallel read, such as partitionColumn, lowerBound, upperBound, numPartitions.
    """
    options = {"url": url or os.environ.get("JDBC_URL", ""), "dbtable": table, "user": user or os.environ.get("JDBC_USER", ""), "password": password or os.environ.get("JDBC_PASSWORD", ""), "driver": driver}
    return lambda spark: spark.read.format("jdbc").options(**options, **partitioning).load()


def first_available(*readers: Reader) -> Reader:
    """The first reader that gives a table; errors of those before it are told if none does."""

    def read(spark: SparkSession) -> DataFrame:
        errors = []
        for r in readers:
            try:
                return r(spark)
            except Exception as e:  # noqa: BLE001  whatever a source that can't be reached raises
                errors.append(f"{type(e).__name__}: {str(e)[:200]}")
        raise RuntimeError("no source is available: " + "; ".join(errors))

    return read


@dataclass
class Registry:
    """Readers by logical name, of one or several systems, and views over them in order."""

    readers: dict[str, Reader] = field(default_factory=dict)
    views: dict[str, Callable[[Registry, SparkSession], DataFrame]] = field(default_factory=dict)

    def source(self, name: str, reader: Reader) -> None:
        self.readers[name] = reader

    def folder(self, path: str, kind: str = "json") -> None:
        """All known tables as files of one format in a folder."""
        for name, schema in SCHEMAS.items():
            self.source(name, of_format(kind, f"{path}/{name}", schema))

    def view(self, name: str, build: Callable[[Registry, SparkSession], DataFrame]) -> None:
        self.views[name] = build

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return self.views[name](self, spark) if name in self.views else self.readers[name](spark)

    def publish(self, spark: SparkSession, prefix: str = "") -> list[str]:
        """Creates or replaces a temporary view for every view, in order; gives their names."""
        for name in self.views:
            self.table(spark, name).createOrReplaceTempView(prefix + name)
        return [prefix + name for name in self.views]


def trimmed(df: DataFrame, columns: list[str], fill: Column | None = None) -> DataFrame:
    """Some columns of a wide table, in order; one that it lacks is `fill`, null if not given."""
    missing = F.lit(None).cast("string") if fill is None else fill
    return df.select(*[F.col(c) if c in df.columns else missing.alias(c) for c in columns])
