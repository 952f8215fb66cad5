"""Sinks: files of several formats, logs, snapshots of views. Writes go through Spark to whatever file system a path names."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Overwrites; `by` partition columns. Rows of a partition meet in few tasks first, so that files aren't many and small."""
    out = df.hint("rebalance", *by) if by else df  # a large partition is split among tasks
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_tsv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Tab-separated text without a header. `single_file` is for small tables only: all rows go through one task."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("sep", "\t").option("emptyValue", "").csv(path)


def export_view(spark: SparkSession, view: str, path: str, separator: str = "\t") -> None:
    """A registered view as delimited text."""
    spark.table(view).write.mode("overwrite").option("sep", separator).option("nullValue", r"\N").csv(path)


def export_json(df: DataFrame, path: str, order: list[Column], most: int = 5000) -> None:
    """The first rows in an order as one document {rows, count}; bounded, so that they fit in one."""
    rows = df.orderBy(*order).limit(most)
    document = rows.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("rows"), F.count(F.lit(1)).alias("count"))
    document.coalesce(1).write.mode("overwrite").json(path)


def append_log(spark: SparkSession, path: str, record: dict[str, str | int | float | None]) -> None:
    """One record of a run, as a line of JSON in a new file of the folder."""
    spark.createDataFrame([record]).coalesce(1).write.mode("append").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds anything, in any file system that Spark reads; not whether a job that wrote there has ended, see `Snapshots`."""
    from pyspark.errors import AnalysisException

    try:
        return not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").isEmpty()
    except AnalysisException:
        return False


class Snapshots:
    """Whole versions of a table below one path, and a pointer to the current one.

    A version is written to a folder of its own, and only when its job has ended is a pointer to it, which holds its schema, put in place, by renaming a
    finished file. So a reader sees a whole version at any time: a job that is lost leaves the version before,
    and a plan that reads the current version may itself make the next one. Old versions stay readable until `prune`. Works in any
    file system that Spark writes to; of two writers at once the later pointer wins, and both versions are whole.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Versions that pointers name, oldest first; the last is current."""
        if not self._fs.exists(self._at("pointers")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("pointers"))]
        return [n.split(".", 1)[1] for n in sorted(names) if not n.startswith(("_", "."))]

    def write(self, df: DataFrame, by: list[str] | None = None) -> str:
        """Writes a version, in folders of the columns `by`, and makes it current; its name."""
        version = f"v{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.path}/versions/{version}")
        number = 1 + max((int(n.getPath().getName().split(".")[0]) for n in self._pointer_files()), default=0)
        unfinished = self._at("pointers", f"_{version}")
        out = self._fs.create(unfinished)
        out.write(df.schema.json().encode())
        out.close()
        while not self._fs.rename(unfinished, self._at("pointers", f"{number:012d}.{version}")):
            number += 1
        return version

    def _pointer_files(self) -> list:
        if not self._fs.exists(self._at("pointers")):
            return []
        return [f for f in self._fs.listStatus(self._at("pointers")) if not f.getPath().getName().startswith(("_", "."))]

    def read(self, version: str | None = None) -> DataFrame:
        """The current version or a named one; raises if there is none."""
        known = self.versions()
        if not known or (version and version not in known):
            raise ValueError(f"{self.path} has no version {version or ''}".rstrip())
        version = version or known[-1]
        (pointer,) = (f.getPath() for f in self._pointer_files() if f.getPath().getName().endswith(f".{version}"))
        stream = self._fs.open(pointer)
        schema = StructType.fromJson(json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        stream.close()
        return self.spark.read.schema(schema).parquet(f"{self.path}/versions/{version}")

    def prune(self, keep: int = 2) -> None:
        """Removes all but the latest versions, and what no pointer names; not while others write or read old ones."""
        kept = self.versions()[-keep:]
        for f in self._pointer_files():
            if f.getPath().getName().split(".", 1)[1] not in kept:
                self._fs.delete(f.getPath(), True)
        if self._fs.exists(self._at("versions")):
            for f in self._fs.listStatus(self._at("versions")):
                if f.getPath().getName() not in kept:
                    self._fs.delete(f.getPath(), True)


def snapshot(df: DataFrame, view: str, path: str) -> DataFrame:
    """Writes a view's rows as the next version below a path and registers the view over it; later plans begin there.

    `df` may read the view or the version before.
    """
    store = Snapshots(df.sparkSession, path)
    stored = store.read(store.write(df))
    stored.createOrReplaceTempView(view)
    return stored


def materialize_if_absent(spark: SparkSession, path: str, build: Callable[[], DataFrame], reuse: bool = True) -> DataFrame:
    """The current version below a path; built and written first if there is none, or if it shall not be reused.

    What a lost job left counts as nothing.
    """
    store = Snapshots(spark, path)
    if not (reuse and store.versions()):
        store.write(build())
    return store.read()


def load_and_count(df: DataFrame, path: str, expected: int | None = None) -> int:
    """Replaces a staging table, counts what was written, and raises if it isn't what was expected."""
    df.write.mode("overwrite").parquet(path)
    n = df.sparkSession.read.schema(df.schema).parquet(path).count()
    if expected is not None and n != expected:
        raise ValueError(f"{path} has {n} rows, not {expected}")
    return n
