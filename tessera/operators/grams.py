"""An index of trigrams for searches of words anywhere in a text: stored once, read by few of its parts, verified by the search itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.cells import same_keys
from tessera.sources.sinks import Snapshots


def grams_of(text: Column, size: int = 3) -> Column:
    """The distinct stretches of `size` characters of a text; none of a shorter one or null."""
    n = F.length(text) - (size - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


class GramIndex:
    """Postings (gram, keys), dealt to folders by a hash of the gram, and how many keys each gram has.

    A text that holds a word holds all its grams, so the keys that have the rarest grams of every word are all that can match;
    they are few, and a search on their rows gives what a search on all rows gives. A key may have several rows.
    """

    size, buckets, rarest = 3, 64, 3

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.keys = spark, keys
        self._postings, self._counts = Snapshots(spark, f"{path}/postings"), Snapshots(spark, f"{path}/counts")

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def build(self, rows: DataFrame, text: Column) -> GramIndex:
        """Indexes a table by a text that is already folded as the words will be. Counts are pointed to last: without them nothing is found stale."""
        grams = rows.select(*self.keys, F.explode(grams_of(text, self.size)).alias("gram")).distinct().withColumn("bucket", self._bucket(F.col("gram")))
        self._postings.write(grams.repartition("bucket"), ["bucket"])
        self._counts.write(self._postings.read().groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
        return self

    def exists(self) -> bool:
        return bool(self._counts.versions())

    def candidates(self, words: list[str]) -> DataFrame | None:
        """Keys that may hold all words; None if no word is long enough to tell.

        Of each word the rarest grams are looked up: at most `rarest` lists a word are read, from their folders only.
        """
        own = {w: {w[k : k + self.size] for k in range(len(w) - self.size + 1)} for w in words if len(w) >= self.size}
        if not own:
            return None
        asked = sorted(set().union(*own.values()))  # bounded by the query's length
        counts = {r["gram"]: r["n"] for r in self._counts.read().where(F.col("gram").isin(asked)).collect()}
        chosen = sorted(set().union(*(sorted(grams, key=lambda g: (counts.get(g, 0), g))[: self.rarest] for grams in own.values())))
        numbers = [r["b"] for r in self.spark.createDataFrame([(g,) for g in chosen], "g string").select(self._bucket(F.col("g")).alias("b")).distinct().collect()]
        found = self._postings.read().where(F.col("bucket").isin(numbers) & F.col("gram").isin(chosen))
        return found.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == len(chosen)).select(*self.keys)

    def narrowed(self, rows: DataFrame, words: list[str]) -> DataFrame:
        """The rows whose keys may hold all words."""
        found = self.candidates(words)
        if found is None:
            return rows
        names = {k: f"__k{i}" for i, k in enumerate(self.keys)}
        return rows.join(found.withColumnsRenamed(names), same_keys(names), "left_semi")
