"""Prioritised entity resolution, and fusion of columns with provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Rows match where the key columns are equal and not null. A lower priority is better."""

    priority: int
    left: tuple[str, ...]
    right: tuple[str, ...]


def resolve(left: DataFrame, right: DataFrame, rules: list[Rule], keys: list[str], right_id: str, unmatched: int = 99) -> DataFrame:
    """The best match in `right` of each row of `left`, by the rule of the least priority, ties by the least right id.

    Adds `prio` and `match`, the right row as a struct or null. `keys` tell the left rows apart. Each rule is an
    equi join that keeps the least right row of a key, so a common name doesn't multiply rows; all rules then
    meet in one aggregation by key, without a sort.
    """
    record = F.struct(*right.columns)
    out = left
    chosen = F.lit(None)
    prio: Column = F.lit(unmatched)
    for rule in sorted(rules, key=lambda r: -r.priority):
        known = right
        for c in rule.right:
            known = known.where(F.col(c).isNotNull())
        names = [f"__r{rule.priority}_{k}" for k in range(len(rule.right))]
        best = known.groupBy(*[F.col(c).alias(n) for c, n in zip(rule.right, names)]).agg(F.min_by(record, F.col(right_id)).alias(f"__m{rule.priority}"))
        condition = F.lit(True)
        for c, n in zip(rule.left, names):
            condition &= F.col(c) == F.col(n)
        out = out.join(best, condition, "left").drop(*names)
        found = F.col(f"__m{rule.priority}")
        prio = F.when(found.isNotNull(), F.lit(rule.priority)).otherwise(prio)
        chosen = F.coalesce(found, chosen) if rule is not max(rules, key=lambda r: r.priority) else found
    picked = out.select(*left.columns, prio.alias("prio"), chosen.alias("match"))
    order = F.struct("prio", F.col("match")[right_id].isNull(), F.col("match")[right_id])
    return picked.groupBy(*keys).agg(F.min_by(F.struct(*picked.columns), order).alias("__row")).select("__row.*")


def fused(column: str, sources: dict[str, Column], provenance: bool = True) -> list[Column]:
    """The first known value of the sources in order, and `src_<column>`, the name of the source it is from."""
    value = F.coalesce(*sources.values()).alias(column)
    if not provenance:
        return [value]
    origin: Column = F.lit(None).cast("string")
    for name, source in reversed(list(sources.items())):
        origin = F.when(source.isNotNull(), F.lit(name)).otherwise(origin)
    return [value, origin.alias(f"src_{column}")]


def full_outer(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str] = ("l", "r")) -> DataFrame:
    """Full outer join on keys that are not null: structs of both sides under their names."""
    a = left.select(F.struct(*left.columns).alias(names[0]))
    b = right.select(F.struct(*right.columns).alias(names[1]))
    condition = F.lit(True)
    for k in keys:
        condition &= F.col(names[0])[k] == F.col(names[1])[k]
    return a.join(b, condition, "full_outer")


def best_candidate(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that leaves no ties."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(by)).where("__k = 1").drop("__k")
