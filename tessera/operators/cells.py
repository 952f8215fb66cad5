"""Ordered work over groups of any size: cells of the order, and what is carried from cell to cell.

A group (a team, a tool) may hold a third of all rows, so no window here has a group as its only key. Rows are cut into
cells that follow the order; windows run within a group's part of a cell, which is small whatever the group; what a row needs from the
cells before it comes from a table with one row for each group and cell, joined to the rows. Cells are either quantiles of the order,
from a bounded sample, or given by the caller as a column that grows with the order, such as a month.

Orders are of ascending columns, nulls first; `descending` turns a number around.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample for each cell that is wanted, about.
SAMPLE = 64
CELL = "__cell"


def descending(value: Column) -> Column:
    """A key whose ascending order, nulls last, is the descending order of a number, nulls last."""
    return F.struct(value.isNull(), -value)


def default_cells(df: DataFrame) -> int:
    """As many cells as the session has shuffle partitions."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_cells(df: DataFrame, order: list[str | Column], n_cells: int | None = None, name: str = CELL, boundary: str | None = None) -> DataFrame:
    """Adds the number of each row's cell, an int that never falls along `order`; cells have about the same number of rows.

    With `boundary`, a boolean of that name tells which rows have the least key of their cell, in all cells but number 0. The boundaries are quantiles of a sample of about 64 rows a cell, those with the least hashes of their order columns, so that every
    use of the result finds the same ones. Rows that are equal in all order columns share a cell. An empty table has one cell.
    """
    n_cells = n_cells or default_cells(df)
    key = F.struct(*order)
    # every task draws by itself; of equal keys it sends one
    part = F.lit(float(n_cells * SAMPLE)) / F.greatest(df.agg(F.count(F.lit(1))).scalar(), F.lit(1))
    drawn = df.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(2**31)) / F.lit(2.0**31) < part).distinct()
    at = f"transform(sequence(1, {n_cells - 1}), i -> get(k, cast(floor(i * size(k) / {n_cells}) as int)))"
    bounds = drawn.agg(F.array_sort(F.collect_list("k")).alias("k")).select(F.expr(f"case when size(k) > 0 and {n_cells} > 1 then {at} end"))
    # how many of the sorted boundaries aren't above a row, by bisection
    half = "cast((a.lo + a.hi) div 2 as int)"
    step = f"case when a.lo >= a.hi then a when get(__bounds, {half}) <= __key then named_struct('lo', {half} + 1, 'hi', a.hi) else named_struct('lo', a.lo, 'hi', {half}) end"
    found = F.expr(f"coalesce(aggregate(sequence(1, {max(1, (n_cells - 1).bit_length())}), named_struct('lo', 0, 'hi', {n_cells - 1}), (a, i) -> {step}, a -> a.lo), 0)")
    rows = df.withColumn("__bounds", bounds.scalar()).withColumn("__key", key).withColumn(name, found)
    if boundary:  # a boundary is the key of a row
        rows = rows.withColumn(boundary, F.coalesce(F.when(F.col(name) > 0, F.col("__key").eqNullSafe(F.expr(f"get(__bounds, `{name}` - 1)"))), F.lit(False)))
    return rows.drop("__bounds", "__key")


def _cut(df: DataFrame, keys: list[str], order: list[str], cell: Column | None, n_cells: int | None) -> DataFrame:
    return with_cells(df, [*keys, *order], n_cells) if cell is None else df.withColumn(CELL, cell)


def same_keys(names: dict[str, str]) -> Column:
    """Whether all columns equal those that stand for them, null being equal to null."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], F.lit(True))


def _joined(rows: DataFrame, carried: DataFrame, keys: list[str], kept: list[str], how: str = "left") -> DataFrame:
    """Join on keys and cell, null keys being keys like any other."""
    names = {k: f"__k{i}" for i, k in enumerate([*keys, CELL])}
    right = carried.select(*[F.col(k).alias(n) for k, n in names.items()], *kept)
    return rows.join(right, same_keys(names), how).drop(*names.values())


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "run", cell: Column | None = None, n_cells: int | None = None) -> DataFrame:
    """Adds the number of each row in its group, from 1, as an int; rows equal in all order columns are numbered in any order."""
    rows = _cut(df, keys, order, cell, n_cells)
    local = F.row_number().over(Window.partitionBy(*keys, CELL).orderBy(*order))
    counts = rows.groupBy(*keys, CELL).agg(F.count(F.lit(1)).alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.withColumn("__before", earlier).where("__before > 0")
    found = _joined(rows.withColumn(name, local), carried, keys, ["__before"])
    return found.withColumn(name, (F.col(name) + F.coalesce("__before", F.lit(0))).cast("int")).drop("__before", CELL)


def with_previous(df: DataFrame, keys: list[str], order: list[str], previous: dict[str, Column], cell: Column | None = None, n_cells: int | None = None, number: str | None = None) -> DataFrame:
    """Adds, under each name of `previous`, an expression's value in the row before in the group; null in the first row.

    `order` must tell a group's rows apart. With `number` a column of that name numbers the rows from 1.
    """
    rows = _cut(df, keys, order, cell, n_cells).withColumn("__own", F.struct(*[c.alias(n) for n, c in previous.items()]))
    by = Window.partitionBy(*keys, CELL).orderBy(*order)
    local = rows.withColumn("__at", F.row_number().over(by)).withColumn("__lag", F.lag("__own").over(by))
    lasts = rows.groupBy(*keys, CELL).agg(F.max_by("__own", F.struct(*order)).alias("__last"), F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*keys).orderBy(CELL)
    carried = lasts.withColumn("__carry", F.lag("__last").over(over)).withColumn("__before", F.sum("__n").over(over.rowsBetween(Window.unboundedPreceding, -1))).where("__before > 0")
    found = _joined(local, carried, keys, ["__carry", "__before"])
    before = F.when(F.col("__at") == 1, F.col("__carry")).otherwise(F.col("__lag"))
    found = found.withColumns({n: before[n] for n in previous})
    if number:
        found = found.withColumn(number, (F.col("__at") + F.coalesce("__before", F.lit(0))).cast("int"))
    return found.drop("__own", "__at", "__lag", "__carry", "__before", CELL)


def _runs(rows: DataFrame, keys: list[str], order: list[str], flag: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """(keys, cell, __n, __flag, __run, sums): rows of a group in a cell, its last flag, and how many rows at its end have that; ties as in `streaks`."""
    placed = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*keys, CELL).orderBy(*order, flag)))
    added = {k: F.sum(v).alias(k) for k, v in (sums or {}).items()}
    ends = placed.groupBy(*keys, CELL, F.col(flag).alias("__flag")).agg(F.max("__at").alias("__end"), F.count(F.lit(1)).alias("__rows"), *added.values())
    # the run at the end begins after the last row of another flag
    whole = ends.groupBy(*keys, CELL).agg(F.max_by("__flag", "__end").alias("__flag"), F.sum("__rows").alias("__n"), F.sort_array(F.collect_list("__end"), asc=False).alias("__ends"), *[F.sum(k).alias(k) for k in added])
    return whole.withColumn("__run", F.col("__n") - F.coalesce(F.get("__ends", F.lit(1)), F.lit(0))).drop("__ends")


def streaks(df: DataFrame, keys: list[str], order: list[str], flag: str, cell: Column | None = None, n_cells: int | None = None) -> DataFrame:
    """Adds `streak`: how many rows in a row, up to and with this one, have the same flag in their group; null is a flag like any other.

    Runs add up over cells: of each cell its last flag and the rows at its end that have it, or all of them. A run that fills cells
    goes on from those before. Rows that are equal in all order columns come in the order of their flags, nulls first.
    """
    rows = _cut(df, keys, order, cell, n_cells)
    by = Window.partitionBy(*keys, CELL).orderBy(*order, flag)
    changed = F.when(F.row_number().over(by) == 1, 1).when(F.lag(flag).over(by).eqNullSafe(F.col(flag)), 0).otherwise(1)
    local = rows.withColumn("__new", changed).withColumn("__island", F.sum("__new").over(by))
    local = local.withColumn("streak", F.row_number().over(Window.partitionBy(*keys, CELL, "__island").orderBy(*order)))
    over = Window.partitionBy(*keys).orderBy(CELL)
    ends = _runs(rows, keys, order, flag)
    goes_on = (F.col("__run") == F.col("__n")) & F.lag("__flag").over(over).eqNullSafe(F.col("__flag")) & F.lag(F.lit(True)).over(over).isNotNull()
    ends = ends.withColumn("__block", F.sum(F.when(goes_on, 0).otherwise(1)).over(over))
    ends = ends.withColumn("__total", F.sum("__run").over(Window.partitionBy(*keys, "__block").orderBy(CELL)))
    carried = ends.withColumn("__carry", F.lag(F.struct(F.col("__flag").alias("flag"), F.col("__total").alias("total"))).over(over)).where("__carry is not null")
    found = _joined(local, carried, keys, ["__carry"])
    more = (F.col("__island") == 1) & F.col("__carry").isNotNull() & F.col("__carry.flag").eqNullSafe(F.col(flag))
    return found.withColumn("streak", (F.col("streak") + F.when(more, F.col("__carry.total")).otherwise(0)).cast("int")).drop("__new", "__island", "__carry", CELL)


def last_streaks(df: DataFrame, keys: list[str], order: list[str], flag: str, sums: dict[str, Column] | None = None, cell: Column | None = None, n_cells: int | None = None) -> DataFrame:
    """(keys, n, flag, streak, sums): a group's rows, its last flag, how many rows at its end have that, and sums over all rows.

    One row for each cell of a group reaches the group's task; the cells are folded there in order, as in `streaks`.
    """
    ends = _runs(_cut(df, keys, order, cell, n_cells), keys, order, flag, sums)
    part = F.struct(F.col(CELL).alias("cell"), F.col("__n").alias("n"), F.col("__flag").alias("flag"), F.col("__run").alias("run"))
    none = F.struct(F.lit(None).cast(dict(df.dtypes)[flag]).alias("flag"), F.lit(0).cast("long").alias("run"))
    longer = lambda acc, c: c["run"] + F.when((c["run"] == c["n"]) & acc["flag"].eqNullSafe(c["flag"]), acc["run"]).otherwise(F.lit(0).cast("long"))
    fold = lambda acc, c: F.struct(c["flag"].alias("flag"), longer(acc, c).alias("run"))
    folded = ends.groupBy(*keys).agg(F.sum("__n").alias("n"), F.array_sort(F.collect_list(part)).alias("cells"), *[F.sum(k).alias(k) for k in sums or {}])
    last = F.aggregate("cells", none, fold)
    return folded.withColumn("__last", last).select(*keys, "n", F.col("__last.flag").alias(flag), F.col("__last.run").alias("streak"), *(sums or {}))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, parts: dict[str, float], n_cells: int | None = None) -> DataFrame:
    """(keys, and each name of `parts`): percentiles of the known values of each group, between two values by their distance, as `percentile` has them.

    By rank selection: equal values are counted in every task first; counts by group and cell of the values tell which cells
    hold the ranks that are asked for, and only these are put in order. No task holds a group. A group without known values has no row.
    """
    known = with_cells(df.where(F.col(value).isNotNull()).select(*keys, value), [*keys, value], n_cells)
    counts = known.groupBy(*keys, CELL, value).agg(F.count(F.lit(1)).alias("__n"))
    cells = counts.groupBy(*keys, CELL).agg(F.sum("__n").alias("__rows"))
    over = Window.partitionBy(*keys)  # of a row a cell
    earlier = F.coalesce(F.sum("__rows").over(over.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("__before", earlier).withColumn("__last", F.sum("__rows").over(over) - 1)
    ranks = F.array(*[F.struct(F.lit(n).alias("name"), (p * F.col("__last")).alias("at")) for n, p in parts.items()])
    within = lambda r: (F.ceil(r["at"]) >= F.col("__before")) & (F.floor(r["at"]) < F.col("__before") + F.col("__rows"))
    asked = cells.withColumn("__asked", F.filter(ranks, within)).where(F.size("__asked") > 0)
    held = _joined(counts, asked, keys, ["__before", "__asked"], "inner")
    upto = F.sum("__n").over(Window.partitionBy(*keys, CELL).orderBy(value))
    held = held.withColumn("__upto", F.col("__before") + upto).withColumn("__from", F.col("__upto") - F.col("__n"))
    here = lambda rank: (rank >= F.col("__from")) & (rank < F.col("__upto"))
    found = held.select(*keys, value, "__from", "__upto", F.explode("__asked").alias("r")).where(here(F.floor("r.at")) | here(F.ceil("r.at")))

    def at(name: str) -> Column:
        own, rank = F.col("r.name") == name, F.col("r.at")
        low, high = (F.max(F.when(own & here(end(rank)), F.col(value).cast("double"))) for end in (F.floor, F.ceil))
        place = F.max(F.when(own, rank))
        mixed = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        return F.when(low == high, low).otherwise(mixed).alias(name)

    return found.groupBy(*keys).agg(*[at(n) for n in parts])
