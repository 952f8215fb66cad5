"""Work by cells of an order, intervals by dyadic blocks, digests and snapshots against their plain forms."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import cells as O
from tessera.operators import checks as C
from tessera.operators import joins as J
from tessera.operators import windows as W
from tessera.plans import winmodel as M
from tessera.sources import sinks as K

COLUMNS = ["k", "d", "i", "w", "v"]


@pytest.fixture(scope="module")
def runs(spark):
    """Rows of a hot key, others and a null one; few days, so that cells are filled by one run; some flags and values are null."""
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        w = 1 if 300 < i < 700 else rng.choice([1, 1, 0, None])
        rows.append((rng.choice(["a"] * 9 + ["b", "c", None]), i // 60, i, w, rng.choice([None, round(rng.random(), 2), 7.5])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, d int, i int, w int, v double").repartition(3).cache()


HOW = [8, 1, 300, "d"]


def by():
    return Window.partitionBy("k").orderBy("d", "i")


def cells_of(how):
    return {"cell": F.col(how)} if isinstance(how, str) else {"n_cells": how}


def windows_by_one_key(df):
    """Windows of a plan whose only partition key is k, but for those over the small tables of cells, which are in order of the cell."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [w for w in re.findall(r"Window \[(.*?)\], \[k#\d+\]", plan) if "__cell" not in w]


@pytest.mark.parametrize("how", HOW)
def test_numbers_and_previous_rows(runs, rows, how):
    want = runs.withColumns({"run": F.row_number().over(by()), "pv": F.lag("v").over(by()), "pw": F.lag("w").over(by())})
    got = O.numbered(runs, ["k"], ["d", "i"], "run", **cells_of(how))
    assert rows(got.select(*COLUMNS, "run")) == rows(want.select(*COLUMNS, "run"))
    got = O.with_previous(runs, ["k"], ["d", "i"], {"pv": F.col("v"), "pw": F.col("w")}, number="run", **cells_of(how))
    assert got.columns == [*COLUMNS, "pv", "pw", "run"] and rows(got) == rows(want.select(*COLUMNS, "pv", "pw", "run"))


@pytest.mark.parametrize("how", HOW)
def test_streaks_go_on_over_cells(runs, rows, how):
    changed = F.when(F.row_number().over(by()) == 1, 1).when(F.lag("w").over(by()).eqNullSafe(F.col("w")), 0).otherwise(1)
    want = runs.withColumn("island", F.sum(changed).over(by())).withColumn("streak", F.row_number().over(Window.partitionBy("k", "island").orderBy("d", "i")))
    got = O.streaks(runs, ["k"], ["d", "i"], "w", **cells_of(how))
    assert rows(got) == rows(want.select(*COLUMNS, "streak"))
    last = want.groupBy("k").agg(F.count("*").alias("n"), F.max_by(F.struct("w", "streak"), F.struct("d", "i")).alias("l"), F.sum("d").alias("s"))
    found = O.last_streaks(runs, ["k"], ["d", "i"], "w", {"s": F.col("d")}, **cells_of(how))
    assert rows(found) == rows(last.select("k", "n", "l.w", F.col("l.streak").cast("long"), "s"))
    assert not windows_by_one_key(got) and not windows_by_one_key(found)


def test_cells_split_a_hot_key_evenly(runs):
    sizes = [r["count"] for r in O.with_cells(runs, ["k", "d", "i"], 10).groupBy("__cell").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * 120
    cells = O.with_cells(runs, ["k", "d", "i"], 10).orderBy("k", "d", "i").select("__cell").collect()
    assert [c[0] for c in cells] == sorted(c[0] for c in cells)
    parts = [r["k"] for r in O.with_cells(runs, ["k", "d", "i"], 10).select("k", "__cell").distinct().collect()]
    assert parts.count("a") >= 6


def test_ties_and_empty_tables(spark, runs, rows):
    none = runs.limit(0)
    assert O.numbered(none, ["k"], ["d", "i"]).count() == O.streaks(none, ["k"], ["i"], "w").count() == O.last_streaks(none, ["k"], ["i"], "w").count() == 0
    assert O.exact_percentiles(none, ["k"], "v", {"p": 0.5}).count() == 0 and W.page_by_rank(none, ["i"], 1, 5).count() == 0
    ties = spark.createDataFrame([("a", 1)] * 50 + [("b", None)] * 3, "k string, o int")
    assert rows(O.numbered(ties, ["k"], ["o"], "n", n_cells=9).groupBy("k").agg(F.min("n"), F.max("n"), F.count_distinct("n"))) == [("a", 1, 50, 50), ("b", 1, 3, 3)]


@pytest.mark.parametrize("how", HOW)
def test_streaks_of_rows_at_one_place_of_the_order(spark, rows, how):
    """rows that the order leaves open have streaks of one sequence, the flag's."""
    rng = random.Random(5)
    table = [(rng.choice("aaab"), at // 4, at // 2, rng.choice([0, 1, None])) for at in range(160) for _ in range(rng.choice([1, 1, 2]))]
    want, last = [], {}
    for k, d, i, w in sorted(table, key=lambda r: (*r[:3], -1 if r[3] is None else r[3])):
        flag, streak, n = last.get(k, (w, 0, 0))
        last[k] = (w, streak + 1 if flag == w else 1, n + 1)
        want.append((k, d, i, w, last[k][1]))
    df = spark.createDataFrame(table, "k string, d int, i int, w int").repartition(5)
    assert rows(O.streaks(df, ["k"], ["d", "i"], "w", **cells_of(how))) == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))
    assert rows(O.last_streaks(df, ["k"], ["d", "i"], "w", **cells_of(how))) == [(k, n, w, streak) for k, (w, streak, n) in sorted(last.items())]


@pytest.mark.parametrize("n_cells", [1, 7, 64])
def test_percentiles_are_those_of_the_whole_group(runs, rows, n_cells):
    parts = {"low": 0.0, "q": 0.25, "median": 0.5, "p95": 0.95, "top": 1.0}
    want = runs.where("v is not null").groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in parts.items()])
    got = O.exact_percentiles(runs, ["k"], "v", parts, n_cells)
    assert rows(got) == rows(want) and "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_percentiles_of_few_values(spark, rows):
    df = spark.createDataFrame([("one", 4), ("two", 1), ("two", 4), ("none", None)], "k string, v int")
    assert rows(O.exact_percentiles(df, ["k"], "v", {"m": 0.5, "p": 0.9})) == [("one", 4.0, 4.0), ("two", 2.5, 3.7)]


def test_pages_of_any_depth(runs, rows):
    order = [O.descending(F.col("v")), "d", "i"]
    want = [r["i"] for r in runs.orderBy(F.col("v").desc_nulls_last(), "d", "i").collect()]
    for number, size in ((1, 7), (40, 10), (171, 7), (172, 7), (400, 7), (1, 5000)):
        got = W.page_by_rank(runs, order, number, size, total="total", n_cells=13).collect()
        assert [r["i"] for r in got] == want[(number - 1) * size : number * size]
        assert [r["rank"] for r in got] == list(range((number - 1) * size + 1, (number - 1) * size + 1 + len(got))) and {r["total"] for r in got} <= {1200}


def cover(spark, a, b):
    return [tuple(r) for r in spark.range(1).select(F.inline(J.dyadic_cover(F.lit(a), F.lit(b)))).collect()]


def test_dyadic_covers(spark):
    for a, b in ((0, 0), (0, 7), (1, 6), (-9, 13), (5, 4), (-8, -1), (3, 1000), (None, 3)):
        blocks = cover(spark, a, b)
        numbers = [x for level, at in blocks for x in range(at << level, at + 1 << level)]
        assert sorted(numbers) == ([] if a is None else list(range(a, b + 1)))
    assert len(cover(spark, 123_457, 1_123_456)) <= 40 and len(cover(spark, 1, 2**40)) <= 80


def test_interval_join_equals_the_condition(spark, rows):
    rng = random.Random(2)
    spans = [(k, rng.choice(["x", "y", None]), rng.choice([None, rng.randint(-50, 900)]), 0) for k in range(60)]
    spans = [(k, g, a, rng.choice([None, (a or 0) + rng.randint(-3, 400)])) for k, g, a, _ in spans]
    points = [(k, rng.choice(["x", "y", None]), rng.choice([None, rng.randint(-60, 1000)])) for k in range(300)]
    left = spark.createDataFrame(points, "p int, g string, at int")
    right = spark.createDataFrame(spans, "s int, g string, a int, b int")
    got = J.interval_join(left, right, ["g"], "at", "a", "b")
    met = left.alias("l").join(right.alias("r"), (F.col("l.g") == F.col("r.g")) & F.col("at").isNotNull() & (F.coalesce("a", "at") <= F.col("at")) & (F.coalesce("b", "at") >= F.col("at")))
    assert rows(got.select("g", "p", "at", "s", "a", "b")) == rows(met.select("l.g", "p", "at", "s", "a", "b"))
    assert J.interval_join(left.limit(0), right, ["g"], "at", "a", "b").count() == 0


def test_digests_find_what_differs(spark, rows):
    a = spark.createDataFrame([(k, None if k % 5 else "x", k % 3) for k in range(500)], "id int, v string, n int")
    b = a.where("id != 17").unionByName(a.where("id in (3, 4)")).unionByName(a.where("id = 20").withColumn("v", F.lit("y")))
    for x, y in ((a, b), (b, a), (a, a.limit(0)), (a.limit(0), a.limit(0))):
        assert rows(C.difference_by_digest(x, y.select("n", "v", "id"), 16)) == rows(C.difference(x, y))
    assert C.differing_buckets(a, a.orderBy("v")).count() == 0 and C.differing_buckets(a, a.union(a)).count() > 100
    swapped = spark.createDataFrame([(1, None, 2), (None, "1", 2)], "id int, v string, n int")
    assert C.differing_buckets(swapped, swapped.select("id", "v", F.lit(3).alias("n"))).count() > 0


def test_equal_tables_compare_digests_only(spark, tmp_path):
    spark.range(1000).withColumn("x", F.col("id") * 2).write.parquet(f"{tmp_path}/a")
    a, b = spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/a")
    plan = C.difference_by_digest(a, b.where("id >= 0"), 64)
    assert plan.count() == 0 and "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()


def test_snapshots_are_whole(spark, tmp_path):
    path, view = f"{tmp_path}/s", "snap_whole"
    store = K.Snapshots(spark, path)
    with pytest.raises(ValueError):
        store.read()
    assert store.versions() == []
    K.snapshot(spark.range(3), view, path)
    K.snapshot(spark.table(view).unionAll(spark.range(10, 12)), view, path)  # reads what it replaces
    assert sorted(r[0] for r in spark.table(view).collect()) == [0, 1, 2, 10, 11]
    boom = F.udf(lambda x: 1 // (x - 10), "long")
    with pytest.raises(Exception):
        K.snapshot(spark.table(view).select(boom("id").alias("id")), view, path)
    assert store.read().count() == spark.table(view).count() == 5 and store.read(store.versions()[0]).count() == 3
    (tmp_path / "s" / "versions" / "vlost").mkdir()  # of a job that was lost before its pointer
    assert len(store.versions()) == 2 and K.materialize_if_absent(spark, path, lambda: spark.range(1)).count() == 5
    store.prune(1)
    assert len(store.versions()) == 1 and store.read().count() == 5 and len(list((tmp_path / "s" / "versions").iterdir())) == 1


def test_half_written_tables_are_built_again(spark, tmp_path):
    (tmp_path / "m" / "versions" / "vhalf").mkdir(parents=True)
    (tmp_path / "m" / "versions" / "vhalf" / "part-0.parquet").write_bytes(b"half")
    assert K.materialize_if_absent(spark, f"{tmp_path}/m", lambda: spark.range(4)).count() == 4


def naive_features(games, days=365):
    out = []
    for g, day, h, a, won in games:
        past = [x for x in games if x[1] < day]
        form, rest = {}, {}
        for name, t in (("home", h), ("away", a)):
            own = [(x[1], x[4] if x[2] == t else 1 - x[4]) for x in past for _ in range((x[2] == t) + (x[3] == t)) if t in (x[2], x[3])]
            near = [w for d, w in own if d >= day - days]
            form[name] = sum(near) / len(near) if near else 0.5
            rest[name] = float(min(day - max(d for d, _ in own), M.MOST_REST)) if own else float(M.MOST_REST)
        at_home = [x[4] for x in past if x[2] == h]
        out.append((g, form["home"], form["away"], rest["home"], rest["away"], sum(at_home) / len(at_home) if at_home else 0.5))
    return out


def test_form_by_buckets_of_days(spark, rows):
    rng = random.Random(6)
    teams = ["hot"] * 6 + ["b", "c", "d"]
    games = []
    for g in range(250):
        h, a = rng.sample(teams, 2)
        if h != a:
            games.append((g, rng.choice([rng.randint(-200, 1500), rng.randint(700, 760)]), h, a, rng.randint(0, 1)))
    frame = spark.createDataFrame(games, "game_id int, day int, home_id string, away_id string, won int")
    frame = frame.select("game_id", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias("game_date"), "home_id", "away_id", (F.col("won") * 9).alias("home_pts"), F.lit(5).alias("away_pts"))
    for days in (365, 20):
        got = M.game_features(frame, days).select("game_id", *M.FEATURES)
        assert [tuple(round(x, 9) for x in r) for r in rows(got)] == sorted((tuple(round(x, 9) for x in r) for r in naive_features(games, days)), key=lambda r: tuple(map(str, r)))
    with pytest.raises(ValueError):
        M.game_features(frame, 3)


def test_searches_by_the_index_find_the_same(spark, tmp_path, rows):
    from tessera.plans import queries as Q

    rng = random.Random(3)
    words = ["Lakers", "lake", "Éric", "eric", "o'neal", "x", "yz", "Los", "Angeles", "laker"]
    table = [(rng.choice(["player", "team"]), str(k % 150), " ".join(rng.choices(words, k=rng.randint(0, 4))) or None, rng.choice([None, "Los Angeles"]), str(k)) for k in range(200)]
    frame = spark.createDataFrame(table, "_entity string, _id string, _title string, _subtitle string, _extra string")
    index = Q.search_index(frame, f"{tmp_path}/i")
    assert index.exists()
    for query in ("lake", "LAKE eric", "éric", "x", "yz lake", "nosuchword", "lakers angeles x", "angel", ""):
        for entity in (None, "team"):
            assert Q.search(frame, query, entity, 500, index).collect() == Q.search(frame, query, entity, 500).collect(), query
    assert index.candidates(["yz"]) is None and index.candidates(["lakers"]).count() < 150 and index.candidates(["zzzz"]).count() == 0
    plan = index.candidates(["lakers"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert Q.search(frame, "lake", None, 500, Q.search_index(frame.limit(0), f"{tmp_path}/none")).count() == 0  # an index of other rows names none of these


def test_a_database_is_read_in_parts(spark, rows):
    """An embedded database stands in for a server: written and read through JDBC."""
    from tessera.sources import registry as G

    url, driver = "jdbc:derby:memory:tessera;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.range(100).selectExpr("cast(id as int) as id", "cast(id % 7 as string) as v")
    df.write.format("jdbc").options(url=url, driver=driver, dbtable="things").mode("overwrite").save()
    whole = G.jdbc("things", url=url, driver=driver)(spark)
    parts = G.first_available(G.jdbc("no_such", url=url, driver=driver), G.jdbc("things", url=url, driver=driver, partitionColumn="id", lowerBound=0, upperBound=100, numPartitions=4))(spark)
    assert parts.rdd.getNumPartitions() == 4 and rows(parts.toDF("id", "v")) == rows(whole.toDF("id", "v")) == rows(df)
    some = G.jdbc('(select "id" from things where "id" < 30) t', url=url, driver=driver)(spark)
    assert some.count() == 30


def test_the_win_model_is_the_plain_fit(spark, rows):
    """Coefficients of the library's fit against plain gradient steps on the same games."""
    import numpy as np

    rng = np.random.default_rng(4)
    n = 600
    x = np.column_stack([rng.random(n), rng.random(n), rng.integers(1, 15, n), rng.integers(1, 15, n), rng.random(n)])
    won = (rng.random(n) < 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1] + 0.1 * x[:, 2] - 0.05 * x[:, 3])))).astype(int)
    table = [(k, f"2020-01-{k % 28 + 1:02}", f"h{k % 9}", f"a{k % 7}", int(won[k]), *map(float, x[k])) for k in range(n)]
    frame = spark.createDataFrame(table, "game_id int, game_date string, home_id string, away_id string, home_win int, " + ", ".join(f"{f} double" for f in M.FEATURES))
    model, scored = M.fit_home_win(frame, reg_param=0.01)
    test = {r["game_id"]: r["p_home_win"] for r in scored.collect()}
    train = np.array([k for k in range(n) if k not in test])
    z, y = x[train], won[train]
    mean, sd = z.mean(0), z.std(0, ddof=1)
    z = (z - mean) / sd  # the penalty is on standardised coefficients
    w, b = np.zeros(5), 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        w -= 0.5 * (z.T @ (p - y) / len(y) + 0.01 * w)
        b -= 0.5 * (p - y).mean()
    assert np.allclose(model.coefficients.toArray(), w / sd, atol=2e-3) and abs(model.intercept - (b - (w / sd * mean).sum())) < 5e-3
    for k, p in list(test.items())[:50]:
        assert abs(p - 1 / (1 + np.exp(-((x[k] - mean) / sd @ w + b)))) < 2e-3
    assert 0.1 * n < len(test) < 0.3 * n


def test_the_win_model_computes_features_once(spark):
    """each row of the features is computed for one job, whatever the fit and the scoring read them for."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    frame = spark.range(200).selectExpr("id AS game_id", "'2020-01-01' AS game_date", "'h' AS home_id", "'a' AS away_id", "cast(id % 3 = 0 AS int) AS home_win", *[f"(id * {k + 7} % 11) / 11d AS {f}" for k, f in enumerate(M.FEATURES)])
    _, scored = M.fit_home_win(frame.withColumn("home_form", counted("home_form")))
    assert scored.count() == len(scored.collect()) > 0 and seen.value == 200
