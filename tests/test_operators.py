"""Operators on small tables: nulls, ties, repeats, empty tables; rewrites against their naive forms."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import benchstats as B
from tessera.operators import checks as C
from tessera.operators import joins as J
from tessera.operators import reshape as P
from tessera.operators import resolve as R
from tessera.operators import windows as W
from tessera.operators.ranking import multifactor_rank
from tessera.sources.schemas import SCHEMAS


def test_sum_avg_count_of_nulls(spark, rows):
    df = spark.createDataFrame([("a", 10.5), ("a", None), ("a", 1.5), ("b", None)], "k string, v double")
    assert rows(A.sum_avg_count(df, ["k"], "v")) == [("a", 12.0, 6.0, 2), ("b", None, None, 0)]


def test_share_over_counts_all(spark, rows):
    df = spark.createDataFrame([("a", 120), ("a", 119), ("a", None), ("b", None)], "k string, v int")
    assert rows(A.share_over(df, ["k"], "v", 120)) == [("a", 1, 3, 33.333), ("b", 0, 1, 0.0)]


def test_first_known_skips_nulls(spark, rows):
    df = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, "c", "y"), (None, 3, "d", "z")], "k string, o int, v string, w string")
    assert rows(A.first_known(df, "k", ["v", "w"], "o")) == [("a", "c", "x")]


def test_statistics_of_one_run(spark):
    r = A.statistics(spark.createDataFrame([("q", 2.0)], "k string, v double"), ["k"], "v").first()
    assert r["std"] is None and r["cv"] is None and r["median"] == 2.0


def test_latest_and_pivot(spark, rows):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("b", 1, 9)], "k string, s int, v int")
    assert rows(A.latest_by(df, "k", ["s"], ["s", "v"])) == [("a", 2, 7), ("b", 1, 9)]
    p = A.pivoted(df.withColumn("c", F.concat(F.lit("x"), "s")), "k", "c", ["x1", "x2"], F.sum("v"))
    assert rows(p) == [("a", 5, 7)]


def test_either_key_join_equals_the_disjunction(spark, rows):
    left = spark.createDataFrame([(1, 9, "s"), (None, 2, "s"), (3, 3, "t"), (7, 8, "s")], "a int, b int, g string")
    right = spark.createDataFrame([(1, "s", "one"), (2, "s", "two"), (3, "s", "no"), (None, "s", "null")], "id int, g string, v string")
    got = J.either_key_join(left, right, "a", "b", "id", ["g"], ["v"])
    naive = left.alias("l").join(right.alias("r"), ((F.col("r.id") == F.col("l.a")) | (F.col("r.id") == F.col("l.b"))) & (F.col("l.g") == F.col("r.g")), "left").select("l.a", "l.b", "l.g", "r.v")
    assert rows(C.difference(got.select("a", "b", "g", "v"), naive)) == []


def test_either_key_join_prefers_the_first_and_keeps_rows(spark, rows):
    left = spark.createDataFrame([(1, 2)], "a int, b int")
    right = spark.createDataFrame([(1, None, "x"), (2, "v", "y")], "id int, v string, w string")
    assert rows(J.either_key_join(left, right, "a", "b", "id", [], ["v", "w"])) == [(1, 2, None, "x")]


def test_fallback_is_of_records(spark, rows):
    left = spark.createDataFrame([("p", "LAL"), ("p", "BOS"), ("q", "LAL")], "id string, team string")
    right = spark.createDataFrame([("p", "LAL", None, 1), ("p", "TOT", 5, 2)], "id string, team string, v int, w int")
    got = J.fallback_lookup(left, right, ["id", "team"], "team", "TOT", ["v", "w"])
    assert rows(got.select("id", "team", "v", "w")) == [("p", "BOS", 5, 2), ("p", "LAL", None, 1), ("q", "LAL", None, None)]


def test_excluded_and_members_and_ranges(spark, rows):
    df = spark.createDataFrame([(1, "Ann"), (2, "Bob"), (None, None)], "id int, name string")
    ids, names = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("BOB",)], "y string")
    assert rows(J.excluded(df, ids, names, "id", "name").select("id", "name")) == [(None, None)]
    lists = spark.createDataFrame([("BOS, LAL ,",), ("",), (None,)], "l string")
    assert rows(J.list_members(lists, "l", "m").select("m")) == [("BOS",), ("LAL",)]
    spans = spark.createDataFrame([(2000, 2002), (2003, 2001), (None, 2000)], "a int, b int")
    assert rows(J.seasons_of_range(spans, "a", "b").select("season")) == [(2000,), (2001,), (2002,)]


def naive_resolve(left, right):
    m1 = left.join(right, left.id == right.rid).select(left["*"], F.lit(1).alias("prio"), "rid")
    m2 = left.join(right, left.name == right.rname).select(left["*"], F.lit(2).alias("prio"), "rid")
    m0 = left.select("*", F.lit(99).alias("prio"), F.lit(None).cast("int").alias("rid"))
    return R.best_candidate(m1.unionByName(m2).unionByName(m0), ["id", "name"], [F.col("prio"), F.col("rid").asc_nulls_last()])


def test_resolve_equals_union_of_all_matches(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "a"), (5, None)], "id int, name string")
    right = spark.createDataFrame([(1, "z"), (7, "a"), (6, "a"), (8, "b"), (2, "c")], "rid int, rname string")
    rules = [R.Rule(1, ("id",), ("rid",)), R.Rule(2, ("name",), ("rname",))]
    got = R.resolve(left, right, rules, ["id", "name"], "rid").select("id", "name", "prio", F.col("match.rid").alias("rid"))
    assert rows(got) == rows(naive_resolve(left, right).select("id", "name", "prio", "rid"))
    assert R.resolve(left.limit(0), right, rules, ["id", "name"], "rid").count() == 0


def test_fused_names_the_source(spark, rows):
    df = spark.createDataFrame([("a", "b"), (None, "b"), (None, None)], "x string, y string")
    assert rows(df.select(*R.fused("v", {"first": F.col("x"), "second": F.col("y")}))) == [("a", "first"), ("b", "second"), (None, None)]


def test_full_outer_never_matches_null_keys(spark):
    a = spark.createDataFrame([(1,), (None,)], "k int")
    assert R.full_outer(a, a, ["k"]).count() == 3


def test_top_n_ties_and_plan(spark, rows):
    df = spark.createDataFrame([("a", 5, 2), ("a", 5, 1), ("a", 4, 3), ("b", None, 1)], "k string, v int, id int")
    top = W.top_n(df, ["k"], [F.col("v").desc_nulls_last(), F.col("id")], 1)
    assert rows(top.select("k", "v", "id")) == [("a", 5, 1), ("b", None, 1)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_share_of_group_of_zero(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 0.0)], "k string, v double")
    assert rows(W.share_of_group(df, ["k"], "v", "s")) == [("a", 1.0, 25.0), ("a", 3.0, 75.0), ("b", 0.0, None)]


def test_streaks_and_standings(spark, rows):
    games = [("e", "x", i, w) for i, w in enumerate([1, 1, 0, 1, 1, 1])] + [("e", "y", i, w) for i, w in enumerate([1, 0, 0])] + [("w", "z", 0, 0)]
    table = W.standings(spark.createDataFrame(games, "c string, t string, d int, won int"), "c", "t", ["d"], "won")
    assert rows(table) == [("e", "x", 5, 1, 0.0, "W3"), ("e", "y", 1, 2, 2.5, "L2"), ("w", "z", 0, 1, 0.0, "L1")]


def test_page(spark):
    df = spark.range(10)
    assert [r.id for r in W.page(df, [F.col("id").desc()], 2, 3).collect()] == [6, 5, 4]
    assert W.page(df, [F.col("id")], 9, 3).count() == 0


def test_unpivot_equals_union(spark, rows):
    df = spark.createDataFrame([(1, "a", "b"), (2, None, "c")], "g int, h string, a string")
    got = P.unpivot_sides(df, {"g": F.col("g")}, {"H": {"t": F.col("h")}, "A": {"t": F.col("a")}}, "side")
    naive = df.select("g", F.lit("H").alias("side"), F.col("h").alias("t")).unionByName(df.select("g", F.lit("A").alias("side"), F.col("a").alias("t")))
    assert rows(C.difference(got, naive)) == []


def test_segments_cover_the_tenure(spark):
    df = spark.range(1, 4).select(F.col("id").alias("o"))
    first, last = P.even_segment(F.lit(1999), F.lit(2005), F.col("o"), F.lit(3))
    assert [tuple(r) for r in df.orderBy("o").select(first, last).collect()] == [(1999, 2000), (2001, 2002), (2003, 2005)]


def test_checks(spark, rows):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "id int, v string")
    assert C.missing_columns(a.toDF("ID", "V"), ["id", "w"]) == ["w"] and C.lowered(a.toDF("ID", "V")).columns == ["id", "v"]
    base = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    assert rows(C.key_report("v", base, a, ["id"])) == [("v", 2, 3, -1, 1, 1)]
    assert rows(C.key_report("v", None, a.limit(0), ["id"])) == [("v", None, 0, None, 0, 0)]
    with pytest.raises(ValueError):
        C.require_unique(a, ["id"])
    C.require_unique(base.distinct(), ["id"])
    b = spark.createDataFrame([(1, "x"), (2, "z")], "id int, v string")
    assert rows(C.difference(a, b)) == [(1, "x", "a"), (2, "z", "b"), (None, "y", "a")]


def test_benchstats(spark, rows):
    log = spark.createDataFrame([(1, "hadoop", "q1", 200.0, 10), (2, "pyspark", "q1", 100.0, 10), (3, "pyspark", "q1", 300.0, None), (4, "hadoop", "q2", 50.0, 5)], "seq int, tool string, query string, wall_ms double, rows int")
    assert rows(B.speedup(log, "query", "tool", "hadoop", "pyspark")) == [("q1", 1.0, 1.0)]
    assert rows(B.overall_speedup(log, "query", "tool", "hadoop", "pyspark")) == [(1.0,)]
    assert B.run_statistics(log, ["tool", "query"]).where("tool = 'pyspark'").first()["throughput"] == 50.0
    assert [r["run"] for r in B.throughput_trend(log, ["tool", "query"], "seq", F.col("rows"), F.col("wall_ms")).where("tool = 'pyspark'").orderBy("seq").collect()] == [1, 2]


def test_throughput_of_runs_that_took_no_time(spark):
    """a division by zero is infinite, of zero by zero NaN, and so are the changes."""
    log = spark.createDataFrame([(0, 10, 5.0), (1, 7, 0.0), (2, 8, 0.0), (3, 0, 0.0), (4, 9, 3.0), (5, 9, None), (6, -2, 0.0), (7, 3, -0.0)], "seq int, rows long, wall double").withColumn("tool", F.lit("t"))
    got = B.throughput_trend(log, ["tool"], "seq", F.col("rows"), F.col("wall")).orderBy("seq").collect()
    assert [str(r["throughput"]) for r in got] == ["2000.0", "inf", "inf", "nan", "3000.0", "None", "-inf", "-inf"]
    assert [str(r["change"]) for r in got] == ["None", "inf", "nan", "nan", "nan", "None", "None", "nan"]


def test_throughput_is_rounded_as_in_sql(spark):
    """values of which the shortest decimal form and the scaled double round to different sides."""
    log = spark.createDataFrame([(0, 23137, 0.21), (1, 24691, 0.09), (2, 23137, None)], "seq int, rows long, wall double").withColumn("tool", F.lit("t"))
    got = B.throughput_trend(log, ["tool"], "seq", F.col("rows"), F.col("wall")).orderBy("seq").collect()
    assert [(r["throughput"], r["change"]) for r in got] == [(110176190.476191, None), (274344444.444444, 164168253.968253), (None, None)]


def test_multifactor_rank(spark):
    base = dict(season=2019, team_abbr="LAL", player_name="Ann", pos="C", gs=1, usage_pct=35.0, ts_percent=0.5, pts_per_36=40.0, team_pts=0.0, ws=10.0, vorp=8.0)
    players = [base | dict(player_id=f"p{i:02}", g=82, mp=82 * 30.0) for i in range(17)]
    players += [base | dict(player_id="few", g=9, mp=90.0), base | dict(player_id="null", g=None, mp=90.0), base | dict(player_id="other", team_abbr="BOS", g=82, mp=2460.0, ws=None, vorp=-3.0, usage_pct=None)]
    out = multifactor_rank(spark.createDataFrame([tuple(p[f.name] for f in SCHEMAS["q4_multifactor"]) for p in players], SCHEMAS["q4_multifactor"])).collect()
    lal = [r for r in out if r["team_abbr"] == "LAL"]
    assert [r["player_id"] for r in sorted(lal, key=lambda r: r["rank"])] == [f"p{i:02}" for i in range(15)]
    share = round(100 / 17, 1)
    assert lal[0]["score"] == pytest.approx(0.3 * share / 100 + 0.15 + 0.075 + 0.15 + 0.15, abs=6e-4) and lal[0]["team_pts_share"] is None and lal[0]["player_name"] == "ann"
    other = next(r for r in out if r["player_id"] == "other")
    assert other["score"] == pytest.approx(0.3 + 0.075 + 0.15, abs=6e-4)


def test_sums_keep_all_digits_unless_a_scale_is_given(spark):
    df = spark.createDataFrame([(1, 0.333)] * 3 + [(2, 1e17), (2, None)], "k int, v double")
    got = {r["k"]: (r["total_points"], r["games"]) for r in A.sum_avg_count(df, ["k"], "v").collect()}
    assert abs(got[1][0] - 0.999) < 1e-12 and got[2] == (1e17, 1)
    assert {r["k"]: r["total_points"] for r in A.sum_avg_count(df, ["k"], "v", scale=2).collect()} == {1: 0.99, 2: 1e17}
    assert A.rounded_mean(df.where("k = 2"), ["k"], "v", "mean", "n").where("mean is not null").count() <= 1


def test_a_page_says_how_many_rows_there_are(spark):
    df = spark.range(53)
    got = W.page(df, [F.col("id").desc()], 6, 10, total="total").collect()
    assert [(r["id"], r["total"]) for r in got] == [(2, 53), (1, 53), (0, 53)]
