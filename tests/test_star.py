"""Every registered query of the star schema against SQL in a second engine, and the plans they get."""

import os

import pytest

from tessera.plans import central, integrated, roundtrips, star  # noqa: F401  (two of them register with integrated)

ALL = star.QUERIES | integrated.QUERIES
ALL_SQL = star.ORACLE_SQL | integrated.ORACLE_SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Second pages, of which the smallest tables have no rows.
FEW = {"user_meetings"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ALL_SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = ALL[name](spark, FOLDER).toPandas(), duck.execute(ALL_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    for c in ours:  # integers with nulls come as floats from one side
        if theirs[c].dtype.name.startswith("Int") or ours[c].dtype.name.startswith("Int"):
            ours[c], theirs[c] = ours[c].astype("Float64"), theirs[c].astype("Float64")
    assert len(ours) == len(theirs) and (len(ours) > 0 or name in FEW)
    fix = lambda f: sorted(tuple("" if v is None or v is __import__("pandas").NA or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert fix(ours) == fix(theirs)


@pytest.mark.parametrize("name", sorted(ALL.keys() - {"home_win_model"}))
def test_no_query_multiplies_tables(spark, name):
    plan = ALL[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan or name in ("dq_report", "user_matchup")  # of one row each


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = star.QUERIES["conditional_count"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "l_extendedprice" not in plan


def test_home_attendance_has_every_season(spark):
    """each season and team that has a name and games whose attendance is known."""
    game, teams = integrated.stage(spark, FOLDER, "game"), integrated.stage(spark, FOLDER, "team_season").where("team_name IS NOT NULL")
    played = game.where("attendance IS NOT NULL").selectExpr("season", "home_id AS team_abbr").distinct()
    want = {(r["season"], r["team_abbr"]) for r in played.join(teams, ["season", "team_abbr"]).collect()}
    assert {(r["season"], r["team_abbr"]) for r in ALL["user_home_attendance"](spark, FOLDER).collect()} == want and min(want)[0] < 1998


def test_order_lines_are_shuffled_by_their_order_only(spark):
    """orders get their customers first, as a join by customer after them would shuffle all lines again."""
    plan = star._games(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 3 and "l_orderkey" in joins[0] and "l_suppkey" in joins[1] and "o_custkey" in joins[2]


def test_the_win_model_joins_order_lines_once(spark):
    """the fit and the scoring read staged games, not the tables that they were made of."""
    games = ALL["home_win_model"](spark, FOLDER)
    assert games.count() > 0 and not [f for f in games.inputFiles() if f"{FOLDER}/" in f]
