"""Tiny tables with the cases that matter: accents, traded players, historic codes, blanks, offsets, tenures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.schemas import SCHEMAS


def table(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """Rows with the given columns; the others are null."""
    schema = SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def player_totals(spark):
    base = dict(season="2019", pos="C", g=70, gs=70, pts=1400.0, ast=500.0, trb=700.0)
    return table(
        spark,
        "player_totals",
        [
            base | dict(player="Nikola Jokić", player_id="jokicni01", team="DEN"),
            base | dict(player="Luka Dončić", player_id="x77", team="DAL", pos="pg", season="2019-20"),
            base | dict(player="J.R. Smith", player_id=None, team="LAL", g=None),
            base | dict(player="Traded Man", player_id="t1", team="TOT"),
            base | dict(player="Traded Man", player_id="t1", team="LAL", g=30),
            base | dict(player="Traded Man", player_id="t1", team="BOS", g=40),
            base | dict(player="Nobody Known", player_id="n1", team="LAL"),
        ],
    )


def common_player_info(spark):
    return table(
        spark,
        "common_player_info",
        [
            dict(player_id="jokicni01", full_name="Nikola Jokić", first_name="Nikola", last_name="Jokić", position="Center", height="6-11", weight="284", country="Serbia", team_abbreviation="den", from_year="2015", to_year="2022"),
            dict(player_id="doncilu01", full_name="Luka Doncic", first_name="Luka", last_name="Doncic", height="6-7", weight="230 lbs"),
            dict(player_id="smithjr01", full_name="JR Smith", first_name="JR", last_name="Smith", position="Guard", height="6'6", weight=None),
            dict(player_id="mantr", full_name="Travis Man", first_name="Travis", last_name="Man"),
        ],
    )


def player_per_game(spark):
    return table(
        spark,
        "player_per_game",
        [
            dict(season="2019", player="Nikola Jokic", player_id="jokicni01", team="den", pts_per_game=20.0, ast_per_game=7.0, trb_per_game=10.0),
            dict(season="2019", player="Traded Man", player_id="t1", team="LAL", pts_per_game=5.0),
            dict(season="2019", player="Only Here", player_id="o1", team="BOS", pos="sg", pts_per_game=1.0),
        ],
    )


def player_advanced(spark):
    return table(
        spark,
        "player_advanced",
        [
            dict(season="2019", player_id="jokicni01", team="DEN", per=26.34, ts_percent=0.58, ws=11.8, bpm=9.0, vorp=7.3, usg_percent=30.0),
            dict(season="2019", player_id="x77", team="DAL", per=24.0, ts_percent=58.55, ws=8.0, bpm=7.0, vorp=6.0, usg_percent=33.0),
            dict(season="2019", player_id="t1", team="TOT", per=10.0, ts_percent=0.5, ws=1.0, vorp=0.1, usg_percent=15.0, g=70),
        ],
    )


def player_season_info(spark):
    return table(spark, "player_season_info", [dict(player_id="jokicni01", season="2019", experience=4), dict(player_id="jokicni01", season="2019", experience=5)])


def seasons_stats(spark):
    return table(spark, "seasons_stats", [dict(year="2019", player="Nobody Known", per=9.99, ts_percent=0.4, ws=0.5, vorp=0.04)])


def games(spark):
    side = lambda i, city, name, score: (i, city, name, score)
    lal, bos = ("1", "Los Angeles", "Lakers"), ("2", "Boston", "Celtics")
    rows = [
        ("g1", "2020-01-01T23:30:00-05:00", "2019-20", "19,234", "Lakers", side(*lal, "110"), side(*bos, "100")),
        ("g2", "2020-08-02", None, "19.234", None, side(*bos, "99"), side(*lal, "120")),
        ("g3", "2020-06-02", None, "19234.0", None, side(*lal, None), side("3", None, None, "90")),
        ("g4", "soon", None, "n/a", None, None, side(*bos, "101")),
    ]
    return spark.createDataFrame(rows, SCHEMAS["games"])


def team_summaries(spark):
    return table(
        spark,
        "team_summaries",
        [
            dict(season="2019", lg="NBA", team="Los Angeles Lakers", abbreviation="LAL", arena="Staples", attend="812,292", o_rtg=110.0, pace=100.0, srs=6.0),
            dict(season="2019", lg="NBA", team="Seattle Sonics", abbreviation="SEA", attend=None, attend_g="15,000"),
            dict(season="2019-20", lg="NBA", team="Boston Celtics", abbreviation="BOS", arena=None, attend_g="18,000"),
            dict(season="2001", lg="NBA", team="Nets", abbreviation="NJN"),
            dict(season="2019", team="Nowhere", abbreviation=""),
            dict(season=None, team="Lost", abbreviation="LOS"),
        ],
    )


def team_stats_per_game(spark):
    return table(spark, "team_stats_per_game", [dict(season="2019", abbreviation="LAL", g=71, fg_per_game=42.0, fg_percent=0.48, pts_per_game=113.4)])


def team_totals(spark):
    return table(spark, "team_totals", [dict(season="2019", abbreviation="SEA", g=80, pts=8000.0, mp=19000.0), dict(season="2019", abbreviation="BOS", g=0, pts=1.0)])


def team_abbrev(spark):
    return table(spark, "team_abbrev", [dict(season="2001", abbreviation="NJN", team_name="New Jersey Nets"), dict(season="1998", abbreviation="VAN", team_name="Vancouver Grizzlies")])


def team_details(spark):
    meta = ("Boston", "Brad Stevens", ("TD Garden", "18624"))
    return spark.createDataFrame([("2", "BOS", "Celtics", "Boston Celtics", meta), ("1", "LAL", "Lakers", "Los Angeles Lakers", ("Los Angeles", None, ("Staples Center", "x")))], SCHEMAS["team_details"])


def nba_head_coaches(spark):
    return table(
        spark,
        "nba_head_coaches",
        [
            dict(name="Frank Vogel", teams="LAL", start_season_short="2019", end_season_short="2021", num_of_teams="1"),
            dict(name="Brad Stevens", teams="BOS", start_season_short="2013", end_season_short="2020", num_of_teams="0"),
            dict(name="Aaron Same", teams="BOS", start_season_short="2019", end_season_short="2019", num_of_teams=None),
            dict(name="Byron Scott", teams="BKN, NOH", start_season_short="2000", end_season_short="2009", num_of_teams="2"),
        ],
    )


def player_play_by_play(spark):
    base = dict(season="2019", g=70, gs=60, mp=2100.0, pos="C")
    return table(
        spark,
        "player_play_by_play",
        [
            base | dict(player="Nikola Jokić", player_id="jokicni01", team="DEN"),
            base | dict(player="Traded Man", player_id="t1", team="LAL", g=30, mp=300.0),
            base | dict(player="Traded Man", player_id="t1", team="2TM"),
            base | dict(player="Few Games", player_id="f1", team="LAL", g=9),
            base | dict(player="No Minutes", player_id="m1", team="LAL", mp=None),
        ],
    )


def box(spark):
    base = dict(season="2019", game_id="g1", team="lal", game_date="2020-01-01", matchup="LAL vs BOS", wl="W", min="35")
    return table(
        spark,
        "player_box_score",
        [
            base | dict(player_name="Ann", pts="10", reb="10", ast="10"),
            base | dict(player_name="ANN", game_id="g2", pts="30", reb="12", ast="11"),
            base | dict(player_name="Bob", pts="10", reb=None, oreb="2", dreb="3", ast="10", team="bos"),
            base | dict(player_name="Cid", pts="x", reb="10", ast="10"),
        ],
    )
