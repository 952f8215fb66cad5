"""Integrated views on hand-made fixtures, with the decisions where sources disagree."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import checks as C
from tessera.plans import queries as Q
from tessera.plans import views as V
from tests import fixtures as X


@pytest.fixture(scope="module")
def players(spark):
    return V.global_player_season(X.player_totals(spark), X.common_player_info(spark), X.player_per_game(spark), X.player_advanced(spark), X.player_season_info(spark), X.seasons_stats(spark)).cache()


@pytest.fixture(scope="module")
def teams(spark):
    return V.global_team_season(X.team_summaries(spark), X.team_stats_per_game(spark), X.table(spark, "team_stats_per_100", []), X.table(spark, "opponent_stats_per_100", []), X.team_totals(spark), X.team_abbrev(spark)).cache()


@pytest.fixture(scope="module")
def dim(spark):
    return V.dim_team_season(X.team_summaries(spark), X.team_abbrev(spark), X.team_details(spark), X.nba_head_coaches(spark)).cache()


def test_players_are_resolved_by_three_rules(players):
    got = {(r["player_name"], r["team_abbr"]): r for r in players.collect()}
    jokic = got["Nikola Jokic", "DEN"]
    assert (jokic["player_id"], jokic["position"], jokic["src_position"], jokic["height_cm"], jokic["weight_kg"]) == ("jokicni01", "CENTER", "common_player_info", 211, 129)
    assert (jokic["per"], jokic["ts_percent"], jokic["ws"], jokic["vorp"], jokic["experience_years"], jokic["pts_per_game"]) == (26.3, 58.0, 11.8, 7.3, 5, 20.0)
    luka = got["Luka Doncic", "DAL"]  # by name; ratings by the totals' own id
    assert (luka["player_id"], luka["season"], luka["position"], luka["src_position"], luka["weight_kg"], luka["per"], luka["ts_percent"]) == ("doncilu01", 2019, "PG", "player_totals", 104, 24.0, 58.6)
    assert (got["JR Smith", "LAL"]["player_id"], got["JR Smith", "LAL"]["height_cm"], got["JR Smith", "LAL"]["g"]) == ("smithjr01", None, 0)
    assert got["Travis Man", "LAL"]["player_id"] == "mantr"  # last name and first two letters
    nobody = got["Nobody Known", "LAL"]
    assert (nobody["player_id"], nobody["per"], nobody["ts_percent"], nobody["vorp"]) == ("n1", 10.0, 40.0, 0.0)


def test_players_keep_every_roster_row(players, spark):
    assert players.count() == 7
    C.require_unique(players, ["player_id", "season", "team_abbr"])
    assert V.global_player_season(X.player_totals(spark).limit(0), X.common_player_info(spark), X.player_per_game(spark), X.player_advanced(spark), X.player_season_info(spark), X.seasons_stats(spark)).count() == 0


def test_teams(teams):
    got = {r["team_abbr"]: r for r in teams.collect()}
    assert set(got) == {"LAL", "SEA", "BOS", "NJN"} and len(teams.columns) == 111
    assert (got["LAL"]["team_name"], got["LAL"]["attend"], got["LAL"]["points_per_game"], got["LAL"]["tpg_fg"], got["LAL"]["tpg_fg_percent"]) == ("los angeles lakers", 812292.0, 113.4, 42.0, 0.48)
    assert round(got["LAL"]["attend_g"], 2) == round(812292 / 71, 2)
    assert (got["SEA"]["team_name"], got["SEA"]["attend"], got["SEA"]["points_per_game"], got["SEA"]["tot_minutes"]) == ("oklahoma city thunder", 1_200_000.0, 100.0, 19000.0)
    assert (got["BOS"]["season"], got["BOS"]["team_name"], got["BOS"]["attend"], got["BOS"]["points_per_game"]) == (2019, "boston celtics", None, None)
    assert got["NJN"]["team_name"] == "brooklyn nets"


def test_games(spark):
    got = {r["game_id"]: r for r in V.global_game(X.games(spark)).collect()}
    assert (got["g1"]["game_date"], got["g1"]["season"], got["g1"]["attendance"], got["g1"]["winner"], got["g1"]["home_score"]) == (datetime.date(2020, 1, 1), 2019, 19234, "lakers", 110)
    assert (got["g2"]["season"], got["g2"]["attendance"]) == (2020, 19234)
    assert (got["g3"]["season"], got["g3"]["attendance"], got["g3"]["home_score"]) == (2019, 19234, None)
    assert (got["g4"]["game_date"], got["g4"]["season"], got["g4"]["attendance"], got["g4"]["home_team_id"]) == (None, None, None, None)


def test_tenures_and_team_dimension(spark, rows, dim):
    assert rows(V.coach_tenures(X.nba_head_coaches(spark)).where("coach = 'Byron Scott'")) == [("Byron Scott", "BRK", 2000, 2004), ("Byron Scott", "NOP", 2005, 2009)]
    got = {r["team_abbr"]: r for r in dim.collect()}
    assert (got["LAL"]["coach"], got["LAL"]["src_coach"], got["LAL"]["src_arena"], got["LAL"]["arena_capacity"]) == ("frank vogel", "nba_head_coaches", "team_summaries", None)
    bos = got["BOS"]  # two coaches hold the season: the one that the details name
    assert (bos["coach"], bos["arena_name"], bos["src_arena"], bos["arena_capacity"], bos["city"]) == ("brad stevens", "td garden", "team_details", 18624, "boston")
    assert (got["NJN"]["coach"], got["NJN"]["team_abbr"]) == ("byron scott", "NJN")  # codes of today on both sides, own code kept
    assert (got["SEA"]["coach"], got["SEA"]["src_coach"], got["SEA"]["src_arena"]) == (None, None, None)


def test_no_cartesian_product(spark, dim, players):
    for df in (dim, players):
        assert "CartesianProduct" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_points_and_dimensions(spark, rows, tmp_path):
    fact, teams = V.prepare_team_points(X.games(spark), str(tmp_path))
    assert fact.count() == 7 and V.team_points(X.games(spark), complete=True).count() == 2
    assert rows(teams) == [("1", "Los Angeles", "Lakers"), ("2", "Boston", "Celtics"), ("3", None, None)]
    stored = spark.read.schema(fact.schema).parquet(f"{tmp_path}/team_game_points")
    assert rows(C.difference(stored.select(fact.columns), fact)) == []
    assert len(list((tmp_path / "teams_dim_tsv").glob("part-*"))) == 1
    assert rows(V.teams_from_details(fact, X.team_details(spark), ["abbreviation"])) == [("1", "Los Angeles", "Los Angeles Lakers"), ("2", "Boston", "Boston Celtics"), ("3", "", "")]


def test_multifactor_fact(spark):
    points = spark.createDataFrame([("2019", "lal", 9000)], "season string, abbreviation string, pts int")
    per_game = X.table(spark, "player_per_game", [dict(season="2019", player_id="t1", team="TOT", mp_per_game=18.0, pts_per_game=9.0), dict(season="2019", player_id="jokicni01", team="DEN", mp_per_game=0.0, pts_per_game=1.0)])
    got = {r["player_id"]: r for r in V.q4_multifactor(X.player_play_by_play(spark), X.player_advanced(spark), per_game, points).collect()}
    assert set(got) == {"jokicni01", "t1"}
    assert (got["t1"]["usage_pct"], got["t1"]["pts_per_36"], got["t1"]["team_pts"], got["t1"]["vorp"]) == (15.0, 18.0, 9000.0, 0.1)
    assert (got["jokicni01"]["usage_pct"], got["jokicni01"]["pts_per_36"], got["jokicni01"]["team_pts"]) == (30.0, None, None)


def test_relational_layer(spark, rows):
    totals, per_game = V.std_player_totals(X.player_totals(spark)), V.std_player_per_game(X.player_per_game(spark))
    bio = V.std_player_bio(X.table(spark, "player_bio", [dict(player_id=" jokicni01 ", full_name=" Nikola JOKIĆ", position="C", height="6-11", weight="284"), dict(player_id=" ")]))
    advanced = V.std_player_advanced(X.player_advanced(spark))
    out = V.relational_player_season(totals, per_game, bio, advanced)
    got = {(r["player_id"], r["team_abbr"]): r for r in out.collect()}
    assert (got["jokicni01", "DEN"]["src_position"], got["jokicni01", "DEN"]["src_height"], got["jokicni01", "DEN"]["pts_per_game"], got["jokicni01", "DEN"]["per"]) == ("player_bio", "player_bio", 20.0, 26.34)
    assert (got["o1", "BOS"]["season"], got["o1", "BOS"]["src_position"]) == (None, "player_per_game")
    assert out.where("player_id = 't1'").count() == 3
    assert V.relational_player_season(totals, per_game, bio, advanced, by_team=False).where("player_id = 't1'").count() == 3
    flat = X.table(spark, "team_details_flat", [dict(team_id="2", abbreviation="bos", nickname="Celtics", city="Boston", arena="TD Garden", headcoach="Brad")])
    fused = V.relational_team_season(V.std_team_summaries(X.team_summaries(spark)), V.std_team_abbrev(X.team_abbrev(spark)), V.std_team_details(flat))
    teams = {r["team_abbr"]: r for r in fused.collect()}
    assert (teams["BOS"]["src_arena"], teams["BOS"]["src_coach"], teams["LAL"]["src_arena"], teams["SEA"]["src_arena"]) == ("team_details", "team_details", "team_summaries", None)
    assert (teams["VAN"]["season"], teams["VAN"]["team_name"]) == (None, "vancouver grizzlies")
    assert V.std_games(X.table(spark, "games_flat", [dict(game_id="g", home_score=1)])).first()["home_score"] == 1


def test_user_queries(spark, players, teams, dim, rows):
    assert [r["player_name"] for r in Q.roster(players, "lal", 2019, 2021).collect()] == ["JR Smith", "Nobody Known", "Travis Man"]
    box = V.player_game_box(X.box(spark))
    assert rows(Q.triple_doubles(box, 2010, 2020)) == [("ann", 2)]
    assert [r["coach"] for r in Q.coach_and_arena(dim, ["bos", "lal"], 2019).collect()] == ["brad stevens", "frank vogel"]
    assert [r["player_name"] for r in Q.best_by_rating(players, "LAL", 2019, 2).collect()] == ["Nobody Known", "Travis Man"] or Q.best_by_rating(players, "LAL", 2019, 2).first()["per"] == 10.0
    game = V.global_game(X.games(spark))
    assert [r["game_id"] for r in Q.most_attended(game, 2019, 5).collect()] == ["g1", "g3"]
    assert Q.compare_teams(teams, ["lal"], 2019).first()["points_per_game"] == 113.4
    assert [r["team_abbr"] for r in Q.season_attendance(teams, 2019).collect()] == ["SEA", "LAL", "BOS"]
    assert rows(Q.home_attendance(game, dim)) == [(2019, "LAL", 19234, 2)]
    strength = {(r["season"], r["home_team_name"]): r for r in Q.attendance_and_strength(game).collect()}
    assert (strength[2019, "lakers"]["win_pct"], strength[2019, "lakers"]["avg_margin"], strength[2019, "lakers"]["avg_attendance"]) == (0.5, 10.0, 19234)
    usage = Q.player_usage(V.player_play_by_play(X.player_play_by_play(spark)), players, "DEN", 2019).first()
    assert (usage["mpg"], usage["pct_team_minutes"], usage["per"]) == (30.0, 100.0, 26.3)
    names = Q.team_names({"a": spark.createDataFrame([("1", "Los Angeles", "Lakers"), ("2", None, None)], "team_id string, team_city string, team_name string"), "b": spark.createDataFrame([("2", "Boston", "Celtics")], "team_id string, team_city string, team_name string")})
    assert rows(names) == [("1", "Los Angeles Lakers", "a"), ("2", "Boston Celtics", "b")]
    result = spark.createDataFrame([("1", "g1"), ("9", "g9")], "team_id string, game_id string")
    assert rows(Q.with_team_names(result, names).select("team_id", "team_full_name")) == [("1", "Los Angeles Lakers"), ("9", None)]
    assert rows(Q.with_game_dates(result, game).select("game_id", "game_date_iso")) == [("g1", "2020-01-01"), ("g9", None)]
    profile = {r["team_abbr"]: r for r in Q.team_profile(players, teams).collect()}
    assert profile["LAL"]["roster_size"] == 3 and profile["LAL"]["names"][0]["first"] == 2019
    detail = {r["game_id"]: r for r in Q.game_detail(game, X.table(spark, "line_score", [dict(game_id="g1", period=2, home_pts=20, away_pts=1), dict(game_id="g1", period=1, home_pts=30, away_pts=2)]), box).collect()}
    assert [p["period"] for p in detail["g1"]["periods"]] == [1, 2] and [s["reb"] for s in detail["g1"]["sides"]] == [5.0, 20.0] and detail["g3"]["periods"] is None


def test_career_and_seasons(spark, rows):
    box = X.table(spark, "player_season_box", [dict(player_id="p", season=2019, g=10, pts=100.0, ast=0.0, reb=1.0, fgm=40.0, fga=80.0, fg3m=10.0, fg3a=0.0, ftm=5.0, fta=10.0), dict(player_id="p", season=2020, g=10, pts=300.0, ast=0.0, reb=1.0, fgm=40.0, fga=80.0, fg3m=10.0, fg3a=0.0, ftm=5.0, fta=10.0)])
    c = Q.career(box).first()
    assert (c["ppg"], c["fg_pct"], c["fg3_pct"], c["ft_pct"], c["efg_pct"], c["latest_season"], c["latest_ppg"]) == (20.0, 50.0, None, 50.0, 56.3, 2020, 30.0)
    assert [(r["season"], r["ppg"], r["twos"]) for r in Q.scoring_by_season(box).collect()] == [(2019, 10.0, 30.0), (2020, 30.0, 30.0)]


def test_meetings_search_and_matchups(spark, rows, dim):
    d = datetime.date
    games = spark.createDataFrame(
        [("g1", d(2020, 1, 1), "LAL 2019", "BOS 2019", 110, 100, "w"), ("g2", d(2020, 1, 5), "BOS 2019", "LAL 2019", 90, 95, "w"), ("g3", d(2020, 1, 7), "BOS 2019", "SEA 2019", 90, 95, "w")],
        "game_id string, game_date date, home_id string, away_id string, home_pts int, away_pts int, conference string",
    )
    assert rows(Q.head_to_head(games, "home_id", "away_id")) == [("BOS 2019", "LAL 2019", 2, 0, 2, -7.5), ("BOS 2019", "SEA 2019", 1, 0, 1, -5.0)]
    assert [r["game_id"] for r in Q.meetings(games, "LAL 2019", "BOS 2019", 1, 1).collect()] == ["g2"]
    assert [tuple(r) for r in Q.conference_standings(games).collect()][0] == ("w", "LAL 2019", 2, 0, 0.0, "W2")
    every = Q.entities(V.dim_player(X.common_player_info(spark)), dim, V.global_game(X.games(spark)))
    assert [r["_id"] for r in Q.search(every, "jokic NIKOLA").collect()] == ["jokicni01"]
    assert [r["_entity"] for r in Q.search(every, "celtics").collect()] == ["game", "game", "game", "team"] and Q.search(every, "celtics", "team").count() == 1
    assert Q.search(every, "  ").count() == 0 and Q.search(every, "celtics zebra").count() == 0
    assert Q.split_matchup("Lakers VS. Celtics") == ("Lakers", "Celtics") and Q.split_matchup("a @ b") == ("a", "b") and Q.split_matchup("vs Celtics") is None
    assert rows(Q.matchup("lakers v celtics", every, games)) == [("BOS 2019", "LAL 2019", 2, 0, 2, -7.5)]
    assert Q.matchup("lakers", every, games).count() == 0 and Q.matchup("lakers vs zebra", every, games).count() == 0


def test_win_model(spark, tmp_path):
    from tessera.plans.winmodel import fit_home_win, game_features

    start = datetime.date(2020, 1, 1)
    played = [(f"g{i}", start + datetime.timedelta(days=i), "ab"[i % 2] if i % 3 else "c", "c" if i % 3 else "ab"[i % 2], 100 + 10 * (i % 3 == 0), 105) for i in range(120)]
    features = game_features(spark.createDataFrame(played, "game_id string, game_date date, home_id string, away_id string, home_pts int, away_pts int"))
    first = features.where("game_id = 'g0'").first()
    assert (first["home_form"], first["away_form"], first["home_rest"], first["home_baseline"]) == (0.5, 0.5, 14.0, 0.5)
    model, scored = fit_home_win(features, model_path=str(tmp_path / "m"))
    got = scored.collect()
    assert 5 < len(got) < 60 and all(abs(r["p_home_win"] + r["p_away_win"] - 1) < 1e-9 for r in got)
    assert sum((r["winner"] == r["home_id"]) == bool(r["home_win"]) for r in got) / len(got) > 0.9
    assert (tmp_path / "m").exists()
