"""The users' queries over the integrated views. Every one takes DataFrames and gives one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import aggregates as A
from tessera.operators import windows as W
from tessera.operators.grams import GramIndex
from tessera.operators.resolve import fused


def roster(player_season: DataFrame, team: str, first: int, last: int) -> DataFrame:
    """Q5: players of a team in a range of seasons, with position and physique; latest season first."""
    rows = player_season.where((F.col("team_abbr") == team.upper()) & F.col("season").between(first, last))
    return rows.select("player_name", "season", "team_abbr", "position", "height_cm", "weight_kg").orderBy(F.col("season").desc_nulls_last(), F.col("player_name").asc_nulls_last())


def triple_doubles(box: DataFrame, first: int, last: int) -> DataFrame:
    """Q6: games of ten points, rebounds and assists by player, in a range of seasons."""
    conditions = [S.season_of(F.col("season")).between(first, last), F.col("pts") >= 10, F.col("reb") >= 10, F.col("ast") >= 10]
    counted = A.count_where(box, ["player_name"], conditions, "triple_doubles")
    return counted.orderBy(F.col("triple_doubles").desc(), F.col("player_name").asc_nulls_last())


def coach_and_arena(team_season: DataFrame, teams: list[str], season: int) -> DataFrame:
    """Q7: coach and arena of some teams in a season."""
    rows = team_season.where(F.col("team_abbr").isin([t.upper() for t in teams]) & (F.col("season") == season))
    return rows.select("season", "team_abbr", "team_name", "coach", "arena_name").orderBy("team_abbr")


def best_by_rating(player_season: DataFrame, team: str, season: int, n: int = 10) -> DataFrame:
    """Q8: the n players of a team's season with the highest efficiency rating."""
    rows = player_season.where((F.col("team_abbr") == team.upper()) & (F.col("season") == season))
    return rows.select("player_name", "team_abbr", "per", "ts_percent", "ws", "vorp").orderBy(F.col("per").desc_nulls_last(), F.col("player_name").asc_nulls_last()).limit(n)


def most_attended(game: DataFrame, season: int, n: int = 50) -> DataFrame:
    """Q9: the n games of a season with the most people."""
    columns = ["game_id", "game_date", "home_team_name", "away_team_name", "home_score", "away_score", "attendance"]
    return game.where(F.col("season") == season).select(*columns).orderBy(F.col("attendance").desc_nulls_last(), F.col("game_id").asc_nulls_last()).limit(n)


def compare_teams(team_season: DataFrame, teams: list[str], season: int) -> DataFrame:
    """Q10: advanced figures of some teams; points per game from rating and pace where unknown."""
    rows = team_season.where(F.col("team_abbr").isin([t.upper() for t in teams]) & (F.col("season") == season))
    points = F.round(F.coalesce("points_per_game", F.col("o_rtg") * F.col("pace") / 100.0), 1)
    return rows.select("season", "team_abbr", "team_name", "o_rtg", "d_rtg", "n_rtg", "pace", "srs", "ts_percent", points.alias("points_per_game")).orderBy("team_abbr")


def season_attendance(team_season: DataFrame, season: int) -> DataFrame:
    """Q11: people of a season by team, most first."""
    rows = team_season.where(F.col("season") == season)
    return rows.select("season", "team_abbr", "team_name", "attend", "attend_g").orderBy(F.col("attend").desc_nulls_last(), "team_abbr")


def home_attendance(game: DataFrame, team_season: DataFrame) -> DataFrame:
    """Q12: mean people at home by season and team; games meet teams by season and name."""
    names = team_season.select("season", F.lower("team_name").alias("home_team_name"), "team_abbr").distinct()
    joined = game.select("season", F.lower(F.concat_ws(" ", "home_team_city", "home_team_name")).alias("full"), F.lower("home_team_name").alias("home_team_name"), "attendance")
    by_full = joined.join(names.withColumnRenamed("home_team_name", "full"), ["season", "full"])
    return A.rounded_mean(by_full, ["season", "team_abbr"], "attendance", "avg_attendance", "games").orderBy("season", "team_abbr")


def attendance_and_strength(game: DataFrame) -> DataFrame:
    """Q13: mean people at home, part of home games won, and mean margin, by season and team."""
    keys = ["season", "home_team_name"]
    people = A.rounded_mean(game, keys, "attendance", "avg_attendance", "games_counted")
    wins = A.win_share(game, keys, "home_score", "away_score")
    return wins.join(people, keys, "left").select(*keys, "avg_attendance", "win_pct", "avg_margin", "games").orderBy(*keys)


def player_usage(play_by_play: DataFrame, player_season: DataFrame, team: str, season: int, n: int = 20) -> DataFrame:
    """Q14: minutes a game, percentage of the team's minutes, and advanced figures; the n players used most."""
    rows = play_by_play.where((F.col("team_abbr") == team.upper()) & (F.col("season") == season))
    shares = W.share_of_group(rows, ["season", "team_abbr"], "minutes", "pct_team_minutes")
    stats = player_season.select("season", "team_abbr", "player_id", "per", "ts_percent", "ws", "vorp")
    joined = shares.join(stats, ["season", "team_abbr", "player_id"], "left")
    return joined.select("player_name", "season", "team_abbr", "g", S.per_game(F.col("minutes"), F.col("g")).alias("mpg"), "pct_team_minutes", "per", "ts_percent", "ws", "vorp").orderBy(
        F.col("pct_team_minutes").desc_nulls_last(), F.col("player_name").asc_nulls_last()
    ).limit(n)


def team_names(sources: dict[str, DataFrame]) -> DataFrame:
    """Name of each team id, `City Name`, from the first source that knows it, with that source's name.

    Each source: (team_id, team_city, team_name). Within one, the least name of an id counts.
    """
    named, columns = None, {}
    for k, (source, df) in enumerate(sources.items()):
        full = F.nullif(F.trim(F.concat_ws(" ", "team_city", "team_name")), F.lit(""))
        own = df.where(F.col("team_id").isNotNull()).groupBy("team_id").agg(F.min(full).alias(f"__n{k}"))
        named = own if named is None else named.join(own, "team_id", "full_outer")
        columns[source] = F.col(f"__n{k}")
    return named.select("team_id", *fused("team", columns))


def with_team_names(result: DataFrame, names: DataFrame, id_column: str = "team_id") -> DataFrame:
    """Q15: a result with the names of its team ids; unknown ids keep a null name."""
    own = names.select(F.col("team_id").alias(id_column), F.col("team").alias("team_full_name"))
    return result.join(own, id_column, "left")


def with_game_dates(result: DataFrame, game: DataFrame) -> DataFrame:
    """Q16: a result with the date of its games, as the first ten characters."""
    dates = game.groupBy("game_id").agg(F.min(S.date_prefix(F.col("game_date"))).alias("game_date_iso"))
    return result.join(dates, "game_id", "left")


_SUMS = ["g", "pts", "ast", "reb", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta"]


def career(box: DataFrame) -> DataFrame:
    """Q17: sums of a career and rates of the sums, with the latest season's points; rates of nothing tried are null."""
    sums = box.groupBy("player_id").agg(*[F.sum(c).alias(c) for c in _SUMS])
    rates = sums.select(
        "*",
        S.per_game(F.col("pts"), F.col("g")).alias("ppg"),
        S.per_game(F.col("ast"), F.col("g")).alias("apg"),
        S.per_game(F.col("reb"), F.col("g")).alias("rpg"),
        S.made_percent(F.col("fgm"), F.col("fga")).alias("fg_pct"),
        S.made_percent(F.col("fg3m"), F.col("fg3a")).alias("fg3_pct"),
        S.made_percent(F.col("ftm"), F.col("fta")).alias("ft_pct"),
        S.effective_percent(F.col("fgm"), F.col("fg3m"), F.col("fga")).alias("efg_pct"),
    )
    latest = A.latest_by(box, "player_id", ["season", "g", "pts"], ["season", "g", "pts"]).select("player_id", F.col("season").alias("latest_season"), S.per_game(F.col("pts"), F.col("g")).alias("latest_ppg"))
    return rates.join(latest, "player_id", "left")


def scoring_by_season(box: DataFrame) -> DataFrame:
    """Q18: games, points, points a game, and threes, twos and free throws made, by season."""
    sums = box.groupBy("season").agg(F.sum("g").alias("games"), F.sum("pts").alias("pts"), F.sum("fg3m").alias("threes"), F.sum(F.col("fgm") - F.col("fg3m")).alias("twos"), F.sum("ftm").alias("free_throws"))
    return sums.withColumn("ppg", S.per_game(F.col("pts"), F.col("games"))).orderBy("season")


def head_to_head(games: DataFrame, home: str = "home", away: str = "away", home_pts: str = "home_pts", away_pts: str = "away_pts") -> DataFrame:
    """Q19: games, wins and mean difference of every pair (a < b), whichever played at home; a team against itself is no pair."""
    difference = F.col(home_pts) - F.col(away_pts)
    pairs = games.where(F.col(home) != F.col(away)).select(F.least(home, away).alias("a"), F.greatest(home, away).alias("b"), F.when(F.col(home) <= F.col(away), difference).otherwise(-difference).alias("diff"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("games"), F.count(F.when(F.col("diff") > 0, 1)).alias("a_w"), F.count(F.when(F.col("diff") < 0, 1)).alias("b_w"), F.round(F.avg("diff"), 4).alias("avg_diff"))


def meetings(games: DataFrame, a: str, b: str, number: int = 1, size: int = 10) -> DataFrame:
    """One page of the games of a pair, latest first, and how many there are."""
    rows = games.where(((F.col("home_id") == a) & (F.col("away_id") == b)) | ((F.col("home_id") == b) & (F.col("away_id") == a)))
    return W.page(rows, [F.col("game_date").desc_nulls_last(), F.col("game_id").asc_nulls_last()], number, size, total="total")


def conference_standings(games: DataFrame) -> DataFrame:
    """Q20: standings from games (game_id, game_date, home_id, away_id, home_pts, away_pts, conference)."""
    home_won = F.when(F.col("home_pts") > F.col("away_pts"), 1).otherwise(0)
    sides = F.inline(F.array(F.struct(F.col("home_id").alias("team"), home_won.alias("won")), F.struct(F.col("away_id").alias("team"), (1 - home_won).alias("won"))))
    rows = games.where("home_pts is not null and away_pts is not null").select("conference", "game_date", "game_id", sides)
    table = W.standings(rows, "conference", "team", ["game_date", "game_id"], "won", F.trunc("game_date", "month"))
    return table.orderBy("conference", "gb", F.col("w").desc(), "team")


def entities(player: DataFrame, team: DataFrame, game: DataFrame) -> DataFrame:
    """Players, teams and games as one table to search: (_entity, _id, _title, _subtitle, _extra)."""
    text = lambda *c: F.concat_ws(" ", *c)
    players = player.select(F.lit("player").alias("_entity"), F.col("player_id").cast("string").alias("_id"), F.col("full_name").alias("_title"), text("team_abbr", "country").alias("_subtitle"), text("from_year", "to_year").alias("_extra"))
    teams = team.select(F.lit("team").alias("_entity"), text("team_abbr", "season").alias("_id"), F.col("team_name").alias("_title"), text("team_abbr", "season").alias("_subtitle"), text("city", "arena_name").alias("_extra"))
    games = game.select(F.lit("game").alias("_entity"), F.col("game_id").cast("string").alias("_id"), text("home_team_name", F.lit("vs"), "away_team_name").alias("_title"), F.col("game_date").cast("string").alias("_subtitle"), F.col("season").cast("string").alias("_extra"))
    return players.unionByName(teams).unionByName(games)


def _folded(text: Column) -> Column:
    return S.fold_accents(F.lower(text))


def _searched() -> Column:
    """What tokens are looked for in."""
    return _folded(F.concat_ws(" ", "_title", "_subtitle", "_extra"))


def search_index(table: DataFrame, path: str) -> GramIndex:
    """An index of entities for `search`, stored below a path."""
    return GramIndex(table.sparkSession, path, ["_entity", "_id"]).build(table, _searched())


def search(table: DataFrame, query: str, entity: str | None = None, limit: int = 20, index: GramIndex | None = None) -> DataFrame:
    """Q21: rows that hold every token of the query somewhere, without regard to case, accents or order.

    The more tokens in the title, the higher; then by entity, title and id. An id comes once for each entity. An
    empty query finds nothing. With an index of the table only the rows that it names are looked at, to the same result.
    """
    fold = _folded
    tokens = sorted({t for t in query.lower().split() if t})
    if not tokens:
        return table.limit(0)
    if entity:
        table = table.where(F.col("_entity") == entity)
    if index:
        table = index.narrowed(table, [t.translate(str.maketrans(S.ACCENTED, S.PLAIN)) for t in tokens])
    everything = _searched()
    score: Column = F.lit(0)
    for t in tokens:
        folded = fold(F.lit(t))
        table = table.where(F.contains(everything, folded))
        score = score + F.when(F.contains(fold(F.col("_title")), folded), 1).otherwise(0)
    columns = ["_entity", "_id", "_title", "_subtitle", "_extra"]
    once = table.withColumn("__score", score).groupBy("_entity", "_id").agg(F.max_by(F.struct("_title", "_subtitle", "_extra", "__score"), F.struct("__score", "_title")).alias("r")).select("_entity", "_id", "r.*")
    return once.orderBy(F.col("__score").desc(), "_entity", F.col("_title").asc_nulls_last(), "_id").limit(limit).select(*columns)


def split_matchup(query: str) -> tuple[str, str] | None:
    """Both sides of `A vs B`, `A v B` or `A @ B`; None if the query is no matchup."""
    import re

    sides = re.split(r"\s(?:vs\.?|@|v)\s", query.strip(), maxsplit=1, flags=re.IGNORECASE)
    return (sides[0].strip(), sides[1].strip()) if len(sides) == 2 and all(s.strip() for s in sides) else None


def matchup(query: str, teams: DataFrame, games: DataFrame, index: GramIndex | None = None) -> DataFrame:
    """Q22: the record of the two teams of a query, the best hit for each side; no row if either side finds none.

    `teams`: entities to search, by `index` if given, whose ids are those of `games` (home_id, away_id).
    """
    sides = split_matchup(query)
    if sides is None:
        return head_to_head(games.limit(0), "home_id", "away_id")
    a, b = (search(teams, side, "team", 1, index).select(F.col("_id").alias(name)) for side, name in zip(sides, ("x", "y")))
    pair = a.crossJoin(b).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))  # one row each
    return head_to_head(games, "home_id", "away_id").join(F.broadcast(pair), ["a", "b"])


def game_detail(game: DataFrame, line_score: DataFrame, box: DataFrame) -> DataFrame:
    """Q23: each game with its period scores in order and both sides' sums; rebounds from their parts where unknown."""
    periods = line_score.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("period", "home_pts", "away_pts"))).alias("periods"))
    rebounds = F.coalesce("reb", F.coalesce("oreb", F.lit(0.0)) + F.coalesce("dreb", F.lit(0.0)))
    sums = box.groupBy("game_id", "team_abbr").agg(F.sum("pts").alias("pts"), F.sum(rebounds).alias("reb"), F.sum("ast").alias("ast"))
    sides = sums.groupBy("game_id").agg(F.array_sort(F.collect_list(F.struct("team_abbr", "pts", "reb", "ast"))).alias("sides"))
    return game.join(periods, "game_id", "left").join(sides, "game_id", "left")


def team_profile(player_season: DataFrame, team_season: DataFrame) -> DataFrame:
    """Q24: each team's roster of its latest season, its size, and the seasons of each of its names."""
    latest = player_season.groupBy("team_abbr").agg(F.max("season").alias("season"))
    now = player_season.join(latest, ["team_abbr", "season"]).groupBy("team_abbr", "season")
    players = now.agg(F.array_sort(F.collect_set(F.struct("player_name", "position"))).alias("roster")).withColumn("roster_size", F.size("roster"))
    ranges = team_season.where("team_name is not null").groupBy("team_abbr", "team_name").agg(F.min("season").alias("first"), F.max("season").alias("last"))
    names = ranges.groupBy("team_abbr").agg(F.array_sort(F.collect_list(F.struct("first", "last", "team_name"))).alias("names"))
    return players.join(names, "team_abbr", "full_outer")
