"""The integrated views: players, teams and games of several sources in one schema.

Each view takes the staging tables it needs as DataFrames. Keys are normalised once on both sides of every join;
text is never cast plainly. Where sources disagree the order of preference is written as it is applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import joins as J
from tessera.operators import reshape as P
from tessera.operators import resolve as R
from tessera.operators.aggregates import first_known
from tessera.sources.registry import Registry
from tessera.sources.sinks import write_parquet, write_tsv


def franchise_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(code, name) for name, codes in S.FRANCHISES.items() for code in codes], "code string, name string")


def canonical_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(old, new) for new, olds in S.CANONICAL.items() for old in olds], "old string, new string")


def _season() -> Column:
    return S.season_of(F.col("season"))


# --- players


def global_player_season(player_totals: DataFrame, common_player_info: DataFrame, player_per_game: DataFrame, player_advanced: DataFrame, player_season_info: DataFrame, seasons_stats: DataFrame) -> DataFrame:
    """One row for each player, season and team of the totals, with identity, physique and ratings.

    Players are resolved to the register by id, then by name, then by last name and first two letters. Ratings
    are looked up by the register's id, or else by the totals' own; unknown ones come from the historical table by name.
    """
    words = F.col("player")
    totals = player_totals.select(
        F.col("player_id").alias("pt_id"),
        _season().alias("season"),
        S.upper_trim(F.col("team")).alias("team_abbr"),
        S.norm_name(words).alias("name_key"),
        S.last_name_key(words).alias("last_key"),
        S.first_letters_key(words).alias("first_key"),
        S.upper_trim(F.col("pos")).alias("pt_position"),
        F.col("player"),
        *[F.coalesce(S.to_int_loose(F.col(c)), F.lit(0)).alias(c) for c in ("g", "gs")],
        *[S.to_double(F.col(c)).alias(c) for c in ("pts", "ast", "trb")],
    )
    keys = ["pt_id", "season", "team_abbr"]
    roster = totals.groupBy(*keys, "name_key", "last_key", "first_key", "pt_position").agg(*[F.max(c).alias(c) for c in ("player", "g", "gs", "pts", "ast", "trb")])
    info = common_player_info.select(
        F.col("player_id").alias("cpi_id"),
        "full_name",
        F.col("position").alias("cpi_position"),
        "height",
        "weight",
        S.norm_name(F.col("full_name")).alias("cpi_name"),
        S.norm_name(F.col("last_name")).alias("cpi_last"),
        F.substring(S.norm_name(F.col("first_name")), 1, 2).alias("cpi_first"),
    )
    rules = [R.Rule(1, ("pt_id",), ("cpi_id",)), R.Rule(2, ("name_key",), ("cpi_name",)), R.Rule(3, ("last_key", "first_key"), ("cpi_last", "cpi_first"))]
    # a roster row without an id is told apart by its name, so that unrelated players don't pool
    found = R.resolve(roster, info, rules, [*keys, "name_key"], "cpi_id")
    position = R.fused("position", {"common_player_info": F.col("match.cpi_position"), "player_totals": F.col("pt_position")})
    players = found.select(
        "pt_id",
        F.coalesce("match.cpi_id", "pt_id").alias("player_id"),
        S.fold_accents(F.coalesce("match.full_name", "player")).alias("player_name"),
        "season",
        "team_abbr",
        F.upper(position[0]).alias("position"),
        position[1],
        S.height_cm(F.col("match.height")).alias("height_cm"),
        S.weight_kg(F.col("match.weight")).alias("weight_kg"),
        *["g", "gs", "pts", "ast", "trb"],
    )
    per_game = player_per_game.groupBy("player_id", _season().alias("season"), S.upper_trim(F.col("team")).alias("team_abbr")).agg(*[F.avg(c).alias(c) for c in ("pts_per_game", "ast_per_game", "trb_per_game")])
    advanced = player_advanced.groupBy("player_id", _season().alias("season")).agg(*[F.avg(c).alias(f"adv_{c}") for c in ("per", "ts_percent", "ws", "bpm", "vorp")])
    experience = player_season_info.groupBy("player_id", _season().alias("season")).agg(F.max("experience").alias("experience_years"))
    history = seasons_stats.groupBy(S.norm_name(F.col("player")).alias("history_key"), S.season_of(F.col("year")).alias("season")).agg(*[F.avg(c).alias(f"old_{c}") for c in ("per", "ts_percent", "ws", "vorp")])
    out = J.either_key_join(players, per_game, "player_id", "pt_id", "player_id", ["season", "team_abbr"], ["pts_per_game", "ast_per_game", "trb_per_game"])
    out = J.either_key_join(out, advanced, "player_id", "pt_id", "player_id", ["season"], [c for c in advanced.columns if c.startswith("adv_")])
    out = out.join(experience, ["player_id", "season"], "left").withColumn("history_key", S.norm_name(F.col("player_name"))).join(history, ["history_key", "season"], "left")
    known = lambda c: F.coalesce(f"adv_{c}", f"old_{c}")
    return out.select(
        *["player_id", "player_name", "season", "team_abbr", "position", "height_cm", "weight_kg", "g", "gs", "pts", "ast", "trb", "pts_per_game", "ast_per_game", "trb_per_game"],
        F.round(known("per"), 1).alias("per"),
        S.percent_scale(known("ts_percent")).alias("ts_percent"),
        F.round(known("ws"), 1).alias("ws"),
        F.col("adv_bpm").alias("bpm"),
        F.round(known("vorp"), 1).alias("vorp"),
        "experience_years",
        "src_position",
    )


def dim_player(common_player_info: DataFrame) -> DataFrame:
    """The register of players, each row once, names in lower case."""
    lower = {"full_name": "full_name", "first_name": "first_name", "last_name": "last_name", "country": "country", "school": "college"}
    return common_player_info.select(
        "player_id",
        *[F.lower(c).alias(n) for c, n in lower.items()],
        *["birthdate", "height", "weight"],
        F.upper("team_abbreviation").alias("team_abbr"),
        *["from_year", "to_year", "draft_year", "draft_round", "draft_number"],
    ).distinct()


def player_game_box(player_box_score: DataFrame) -> DataFrame:
    """One row for each player and game; figures as numbers, text as compared."""
    numbers = ["fgm", "fga", "fg_pct", "fg3m", "fg3a", "fg3_pct", "ftm", "fta", "ft_pct", "oreb", "dreb", "reb", "ast", "stl", "blk", "tov", "pf", "pts", "plus_minus"]
    return player_box_score.select(
        "season",
        "game_id",
        F.lower("player_name").alias("player_name"),
        F.upper("team").alias("team_abbr"),
        S.tolerant_date(F.col("game_date")).alias("game_date"),
        F.lower("matchup").alias("matchup"),
        F.lower("wl").alias("wl"),
        S.to_double(F.col("min")).alias("minutes"),
        *[S.to_double(F.col(c)).alias(c) for c in numbers],
    )


def player_play_by_play(play_by_play: DataFrame) -> DataFrame:
    """Minutes of each player, team and season."""
    return play_by_play.select(_season().alias("season"), F.lower("player").alias("player_name"), "player_id", F.upper("team").alias("team_abbr"), F.col("pos").alias("position"), "g", "gs", S.to_double(F.col("mp")).alias("minutes"))


# --- teams


def _by_team(df: DataFrame, prefix: str) -> DataFrame:
    """A season table keyed by (k_season, k_abbr), one row each, its columns as a struct."""
    own = df.select(_season().alias("k_season"), S.upper_trim(F.col("abbreviation")).alias("k_abbr"), F.struct(*df.columns).alias(prefix))
    return own.groupBy("k_season", "k_abbr").agg(F.max(prefix).alias(prefix))


#: Columns of a side table and the prefix or names that they get in the wide view.
_FIGURES = ["fg", "fga", "fg_percent", "x3p", "x3pa", "x3p_percent", "x2p", "x2pa", "x2p_percent", "ft", "fta", "ft_percent", "orb", "drb", "trb", "ast", "stl", "blk", "tov", "pf", "pts"]
_RATINGS = ["mov", "sos", "srs", "o_rtg", "d_rtg", "n_rtg", "pace", "f_tr", "x3p_ar", "ts_percent", "e_fg_percent", "tov_percent", "orb_percent", "ft_fga", "opp_e_fg_percent", "opp_tov_percent", "drb_percent", "opp_ft_fga"]


def global_team_season(team_summaries: DataFrame, team_stats_per_game: DataFrame, team_stats_per_100: DataFrame, opponent_stats_per_100: DataFrame, team_totals: DataFrame, team_abbrev: DataFrame) -> DataFrame:
    """About 85 columns for each season and team of the summaries; five tables are joined by season and code.

    People come from the season's number, or from the number a game and the games; points a game from their table, or from
    the totals. Rows without a season or code are left out.
    """
    spark = team_summaries.sparkSession
    base = team_summaries.select(_season().alias("k_season"), S.upper_trim(F.col("abbreviation")).alias("k_abbr"), F.struct(*team_summaries.columns).alias("ts"))
    sides = {"tpg": team_stats_per_game, "t100": team_stats_per_100, "opp": opponent_stats_per_100, "tot": team_totals, "ta": team_abbrev}
    for name, df in sides.items():
        base = base.join(_by_team(df, name), ["k_season", "k_abbr"], "left")
    code = F.coalesce("ts.abbreviation", "tpg.abbreviation", "t100.abbreviation", "ta.abbreviation")
    base = base.withColumn("team_abbr", code).where(F.col("k_season").isNotNull() & F.col("team_abbr").isNotNull() & (F.trim("team_abbr") != ""))
    base = J.mapped(base, franchise_names(spark), S.upper_trim(F.col("team_abbr")), "team_name", F.coalesce(F.lower("ts.team"), F.lower("ta.team_name")))
    games = F.coalesce(S.to_double(F.col("tpg.g")), S.to_double(F.col("tot.g")))
    games = F.when(games > 0, games)
    season_people, game_people = S.number_with_commas(F.col("ts.attend")), S.number_with_commas(F.col("ts.attend_g"))
    of = lambda side, suffix, c: F.col(f"{side}.{c}" if c.endswith("percent") else f"{side}.{c}{suffix}")
    tpg = [of("tpg", "_per_game", c).alias(f"tpg_{c}") for c in _FIGURES]
    per_100 = [of("t100", "_per_100_poss", c).alias(f"t100_{c}" if c.endswith("percent") else f"{c}_per_100_poss") for c in _FIGURES]
    opponent = [F.col(f"opp.opp_{c}" if c.endswith("percent") else f"opp.opp_{c}_per_100_poss") for c in _FIGURES]
    totals = [F.col(f"tot.{c}").alias(f"tot_{c}") for c in _FIGURES]
    return base.select(
        F.col("k_season").alias("season"),
        "team_abbr",
        "team_name",
        F.coalesce(season_people, game_people * games).alias("attend"),
        F.coalesce(game_people, S.safe_ratio(season_people, games)).alias("attend_g"),
        *[F.col(f"ts.{c}") for c in _RATINGS],
        F.col("tpg.g").alias("games_pg"),
        F.col("tpg.mp_per_game").alias("tpg_minutes"),
        *tpg,
        F.coalesce("tpg.pts_per_game", S.safe_ratio(F.col("tot.pts"), F.col("tot.g"))).alias("points_per_game"),
        *per_100,
        *opponent,
        F.col("tot.mp").alias("tot_minutes"),
        *totals,
    )


def coach_tenures(nba_head_coaches: DataFrame) -> DataFrame:
    """(coach, team_code, seg_start, seg_end): each team of a coach's list gets an even part of the tenure, in order."""
    parts = F.filter(F.transform(F.split(F.upper("teams"), ","), lambda c: F.trim(c)), lambda c: c != "")
    known = nba_head_coaches.select(F.col("name").alias("coach"), "teams", S.to_int(F.col("start_season_short")).alias("start"), S.to_int(F.col("end_season_short")).alias("end"), F.nullif(S.to_int(F.col("num_of_teams")), F.lit(0)).alias("stated"))
    rows = P.ordered_members(known.where("start <= end"), parts, "code", "ord", "listed")
    first, last = P.even_segment(F.col("start"), F.col("end"), F.col("ord"), F.coalesce("stated", "listed", F.lit(1)))
    rows = rows.select("coach", "code", first.alias("seg_start"), last.alias("seg_end"))
    return J.mapped(rows, canonical_codes(rows.sparkSession), F.col("code"), "team_code", F.col("code")).select("coach", "team_code", "seg_start", "seg_end")


def dim_team_season(team_summaries: DataFrame, team_abbrev: DataFrame, team_details: DataFrame, nba_head_coaches: DataFrame) -> DataFrame:
    """Each season and team with city, arena, coach and league, and which source the arena and the coach are from.

    A coach is one whose segment holds the season, at a team of the same code of today; of several the one the details name,
    then the nearest to an end of the segment, then by name. Without one, the details' coach.
    """
    spark = team_summaries.sparkSession
    summaries = team_summaries.select(_season().alias("season"), S.upper_trim(F.col("abbreviation")).alias("team_abbr"), F.lower("team").alias("ts_name"), F.lower("arena").alias("ts_arena"), F.col("lg").alias("league")).distinct()
    abbrev = team_abbrev.groupBy(_season().alias("season"), S.upper_trim(F.col("abbreviation")).alias("team_abbr")).agg(F.min(F.lower("team_name")).alias("ta_name"))
    details = team_details.groupBy(S.upper_trim(F.col("abbreviation")).alias("team_abbr")).agg(
        F.min(F.struct(F.lower("nickname").alias("nickname"), F.lower("meta.city").alias("city"), F.lower("meta.arena.name").alias("arena"), S.to_int_loose(F.col("meta.arena.capacity")).alias("capacity"), F.lower("meta.head_coach").alias("coach"))).alias("td")
    )
    base = summaries.where(F.col("season").isNotNull() & (F.col("team_abbr") != "")).join(abbrev, ["season", "team_abbr"], "left").join(details, "team_abbr", "left")
    base = J.mapped(base, canonical_codes(spark), F.col("team_abbr"), "team_code", F.col("team_abbr"))
    arena = R.fused("arena_name", {"team_summaries": F.col("ts_arena"), "team_details": F.col("td.arena")})
    base = base.select("season", "team_abbr", "team_code", F.coalesce("ts_name", "ta_name", "td.nickname").alias("team_name"), F.col("td.city").alias("city"), *arena, F.col("td.capacity").alias("arena_capacity"), F.col("td.coach").alias("td_coach"), "league")
    tenures = J.seasons_of_range(coach_tenures(nba_head_coaches), "seg_start", "seg_end")
    candidates = base.join(tenures, ["season", "team_code"], "left")
    name = F.lower("coach")
    order = [
        F.when(F.col("coach").isNotNull(), 0).otherwise(1),
        F.when(name == F.col("td_coach"), 0).otherwise(1),
        S.least_known(F.abs(F.col("season") - F.col("seg_start")), F.abs(F.col("season") - F.col("seg_end"))).asc_nulls_last(),
        F.coalesce(name, "td_coach").asc_nulls_last(),
        F.col("team_name").asc_nulls_last(),
        F.col("arena_name").asc_nulls_last(),
    ]
    best = R.best_candidate(candidates, ["season", "team_abbr"], order)
    coach = R.fused("coach", {"nba_head_coaches": name, "team_details": F.col("td_coach")})
    return best.select("season", "team_abbr", "team_name", "city", "arena_name", "arena_capacity", *coach, "league", "src_arena_name").withColumnRenamed("src_arena_name", "src_arena")


# --- games


def global_game(games: DataFrame) -> DataFrame:
    """One row for each game document: dates, season, both sides, people."""
    date = S.tolerant_date(F.col("date"))
    side = lambda s: [F.col(f"{s}.team_id").alias(f"{s}_team_id"), F.lower(f"{s}.team_city").alias(f"{s}_team_city"), F.lower(f"{s}.team_name").alias(f"{s}_team_name"), S.to_int_loose(F.col(f"{s}.score")).alias(f"{s}_score")]
    return games.select("game_id", date.alias("game_date"), S.season_of(F.col("season"), date).alias("season"), *side("home"), *side("away"), F.lower("winner").alias("winner"), S.attendance(F.col("attendance")).alias("attendance"))


def team_points(games: DataFrame, complete: bool = False) -> DataFrame:
    """U1 of N12: one row for each side of a game. Rows need a team; if `complete`, also season, game and points."""
    side = lambda s, o: {"team_id": F.col(f"{s}.team_id"), "team_city": F.col(f"{s}.team_city"), "team_name": F.col(f"{s}.team_name"), "opponent_team_id": F.col(f"{o}.team_id"), "points": S.to_int_loose(F.col(f"{s}.score"))}
    rows = P.unpivot_sides(games, {"game_id": F.col("game_id"), "season": F.col("season")}, {"H": side("home", "away"), "A": side("away", "home")}, "home_away")
    rows = rows.where(F.col("team_id").isNotNull())
    return rows.where((F.trim("team_id") != "") & (F.col("season") != "") & (F.col("game_id") != "") & F.col("points").isNotNull()) if complete else rows


def teams_dim(points: DataFrame) -> DataFrame:
    """The dimension of N12: each team with its first known city and name, in order of game."""
    return first_known(points, "team_id", ["team_city", "team_name"], "game_id")


def teams_from_details(points: DataFrame, details: DataFrame, order: list[str]) -> DataFrame:
    """A4: every team of the facts, with city and name of its last detail row in an order of the details' columns.

    The name is the row's, or else its nickname; rows with neither a name nor a city don't count. What the row doesn't have is empty, as is a team without details.
    """
    name = F.coalesce(F.nullif(F.col("team_name"), F.lit("")), F.nullif(F.col("nickname"), F.lit("")))
    city = F.nullif(F.col("meta.city"), F.lit(""))
    last = F.max_by(F.struct(city.alias("team_city"), name.alias("team_name")), F.when(name.isNotNull() | city.isNotNull(), F.struct(*order)))
    known = details.groupBy("team_id").agg(last.alias("last"))
    joined = points.select("team_id").distinct().join(known, "team_id", "left")
    return joined.select("team_id", *[F.coalesce(F.col("last")[c], F.lit("")).alias(c) for c in ("team_city", "team_name")])


def prepare_team_points(games: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Writes fact (parquet by season, and text) and dimension (both), and gives them as read from the games."""
    fact = team_points(games)
    dim = teams_dim(fact)
    write_parquet(fact, f"{folder}/team_game_points", ["season"])
    write_tsv(fact.select("season", "team_id", "points", "game_id"), f"{folder}/team_game_points_tsv")
    write_parquet(dim, f"{folder}/teams_dim")
    write_tsv(dim, f"{folder}/teams_dim_tsv", single_file=True)
    return fact, dim


def q4_multifactor(play_by_play: DataFrame, advanced: DataFrame, per_game: DataFrame, team_summaries: DataFrame, min_games: int = 10) -> DataFrame:
    """The enriched fact of the multi-factor ranking; team points come from `team_summaries` (season, abbreviation, pts).

    Advanced and per-game rows are those of the player's team, or else the season's total row (TOT), record by record.
    """
    keys = ["season", "team_abbr", "player_id"]
    keyed = lambda df: df.select(_season().alias("season"), S.upper_trim(F.col("team")).alias("team_abbr"), "player_id", *[c for c in df.columns if c not in ("season", "team", "player_id")])
    rows = keyed(play_by_play).where(F.col("season").isNotNull() & (F.col("g") >= min_games) & F.col("mp").isNotNull() & ~S.several_teams(F.col("team_abbr")))
    last = lambda df: J.last_of_key(keyed(df), keys, ["g", "mp" if "mp" in df.columns else "mp_per_game"])
    rows = rows.select(*keys, F.col("player").alias("player_name"), "pos", "g", "gs", "mp")
    adv = last(advanced).select(*keys, F.col("usg_percent").alias("usage_pct"), "ts_percent", "ws", "vorp")
    ppg = last(per_game).select(*keys, "mp_per_game", "pts_per_game")
    rows = J.fallback_lookup(rows, adv, keys, "team_abbr", "TOT", ["usage_pct", "ts_percent", "ws", "vorp"])
    rows = J.fallback_lookup(rows, ppg, keys, "team_abbr", "TOT", ["mp_per_game", "pts_per_game"])
    points = team_summaries.groupBy(_season().alias("season"), S.upper_trim(F.col("abbreviation")).alias("team_abbr")).agg(F.max(F.col("pts").cast("double")).alias("team_pts"))
    joined = rows.join(points, ["season", "team_abbr"], "left").withColumn("pts_per_36", S.per_36(F.col("pts_per_game"), F.col("mp_per_game")))
    numbers = ["mp", "usage_pct", "ts_percent", "pts_per_36", "team_pts", "ws", "vorp"]
    return joined.select("season", "team_abbr", "player_id", "player_name", "pos", "g", "gs", *[F.round(c, 3).alias(c) for c in numbers])


# --- the relational layer: standardised tables, then fusion with provenance


def _std_player(df: DataFrame, figures: list[str]) -> DataFrame:
    return df.select(
        "season",
        S.lower_trim(F.col("player")).alias("player_name"),
        S.blank_to_null(F.col("player_id")).alias("player_id"),
        S.upper_trim(F.col("team")).alias("team_abbr"),
        S.upper_trim(F.col("pos")).alias("position"),
        F.col("season").alias("season_start"),
        (S.to_int(F.col("season")) + 1).cast("string").alias("season_end"),
        S.season_label(F.col("season")).alias("season_label"),
        *figures,
    )


def std_player_totals(df: DataFrame) -> DataFrame:
    """N8."""
    return _std_player(df, ["g", "gs", "mp", *[c for c in _FIGURES if c != "mp"], "e_fg_percent", "trp_dbl"])


def std_player_per_game(df: DataFrame) -> DataFrame:
    """N8."""
    return _std_player(df, ["g", "gs", "mp_per_game", *[c if c.endswith("percent") else f"{c}_per_game" for c in _FIGURES], "e_fg_percent"])


def std_player_bio(df: DataFrame) -> DataFrame:
    """N8."""
    return df.select(S.blank_to_null(F.col("player_id")).alias("player_id"), *[S.lower_trim(F.col(c)).alias(c) for c in ("full_name", "first_name", "last_name")], "birthdate", "country", F.col("school").alias("college"), "position", "height", "weight", S.upper_trim(F.col("team_abbreviation")).alias("team_abbr"), "src")


def std_team_summaries(df: DataFrame) -> DataFrame:
    """N8."""
    return df.select("season", S.upper_trim(F.col("abbreviation")).alias("team_abbr"), S.lower_trim(F.col("team")).alias("team_name"), S.lower_trim(F.col("arena")).alias("arena_name"), "attend", "attend_g")


def std_team_abbrev(df: DataFrame) -> DataFrame:
    """N8."""
    return df.select("season", S.upper_trim(F.col("abbreviation")).alias("team_abbr"), S.lower_trim(F.col("team_name")).alias("team_name"))


def std_team_details(df: DataFrame) -> DataFrame:
    """N8."""
    return df.select(S.blank_to_null(F.col("team_id")).alias("team_id"), S.upper_trim(F.col("abbreviation")).alias("team_abbr"), S.lower_trim(F.col("nickname")).alias("team_name"), S.lower_trim(F.col("city")).alias("city"), S.lower_trim(F.col("arena")).alias("arena_name"), F.col("headcoach").alias("coach"), "arenacapacity", "src")


def std_games(df: DataFrame) -> DataFrame:
    """N8."""
    sides = [f"{s}_{c}" for s in ("home", "away") for c in ("team_id", "team_city", "team_name", "score")]
    return df.select("game_id", "game_date", "season_label", *sides, "attendance")


def std_player_advanced(df: DataFrame) -> DataFrame:
    """N8."""
    return df.select("season", S.lower_trim(F.col("player")).alias("player_name"), S.blank_to_null(F.col("player_id")).alias("player_id"), S.upper_trim(F.col("team")).alias("team_abbr"), "per", "ts_percent", "ws", "bpm", "vorp")


def relational_player_season(totals: DataFrame, per_game: DataFrame, bio: DataFrame, advanced: DataFrame, by_team: bool = True) -> DataFrame:
    """Std totals and per-game rows fused by player and season (and team, unless a fan-out of traded players is wanted),
    with register and ratings, and the source of position, height and weight. The season is that of the totals only."""
    keys = ["player_id", "season", "team_abbr"] if by_team else ["player_id", "season"]
    both = R.full_outer(totals, per_game, keys, ("pt", "pg"))
    both = both.withColumn("player_id", F.coalesce("pt.player_id", "pg.player_id")).withColumn("k_season", F.coalesce("pt.season", "pg.season")).withColumn("team_abbr", F.coalesce("pt.team_abbr", "pg.team_abbr"))
    pb = bio.where("player_id is not null").select("player_id", F.struct(*bio.columns).alias("pb"))
    on = ["player_id", "k_season", "team_abbr"] if by_team else ["player_id", "k_season"]
    adv = advanced.where("player_id is not null").select("player_id", F.col("season").alias("k_season"), *(["team_abbr"] if by_team else []), F.struct("per", "ts_percent", "ws", "bpm", "vorp").alias("adv"))
    joined = both.join(pb, "player_id", "left").join(adv, on, "left")
    position = R.fused("position", {"player_bio": F.col("pb.position"), "player_totals": F.col("pt.position"), "player_per_game": F.col("pg.position")})
    matched = F.when(F.col("pb.player_id").isNotNull(), "player_bio")
    return joined.select(
        "player_id",
        F.coalesce("pt.player_name", "pg.player_name").alias("player_name"),
        "team_abbr",
        S.to_int(F.col("pt.season")).alias("season"),
        *position,
        "pb.height",
        "pb.weight",
        matched.alias("src_height"),
        matched.alias("src_weight"),
        *[f"pt.{c}" for c in ("g", "gs", "pts", "ast", "trb")],
        *[f"pg.{c}" for c in ("pts_per_game", "ast_per_game", "trb_per_game")],
        "adv.*",
    )


def relational_team_season(summaries: DataFrame, abbrev: DataFrame, details: DataFrame) -> DataFrame:
    """Std summaries and codes fused by season and code, with details by code, and the source of arena and coach."""
    both = R.full_outer(summaries, abbrev, ["season", "team_abbr"], ("ts", "ta"))
    both = both.withColumn("k_abbr", F.coalesce("ts.team_abbr", "ta.team_abbr"))
    joined = both.join(details.select(F.col("team_abbr").alias("k_abbr"), F.struct(*details.columns).alias("td")), "k_abbr", "left")
    arena = R.fused("arena", {"team_summaries": F.col("ts.arena_name"), "team_details": F.col("td.arena_name")})
    coach = R.fused("coach", {"team_details": F.col("td.coach")})
    return joined.select(S.to_int(F.col("ts.season")).alias("season"), F.coalesce("k_abbr", "td.team_abbr").alias("team_abbr"), F.coalesce("ts.team_name", "ta.team_name", "td.team_name").alias("team_name"), arena[0].alias("arena_name"), "td.city", coach[0], "ts.attend", "ts.attend_g", arena[1], coach[1])


def register(registry: Registry) -> Registry:
    """Adds all views, in an order in which each finds what it needs; sources are looked up when a view is built."""
    needs = {
        "global_player_season": (global_player_season, ["player_totals", "common_player_info", "player_per_game", "player_advanced", "player_season_info", "seasons_stats"]),
        "global_team_season": (global_team_season, ["team_summaries", "team_stats_per_game", "team_stats_per_100", "opponent_stats_per_100", "team_totals", "team_abbrev"]),
        "global_game": (global_game, ["games"]),
        "dim_player": (dim_player, ["common_player_info"]),
        "dim_team_season": (dim_team_season, ["team_summaries", "team_abbrev", "team_details", "nba_head_coaches"]),
        "player_game_box": (player_game_box, ["player_box_score"]),
        "player_usage_minutes": (player_play_by_play, ["player_play_by_play"]),
        "team_points": (team_points, ["games"]),
        "std_player_totals": (std_player_totals, ["player_totals"]),
        "std_player_per_game": (std_player_per_game, ["player_per_game"]),
        "std_player_bio": (std_player_bio, ["player_bio"]),
        "std_team_summaries": (std_team_summaries, ["team_summaries"]),
        "std_team_abbrev": (std_team_abbrev, ["team_abbrev"]),
        "std_team_details": (std_team_details, ["team_details_flat"]),
        "std_games": (std_games, ["games_flat"]),
        "std_player_advanced": (std_player_advanced, ["player_advanced"]),
        "relational_player_season": (relational_player_season, ["std_player_totals", "std_player_per_game", "std_player_bio", "std_player_advanced"]),
        "relational_team_season": (relational_team_season, ["std_team_summaries", "std_team_abbrev", "std_team_details"]),
    }
    for name, (build, inputs) in needs.items():
        registry.view(name, lambda reg, spark, build=build, inputs=inputs: build(*[reg.table(spark, i) for i in inputs]))
    return registry
