"""Schemas of the input tables. In the short form `s` is string, `i` integer, `d` double; every column may be null."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

_KINDS = {"s": StringType(), "i": IntegerType(), "d": DoubleType()}


def short(*groups: str) -> StructType:
    """`short("s: season lg", "d: mp fg")`: columns in order, with their types."""
    fields = []
    for group in groups:
        kind, names = group.split(":")
        fields += [StructField(n, _KINDS[kind.strip()]) for n in names.split()]
    return StructType(fields)


_PLAYER = "s: season lg player player_id", "i: age", "s: team pos", "i: g gs"
_SIDE = StructType([StructField(n, StringType()) for n in ("team_id", "team_city", "team_name", "score")])

#: One game as a document; numbers are text there, as their type isn't stable.
GAMES_JSON = StructType([*[StructField(n, StringType()) for n in ("game_id", "date", "season", "attendance", "winner")], StructField("home", _SIDE), StructField("away", _SIDE)])
#: One team's details as a document of two levels.
TEAM_DETAILS_JSON = StructType(
    [
        *[StructField(n, StringType()) for n in ("team_id", "abbreviation", "nickname", "team_name")],
        StructField("meta", StructType([StructField("city", StringType()), StructField("head_coach", StringType()), StructField("arena", StructType([StructField("name", StringType()), StructField("capacity", StringType())]))])),
    ]
)

SCHEMAS: dict[str, StructType] = {
    "games": GAMES_JSON,
    "team_details": TEAM_DETAILS_JSON,
    "team_game_points": short("s: game_id season home_away team_id team_city team_name opponent_team_id", "i: points"),
    "team_game_points_tsv": short("s: season team_id", "i: points", "s: game_id"),
    "teams_dim": short("s: team_id team_city team_name"),
    "q4_multifactor": short("i: season", "s: team_abbr player_id player_name pos", "i: g gs", "d: mp usage_pct ts_percent pts_per_36 team_pts ws vorp"),
    "bench_log": short("i: seq", "s: tool query", "d: wall_ms", "i: rows", "s: fmt", "i: topn"),
    "player_totals": short(*_PLAYER, "d: mp fg fga fg_percent x3p x3pa x3p_percent x2p x2pa x2p_percent e_fg_percent ft fta ft_percent orb drb trb ast stl blk tov pf pts", "i: trp_dbl"),
    "player_per_game": short(
        *_PLAYER,
        "d: mp_per_game fg_per_game fga_per_game fg_percent x3p_per_game x3pa_per_game x3p_percent x2p_per_game x2pa_per_game x2p_percent e_fg_percent",
        "d: ft_per_game fta_per_game ft_percent orb_per_game drb_per_game trb_per_game ast_per_game stl_per_game blk_per_game tov_per_game pf_per_game pts_per_game",
    ),
    "player_bio": short("s: player_id full_name first_name last_name birthdate school country height weight position team_id team_name team_abbreviation from_year to_year draft_year draft_round draft_number src"),
    "team_summaries": short("s: season lg team abbreviation playoffs", "d: age", "i: w l pw pl", "d: mov sos srs o_rtg d_rtg n_rtg pace f_tr x3p_ar ts_percent e_fg_percent tov_percent orb_percent ft_fga opp_e_fg_percent opp_tov_percent drb_percent opp_ft_fga", "s: arena attend attend_g"),
    "team_abbrev": short("s: season lg team_name abbreviation playoffs"),
    "team_details_flat": short("s: team_id abbreviation nickname yearfounded city arena arenacapacity owner generalmanager headcoach dleagueaffiliation facebook instagram twitter src"),
    "games_flat": short("s: game_id game_date season_label home_team_id home_team_city home_team_name", "i: home_score", "s: away_team_id away_team_city away_team_name", "i: away_score", "s: winner game_type", "i: attendance", "s: arena_id"),
    "player_advanced": short(*_PLAYER, "d: mp per ts_percent x3p_ar f_tr orb_percent drb_percent trb_percent ast_percent stl_percent blk_percent tov_percent usg_percent ows dws ws ws_48 obpm dbpm bpm vorp"),
    "player_box_score": short("s: season game_id player_name team game_date matchup wl min", "s: fgm fga fg_pct fg3m fg3a fg3_pct ftm fta ft_pct oreb dreb reb ast stl blk tov pf pts plus_minus"),
    "team_stats_per_game": short(
        "s: season lg team abbreviation playoffs",
        "i: g",
        "d: mp_per_game fg_per_game fga_per_game fg_percent x3p_per_game x3pa_per_game x3p_percent x2p_per_game x2pa_per_game x2p_percent",
        "d: ft_per_game fta_per_game ft_percent orb_per_game drb_per_game trb_per_game ast_per_game stl_per_game blk_per_game tov_per_game pf_per_game pts_per_game",
    ),
    "team_stats_per_100": short(
        "s: season lg team abbreviation playoffs",
        "i: g",
        "d: mp fg_per_100_poss fga_per_100_poss fg_percent x3p_per_100_poss x3pa_per_100_poss x3p_percent x2p_per_100_poss x2pa_per_100_poss x2p_percent",
        "d: ft_per_100_poss fta_per_100_poss ft_percent orb_per_100_poss drb_per_100_poss trb_per_100_poss ast_per_100_poss stl_per_100_poss blk_per_100_poss tov_per_100_poss pf_per_100_poss pts_per_100_poss",
    ),
    "team_totals": short("s: season lg team abbreviation playoffs", "i: g", "d: mp fg fga fg_percent x3p x3pa x3p_percent x2p x2pa x2p_percent ft fta ft_percent orb drb trb ast stl blk tov pf pts"),
    "opponent_stats_per_100": short(
        "s: season lg team abbreviation",
        "i: g",
        "d: mp opp_fg_per_100_poss opp_fga_per_100_poss opp_fg_percent opp_x3p_per_100_poss opp_x3pa_per_100_poss opp_x3p_percent opp_x2p_per_100_poss opp_x2pa_per_100_poss opp_x2p_percent",
        "d: opp_ft_per_100_poss opp_fta_per_100_poss opp_ft_percent opp_orb_per_100_poss opp_drb_per_100_poss opp_trb_per_100_poss opp_ast_per_100_poss opp_stl_per_100_poss opp_blk_per_100_poss opp_tov_per_100_poss opp_pf_per_100_poss opp_pts_per_100_poss",
    ),
    "player_shooting": short("s: season lg player player_id", "i: age", "s: team pos", "i: g", "d: mp fg_pct x2p_percent x3p_percent ft_percent"),
    "player_play_by_play": short(*_PLAYER, "d: mp"),
    "seasons_stats": short("s: year player pos", "i: age", "s: tm", "i: g gs", "d: mp per ts_percent ws vorp"),
    "nba_head_coaches": short("s: name teams start_season end_season years_in_rule birth_date nationality start_season_short end_season_short num_of_teams"),
    "player_season_info": short("s: player_id season", "i: experience"),
    "common_player_info": short("s: player_id full_name first_name last_name birthdate country school position height weight team_abbreviation from_year to_year draft_year draft_round draft_number"),
    "player_season_box": short("s: player_id", "i: season g", "d: pts ast reb fgm fga fg3m fg3a ftm fta"),
    "line_score": short("s: game_id", "i: period home_pts away_pts"),
}
