"""The integrated views and the users' queries, registered on tables staged from the star schema, with SQL that must give the same rows.

A staging table is one SQL text that Spark and a second engine both run: seasons are years of orders, teams nations, players customers.
What is compared is what the library's builders make of the staging tables, against plain SQL on the same.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.checks import lowered, missing_columns
from tessera.plans import queries as Q
from tessera.plans import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_FIGURES, _RATINGS = V._FIGURES, V._RATINGS
#: Codes of the first nations; they have franchise names, the others have codes of their own.
_CODES = "CASE c_nationkey WHEN 0 THEN 'ATL' WHEN 1 THEN 'NJN' WHEN 2 THEN 'chh' WHEN 3 THEN 'SEA' ELSE 'T' || CAST(c_nationkey AS STRING) END"


def _made(columns: list[str], key: str, kind: str = "DOUBLE") -> str:
    return ", ".join(f"CAST(({key} * {k + 3} + y * 7) % 97 AS {kind}) AS {c}" for k, c in enumerate(columns))


def _suffixed(suffix: str, prefix: str = "") -> list[str]:
    return [f"{prefix}{c}" if c.endswith("percent") else f"{prefix}{c}{suffix}" for c in _FIGURES]


#: Staging tables; other tables are named in braces.
STAGES = {
    "py": "SELECT c_custkey, c_nationkey, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey, year(o_orderdate)",
    "ty": "SELECT c_nationkey, y, count(*) AS n FROM {py} GROUP BY c_nationkey, y",
    # players
    "player_totals": f"""SELECT CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE 'P' || CAST(c_custkey AS STRING) END AS player_id, CAST(y AS STRING) AS season, ' Jo' || CAST(c_custkey % 13 AS STRING) || ' OAK-' || CAST(c_custkey AS STRING) AS player,
      ' n' || CAST(c_nationkey AS STRING) || ' ' AS team, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE ' g ' END AS pos, CAST(n AS DOUBLE) AS g, CAST(n % 3 AS DOUBLE) AS gs, CAST(n * 30 AS DOUBLE) AS mp,
      {_made([*_FIGURES, "e_fg_percent", "trp_dbl"], "c_custkey")} FROM {{py}}""",
    "player_per_game": f"""SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'P' || CAST(c_custkey AS STRING) END AS player_id, CAST(CASE WHEN c_custkey % 8 = 1 THEN y + 50 ELSE y END AS STRING) AS season, 'JO OAK-' || CAST(c_custkey AS STRING) AS player,
      'N' || CAST(c_nationkey AS STRING) AS team, 'F' AS pos, CAST(n AS DOUBLE) AS g, CAST(n % 3 AS DOUBLE) AS gs, CAST(n % 40 AS DOUBLE) AS mp_per_game,
      {_made([*_suffixed("_per_game"), "e_fg_percent"], "c_custkey")} FROM {{py}} WHERE c_custkey % 4 <> 0""",
    "player_advanced": f"""SELECT CAST(y AS STRING) AS season, 'Jo' AS player, CASE WHEN c_custkey % 22 = 0 THEN ' ' ELSE 'P' || CAST(c_custkey AS STRING) END AS player_id, 'n' || CAST(c_nationkey AS STRING) AS team,
      {_made(["per", "ts_percent", "ws", "bpm", "vorp"], "c_custkey")} FROM {{py}} WHERE c_custkey % 2 = 0""",
    "player_bio": """SELECT 'P' || CAST(c_custkey AS STRING) AS player_id, upper(c_name) AS full_name, 'JO ' AS first_name, ' Oak' AS last_name, '1990-01-01' AS birthdate, 'X' AS country, c_mktsegment AS school, CASE WHEN c_custkey % 2 = 0 THEN 'Guard' END AS position,
      '6-7' AS height, '210' AS weight, 'n' || CAST(c_nationkey AS STRING) AS team_abbreviation, 'cpi' AS src FROM {customer} WHERE c_custkey % 3 <> 0""",
    "common_player_info": """SELECT 'P' || CAST(c_custkey % 500 AS STRING) AS player_id, upper(c_mktsegment) AS full_name, 'JO' AS first_name, upper(c_mktsegment) AS last_name, 'Land' AS country, 'S' AS school, CAST(NULL AS STRING) AS birthdate,
      '6-1' AS height, '190' AS weight, 'n' || CAST(c_nationkey AS STRING) AS team_abbreviation, 1990 AS from_year, 2000 AS to_year, 1990 AS draft_year, 1 AS draft_round, 2 AS draft_number FROM {customer}""",
    "player_box_score": f"""SELECT CAST(year(o_orderdate) AS STRING) AS season, CAST(o_orderkey AS STRING) AS game_id, 'Player ' || CAST(l_suppkey AS STRING) AS player_name, 't' || CAST(l_suppkey % 30 AS STRING) AS team,
      CAST(CAST(o_orderdate AS DATE) AS STRING) AS game_date, 'A vs. B' AS matchup, CASE WHEN l_linenumber % 2 = 0 THEN 'W' ELSE 'L' END AS wl, ' ' || CAST(l_linenumber * 5 AS STRING) AS min,
      {", ".join(f"CASE WHEN (l_suppkey + {k}) % 10 = 0 THEN 'n/a' ELSE CAST((l_partkey + l_suppkey * {k + 2}) % 41 AS STRING) END AS {c}" for k, c in enumerate(["fgm", "fga", "fg_pct", "fg3m", "fg3a", "fg3_pct", "ftm", "fta", "ft_pct", "oreb", "dreb", "reb", "ast", "stl", "blk", "tov", "pf", "pts", "plus_minus"]))}
      FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "play_by_play": """SELECT CAST(y AS STRING) AS season, 'Jo ' || CAST(c_custkey AS STRING) AS player, 'P' || CAST(c_custkey AS STRING) AS player_id, CASE WHEN c_custkey % 17 = 0 THEN '2tm' ELSE 'n' || CAST(c_nationkey AS STRING) END AS team, 'G' AS pos,
      CAST(n * 3 AS INT) AS g, CAST(n AS INT) AS gs, CAST(n * 40 + c_custkey % 7 AS DOUBLE) AS mp FROM {py}""",
    # teams
    "team_summaries": f"SELECT CAST(y AS STRING) AS season, ' ' || {_CODES} AS abbreviation, 'Team ' || CAST(c_nationkey AS STRING) AS team, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE ' Arena ' || CAST(c_nationkey AS STRING) END AS arena, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE '1,' || CAST(n % 900 + 100 AS STRING) END AS attend, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE CAST(n % 50 + 1 AS STRING) END AS attend_g, {_made(_RATINGS, 'c_nationkey')} FROM {{ty}}",
    "team_abbrev": f"SELECT CAST(CASE WHEN c_nationkey % 7 = 6 THEN y + 50 ELSE y END AS STRING) AS season, {_CODES} AS abbreviation, 'Abbrev ' || CAST(c_nationkey AS STRING) AS team_name FROM {{ty}}",
    "team_stats_per_game": f"SELECT CAST(y AS STRING) AS season, {_CODES} AS abbreviation, CAST(82 AS DOUBLE) AS g, CAST(240 AS DOUBLE) AS mp_per_game, {_made(_suffixed('_per_game'), 'c_nationkey')} FROM {{ty}} WHERE c_nationkey % 6 <> 5",
    "team_stats_per_100": f"SELECT CAST(y AS STRING) AS season, {_CODES} AS abbreviation, {_made(_suffixed('_per_100_poss'), 'c_nationkey + 1')} FROM {{ty}}",
    "opponent_stats_per_100": f"SELECT CAST(y AS STRING) AS season, {_CODES} AS abbreviation, {_made(_suffixed('_per_100_poss', 'opp_'), 'c_nationkey + 2')} FROM {{ty}}",
    "team_totals": f"SELECT CAST(y AS STRING) AS season, {_CODES} AS abbreviation, CAST(n % 4 * 10 AS DOUBLE) AS g, CAST(n AS DOUBLE) AS mp, {_made(_FIGURES, 'c_nationkey + 3')} FROM {{ty}}",
    "team_details_flat": "SELECT 'D' || CAST(n_nationkey AS STRING) AS team_id, 'T' || CAST(n_nationkey AS STRING) AS abbreviation, n_name AS nickname, 'CITY' AS city, 'DOME' AS arena, CASE WHEN n_nationkey % 2 = 0 THEN 'Coach' END AS headcoach, 100 AS arenacapacity, 'td' AS src FROM {nation}",
    "team_detail_rows": "SELECT 'T' || CAST(s_nationkey AS STRING) AS team_id, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN '' END AS team_name, CASE WHEN s_suppkey % 5 < 3 THEN 'nick ' || CAST(s_suppkey AS STRING) END AS nickname, CASE WHEN s_suppkey % 4 > 0 THEN 'city ' || CAST(s_suppkey AS STRING) END AS city, s_suppkey AS seq FROM {supplier} WHERE s_nationkey % 6 <> 0",
    # games
    "games_flat": """SELECT CAST(o_orderkey AS STRING) AS game_id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS game_date, CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T19:00:00' AS date, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS STRING) || '-99' END AS season,
      CAST(year(o_orderdate) AS STRING) || '-x' AS season_label, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE 'T' || CAST(c_nationkey AS STRING) END AS home_team_id, CASE WHEN c_nationkey % 2 = 0 THEN 'City' END AS home_team_city, 'Home ' || CAST(c_nationkey AS STRING) AS home_team_name, CAST(o_orderkey % 61 + 60 AS STRING) || '.0' AS home_score,
      'T' || CAST(o_orderkey % 25 AS STRING) AS away_team_id, 'Town' AS away_team_city, 'AWAY ' || CAST(o_orderkey % 25 AS STRING) AS away_team_name, CASE WHEN o_orderkey % 40 = 7 THEN 'n/a' ELSE CAST(o_orderkey * 7 % 61 + 60 AS STRING) END AS away_score, 'HOME' AS winner,
      CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey % 3000 + 1 AS STRING) || '.' || CAST(o_orderkey % 900 + 100 AS STRING) WHEN 1 THEN CAST(o_orderkey % 3000 + 1 AS STRING) || ',' || CAST(o_orderkey % 900 + 100 AS STRING) || '.0'
        WHEN 2 THEN CAST(o_orderkey % 3000 + 1 AS STRING) || ',' || CAST(o_orderkey % 900 + 100 AS STRING) WHEN 3 THEN CAST(o_orderkey % 3000 + 1 AS STRING) || CAST(o_orderkey % 900 + 100 AS STRING) WHEN 4 THEN ''
        ELSE ' ' || CAST(o_orderkey % 3000 + 1 AS STRING) || ' ' || CAST(o_orderkey % 900 + 100 AS STRING) || ' ' END AS attendance
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "game": """SELECT CAST(o_orderkey AS STRING) AS game_id, CAST(o_orderdate AS DATE) AS game_date, CAST(year(o_orderdate) AS INT) AS season, 'T' || CAST(c_nationkey AS STRING) AS home_id, 'T' || CAST(o_orderkey % 25 AS STRING) AS away_id, 'City' AS home_team_city, 'team ' || CAST(c_nationkey AS STRING) AS home_team_name,
      'team ' || CAST(o_orderkey % 25 AS STRING) AS away_team_name, CAST(o_orderkey % 61 + 60 AS INT) AS home_score, CASE WHEN o_orderkey % 40 = 7 THEN NULL ELSE CAST(o_orderkey * 7 % 61 + 60 AS INT) END AS away_score, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey % 20000 AS INT) END AS attendance
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "scored": "SELECT game_id, game_date, home_id, away_id, home_score AS home_pts, away_score AS away_pts, CASE WHEN home_id < 'T2' THEN 'East' ELSE 'West' END AS conference FROM {game}",
    # the views' outputs, as far as the users' queries read them
    "player_season": """SELECT 'P' || CAST(c_custkey AS STRING) AS player_id, 'jo ' || CAST(c_custkey AS STRING) AS player_name, y AS season, 'N' || CAST(c_nationkey AS STRING) AS team_abbr, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'G' END AS position, CAST(180 + c_custkey % 30 AS INT) AS height_cm, CAST(80 + c_custkey % 40 AS INT) AS weight_kg,
      CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey * 13 % 40 AS DOUBLE) END AS per, CAST(c_custkey % 60 AS DOUBLE) AS ts_percent, CAST(n % 9 AS DOUBLE) AS ws, CAST(n % 5 AS DOUBLE) AS vorp FROM {py}""",
    "team_season": """SELECT y AS season, 'T' || CAST(c_nationkey AS STRING) AS team_abbr, CASE WHEN c_nationkey % 9 = 8 THEN NULL WHEN y < 1998 THEN 'City old ' || CAST(c_nationkey AS STRING) ELSE 'City team ' || CAST(c_nationkey AS STRING) END AS team_name, 'coach ' || CAST(y % 7 AS STRING) AS coach, 'arena' AS arena_name, CAST(n * 10 AS DOUBLE) AS attend, CAST(n % 100 AS DOUBLE) AS attend_g,
      CAST(100 + c_nationkey AS DOUBLE) AS o_rtg, CAST(100 + n % 9 AS DOUBLE) AS d_rtg, CAST(c_nationkey AS DOUBLE) AS n_rtg, CAST(90 AS DOUBLE) AS pace, CAST(1 AS DOUBLE) AS srs, CAST(55 AS DOUBLE) AS ts_percent, CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE CAST(n % 30 + 90 AS DOUBLE) END AS points_per_game FROM {ty}""",
    "home_game": "SELECT season, home_team_city, CASE WHEN season < 1998 THEN replace(home_team_name, 'team ', 'old ') ELSE home_team_name END AS home_team_name, attendance FROM {game}",
    "usage": "SELECT y AS season, 'jo ' || CAST(c_custkey AS STRING) AS player_name, 'P' || CAST(c_custkey AS STRING) AS player_id, 'N' || CAST(c_nationkey AS STRING) AS team_abbr, CAST(n AS DOUBLE) AS g, CAST(n * (c_custkey % 50 + 1) AS DOUBLE) AS minutes FROM {py}",
    "box": """SELECT CAST(l_orderkey AS STRING) AS game_id, 'T' || CAST(l_suppkey % 30 AS STRING) AS team_abbr, 'jo ' || CAST(l_suppkey AS STRING) AS player_name, CAST(year(l_shipdate) AS INT) AS season, CAST(l_partkey % 30 AS DOUBLE) AS pts, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_partkey % 17 AS DOUBLE) END AS reb, CAST(l_suppkey % 9 AS DOUBLE) AS oreb, CAST(l_partkey % 5 AS DOUBLE) AS dreb, CAST(l_partkey % 13 AS DOUBLE) AS ast FROM {lineitem}""",
    "season_box": """SELECT o_custkey AS player_id, CAST(year(o_orderdate) AS INT) AS season, count(*) AS g, sum(o_orderkey % 31) AS pts, sum(o_orderkey % 7) AS ast, sum(o_orderkey % 11) AS reb, sum(o_orderkey % 9) AS fgm, sum(o_orderkey % 9 + o_orderkey % 4) AS fga, sum(o_orderkey % 3) AS fg3m, sum(o_orderkey % 3 + o_orderkey % 2) AS fg3a, sum(o_orderkey % 5) AS ftm, sum(o_orderkey % 5 + o_orderkey % 3) AS fta FROM {orders} GROUP BY o_custkey, year(o_orderdate)""",
    "periods": "SELECT CAST(l_orderkey AS STRING) AS game_id, CAST(l_linenumber AS INT) AS period, CAST(l_quantity AS INT) AS home_pts, CAST(l_partkey % 40 AS INT) AS away_pts FROM {lineitem}",
}
_NAMED = re.compile(r"\{(\w+)\}")


def stage(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A staging table, or a table of the star schema, as a DataFrame."""
    if name not in STAGES:
        return spark.read.parquet(f"{d}/{name}.parquet")
    return spark.sql(STAGES[name], **{n: stage(spark, d, n) for n in sorted(set(_NAMED.findall(STAGES[name])))})


def _with(sql: str) -> str:
    """SQL with the staging tables that it names in braces, and theirs, before it."""
    parts: dict[str, str] = {}

    def add(text: str) -> str:
        for n in _NAMED.findall(text):
            if n in STAGES and n not in parts:
                parts[n] = add(STAGES[n])
        return _NAMED.sub(r"\1", text)

    body = add(sql)
    order: list[str] = []

    def place(n: str) -> None:
        for m in _NAMED.findall(STAGES[n]):
            if m in STAGES and m not in order:
                place(m)
        if n not in order:
            order.append(n)

    for n in list(parts):
        place(n)
    if not order:
        return body
    views = ", ".join(f"{n} AS ({parts[n]})" for n in order)
    return f"WITH {views}, {body[5:]}" if body.startswith("WITH ") else f"WITH {views} {body}"


def _query(sql: str, *inputs: str) -> Callable:
    """Registers a function of DataFrames on staging tables, with SQL."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, d: f(*[stage(spark, d, n) for n in inputs])
        ORACLE_SQL[f.__name__] = _with(sql.strip())
        return f

    return add


def _dated(df: DataFrame) -> DataFrame:
    """The date of a game as text, as which both engines write it alike."""
    return df.withColumn("game_date", F.col("game_date").cast("string"))


# --- views

_LABEL = "CAST(CAST(season AS INT) AS VARCHAR) || '-' || right(CAST(CAST(season AS INT) + 1 AS VARCHAR), 2)"


def _std_player_sql(table: str, figures: list[str]) -> str:
    return f"""SELECT season, lower(trim(player)) AS player_name, nullif(trim(player_id), '') AS player_id, upper(trim(team)) AS team_abbr, upper(trim(pos)) AS position, season AS season_start, CAST(CAST(season AS INT) + 1 AS VARCHAR) AS season_end,
      {_LABEL} AS season_label, {", ".join(figures)} FROM {{{table}}}"""


_STD_TOTALS = _std_player_sql("player_totals", ["g", "gs", "mp", *_FIGURES, "e_fg_percent", "trp_dbl"])
_STD_PER_GAME = _std_player_sql("player_per_game", ["g", "gs", "mp_per_game", *_suffixed("_per_game"), "e_fg_percent"])
_STD_BIO = "SELECT nullif(trim(player_id), '') AS player_id, lower(trim(full_name)) AS full_name, lower(trim(first_name)) AS first_name, lower(trim(last_name)) AS last_name, birthdate, country, school AS college, position, height, weight, upper(trim(team_abbreviation)) AS team_abbr, src FROM {player_bio}"
_STD_SUMMARIES = "SELECT season, upper(trim(abbreviation)) AS team_abbr, lower(trim(team)) AS team_name, lower(trim(arena)) AS arena_name, attend, attend_g FROM {team_summaries}"
_STD_ABBREV = "SELECT season, upper(trim(abbreviation)) AS team_abbr, lower(trim(team_name)) AS team_name FROM {team_abbrev}"
_STD_DETAILS = "SELECT nullif(trim(team_id), '') AS team_id, upper(trim(abbreviation)) AS team_abbr, lower(trim(nickname)) AS team_name, lower(trim(city)) AS city, lower(trim(arena)) AS arena_name, headcoach AS coach, arenacapacity, src FROM {team_details_flat}"
_STD_ADVANCED = "SELECT season, lower(trim(player)) AS player_name, nullif(trim(player_id), '') AS player_id, upper(trim(team)) AS team_abbr, per, ts_percent, ws, bpm, vorp FROM {player_advanced}"


@_query(_STD_TOTALS, "player_totals")
def view_std_player_totals(df: DataFrame) -> DataFrame:
    """N8."""
    return V.std_player_totals(df)


@_query(_STD_PER_GAME, "player_per_game")
def view_std_player_per_game(df: DataFrame) -> DataFrame:
    """N8."""
    return V.std_player_per_game(df)


@_query(_STD_BIO, "player_bio")
def view_std_player_bio(df: DataFrame) -> DataFrame:
    """N8."""
    return V.std_player_bio(df)


@_query(_STD_SUMMARIES, "team_summaries")
def view_std_team_summaries(df: DataFrame) -> DataFrame:
    """N8."""
    return V.std_team_summaries(df)


@_query(_STD_ABBREV, "team_abbrev")
def view_std_team_abbrev(df: DataFrame) -> DataFrame:
    """N8."""
    return V.std_team_abbrev(df)


@_query(_STD_DETAILS, "team_details_flat")
def view_std_team_details(df: DataFrame) -> DataFrame:
    """N8."""
    return V.std_team_details(df)


@_query("SELECT game_id, game_date, season_label, home_team_id, home_team_city, home_team_name, home_score, away_team_id, away_team_city, away_team_name, away_score, attendance FROM {games_flat}", "games_flat")
def view_std_games(df: DataFrame) -> DataFrame:
    """N8."""
    return V.std_games(df)


@_query(_STD_ADVANCED, "player_advanced")
def view_std_player_advanced(df: DataFrame) -> DataFrame:
    """N8."""
    return V.std_player_advanced(df)


@_query(f"""WITH t AS ({_STD_TOTALS}), p AS ({_STD_PER_GAME}), b AS ({_STD_BIO}), a AS ({_STD_ADVANCED}),
u AS (SELECT coalesce(t.player_id, p.player_id) AS player_id, coalesce(t.season, p.season) AS k_season, coalesce(t.team_abbr, p.team_abbr) AS team_abbr, coalesce(t.player_name, p.player_name) AS player_name, t.season AS t_season,
  t.position AS t_position, p.position AS p_position, t.g, t.gs, t.pts, t.ast, t.trb, p.pts_per_game, p.ast_per_game, p.trb_per_game
  FROM t FULL OUTER JOIN p ON t.player_id = p.player_id AND t.season = p.season AND t.team_abbr = p.team_abbr)
SELECT u.player_id, u.player_name, u.team_abbr, CAST(t_season AS INT) AS season, coalesce(b.position, t_position, p_position) AS position,
  CASE WHEN b.position IS NOT NULL THEN 'player_bio' WHEN t_position IS NOT NULL THEN 'player_totals' WHEN p_position IS NOT NULL THEN 'player_per_game' END AS src_position,
  b.height, b.weight, CASE WHEN b.player_id IS NOT NULL THEN 'player_bio' END AS src_height, CASE WHEN b.player_id IS NOT NULL THEN 'player_bio' END AS src_weight,
  g, gs, pts, ast, trb, pts_per_game, ast_per_game, trb_per_game, a.per, a.ts_percent, a.ws, a.bpm, a.vorp
FROM u LEFT JOIN b ON b.player_id = u.player_id LEFT JOIN a ON a.player_id = u.player_id AND a.season = u.k_season AND a.team_abbr = u.team_abbr""", "player_totals", "player_per_game", "player_bio", "player_advanced")
def view_relational_player_season(totals: DataFrame, per_game: DataFrame, bio: DataFrame, advanced: DataFrame) -> DataFrame:
    """N9."""
    return V.relational_player_season(V.std_player_totals(totals), V.std_player_per_game(per_game), V.std_player_bio(bio), V.std_player_advanced(advanced))


@_query(f"""WITH s AS ({_STD_SUMMARIES}), a AS ({_STD_ABBREV}), d AS ({_STD_DETAILS}),
u AS (SELECT s.season AS season, coalesce(s.team_abbr, a.team_abbr) AS team_abbr, coalesce(s.team_name, a.team_name) AS team_name, s.arena_name, s.attend, s.attend_g FROM s FULL OUTER JOIN a ON s.season = a.season AND s.team_abbr = a.team_abbr)
SELECT CAST(u.season AS INT) AS season, u.team_abbr, coalesce(u.team_name, d.team_name) AS team_name, coalesce(u.arena_name, d.arena_name) AS arena_name, d.city, d.coach, u.attend, u.attend_g,
  CASE WHEN u.arena_name IS NOT NULL THEN 'team_summaries' WHEN d.arena_name IS NOT NULL THEN 'team_details' END AS src_arena, CASE WHEN d.coach IS NOT NULL THEN 'team_details' END AS src_coach
FROM u LEFT JOIN d ON d.team_abbr = u.team_abbr""", "team_summaries", "team_abbrev", "team_details_flat")
def view_relational_team_season(summaries: DataFrame, abbrev: DataFrame, details: DataFrame) -> DataFrame:
    """N10."""
    return V.relational_team_season(V.std_team_summaries(summaries), V.std_team_abbrev(abbrev), V.std_team_details(details))


@_query("""SELECT DISTINCT player_id, lower(full_name) AS full_name, lower(first_name) AS first_name, lower(last_name) AS last_name, lower(country) AS country, lower(school) AS college, birthdate, height, weight, upper(team_abbreviation) AS team_abbr,
  from_year, to_year, draft_year, draft_round, draft_number FROM {common_player_info}""", "common_player_info")
def view_dim_player(df: DataFrame) -> DataFrame:
    """N4, A8."""
    return V.dim_player(df)


_BOX_NUMBERS = ["fgm", "fga", "fg_pct", "fg3m", "fg3a", "fg3_pct", "ftm", "fta", "ft_pct", "oreb", "dreb", "reb", "ast", "stl", "blk", "tov", "pf", "pts", "plus_minus"]


@_query(f"""SELECT season, game_id, lower(player_name) AS player_name, upper(team) AS team_abbr, game_date, lower(matchup) AS matchup, lower(wl) AS wl, CAST(trim(min) AS DOUBLE) AS minutes,
  {", ".join(f"try_cast({c} AS DOUBLE) AS {c}" for c in _BOX_NUMBERS)} FROM {{player_box_score}}""", "player_box_score")
def view_player_game_box(df: DataFrame) -> DataFrame:
    """N6, F25."""
    return _dated(V.player_game_box(df))


@_query("SELECT CAST(season AS INT) AS season, lower(player) AS player_name, player_id, upper(team) AS team_abbr, pos AS position, g, gs, mp AS minutes FROM {play_by_play}", "play_by_play")
def view_player_usage_minutes(df: DataFrame) -> DataFrame:
    """N7."""
    return V.player_play_by_play(df)


def _documents(flat: DataFrame) -> DataFrame:
    """Game documents with a struct for each side."""
    side = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("team_id", "team_city", "team_name", "score")]).alias(s)
    return flat.select("game_id", "date", "season", side("home"), side("away"), "winner", "attendance")


_SCORE = "CAST(try_cast({}_score AS DOUBLE) AS INT)"


@_query(f"""SELECT game_id, game_date, CAST(CASE WHEN season IS NOT NULL THEN CAST(substr(season, 1, 4) AS INT) WHEN month(CAST(game_date AS DATE)) >= 7 THEN year(CAST(game_date AS DATE)) ELSE year(CAST(game_date AS DATE)) - 1 END AS INT) AS season,
  home_team_id, lower(home_team_city) AS home_team_city, lower(home_team_name) AS home_team_name, {_SCORE.format("home")} AS home_score, away_team_id, lower(away_team_city) AS away_team_city, lower(away_team_name) AS away_team_name, {_SCORE.format("away")} AS away_score,
  lower(winner) AS winner, CASE WHEN CAST(game_id AS BIGINT) % 6 <> 4 THEN CAST((CAST(game_id AS BIGINT) % 3000 + 1) * 1000 + CAST(game_id AS BIGINT) % 900 + 100 AS INT) END AS attendance FROM {{games_flat}}""", "games_flat")
def view_global_game(flat: DataFrame) -> DataFrame:
    """Every way of writing a head count gives the number."""
    return _dated(V.global_game(_documents(flat)))


_TEAM_POINTS = f"""SELECT game_id, season, 'H' AS home_away, home_team_id AS team_id, home_team_city AS team_city, home_team_name AS team_name, away_team_id AS opponent_team_id, {_SCORE.format("home")} AS points FROM {{games_flat}} WHERE home_team_id IS NOT NULL
UNION ALL SELECT game_id, season, 'A', away_team_id, away_team_city, away_team_name, home_team_id, {_SCORE.format("away")} FROM {{games_flat}} WHERE away_team_id IS NOT NULL"""


@_query(_TEAM_POINTS, "games_flat")
def view_team_points(flat: DataFrame) -> DataFrame:
    """N12, U1."""
    return V.team_points(_documents(flat))


@_query(f"""WITH p AS ({_TEAM_POINTS}) SELECT game_id, season, home_away, team_id, team_city, team_name, opponent_team_id, points FROM p WHERE season <> '' AND points IS NOT NULL""", "games_flat")
def view_team_points_complete(flat: DataFrame) -> DataFrame:
    """N12 with all fields known, P3, D6: column names as some source writes them, which must hold all that is needed."""
    spelt = flat.select(*[F.col(c).alias(c.upper() if k % 2 else c.capitalize()) for k, c in enumerate(flat.columns)])
    named = lowered(spelt)
    if missing := missing_columns(named, ["game_id", "season", "home_team_id", "away_team_id", "home_score", "away_score"]):
        raise ValueError(f"columns {missing} are missing")
    return V.team_points(_documents(named), complete=True)


@_query(f"""WITH p AS ({_TEAM_POINTS}) SELECT team_id, arg_min(team_city, CAST(game_id AS BIGINT)) FILTER (team_city IS NOT NULL) AS team_city, arg_min(team_name, CAST(game_id AS BIGINT)) FILTER (team_name IS NOT NULL) AS team_name
FROM (SELECT * FROM p WHERE team_city IS NULL OR home_away = 'H') GROUP BY team_id""", "games_flat")
def view_teams_dim(flat: DataFrame) -> DataFrame:
    """N12's dimension, P5, A3: over home sides, in order of the game's number."""
    home = V.team_points(_documents(flat)).where("home_away = 'H'").withColumn("game_id", F.col("game_id").cast("long"))
    return V.teams_dim(home)


@_query(f"""WITH p AS ({_TEAM_POINTS}), k AS (SELECT *, coalesce(nullif(team_name, ''), nickname) AS name FROM {{team_detail_rows}}),
l AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY seq DESC) AS r FROM k WHERE name IS NOT NULL OR city IS NOT NULL)
SELECT t.team_id, coalesce(l.city, '') AS team_city, coalesce(l.name, '') AS team_name FROM (SELECT DISTINCT team_id FROM p) t LEFT JOIN l ON l.team_id = t.team_id AND r = 1""", "games_flat", "team_detail_rows")
def view_teams_from_details(flat: DataFrame, rows: DataFrame) -> DataFrame:
    """A4: nickname where there is no name, and the last row that has anything."""
    details = rows.select("team_id", "team_name", "nickname", F.struct("city").alias("meta"), "seq")
    return V.teams_from_details(V.team_points(_documents(flat)), details, ["seq"])


_WIDE = ", ".join(
    [*[f"ts.{c}" for c in _RATINGS], "tpg.g AS games_pg", "tpg.mp_per_game AS tpg_minutes"]
    + [f"tpg.{s} AS tpg_{c}" for c, s in zip(_FIGURES, _suffixed("_per_game"))]
    + [f"t100.{s} AS {'t100_' + c if c.endswith('percent') else s}" for c, s in zip(_FIGURES, _suffixed("_per_100_poss"))]
    + [f"opp.{s}" for s in _suffixed("_per_100_poss", "opp_")]
    + [f"tot.{c} AS tot_{c}" for c in _FIGURES]
)
_GAMES_OF = "nullif(coalesce(tpg.g, tot.g), 0)"


@_query(f"""WITH k AS (SELECT *, upper(trim(abbreviation)) AS k FROM {{team_summaries}})
SELECT CAST(ts.season AS INT) AS season, ts.abbreviation AS team_abbr, CASE ts.k WHEN 'ATL' THEN 'atlanta hawks' WHEN 'NJN' THEN 'brooklyn nets' WHEN 'CHH' THEN 'charlotte hornets' WHEN 'SEA' THEN 'oklahoma city thunder' ELSE lower(ts.team) END AS team_name,
  coalesce(CAST(replace(ts.attend, ',', '') AS DOUBLE), CAST(ts.attend_g AS DOUBLE) * {_GAMES_OF}) AS attend, coalesce(CAST(ts.attend_g AS DOUBLE), CAST(replace(ts.attend, ',', '') AS DOUBLE) / {_GAMES_OF}) AS attend_g,
  {_WIDE}, coalesce(tpg.pts_per_game, tot.pts / nullif(tot.g, 0)) AS points_per_game, tot.mp AS tot_minutes
FROM k ts LEFT JOIN {{team_stats_per_game}} tpg ON tpg.season = ts.season AND upper(tpg.abbreviation) = ts.k LEFT JOIN {{team_stats_per_100}} t100 ON t100.season = ts.season AND upper(t100.abbreviation) = ts.k
LEFT JOIN {{opponent_stats_per_100}} opp ON opp.season = ts.season AND upper(opp.abbreviation) = ts.k LEFT JOIN {{team_totals}} tot ON tot.season = ts.season AND upper(tot.abbreviation) = ts.k""", "team_summaries", "team_stats_per_game", "team_stats_per_100", "opponent_stats_per_100", "team_totals", "team_abbrev")
def view_global_team_season(*tables: DataFrame) -> DataFrame:
    """A base and five left joins."""
    return V.global_team_season(*tables)


# --- users' queries


@_query("SELECT player_name, season, team_abbr, position, height_cm, weight_kg FROM {player_season} WHERE team_abbr = 'N3' AND season BETWEEN 1994 AND 1996", "player_season")
def user_roster(player_season: DataFrame) -> DataFrame:
    """Q5."""
    return Q.roster(player_season, "n3", 1994, 1996)


@_query("SELECT player_name, count(*) AS triple_doubles FROM {box} WHERE season BETWEEN 1993 AND 1997 AND pts >= 10 AND reb >= 10 AND ast >= 10 GROUP BY 1", "box")
def user_triple_doubles(box: DataFrame) -> DataFrame:
    """Q6."""
    return Q.triple_doubles(box, 1993, 1997)


@_query("SELECT season, team_abbr, team_name, coach, arena_name FROM {team_season} WHERE team_abbr IN ('T1', 'T2', 'T8') AND season = 1996", "team_season")
def user_coach_and_arena(team_season: DataFrame) -> DataFrame:
    """Q7."""
    return Q.coach_and_arena(team_season, ["t1", "T2", "T8"], 1996)


@_query("SELECT player_name, team_abbr, per, ts_percent, ws, vorp FROM {player_season} WHERE team_abbr = 'N5' AND season = 1995 ORDER BY per DESC NULLS LAST, player_name LIMIT 10", "player_season")
def user_best_by_rating(player_season: DataFrame) -> DataFrame:
    """Q8."""
    return Q.best_by_rating(player_season, "N5", 1995)


@_query("SELECT game_id, CAST(game_date AS VARCHAR) AS game_date, home_team_name, away_team_name, home_score, away_score, attendance FROM {game} WHERE season = 1996 ORDER BY attendance DESC NULLS LAST, game_id LIMIT 50", "game")
def user_most_attended(game: DataFrame) -> DataFrame:
    """Q9."""
    return _dated(Q.most_attended(game, 1996))


@_query("SELECT season, team_abbr, team_name, o_rtg, d_rtg, n_rtg, pace, srs, ts_percent, round(coalesce(points_per_game, o_rtg * pace / 100), 1) AS points_per_game FROM {team_season} WHERE team_abbr IN ('T1', 'T10') AND season = 1997", "team_season")
def user_compare_teams(team_season: DataFrame) -> DataFrame:
    """Q10."""
    return Q.compare_teams(team_season, ["T1", "t10"], 1997)


@_query("SELECT season, team_abbr, team_name, attend, attend_g FROM {team_season} WHERE season = 1996", "team_season")
def user_season_attendance(team_season: DataFrame) -> DataFrame:
    """Q11."""
    return Q.season_attendance(team_season, 1996)


@_query("""SELECT g.season, team_abbr, CAST(round(CAST(sum(attendance) AS DOUBLE) / count(attendance)) AS INT) AS avg_attendance, count(attendance) AS games FROM {home_game} g
JOIN (SELECT DISTINCT season, lower(team_name) AS name, team_abbr FROM {team_season}) t ON t.season = g.season AND t.name = lower(home_team_city || ' ' || home_team_name) WHERE attendance IS NOT NULL GROUP BY 1, 2""", "home_game", "team_season")
def user_home_attendance(game: DataFrame, team_season: DataFrame) -> DataFrame:
    """Q12, A10: a home team has the name of its season, so every season has its rows."""
    return Q.home_attendance(game, team_season)


@_query("""SELECT season, home_team_name, CAST(round(CAST(sum(attendance) AS DOUBLE) / nullif(count(attendance), 0)) AS INT) AS avg_attendance, round(avg(CASE WHEN home_score > away_score THEN 1.0::double ELSE 0 END), 4) AS win_pct, round(avg(home_score - away_score), 4) AS avg_margin, count(*) AS games
FROM {game} GROUP BY 1, 2""", "game")
def user_attendance_and_strength(game: DataFrame) -> DataFrame:
    """Q13, A11."""
    return Q.attendance_and_strength(game)


@_query("""WITH u AS (SELECT *, round(100.0::double * minutes / sum(minutes) OVER (PARTITION BY season, team_abbr), 1) AS pct_team_minutes FROM {usage} WHERE team_abbr = 'N7' AND season = 1996)
SELECT u.player_name, u.season, u.team_abbr, u.g, round(minutes / nullif(g, 0), 1) AS mpg, pct_team_minutes, per, ts_percent, ws, vorp FROM u LEFT JOIN {player_season} p ON p.season = u.season AND p.team_abbr = u.team_abbr AND p.player_id = u.player_id
ORDER BY pct_team_minutes DESC NULLS LAST, u.player_name LIMIT 20""", "usage", "player_season")
def user_player_usage(usage: DataFrame, player_season: DataFrame) -> DataFrame:
    """Q14, W4."""
    return Q.player_usage(usage, player_season, "n7", 1996)


@_query("""WITH r AS (SELECT home_id AS team_id, count(*) AS games FROM {game} GROUP BY 1), d AS (SELECT team_id, min(nullif(trim(concat_ws(' ', city, team_name)), '')) AS team FROM {team_detail_rows} GROUP BY 1),
s AS (SELECT 'T' || CAST(n_nationkey AS STRING) AS team_id, n_name AS team FROM nation) SELECT r.team_id, games, coalesce(d.team, s.team) AS team_full_name FROM r LEFT JOIN d USING (team_id) LEFT JOIN s USING (team_id)""", "game", "team_detail_rows", "nation")
def user_team_names(game: DataFrame, rows: DataFrame, nation: DataFrame) -> DataFrame:
    """Q15: names from the details, or else from the list of nations."""
    details = rows.select("team_id", F.col("city").alias("team_city"), "team_name")
    listed = nation.select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("team_id"), F.lit(None).cast("string").alias("team_city"), F.col("n_name").alias("team_name"))
    result = game.groupBy(F.col("home_id").alias("team_id")).agg(F.count(F.lit(1)).alias("games"))
    return Q.with_team_names(result, Q.team_names({"details": details, "nations": listed}))


@_query("SELECT b.game_id, b.n, substr(CAST(g.game_date AS VARCHAR), 1, 10) AS game_date_iso FROM (SELECT game_id, count(*) AS n FROM {box} GROUP BY 1) b LEFT JOIN {game} g USING (game_id)", "box", "game")
def user_game_dates(box: DataFrame, game: DataFrame) -> DataFrame:
    """Q16."""
    return Q.with_game_dates(box.groupBy("game_id").agg(F.count(F.lit(1)).alias("n")), game)


@_query("""WITH n AS (SELECT DISTINCT lower(trim(home_team_name)) AS team FROM {games_flat} UNION SELECT DISTINCT CASE WHEN c_nationkey % 3 = 0 THEN 'portland trail blazers' ELSE 'los angeles ' || lower(c_mktsegment) END FROM customer)
SELECT team, CASE WHEN team LIKE '%trail blazers' THEN 'trail blazers' ELSE regexp_extract(team, '[^ ]+$') END AS nickname FROM n""", "games_flat", "customer")
def user_nicknames(flat: DataFrame, customer: DataFrame) -> DataFrame:
    """the last word of a team's name, or both where it has two."""
    named = flat.select(F.lower(F.trim("home_team_name")).alias("team")).union(customer.select(F.when(F.col("c_nationkey") % 3 == 0, "portland trail blazers").otherwise(F.concat(F.lit("los angeles "), F.lower("c_mktsegment"))))).distinct()
    return named.select("team", S.nickname(F.col("team")).alias("nickname"))


_CAREER = ["g", "pts", "ast", "reb", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta"]


@_query(f"""WITH s AS (SELECT player_id, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _CAREER)} FROM {{season_box}} GROUP BY 1), l AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC) AS k FROM {{season_box}})
SELECT s.*, round(s.pts::double / s.g, 1) AS ppg, round(s.ast::double / s.g, 1) AS apg, round(s.reb::double / s.g, 1) AS rpg, round(100.0::double * (s.fgm::double / nullif(s.fga, 0)), 1) AS fg_pct, round(100.0::double * (s.fg3m::double / nullif(s.fg3a, 0)), 1) AS fg3_pct,
  round(100.0::double * (s.ftm::double / nullif(s.fta, 0)), 1) AS ft_pct, round(100.0::double * ((s.fgm + 0.5::double * s.fg3m) / nullif(s.fga, 0)), 1) AS efg_pct, l.season AS latest_season, round(l.pts::double / l.g, 1) AS latest_ppg
FROM s JOIN l ON l.player_id = s.player_id AND k = 1""", "season_box")
def user_career(box: DataFrame) -> DataFrame:
    """Q17, A16, A17, F22."""
    return Q.career(box)


@_query("SELECT season, CAST(sum(g) AS BIGINT) AS games, CAST(sum(pts) AS BIGINT) AS pts, CAST(sum(fg3m) AS BIGINT) AS threes, CAST(sum(fgm - fg3m) AS BIGINT) AS twos, CAST(sum(ftm) AS BIGINT) AS free_throws, round(sum(pts)::double / sum(g), 1) AS ppg FROM {season_box} GROUP BY 1", "season_box")
def user_scoring_by_season(box: DataFrame) -> DataFrame:
    """Q18."""
    return Q.scoring_by_season(box)


_PAIR = "((home_id = 'T3' AND away_id = 'T5') OR (home_id = 'T5' AND away_id = 'T3'))"


@_query(f"SELECT game_id, CAST(game_date AS VARCHAR) AS game_date, home_id, away_id, home_pts, away_pts, conference, (SELECT count(*) FROM {{scored}} WHERE {_PAIR}) AS total FROM {{scored}} WHERE {_PAIR} ORDER BY scored.game_date DESC NULLS LAST, game_id LIMIT 5 OFFSET 5", "scored")
def user_meetings(games: DataFrame) -> DataFrame:
    """The second page, and how many games there are."""
    return _dated(Q.meetings(games, "T3", "T5", 2, 5))


@_query("""WITH h AS (SELECT conference, game_date, game_id, home_id, away_id, CASE WHEN home_pts > away_pts THEN 1 ELSE 0 END AS hw FROM {scored} WHERE home_pts IS NOT NULL AND away_pts IS NOT NULL AND home_id <> away_id),
r AS (SELECT conference, home_id AS team, hw AS won, game_date, game_id FROM h UNION ALL SELECT conference, away_id, 1 - hw, game_date, game_id FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conference, team ORDER BY game_date, game_id) AS k, row_number() OVER (PARTITION BY conference, team, won ORDER BY game_date, game_id) AS kw FROM r),
i AS (SELECT *, row_number() OVER (PARTITION BY conference, team, won, k - kw ORDER BY k) AS streak FROM o),
t AS (SELECT conference, team, CAST(sum(won) AS BIGINT) AS w, CAST(sum(1 - won) AS BIGINT) AS l, arg_max(CASE WHEN won = 1 THEN 'W' ELSE 'L' END || CAST(streak AS VARCHAR), k) AS streak FROM i GROUP BY 1, 2)
SELECT conference, team, w, l, (max(w - l) OVER (PARTITION BY conference) - (w - l)) / 2.0::double AS gb, streak FROM t""", "scored")
def user_conference_standings(games: DataFrame) -> DataFrame:
    """Q20, W7."""
    return Q.conference_standings(games.where("home_id <> away_id"))


@_query("""SELECT least(home_id, away_id) AS a, greatest(home_id, away_id) AS b, count(*) AS games, count(*) FILTER (d > 0) AS a_w, count(*) FILTER (d < 0) AS b_w, round(avg(d), 4) AS avg_diff FROM
(SELECT *, CASE WHEN home_id <= away_id THEN home_pts - away_pts ELSE away_pts - home_pts END AS d FROM {scored}) WHERE (home_id = 'T6' AND away_id = 'T14') OR (home_id = 'T14' AND away_id = 'T6') GROUP BY 1, 2""", "scored", "nation")
def user_matchup(games: DataFrame, nation: DataFrame) -> DataFrame:
    """Q22: the record of two teams found by name."""
    teams = nation.select(F.lit("team").alias("_entity"), F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("_id"), F.col("n_name").alias("_title"), F.lit("").alias("_subtitle"), F.lit("").alias("_extra"))
    return Q.matchup("nation_6 vs Nation_14", teams, games)


@_query("""WITH p AS (SELECT game_id, string_agg(CAST(period AS VARCHAR) || ':' || CAST(home_pts AS VARCHAR) || '-' || CAST(away_pts AS VARCHAR), ' ' ORDER BY period, home_pts, away_pts) AS periods FROM {periods} GROUP BY 1),
s AS (SELECT game_id, team_abbr, CAST(sum(pts) AS BIGINT) AS pts, CAST(sum(coalesce(reb, oreb + dreb)) AS BIGINT) AS reb, CAST(sum(ast) AS BIGINT) AS ast FROM {box} GROUP BY 1, 2),
t AS (SELECT game_id, string_agg(team_abbr || ':' || CAST(pts AS VARCHAR) || '/' || CAST(reb AS VARCHAR) || '/' || CAST(ast AS VARCHAR), ' ' ORDER BY team_abbr) AS sides FROM s GROUP BY 1)
SELECT g.game_id, home_score, away_score, coalesce(periods, '') AS periods, coalesce(sides, '') AS sides FROM {game} g LEFT JOIN p USING (game_id) LEFT JOIN t USING (game_id)""", "game", "periods", "box")
def user_game_detail(game: DataFrame, periods: DataFrame, box: DataFrame) -> DataFrame:
    """Q23: periods and sides in order, written as text."""
    text = lambda c: c.cast("string")
    whole = lambda c: c.cast("long").cast("string")
    found = Q.game_detail(game.select("game_id", "home_score", "away_score"), periods, box)
    each = F.transform("periods", lambda p: F.concat(text(p["period"]), F.lit(":"), text(p["home_pts"]), F.lit("-"), text(p["away_pts"])))
    sides = F.transform("sides", lambda s: F.concat(s["team_abbr"], F.lit(":"), whole(s["pts"]), F.lit("/"), whole(s["reb"]), F.lit("/"), whole(s["ast"])))
    return found.select("game_id", "home_score", "away_score", F.coalesce(F.array_join(each, " "), F.lit("")).alias("periods"), F.coalesce(F.array_join(sides, " "), F.lit("")).alias("sides"))


@_query("""WITH m AS (SELECT team_abbr, max(season) AS season FROM {player_season} GROUP BY 1), r AS (SELECT DISTINCT p.team_abbr, season, player_name, position FROM {player_season} p JOIN m USING (team_abbr, season)),
a AS (SELECT 'T' || substr(team_abbr, 2) AS team_abbr, season, count(*) AS roster_size, string_agg(player_name || '/' || coalesce(position, ''), ' ' ORDER BY player_name) AS roster FROM r GROUP BY 1, 2),
n AS (SELECT team_abbr, team_name, min(season) AS first, max(season) AS last FROM {team_season} WHERE team_name IS NOT NULL GROUP BY 1, 2), b AS (SELECT team_abbr, string_agg(CAST(first AS VARCHAR) || '-' || CAST(last AS VARCHAR) || ' ' || team_name, ', ' ORDER BY first, last, team_name) AS names FROM n GROUP BY 1)
SELECT coalesce(a.team_abbr, b.team_abbr) AS team_abbr, season, CAST(roster_size AS INT) AS roster_size, coalesce(roster, '') AS roster, coalesce(names, '') AS names FROM a FULL OUTER JOIN b ON a.team_abbr = b.team_abbr""", "player_season", "team_season")
def user_team_profile(player_season: DataFrame, team_season: DataFrame) -> DataFrame:
    """Q24: rosters and names in order, written as text."""
    own = player_season.withColumn("team_abbr", F.concat(F.lit("T"), F.substring("team_abbr", 2, 9)))
    found = Q.team_profile(own, team_season)
    players = F.transform("roster", lambda p: F.concat(p["player_name"], F.lit("/"), F.coalesce(p["position"], F.lit(""))))
    names = F.transform("names", lambda n: F.concat(n["first"].cast("string"), F.lit("-"), n["last"].cast("string"), F.lit(" "), n["team_name"]))
    return found.select("team_abbr", "season", "roster_size", F.coalesce(F.array_join(players, " "), F.lit("")).alias("roster"), F.coalesce(F.array_join(names, ", "), F.lit("")).alias("names"))


@_query("""WITH h AS (SELECT game_id, game_date, home_id, away_id, CASE WHEN home_pts > away_pts THEN 1 ELSE 0 END AS home_win FROM {scored} WHERE home_pts IS NOT NULL AND away_pts IS NOT NULL AND home_id <> away_id),
r AS (SELECT game_id, 'home' AS side, home_id AS team, home_win AS won, date_diff('day', DATE '1970-01-01', game_date) AS day FROM h UNION ALL SELECT game_id, 'away', away_id, 1 - home_win, date_diff('day', DATE '1970-01-01', game_date) FROM h),
f AS (SELECT game_id, side, coalesce(avg(won) OVER y, 0.5::double) AS form, CAST(least(coalesce(day - max(day) OVER a, 14), 14) AS DOUBLE) AS rest, coalesce(avg(CASE WHEN side = 'home' THEN won END) OVER a, 0.5::double) AS baseline FROM r
  WINDOW y AS (PARTITION BY team ORDER BY day RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY team ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT h.game_id, CAST(game_date AS VARCHAR) AS game_date, home_id, away_id, home_win, round(x.form, 9) AS home_form, round(y.form, 9) AS away_form, x.rest AS home_rest, y.rest AS away_rest, round(x.baseline, 9) AS home_baseline FROM h JOIN f x ON x.game_id = h.game_id AND x.side = 'home' JOIN f y ON y.game_id = h.game_id AND y.side = 'away'""", "scored")
def home_win_features(games: DataFrame) -> DataFrame:
    """M2: form, rest and home record before each game."""
    from tessera.plans.winmodel import game_features

    found = game_features(games.where("home_id <> away_id"))
    return _dated(found).select(*[F.round(c, 9).alias(c) if c in ("home_form", "away_form", "home_baseline") else F.col(c) for c in found.columns])
