"""The central views of players, team seasons and the ranking's fact, on tables staged from the star schema, with SQL that must give the same rows.

Registers with `integrated`, whose staging tables and helpers it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.plans import views as V
from tessera.plans.integrated import _CODES, STAGES, _query

_KEY = "CAST(c_custkey AS STRING)"
_TEAM = "' n' || CAST(c_nationkey AS STRING) || ' '"

STAGES |= {
    # rosters: some players without an id, without a position, or with two rows
    "roster": f"""SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'P' || {_KEY} END AS player_id, CAST(y AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN '-99' ELSE '' END AS season, 'Jo' || CAST(c_custkey % 13 AS STRING) || ' Öak-' || {_KEY} AS player,
      {_TEAM} AS team, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE ' g ' END AS pos, CAST(n AS INT) AS g, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(n % 3 AS INT) END AS gs, CAST(n * 10 AS DOUBLE) AS pts, CAST(n % 7 AS DOUBLE) AS ast, CAST(n % 5 AS DOUBLE) AS trb FROM {{py}}
      UNION ALL SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'P' || {_KEY} END, CAST(y AS STRING), 'Jo' || CAST(c_custkey % 13 AS STRING) || ' Öak-' || {_KEY}, {_TEAM}, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'G' END, CAST(n + 1 AS INT), 9, CAST(1 AS DOUBLE), CAST(99 AS DOUBLE), NULL FROM {{py}} WHERE c_custkey % 9 = 0""",
    # the register: known by id, by name, or by last name and first letters; some names twice
    "register": f"""SELECT CASE WHEN c_custkey % 3 = 0 THEN 'P' ELSE 'R' END || {_KEY} AS player_id, CASE c_custkey % 3 WHEN 0 THEN 'Sömeone ' || {_KEY} WHEN 1 THEN 'jo' || CAST(c_custkey % 13 AS STRING) || ' OAK ' || {_KEY} ELSE 'Jonas of Oak' || {_KEY} END AS full_name, 'Jonas' AS first_name,
      CASE WHEN c_custkey % 3 = 2 THEN 'Öak ' || {_KEY} ELSE 'none' END AS last_name, CASE WHEN c_custkey % 5 = 1 THEN NULL ELSE 'Guard' END AS position, CAST(5 + c_custkey % 3 AS STRING) || '-' || CAST(c_custkey % 12 AS STRING) AS height, CAST(180 + c_custkey % 60 AS STRING) || ' lbs' AS weight FROM {{customer}} WHERE c_custkey % 4 <> 3
      UNION ALL SELECT 'S' || {_KEY}, 'Jo' || CAST(c_custkey % 13 AS STRING) || ' Oak-' || {_KEY}, 'Jo', 'x', 'Center', 'tall', '?' FROM {{customer}} WHERE c_custkey % 6 = 1""",
    "rates": f"""SELECT CASE WHEN c_custkey % 2 = 0 THEN 'P' ELSE 'R' END || {_KEY} AS player_id, CAST(y AS STRING) AS season, {_TEAM} AS team, CAST(n % 7 AS DOUBLE) AS pts_per_game, CAST(n % 5 AS DOUBLE) AS ast_per_game, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(n % 3 AS DOUBLE) END AS trb_per_game FROM {{py}}
      UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN 'P' ELSE 'R' END || {_KEY}, CAST(y AS STRING), {_TEAM}, CAST(n AS DOUBLE), CAST(1 AS DOUBLE), NULL FROM {{py}} WHERE c_custkey % 4 = 1""",
    "ratings": f"""SELECT CASE WHEN c_custkey % 4 = 0 THEN 'P' ELSE 'R' END || {_KEY} AS player_id, CAST(y AS STRING) AS season, CAST(n AS DOUBLE) + 0.25 AS per, CASE WHEN c_custkey % 2 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(n + 40 AS DOUBLE) END AS ts_percent, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(n % 9 AS DOUBLE) END AS ws,
      CAST(n % 4 AS DOUBLE) AS bpm, CAST(n % 6 AS DOUBLE) + 0.75 AS vorp FROM {{py}} WHERE c_custkey % 5 <> 2""",
    "experience": f"SELECT CASE WHEN c_custkey % 3 = 0 THEN 'P' ELSE 'R' END || {_KEY} AS player_id, CAST(y AS STRING) AS season, CAST(n % 11 AS INT) AS experience FROM {{py}} UNION ALL SELECT 'R' || {_KEY}, CAST(y AS STRING), 5 FROM {{py}} WHERE c_custkey % 6 = 2",
    "history": f"SELECT 'JO' || CAST(c_custkey % 13 AS STRING) || ' öak ' || {_KEY} AS player, CAST(y AS STRING) AS year, CAST(7 AS DOUBLE) AS per, CAST(1 AS DOUBLE) AS ts_percent, CAST(n % 3 AS DOUBLE) + 0.5 AS ws, CAST(2 AS DOUBLE) AS vorp FROM {{py}} WHERE c_custkey % 3 <> 0",
    # team seasons
    "team_seasons": f"SELECT CAST(y AS STRING) AS season, 'L' AS lg, ' ' || {_CODES} AS abbreviation, CASE WHEN c_nationkey % 6 = 1 THEN NULL ELSE 'Team ' || CAST(c_nationkey AS STRING) END AS team, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE 'Arena ' || CAST(c_nationkey AS STRING) END AS arena FROM {{ty}}",
    "team_codes": f"SELECT CAST(y AS STRING) AS season, {_CODES} AS abbreviation, 'Code ' || CAST(c_nationkey AS STRING) AS team_name FROM {{ty}} WHERE c_nationkey % 7 <> 3",
    "team_facts": f"SELECT {_CODES} AS abbreviation, 'Nick ' || CAST(c_nationkey AS STRING) AS nickname, 'CITY' AS city, CASE WHEN c_nationkey % 8 = 0 THEN NULL ELSE 'Dome' END AS arena, CAST(c_nationkey * 100 AS STRING) || '.0' AS capacity, CASE WHEN c_nationkey % 2 = 0 THEN 'Coach ' || CAST(c_nationkey AS STRING) END AS coach FROM (SELECT DISTINCT c_nationkey FROM {{customer}} WHERE c_nationkey % 5 <> 4) f",
    "coaches": """SELECT 'Coach ' || CAST(s_suppkey % 40 AS STRING) AS name, 't' || CAST(s_nationkey AS STRING) || ', SEA ,T' || CAST((s_nationkey + 3) % 25 AS STRING) || CASE WHEN s_suppkey % 3 = 0 THEN ',' ELSE '' END AS teams, CAST(1993 + s_suppkey % 5 AS STRING) AS start_season_short,
      CAST(1993 + s_suppkey % 5 + s_suppkey % 8 - 1 AS STRING) AS end_season_short, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN '3' ELSE '4' END AS num_of_teams FROM {supplier}""",
    # the ranking's fact
    "season_ratings": f"""SELECT CAST(y AS STRING) AS season, 'P' || {_KEY} AS player_id, CASE WHEN c_custkey % 3 = 0 THEN 'TOT' ELSE {_TEAM} END AS team, CAST(n AS INT) AS g, CAST(n AS DOUBLE) AS mp, CAST(n % 31 AS DOUBLE) AS usg_percent, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(0.5 AS DOUBLE) END AS ts_percent, CAST(n % 9 AS DOUBLE) AS ws, CAST(n % 4 AS DOUBLE) AS vorp FROM {{py}} WHERE c_custkey % 7 <> 6
      UNION ALL SELECT CAST(y AS STRING), 'P' || {_KEY}, CASE WHEN c_custkey % 2 = 0 THEN 'TOT' ELSE {_TEAM} END, CAST(n AS INT), CAST(n + 1 AS DOUBLE), NULL, CAST(0.25 AS DOUBLE), CAST(1 AS DOUBLE), CAST(n AS DOUBLE) FROM {{py}} WHERE c_custkey % 4 = 1""",
    "season_rates": f"SELECT CAST(y AS STRING) AS season, 'P' || {_KEY} AS player_id, CASE WHEN c_custkey % 5 = 0 THEN 'TOT' ELSE {_TEAM} END AS team, CAST(n AS INT) AS g, CAST(n % 6 * 5 AS DOUBLE) AS mp_per_game, CAST(n % 13 AS DOUBLE) AS pts_per_game FROM {{py}}",
    "season_points": "SELECT CAST(y AS STRING) AS season, 'N' || CAST(c_nationkey AS STRING) AS abbreviation, CAST(n % 90 + 20 AS INT) AS pts FROM {ty} WHERE c_nationkey % 9 <> 0 UNION ALL SELECT CAST(y AS STRING), 'n' || CAST(c_nationkey AS STRING), 50 FROM {ty} WHERE c_nationkey % 9 = 1",
}

_FOLD = f"translate({{}}, '{S.ACCENTED}', '{S.PLAIN}')"
_norm = lambda text: f"regexp_replace({_FOLD.format(f'lower({text})')}, '[^a-z0-9]', '', 'g')"
_YEAR = "CAST(substr({}, 1, 4) AS INT)"
_SEASON = _YEAR.format("season")
_ABBR = "upper(trim(team))"
_MATCH = "SELECT roster.*, {} AS prio, i.cpi_id, i.full_name, i.cpi_position, i.height, i.weight FROM r roster"


@_query(f"""WITH r AS (SELECT player_id AS pt_id, {_SEASON} AS season, {_ABBR} AS team_abbr, {_norm("player")} AS name_key, {_norm("regexp_extract(player, '(^| )([^ ]+)$', 2)")} AS last_key, substr({_norm("regexp_extract(player, '^([A-Za-z0-9]+)', 1)")}, 1, 2) AS first_key,
  upper(trim(pos)) AS pt_position, max(player) AS player, max(coalesce(g, 0)) AS g, max(coalesce(gs, 0)) AS gs, max(pts) AS pts, max(ast) AS ast, max(trb) AS trb FROM {{roster}} GROUP BY 1, 2, 3, 4, 5, 6, 7),
i AS (SELECT player_id AS cpi_id, full_name, position AS cpi_position, height, weight, {_norm("full_name")} AS cpi_name, {_norm("last_name")} AS cpi_last, substr({_norm("first_name")}, 1, 2) AS cpi_first FROM {{register}}),
m AS ({_MATCH.format(1)} JOIN i ON cpi_id = pt_id UNION ALL {_MATCH.format(2)} JOIN i ON cpi_name = name_key UNION ALL {_MATCH.format(3)} JOIN i ON cpi_last = last_key AND cpi_first = first_key
  UNION ALL SELECT *, 99, NULL, NULL, NULL, NULL, NULL FROM r),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pt_id, season, team_abbr, name_key ORDER BY prio, cpi_id NULLS LAST) AS k FROM m) WHERE k = 1),
p AS (SELECT *, coalesce(cpi_id, pt_id) AS player_id, {_FOLD.format("coalesce(full_name, player)")} AS player_name FROM b),
per_game AS (SELECT player_id, {_SEASON} AS season, {_ABBR} AS team_abbr, avg(pts_per_game) AS pts_per_game, avg(ast_per_game) AS ast_per_game, avg(trb_per_game) AS trb_per_game FROM {{rates}} GROUP BY 1, 2, 3),
adv AS (SELECT player_id, {_SEASON} AS season, avg(per) AS per, avg(ts_percent) AS ts_percent, avg(ws) AS ws, avg(bpm) AS bpm, avg(vorp) AS vorp FROM {{ratings}} GROUP BY 1, 2),
ex AS (SELECT player_id, {_SEASON} AS season, max(experience) AS experience_years FROM {{experience}} GROUP BY 1, 2),
old AS (SELECT {_norm("player")} AS name_key, {_YEAR.format("year")} AS season, avg(per) AS per, avg(ts_percent) AS ts_percent, avg(ws) AS ws, avg(vorp) AS vorp FROM {{history}} GROUP BY 1, 2),
j AS (SELECT p.*, CASE WHEN x.player_id IS NOT NULL THEN x.pts_per_game ELSE y.pts_per_game END AS pts_per_game, CASE WHEN x.player_id IS NOT NULL THEN x.ast_per_game ELSE y.ast_per_game END AS ast_per_game, CASE WHEN x.player_id IS NOT NULL THEN x.trb_per_game ELSE y.trb_per_game END AS trb_per_game,
  CASE WHEN v.player_id IS NOT NULL THEN v.per ELSE w.per END AS a_per, CASE WHEN v.player_id IS NOT NULL THEN v.ts_percent ELSE w.ts_percent END AS a_ts, CASE WHEN v.player_id IS NOT NULL THEN v.ws ELSE w.ws END AS a_ws, CASE WHEN v.player_id IS NOT NULL THEN v.bpm ELSE w.bpm END AS a_bpm, CASE WHEN v.player_id IS NOT NULL THEN v.vorp ELSE w.vorp END AS a_vorp
  FROM p LEFT JOIN per_game x ON x.player_id = p.player_id AND x.season = p.season AND x.team_abbr = p.team_abbr LEFT JOIN per_game y ON y.player_id = p.pt_id AND y.season = p.season AND y.team_abbr = p.team_abbr
  LEFT JOIN adv v ON v.player_id = p.player_id AND v.season = p.season LEFT JOIN adv w ON w.player_id = p.pt_id AND w.season = p.season)
SELECT j.player_id, j.player_name, j.season, j.team_abbr, upper(coalesce(cpi_position, pt_position)) AS position,
  CASE WHEN regexp_matches(height, '^[0-9]+-[0-9]+$') THEN CAST(round(2.54::double * (12 * CAST(split_part(height, '-', 1) AS INT) + CAST(split_part(height, '-', 2) AS INT))) AS INT) END AS height_cm,
  CAST(round(0.45359237::double * try_cast(regexp_extract(weight, '^[0-9]+') AS INT)) AS INT) AS weight_kg, g, gs, pts, ast, trb, pts_per_game, ast_per_game, trb_per_game, round(coalesce(a_per, old.per), 1) AS per,
  round(CASE WHEN coalesce(a_ts, old.ts_percent) <= 1 THEN 100.0::double * coalesce(a_ts, old.ts_percent) ELSE coalesce(a_ts, old.ts_percent) END, 1) AS ts_percent, round(coalesce(a_ws, old.ws), 1) AS ws, a_bpm AS bpm, round(coalesce(a_vorp, old.vorp), 1) AS vorp, experience_years,
  CASE WHEN cpi_position IS NOT NULL THEN 'common_player_info' WHEN pt_position IS NOT NULL THEN 'player_totals' END AS src_position
FROM j LEFT JOIN ex ON ex.player_id = j.player_id AND ex.season = j.season LEFT JOIN old ON old.name_key = {_norm("j.player_name")} AND old.season = j.season""", "roster", "register", "rates", "ratings", "experience", "history")
def view_global_player_season(*tables: DataFrame) -> DataFrame:
    """Players resolved by three rules, with figures by either id and ratings of two sources."""
    return V.global_player_season(*tables)


_CANON = ", ".join(f"('{old}', '{new}')" for new, olds in S.CANONICAL.items() for old in olds)


@_query(f"""WITH canon(old, new) AS (VALUES {_CANON}),
s AS (SELECT DISTINCT {_SEASON} AS season, upper(trim(abbreviation)) AS team_abbr, lower(team) AS ts_name, lower(arena) AS ts_arena, lg AS league FROM {{team_seasons}}),
a AS (SELECT {_SEASON} AS season, upper(trim(abbreviation)) AS team_abbr, min(lower(team_name)) AS ta_name FROM {{team_codes}} GROUP BY 1, 2),
d AS (SELECT upper(trim(abbreviation)) AS team_abbr, lower(nickname) AS nickname, lower(city) AS city, lower(arena) AS arena, CAST(CAST(capacity AS DOUBLE) AS INT) AS capacity, lower(coach) AS coach FROM {{team_facts}}),
b AS (SELECT s.season, s.team_abbr, coalesce(new, s.team_abbr) AS team_code, coalesce(ts_name, ta_name, nickname) AS team_name, city, coalesce(ts_arena, d.arena) AS arena_name,
  CASE WHEN ts_arena IS NOT NULL THEN 'team_summaries' WHEN d.arena IS NOT NULL THEN 'team_details' END AS src_arena, capacity AS arena_capacity, d.coach AS td_coach, league
  FROM s LEFT JOIN a ON a.season = s.season AND a.team_abbr = s.team_abbr LEFT JOIN d ON d.team_abbr = s.team_abbr LEFT JOIN canon ON old = s.team_abbr),
l AS (SELECT name, CAST(start_season_short AS INT) AS a, CAST(end_season_short AS INT) AS z, nullif(CAST(num_of_teams AS INT), 0) AS stated, list_filter(list_transform(string_split(upper(teams), ','), lambda x: trim(x)), lambda x: x <> '') AS codes FROM {{coaches}}),
u AS (SELECT name, a, z, coalesce(stated, len(codes), 1) AS n, unnest(codes) AS code, generate_subscripts(codes, 1) AS ord FROM l WHERE a <= z),
t AS (SELECT name, coalesce(new, code) AS team_code, a + (ord - 1) * (z - a + 1) // n AS first, a + ord * (z - a + 1) // n - 1 AS last FROM u LEFT JOIN canon ON old = code),
c AS (SELECT b.*, lower(t.name) AS coach_name, row_number() OVER (PARTITION BY b.season, team_abbr ORDER BY CASE WHEN t.name IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN lower(t.name) = td_coach THEN 0 ELSE 1 END,
  least(abs(b.season - t.first), abs(b.season - t.last)) NULLS LAST, coalesce(lower(t.name), td_coach) NULLS LAST, team_name NULLS LAST, arena_name NULLS LAST) AS k FROM b LEFT JOIN t ON t.team_code = b.team_code AND b.season BETWEEN t.first AND t.last)
SELECT season, team_abbr, team_name, city, arena_name, arena_capacity, coalesce(coach_name, td_coach) AS coach, CASE WHEN coach_name IS NOT NULL THEN 'nba_head_coaches' WHEN td_coach IS NOT NULL THEN 'team_details' END AS src_coach, league, src_arena FROM c WHERE k = 1""", "team_seasons", "team_codes", "team_facts", "coaches")
def view_dim_team_season(summaries: DataFrame, codes: DataFrame, facts: DataFrame, coaches: DataFrame) -> DataFrame:
    """Coaches by even segments of their tenures, at codes of today, with the details' coach as a fallback."""
    arena = F.struct(F.col("arena").alias("name"), "capacity").alias("arena")
    details = facts.select("abbreviation", "nickname", F.struct("city", F.col("coach").alias("head_coach"), arena).alias("meta"))
    return V.dim_team_season(summaries, codes, details, coaches)


_KEYS = f"{_SEASON} AS season, {_ABBR} AS team_abbr, player_id"


@_query(f"""WITH r AS (SELECT {_KEYS}, player AS player_name, pos, g, gs, mp FROM {{play_by_play}} WHERE g >= 6 AND mp IS NOT NULL AND NOT regexp_matches({_ABBR}, '^[0-9]+TM$')),
a AS (SELECT * FROM (SELECT {_KEYS}, usg_percent, ts_percent, ws, vorp, row_number() OVER (PARTITION BY {_SEASON}, {_ABBR}, player_id ORDER BY g DESC NULLS LAST, mp DESC NULLS LAST) AS k FROM {{season_ratings}}) WHERE k = 1),
p AS (SELECT * FROM (SELECT {_KEYS}, mp_per_game, pts_per_game, row_number() OVER (PARTITION BY {_SEASON}, {_ABBR}, player_id ORDER BY g DESC NULLS LAST, mp_per_game DESC NULLS LAST) AS k FROM {{season_rates}}) WHERE k = 1),
t AS (SELECT {_SEASON} AS season, upper(trim(abbreviation)) AS team_abbr, CAST(max(pts) AS DOUBLE) AS team_pts FROM {{season_points}} GROUP BY 1, 2),
j AS (SELECT r.*, {", ".join(f"CASE WHEN x.player_id IS NOT NULL THEN x.{c} ELSE y.{c} END AS {c}" for c in ("usg_percent", "ts_percent", "ws", "vorp"))}, {", ".join(f"CASE WHEN v.player_id IS NOT NULL THEN v.{c} ELSE w.{c} END AS {c}" for c in ("mp_per_game", "pts_per_game"))}, team_pts
  FROM r LEFT JOIN a x ON x.season = r.season AND x.team_abbr = r.team_abbr AND x.player_id = r.player_id LEFT JOIN a y ON y.season = r.season AND y.team_abbr = 'TOT' AND y.player_id = r.player_id
  LEFT JOIN p v ON v.season = r.season AND v.team_abbr = r.team_abbr AND v.player_id = r.player_id LEFT JOIN p w ON w.season = r.season AND w.team_abbr = 'TOT' AND w.player_id = r.player_id LEFT JOIN t ON t.season = r.season AND t.team_abbr = r.team_abbr)
SELECT season, team_abbr, player_id, player_name, pos, g, gs, round(mp, 3) AS mp, round(usg_percent, 3) AS usage_pct, round(ts_percent, 3) AS ts_percent, round(CASE WHEN mp_per_game > 0 THEN pts_per_game / mp_per_game * 36.0::double END, 3) AS pts_per_36,
  round(team_pts, 3) AS team_pts, round(ws, 3) AS ws, round(vorp, 3) AS vorp FROM j""", "play_by_play", "season_ratings", "season_rates", "season_points")
def view_q4_multifactor(play_by_play: DataFrame, ratings: DataFrame, rates: DataFrame, points: DataFrame) -> DataFrame:
    """The ranking's fact, with records of the team or else of the season's totals."""
    return V.q4_multifactor(play_by_play, ratings, rates, points, min_games=6)
