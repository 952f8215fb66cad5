"""Multi-factor ranking of players within a team's season."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import clamp01, ramp
from tessera.operators.windows import top_n, with_group_total


@dataclass(frozen=True)
class Factors:
    """Weights of the score's terms, their scales, and the ramps that damp few minutes and games."""

    min_share: float = 0.30
    usage: float = 0.15
    true_shooting: float = 0.15
    per_36: float = 0.15
    points_share: float = 0.10
    win_shares: float = 0.075
    value: float = 0.075
    minutes: tuple[float, float] = (10.0, 30.0)
    games: tuple[float, float] = (10.0, 82.0)
    min_games: int = 10
    keep: int = 15


def _unit(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def multifactor_rank(df: DataFrame, factors: Factors = Factors(), season: int | None = None, team: str | None = None, digits: int = 3) -> DataFrame:
    """The best players of each season and team by score, with the columns that make it.

    Input: season, team_abbr, player_id, player_name, pos, g, gs, mp, usage_pct, ts_percent, pts_per_36, team_pts, ws, vorp.
    Rows with fewer games or none known are left out before any total. Shares are rounded to one digit before
    scoring; unknown terms count 0, but an unknown minute share makes the score null. Ties go by share, minutes and id.
    """
    rows = df.where(F.col("g") >= factors.min_games)
    if season is not None:
        rows = rows.where(F.col("season") == season)
    if team is not None:
        rows = rows.where(F.upper("team_abbr") == team.upper())
    squad = ["season", "team_abbr"]
    rows = with_group_total(rows, squad, {"__minutes": F.sum("mp")})
    mpg = F.round(F.col("mp") / F.col("g"), 1)
    total = F.col("__minutes")
    share = F.round(F.when(total > 0, 100.0 * F.col("mp") / total), 1)
    estimated = F.col("pts_per_36") * F.col("mp") / 36.0
    points = F.when(F.col("team_pts") > 0, F.round(100.0 * estimated / F.col("team_pts"), 1))
    rows = rows.withColumn("minutes_per_game", mpg).withColumn("team_minutes_share", share).withColumn("team_pts_share", points)
    raw = (
        factors.min_share * F.col("team_minutes_share") / 100.0
        + factors.usage * _unit(F.col("usage_pct")) / 35.0
        + factors.true_shooting * _unit(F.col("ts_percent"))
        + factors.per_36 * _unit(F.col("pts_per_36")) / 40.0
        + factors.points_share * _unit(F.col("team_pts_share")) / 100.0
        + factors.win_shares * clamp01(F.col("ws"), 10.0)
        + factors.value * clamp01(F.col("vorp"), 8.0)
    )
    damp = 0.5 * ramp(F.col("minutes_per_game"), *factors.minutes) + 0.5 * ramp(F.col("g"), *factors.games)
    rows = rows.withColumn("score", raw * damp)
    order = [F.col(c).desc_nulls_last() for c in ("score", "team_minutes_share", "mp")]
    ranked = top_n(rows, squad, [*order, F.col("player_id").asc_nulls_last()], factors.keep)
    shown = {"mp": 1, "usage_pct": 1, "ts_percent": 3, "pts_per_36": 1, "score": digits}
    kept = ["season", "team_abbr", "rank", "player_id", "player_name", "pos", "g", "gs", "mp", "minutes_per_game", "team_minutes_share", "usage_pct", "ts_percent", "pts_per_36", "team_pts_share", "ws", "vorp", "score"]
    return ranked.select(*[F.round(c, shown[c]).alias(c) if c in shown else F.lower(c).alias(c) if c == "player_name" else F.col(c) for c in kept])
