"""Home-win model: form, rest and home record as features, logistic regression on them."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.staging import staged

FEATURES = ["home_form", "away_form", "home_rest", "away_rest", "home_baseline"]
#: Rest of a first game, and the most that counts.
MOST_REST = 14


def daily_form(sides: DataFrame, days: int = 365) -> DataFrame:
    """Of each team and day with games: form, rest and home baseline before that day. `sides`: (team, day, at_home, won), a row a team and game.

    Games are added up by team and day first. A team's days are cut into buckets of `days`; each day goes to its own bucket and, as a halo, to
    the next one, which is all that a form of `days` needs, so a team is as many tasks as it has buckets. What reaches back further,
    the home record, is carried from bucket to bucket as sums.
    """
    home = F.when(F.col("at_home"), F.col("won"))
    daily = sides.groupBy("team", "day").agg(F.count("won").alias("n"), F.sum("won").alias("w"), F.count(home).alias("home_n"), F.coalesce(F.sum(home), F.lit(0)).alias("home_w"))
    daily = daily.withColumn("bucket", F.floor(F.col("day") / days))
    sums = daily.groupBy("team", "bucket").agg(F.sum("home_n").alias("n"), F.sum("home_w").alias("w"))
    earlier = Window.partitionBy("team").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # of a row a bucket
    sums = sums.select(F.col("team").alias("of"), F.col("bucket").alias("then"), F.sum("n").over(earlier).alias("before_n"), F.sum("w").over(earlier).alias("before_w")).where("before_n > 0")
    spread = daily.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("halo")).withColumn("at", F.col("bucket") + F.col("halo"))
    # within a bucket the halo's days come first, as they are earlier
    own = Window.partitionBy("team", "at").orderBy("day")
    before, so_far = own.rangeBetween(-days, -1), own.rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda c: F.coalesce(F.sum(F.when(F.col("halo") == 0, F.col(c))).over(so_far), F.lit(0))
    spread = spread.withColumns({"form": F.try_divide(F.sum("w").over(before), F.sum("n").over(before)), "rest": F.col("day") - F.lag("day").over(own), "own_n": inside("home_n"), "own_w": inside("home_w")})
    found = spread.where("halo = 0").join(sums, F.col("team").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("then")), "left")
    baseline = F.try_divide(F.col("own_w") + F.coalesce("before_w", F.lit(0)), F.col("own_n") + F.coalesce("before_n", F.lit(0)))
    rest = F.least(F.coalesce("rest", F.lit(MOST_REST)), F.lit(MOST_REST)).cast("double")
    return found.select("team", "day", F.coalesce("form", F.lit(0.5)).alias("form"), rest.alias("rest"), F.coalesce(baseline, F.lit(0.5)).alias("baseline"))


def game_features(games: DataFrame, days: int = 365) -> DataFrame:
    """Features of each game from games before it: (game_id, game_date, home_id, away_id, home_win, and FEATURES).

    Form is the part of games won in the `days` before (MOST_REST or more), rest the days since the last game, the home baseline the part of
    home games won so far. Without a game before: form and baseline 0.5, rest the most. See `daily_form` for how teams are split.
    Games without both scores or a date are left out.
    """
    if days < MOST_REST:
        raise ValueError(f"form of fewer than {MOST_REST} days doesn't tell the rest")
    games = games.where("home_pts is not null and away_pts is not null and game_date is not null")
    home_win = F.when(F.col("home_pts") > F.col("away_pts"), 1).otherwise(0)
    games = games.select("game_id", "game_date", "home_id", "away_id", home_win.alias("home_win"), F.datediff("game_date", F.lit("1970-01-01").cast("date")).alias("__day"))
    side = lambda team, at_home, won: F.struct(F.col(team).alias("team"), F.lit(at_home).alias("at_home"), won.alias("won"))
    sides = games.select(F.col("__day").alias("day"), F.inline(F.array(side("home_id", True, F.col("home_win")), side("away_id", False, 1 - F.col("home_win")))))
    form = daily_form(sides, days)
    for name in ("home", "away"):
        of = form.select(F.col("team").alias("__team"), F.col("day").alias("__of"), *[F.col(c).alias(f"{name}_{c}") for c in ("form", "rest", "baseline")])
        games = games.join(of, F.col(f"{name}_id").eqNullSafe(F.col("__team")) & (F.col("__day") == F.col("__of"))).drop("__team", "__of")
    return games.select("game_id", "game_date", "home_id", "away_id", "home_win", *FEATURES)


def fit_home_win(features: DataFrame, reg_param: float = 0.01, elastic_net: float = 0.0, test_percent: int = 20, model_path: str | None = None) -> tuple[LogisticRegressionModel, DataFrame]:
    """A model of the training games, and p_home_win, p_away_win and winner of the test games.

    A game's part depends on a hash of what it is, so reruns agree. With `model_path` the model is saved there. Features are staged, as
    the fit takes several jobs and the test games one more.
    """
    features = staged(features.select("game_id", "game_date", "home_id", "away_id", "home_win", *FEATURES), "features")
    part = F.pmod(F.xxhash64("game_id", "game_date", "home_id", "away_id"), F.lit(100)) < test_percent
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features).withColumn("test", part)
    model = LogisticRegression(labelCol="home_win", regParam=reg_param, elasticNetParam=elastic_net, maxIter=50).fit(assembled.where("not test"))
    if model_path:
        model.write().overwrite().save(model_path)
    scored = model.transform(assembled.where("test"))
    p = F.round(vector_to_array("probability")[1], 6)
    winner = F.when(p >= 0.5, F.col("home_id")).otherwise(F.col("away_id"))
    return model, scored.select("game_id", "game_date", "home_id", "away_id", "home_win", p.alias("p_home_win"), F.round(1 - p, 6).alias("p_away_win"), winner.alias("winner"))
