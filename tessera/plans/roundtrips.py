"""Every sink and reader as a query: a table of the star schema is written, read back by the matching reader, and compared with SQL on the table.

Tables go to the folder of spark.checkpoint.dir. Registers with `integrated`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import views as V
from tessera.plans.integrated import _SCORE, _TEAM_POINTS, ORACLE_SQL, QUERIES, _dated, _documents, _with, stage
from tessera.sources import registry as G
from tessera.sources import sinks as K
from tessera.sources.schemas import GAMES_JSON, SCHEMAS, short
from tessera.sources.staging import staging_path


def _query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = _with(sql.strip())
        return f

    return add


def _points(spark: SparkSession, d: str) -> DataFrame:
    return V.team_points(_documents(stage(spark, d, "games_flat")))


@_query(_TEAM_POINTS)
def sink_parquet(spark: SparkSession, d: str) -> DataFrame:
    """The fact by season, read with its schema, so that a season stays text."""
    path = staging_path(spark, "points")
    K.write_parquet(_points(spark, d), path, ["season"])
    return G.parquet(path, SCHEMAS["team_game_points"])(spark)


@_query(f"WITH p AS ({_TEAM_POINTS}) SELECT season, team_id, points, game_id FROM p")
def sink_tsv(spark: SparkSession, d: str) -> DataFrame:
    """The fact as text of four columns."""
    path = staging_path(spark, "points-tsv")
    K.write_tsv(_points(spark, d).select("season", "team_id", "points", "game_id"), path)
    return G.of_format("tsv", path, SCHEMAS["team_game_points_tsv"])(spark)


@_query(f"""SELECT game_id, game_date, CAST(CASE WHEN season IS NOT NULL THEN CAST(substr(season, 1, 4) AS INT) WHEN month(CAST(game_date AS DATE)) >= 7 THEN year(CAST(game_date AS DATE)) ELSE year(CAST(game_date AS DATE)) - 1 END AS INT) AS season, home_team_id, {_SCORE.format("home")} AS home_score, away_team_id, {_SCORE.format("away")} AS away_score FROM {{games_flat}}""")
def source_documents(spark: SparkSession, d: str) -> DataFrame:
    """Games as documents of two levels, one a line, among lines that are blank or broken."""
    path = staging_path(spark, "games-json")
    games = _documents(stage(spark, d, "games_flat"))
    line = F.to_json(F.struct(*games.columns), {"ignoreNullFields": "true"})
    lines = games.select(F.explode(F.array(line, F.lit(""), F.lit("{broken"))).alias("value"))
    lines.write.text(path)
    read = V.global_game(G.json_lines(path, GAMES_JSON)(spark).where("game_id is not null"))
    return _dated(read).select("game_id", "game_date", "season", "home_team_id", "home_score", "away_team_id", "away_score")


@_query("SELECT c_name, CAST(c_custkey AS INT) AS c_custkey, c_acctbal, CAST(NULL AS INT) AS missing FROM customer")
def source_headed_csv(spark: SparkSession, d: str) -> DataFrame:
    """Columns by name whatever their order and case; one that the file lacks is null, and numbers come as `12.0`."""
    path = staging_path(spark, "customer-csv")
    customer = stage(spark, d, "customer")
    customer.select(F.col("c_custkey").cast("double").alias("C_CUSTKEY"), F.col("c_acctbal").alias("c_acctbal"), F.col("c_name").alias("C_Name"), "c_mktsegment").write.option("header", True).csv(path)
    return G.of_format("csv", path, short("s: c_name", "i: c_custkey", "d: c_acctbal", "i: missing"))(spark)


@_query("SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
def source_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A database that can't be reached, then a folder that isn't there, then the files."""
    reader = G.first_available(G.jdbc("orders", url="jdbc:none:x", driver="no.such.Driver"), G.parquet(f"{d}/no_such_orders.parquet"), G.parquet(f"{d}/orders.parquet"))
    return reader(spark).select("o_orderkey", "o_orderstatus", "o_custkey")


@_query("SELECT CAST(c_custkey AS INT) AS c_custkey, c_name, '' AS note FROM customer")
def source_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """Some columns of a wide table, loaded into a staging table whose rows are counted."""
    path = staging_path(spark, "customer-staging")
    customer = stage(spark, d, "customer").withColumn("c_custkey", F.col("c_custkey").cast("int"))
    own = G.trimmed(customer, ["c_custkey", "c_name", "note"], F.lit(""))
    K.load_and_count(own, path, expected=customer.count())
    return G.parquet(path, own.schema)(spark)


@_query("SELECT game_id, season, home_score FROM {games_flat}")
def sink_export_view(spark: SparkSession, d: str) -> DataFrame:
    """A published view as delimited text, nulls being marked."""
    path, registry = staging_path(spark, "export"), G.Registry()
    registry.source("games_flat", lambda s: stage(s, d, "games_flat"))
    registry.view("exported_games", lambda reg, s: reg.table(s, "games_flat").select("game_id", "season", "home_score"))
    (name,) = registry.publish(spark, "rt_")
    K.export_view(spark, name, path)
    return spark.read.schema(short("s: game_id season home_score")).option("sep", "\t").option("nullValue", r"\N").csv(path)


@_query("SELECT o_orderkey, o_totalprice, CAST(200 AS BIGINT) AS listed FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def sink_export_json(spark: SparkSession, d: str) -> DataFrame:
    """The first rows in an order, as one document with their number."""
    path = staging_path(spark, "export-json")
    K.export_json(stage(spark, d, "orders").select("o_orderkey", "o_totalprice"), path, [F.col("o_totalprice").desc(), F.col("o_orderkey")], most=200)
    document = spark.read.schema("rows array<struct<o_orderkey: bigint, o_totalprice: double>>, count bigint").json(path)
    return document.select(F.inline("rows"), F.col("count").alias("listed"))


@_query("SELECT 'orders' AS tool, count(*) AS rows FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def sink_append_log(spark: SparkSession, d: str) -> DataFrame:
    """A record for each run, appended to one log."""
    path = staging_path(spark, "log")
    for name in ("orders", "events"):
        K.append_log(spark, path, {"tool": name, "rows": stage(spark, d, name).count()})
    return G.json_lines(path, short("s: tool").add("rows", "long"))(spark)


@_query("SELECT n_nationkey, n_name, 2 AS version FROM nation UNION ALL SELECT s_suppkey + 1000, s_name, 2 FROM supplier")
def sink_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A view's snapshot, and the next one, which reads the first while it takes its place."""
    path = staging_path(spark, "snapshot")
    named = stage(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.lit(1).alias("version"))
    K.snapshot(named, "rt_named", path)
    more = stage(spark, d, "supplier").select((F.col("s_suppkey") + 1000).cast("long"), "s_name", F.lit(1))
    return K.snapshot(spark.table("rt_named").unionAll(more).withColumn("version", F.lit(2)), "rt_named", path)


@_query("SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1")
def sink_materialized(spark: SparkSession, d: str) -> DataFrame:
    """Built once; the second call finds it."""
    path = staging_path(spark, "materialized")
    K.materialize_if_absent(spark, path, lambda: stage(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders")))
    return K.materialize_if_absent(spark, path, lambda: stage(spark, d, "no_such_table"))
