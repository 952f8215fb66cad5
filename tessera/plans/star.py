"""The registered queries: each operator on the star-schema tables, with SQL that must give the same rows.

Teams are nations or customers, points are prices or quantities, a season is the year that an order's date starts in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import aggregates as A
from tessera.operators import benchstats as B
from tessera.operators import cells as O
from tessera.operators import checks as C
from tessera.operators import joins as J
from tessera.operators import resolve as R
from tessera.operators import reshape as P
from tessera.operators import windows as W
from tessera.operators.ranking import Factors, multifactor_rank
from tessera.sources.staging import staged, staging_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Season of an order in SQL; the same as scalars.season_of_date.
_SEASON = "CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "orders").withColumn("season", S.season_of_date(F.col("o_orderdate")))


@_query(f"""
SELECT CAST({_SEASON} AS INTEGER) AS season, o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_points,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS avg_points, count(o_totalprice) AS games
FROM orders GROUP BY 1, 2""")
def agg_points(spark: SparkSession, d: str) -> DataFrame:
    """Sum, mean and count by season and team."""
    return A.sum_avg_count(_orders(spark, d), ["season", "o_custkey"], "o_totalprice", scale=2)


@_query(f"""
WITH s AS (SELECT CAST({_SEASON} AS INTEGER) AS season, o_custkey, CAST(sum(CASE WHEN o_totalprice >= 400000 THEN 1 ELSE 0 END) AS BIGINT) AS high, count(*) AS total
  FROM orders GROUP BY 1, 2)
SELECT season, o_custkey, high, total, round(100.0::double * high / total, 3) AS pct, c_name FROM s LEFT JOIN customer ON c_custkey = o_custkey""")
def threshold_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of rows over a threshold, then the team's name; aggregated before the join."""
    shares = A.share_over(_orders(spark, d), ["season", "o_custkey"], "o_totalprice", 400_000)
    names = _table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return shares.join(names, "o_custkey", "left")


@_query("""
SELECT o_custkey, o_orderkey, o_totalprice, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS INTEGER) AS rank
  FROM orders) WHERE rank <= 3""")
def topn_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The three highest of each team."""
    order = [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc()]
    return W.top_n(_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], order, 3)


def _games(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as games: the supplier's nation at home, the customer's away; scores are quantity and line number by ten.

    Orders get their customers before lines get their orders, so lines are shuffled by their order only.
    """
    line = _table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber", "l_shipdate")
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customer = _table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("away"))
    supplier = _table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("home"))
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "home", "away", F.col("l_quantity").alias("home_pts"), (F.col("l_linenumber") * 10.0).alias("away_pts"))


_GAMES = """SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, s_nationkey AS home, c_nationkey AS away, l_quantity AS home_pts, l_linenumber * 10.0::double AS away_pts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""


@_query(f"""
WITH g AS ({_GAMES}), u AS (SELECT 'H' AS side, home AS team, away AS opponent, home_pts AS pts FROM g UNION ALL SELECT 'A', away, home, away_pts FROM g)
SELECT side, team, opponent, count(*) AS games, sum(pts) AS pts FROM u GROUP BY ALL""")
def unpivot_sides(spark: SparkSession, d: str) -> DataFrame:
    """One row for each side of a game, in one scan."""
    sides = {"H": {"team": F.col("home"), "opponent": F.col("away"), "p": F.col("home_pts")}, "A": {"team": F.col("away"), "opponent": F.col("home"), "p": F.col("away_pts")}}
    rows = P.unpivot_sides(_games(spark, d), {}, sides, "side")
    return rows.groupBy("side", "team", "opponent").agg(F.count(F.lit(1)).alias("games"), F.sum("p").alias("pts"))


@_query("""
SELECT source, arg_min(lang, doc_id) FILTER (lang IS NOT NULL) AS lang, arg_min(n_chars, doc_id) FILTER (n_chars IS NOT NULL) AS n_chars
FROM documents WHERE source IS NOT NULL GROUP BY source""")
def dim_first_nonnull(spark: SparkSession, d: str) -> DataFrame:
    """A3, P5: the first known attributes of each key."""
    return A.first_known(_table(spark, d, "documents"), "source", ["lang", "n_chars"], "doc_id")


@_query(f"""
WITH s AS (SELECT o_orderkey, CAST({_SEASON} AS INTEGER) AS season FROM orders)
SELECT o_orderkey, season, CAST(season AS VARCHAR) || '-' || right(CAST(season + 1 AS VARCHAR), 2) AS label FROM s""")
def season_label(spark: SparkSession, d: str) -> DataFrame:
    """Season and its label; the date goes through text and back."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    season = S.season_of(F.lit(None).cast("string"), S.tolerant_date(text))
    return _table(spark, d, "orders").select("o_orderkey", season.alias("season"), S.season_label(season).alias("label"))


@_query("""
WITH n AS (SELECT doc_id, text, regexp_replace(translate(lower(text), 'áàäâãåéèëêíìïîóòöôõúùüûñçčćšžđ', 'aaaaaaeeeeiiiiooooouuuuncccszd'), '[^a-z0-9]', '', 'g') AS name_key FROM documents)
SELECT doc_id, sha256(name_key) AS name_key, substr(regexp_replace(lower(nullif(regexp_extract(text, '^([A-Za-z0-9]+)', 1), '')), '[^a-z0-9]', '', 'g'), 1, 2) AS short_key FROM n""")
def name_norm(spark: SparkSession, d: str) -> DataFrame:
    """comparison keys of each document's whole text, the long one as a digest."""
    return _table(spark, d, "documents").select("doc_id", F.sha2(S.norm_name(F.col("text")), 256).alias("name_key"), S.first_letters_key(F.col("text")).alias("short_key"))


@_query("""
SELECT p_partkey, CAST(round(2.54::double * (12 * (p_size // 10) + p_size % 10)) AS INTEGER) AS height_cm, CAST(round(0.45359237::double * (p_size * 5)) AS INTEGER) AS weight_kg FROM part""")
def imperial_to_metric(spark: SparkSession, d: str) -> DataFrame:
    """`feet-inches` and pounds, as text, in metric units."""
    feet = F.concat_ws("-", F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_size") % 10).cast("string"))
    pounds = F.concat((F.col("p_size") * 5).cast("string"), F.lit(" lbs"))
    return _table(spark, d, "part").select("p_partkey", S.height_cm(feet).alias("height_cm"), S.weight_kg(pounds).alias("weight_kg"))


@_query("""
SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderkey % 1000 + 19000 END AS INTEGER) AS attendance,
  CASE o_orderkey % 4 WHEN 1 THEN o_orderkey % 1000 + 19000.0::double WHEN 2 THEN o_orderkey % 1000 + 19000.0::double END AS number FROM orders""")
def attendance_clean(spark: SparkSession, d: str) -> DataFrame:
    """head counts written with dots, commas or a fraction, or not at all, read back."""
    n = F.col("o_orderkey") % 1000 + 19000
    kind = F.col("o_orderkey") % 4
    dotted = F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    comma = F.replace(dotted, F.lit("."), F.lit(","))
    text = F.when(kind == 0, dotted).when(kind == 1, comma).when(kind == 2, F.concat(n.cast("string"), F.lit(".0"))).otherwise("n/a")
    number = F.when(kind.isin(1, 2), S.number_with_commas(text))
    return _table(spark, d, "orders").select("o_orderkey", S.attendance(text).alias("attendance"), number.alias("number"))


@_query("""
WITH l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS hint, c_nationkey AS grp, regexp_extract(c_name, '[0-9]+$') AS digits FROM customer),
r AS (SELECT s_suppkey AS rid, s_nationkey AS rgrp, regexp_extract(s_name, '[0-9]+$') AS rdigits FROM supplier),
m AS (
  SELECT id, 1 AS prio, rid FROM l JOIN r ON hint = rid
  UNION ALL SELECT id, 2, rid FROM l JOIN r ON digits = rdigits
  UNION ALL SELECT id, 3, rid FROM l JOIN r ON grp = rgrp AND right(digits, 2) = right(rdigits, 2)
  UNION ALL SELECT id, 99, NULL FROM l)
SELECT id, CAST(prio AS INTEGER) AS prio, rid FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prio, rid NULLS LAST) AS k FROM m) WHERE k = 1""")
def resolve_entities(spark: SparkSession, d: str) -> DataFrame:
    """The best match by id, then name, then group and name's end, else none."""
    digits = lambda c: F.regexp_extract(c, "[0-9]+$", 0)
    left = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("hint"), F.col("c_nationkey").alias("grp"), digits("c_name").alias("digits"))
    left = left.withColumn("tail", F.right("digits", F.lit(2)))
    right = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("rid"), F.col("s_nationkey").alias("rgrp"), digits("s_name").alias("rdigits"))
    right = right.withColumn("rtail", F.right("rdigits", F.lit(2)))
    rules = [R.Rule(1, ("hint",), ("rid",)), R.Rule(2, ("digits",), ("rdigits",)), R.Rule(3, ("grp", "tail"), ("rgrp", "rtail"))]
    return R.resolve(left, right, rules, ["id"], "rid").select("id", "prio", F.col("match.rid").alias("rid"))


@_query("""
WITH c AS (SELECT c_nationkey AS n, count(*) AS customers, CAST(NULLIF(min(c_custkey) % 2, 0) AS BIGINT) AS v FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS n, count(*) AS suppliers, min(s_suppkey) AS v FROM supplier WHERE s_nationkey % 5 <> 0 GROUP BY 1)
SELECT coalesce(c.n, s.n) AS nation, customers, suppliers, coalesce(c.v, s.v) AS pick,
  CASE WHEN c.v IS NOT NULL THEN 'customer' WHEN s.v IS NOT NULL THEN 'supplier' END AS src_pick FROM c FULL OUTER JOIN s ON c.n = s.n""")
def fuse_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Two sources in full outer join, values with the source they are from."""
    first = _table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.count(F.lit(1)).alias("customers"), F.nullif(F.min("c_custkey") % 2, F.lit(0).cast("long")).alias("v"))
    second = _table(spark, d, "supplier").where("s_nationkey % 5 <> 0").groupBy(F.col("s_nationkey").alias("n")).agg(F.count(F.lit(1)).alias("suppliers"), F.min("s_suppkey").alias("v"))
    both = R.full_outer(first, second, ["n"], ("c", "s"))
    pick = R.fused("pick", {"customer": F.col("c.v"), "supplier": F.col("s.v")})
    return both.select(F.coalesce("c.n", "s.n").alias("nation"), "c.customers", "s.suppliers", *pick)


@_query("""
SELECT o_orderkey, coalesce(a.c_name, b.c_name) AS c_name, coalesce(a.c_acctbal, b.c_acctbal) AS c_acctbal FROM orders
LEFT JOIN customer a ON a.c_custkey = o_orderkey LEFT JOIN customer b ON b.c_custkey = o_custkey""")
def disjunctive_join(spark: SparkSession, d: str) -> DataFrame:
    """Match by one id or the other, the first one winning, as two equi joins."""
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return J.either_key_join(orders, _table(spark, d, "customer"), "o_orderkey", "o_custkey", "c_custkey", [], ["c_name", "c_acctbal"]).drop("o_custkey")


@_query("""
WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part),
o AS (SELECT p_partkey, len(l) AS n, unnest(l) AS token, generate_subscripts(l, 1) AS ord FROM t)
SELECT p_partkey, token, CAST(ord AS INTEGER) AS ord, CAST(n AS INTEGER) AS n,
  CAST(1995 + (ord - 1) * 7 // n AS INTEGER) AS seg_start, CAST(1995 + ord * 7 // n - 1 AS INTEGER) AS seg_end FROM o""")
def ordinal_segments(spark: SparkSession, d: str) -> DataFrame:
    """Ordered explode, and even segments of 1995-2001."""
    rows = P.ordered_members(_table(spark, d, "part").select("p_partkey", "p_name"), F.split("p_name", " "), "token", "ord", "n")
    first, last = P.even_segment(F.lit(1995), F.lit(2001), F.col("ord"), F.col("n"))
    return rows.select("p_partkey", "token", "ord", "n", first.alias("seg_start"), last.alias("seg_end"))


@_query(f"""
WITH seg AS (SELECT n_nationkey, 1995 + n_nationkey % 3 AS seg_start, 1997 + n_nationkey % 4 AS seg_end FROM nation),
o AS (SELECT o_orderkey, c_nationkey, CAST({_SEASON} AS INTEGER) AS season FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT season, c_nationkey, count(*) AS orders FROM o JOIN seg ON n_nationkey = c_nationkey AND season BETWEEN seg_start AND seg_end GROUP BY 1, 2""")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    """Season within a tenure, as an equi join on the seasons of short ranges."""
    nation = _table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (1995 + F.col("n_nationkey") % 3).alias("a"), (1997 + F.col("n_nationkey") % 4).alias("b"))
    tenure = J.seasons_of_range(nation, "a", "b").select("c_nationkey", "season")
    orders = _orders(spark, d).join(_table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("season", "c_nationkey").agg(F.count(F.lit(1)).alias("orders"))
    return orders.join(tenure, ["season", "c_nationkey"])


@_query("""
WITH s AS (SELECT s_suppkey, s_nationkey AS nation, date_diff('day', DATE '1970-01-01', DATE '1992-01-01') + (s_suppkey * 37) % 1500 AS a FROM supplier),
t AS (SELECT s_suppkey, nation, a, CASE WHEN s_suppkey % 5 <> 0 THEN a + (s_suppkey * 91) % 900 END AS b FROM s),
o AS (SELECT o_orderkey, c_nationkey AS nation, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT s_suppkey, count(*) AS orders, CAST(min(day) AS INTEGER) AS first_day FROM t JOIN o ON o.nation = t.nation AND day >= a AND (b IS NULL OR day <= b) GROUP BY 1""")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a supplier's nation in a tenure of up to 900 days, or one without an end, as an equi join on dyadic blocks."""
    days = F.datediff(F.lit("1992-01-01").cast("date"), F.lit("1970-01-01").cast("date")) + (F.col("s_suppkey") * 37) % 1500
    tenures = _table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), days.alias("a"))
    tenures = tenures.withColumn("b", F.when(F.col("s_suppkey") % 5 != 0, F.col("a") + (F.col("s_suppkey") * 91) % 900))
    customer = _table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    orders = _table(spark, d, "orders").join(customer, "o_custkey").groupBy("nation", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    found = J.interval_join(orders, tenures, ["nation"], "day", "a", "b")
    return found.groupBy("s_suppkey").agg(F.sum("n").alias("orders"), F.min("day").alias("first_day"))


_CODES = "['LAL','SEA','NJN','WSB','PHO','BOS']"
_FRANCHISE_VALUES = ", ".join(f"('{code}', '{name}')" for name, codes in S.FRANCHISES.items() for code in codes)
_CANON_VALUES = ", ".join(f"('{old}', '{new}')" for new, olds in S.CANONICAL.items() for old in olds)


@_query(f"""
WITH n AS (SELECT n_nationkey, n_name, {_CODES}[n_nationkey % 6 + 1] AS code FROM nation), c AS (
  SELECT c_custkey, code, n_name FROM customer JOIN n ON n_nationkey = c_nationkey)
SELECT c_custkey, coalesce(f.v, lower(n_name)) AS team_name, coalesce(k.v, code) AS canon FROM c
LEFT JOIN (VALUES {_FRANCHISE_VALUES}) f(k, v) ON f.k = code LEFT JOIN (VALUES {_CANON_VALUES}) k(k, v) ON k.k = code""")
def franchise_map(spark: SparkSession, d: str) -> DataFrame:
    """Codes to names and to codes of today, by broadcast lookup with a fallback."""
    codes = F.array(*[F.lit(x) for x in ("LAL", "SEA", "NJN", "WSB", "PHO", "BOS")])
    nation = _table(spark, d, "nation").select("n_nationkey", "n_name", F.get(codes, F.col("n_nationkey") % 6).alias("code"))
    rows = _table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    names = spark.createDataFrame([(c, n) for n, cs in S.FRANCHISES.items() for c in cs], "k string, v string")
    canon = spark.createDataFrame([(o, n) for n, os in S.CANONICAL.items() for o in os], "k string, v string")
    rows = J.mapped(rows, names, F.col("code"), "team_name", F.lower("n_name"))
    return J.mapped(rows, canon, F.col("code"), "canon", F.col("code")).select("c_custkey", "team_name", "canon")


@_query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, abs(l_quantity - 25), l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k
  FROM lineitem) WHERE k = 1""")
def best_candidate(spark: SparkSession, d: str) -> DataFrame:
    """The best row of each key by several criteria and a full tiebreak."""
    order = [F.when(F.col("l_returnflag") == "R", 0).otherwise(1), F.when(F.col("l_linestatus") == "O", 0).otherwise(1), F.abs(F.col("l_quantity") - 25)]
    order += [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]
    picked = R.best_candidate(_table(spark, d, "lineitem"), ["l_orderkey"], [o.asc_nulls_last() for o in order])
    return picked.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@_query("""
SELECT o_orderkey, o_custkey, round(100.0::double * o_orderkey / sum(o_orderkey) OVER (PARTITION BY o_custkey), 4) AS share FROM orders""")
def group_share(spark: SparkSession, d: str) -> DataFrame:
    """Each row's percentage of its group's sum."""
    return W.share_of_group(_table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey", "share", 4)


@_query(f"""
WITH base AS (SELECT CAST({_SEASON} AS INTEGER) AS season, CAST(c_nationkey AS VARCHAR) AS team_abbr, CAST(o_custkey AS VARCHAR) AS player_id, c_name AS player_name, c_mktsegment AS pos,
    CAST(count(*) AS INTEGER) AS g, CAST(count(DISTINCT o_orderstatus) AS INTEGER) AS gs, sum(l_quantity) AS mp, CAST(sum(l_linenumber) AS DOUBLE) AS pts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4, 5),
full_ AS (SELECT *, CASE WHEN CAST(player_id AS BIGINT) % 7 <> 0 THEN mp / 10 END AS usage_pct, pts / mp AS ts_percent, CASE WHEN mp > 0 THEN pts / mp * 36.0::double END AS pts_per_36,
    sum(pts) OVER (PARTITION BY season, team_abbr) * 2 AS team_pts, CASE WHEN CAST(player_id AS BIGINT) % 5 <> 0 THEN (g - 8.0::double) END AS ws, pts / 20 - 1 AS vorp FROM base),
a AS (SELECT *, round(mp / g, 1) AS minutes_per_game, round(100.0::double * mp / sum(mp) OVER (PARTITION BY season, team_abbr), 1) AS team_minutes_share,
    CASE WHEN team_pts > 0 THEN round(100.0::double * (pts_per_36 * mp / 36.0::double) / team_pts, 1) END AS team_pts_share FROM full_ WHERE g >= 4),
b AS (SELECT *, (0.30::double * team_minutes_share / 100.0::double + 0.15::double * coalesce(usage_pct, 0) / 35.0::double + 0.15::double * coalesce(ts_percent, 0) + 0.15::double * coalesce(pts_per_36, 0) / 40.0::double
    + 0.10::double * coalesce(team_pts_share, 0) / 100.0::double + 0.075::double * greatest(least(coalesce(ws / 10.0::double, 0), 1), 0) + 0.075::double * greatest(least(coalesce(vorp / 8.0::double, 0), 1), 0))
    * (0.5::double * greatest(least((minutes_per_game - 10.0::double) / 20.0::double, 1), 0) + 0.5::double * greatest(least((g - 10.0::double) / 72.0::double, 1), 0)) AS score FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY season, team_abbr ORDER BY round(score, 9) DESC NULLS LAST, team_minutes_share DESC NULLS LAST, mp DESC NULLS LAST, player_id) AS k FROM b)
SELECT season, team_abbr, player_id, minutes_per_game, team_minutes_share, round(score, 6) AS score FROM r WHERE k <= 15""")
def multifactor(spark: SparkSession, d: str) -> DataFrame:
    """The multi-factor ranking, customers being players and nations teams."""
    lines = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("g"), F.sum("l_quantity").alias("mp"), F.sum("l_linenumber").alias("pts"))
    orders = _orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus", "season").join(lines, "o_orderkey")
    sums = orders.groupBy("season", "o_custkey").agg(F.sum("g").cast("int").alias("g"), F.size(F.collect_set("o_orderstatus")).alias("gs"), F.sum("mp").alias("mp"), F.sum("pts").cast("double").alias("pts"))
    keys = ["season", F.col("c_nationkey").cast("string").alias("team_abbr"), F.col("o_custkey").cast("string").alias("player_id"), F.col("c_name").alias("player_name"), F.col("c_mktsegment").alias("pos")]
    base = sums.join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(*keys, "g", "gs", "mp", "pts")
    base = W.with_group_total(base, ["season", "team_abbr"], {"__pts": F.sum("pts")})
    number = F.col("player_id").cast("long")
    base = base.select(
        "*",
        F.when(number % 7 != 0, F.col("mp") / 10).alias("usage_pct"),
        (F.col("pts") / F.col("mp")).alias("ts_percent"),
        S.per_36(F.col("pts"), F.col("mp")).alias("pts_per_36"),
        (F.col("__pts") * 2).alias("team_pts"),
        F.when(number % 5 != 0, F.col("g") - 8.0).alias("ws"),
        (F.col("pts") / 20 - 1).alias("vorp"),
    )
    ranked = multifactor_rank(base, Factors(min_games=4), digits=6)
    return ranked.select("season", "team_abbr", "player_id", "minutes_per_game", "team_minutes_share", "score")


@_query("""
SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_discount >= 0.05 AND l_linenumber >= 2 GROUP BY 1""")
def conditional_count(spark: SparkSession, d: str) -> DataFrame:
    """Rows over three thresholds by key."""
    over = [F.col("l_quantity") >= 10, F.col("l_discount") >= 0.05, F.col("l_linenumber") >= 2]
    return A.count_where(_table(spark, d, "lineitem"), ["l_suppkey"], over, "n")


@_query(f"""
WITH g AS ({_GAMES}) SELECT home, round(avg(CASE WHEN home_pts > away_pts THEN 1.0::double ELSE 0 END), 4) AS win_pct, round(avg(home_pts - away_pts), 4) AS avg_margin, count(*) AS games FROM g GROUP BY 1""")
def win_share(spark: SparkSession, d: str) -> DataFrame:
    """Part of games won at home, and the mean margin."""
    return A.win_share(_games(spark, d), ["home"], "home_pts", "away_pts")


@_query("""
WITH b AS (SELECT count(*) AS base_distinct FROM (SELECT DISTINCT o_orderkey FROM orders)),
g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT 'lines' AS view_name, base_distinct, CAST(sum(n) AS BIGINT) AS gav_rows, CAST(base_distinct - sum(n) AS BIGINT) AS lost_vs_base,
  count(*) FILTER (n > 1) AS gav_duplicates, CAST(0 AS BIGINT) AS gav_null_keys FROM g, b GROUP BY base_distinct""")
def dq_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows lost against a base, duplicate and null keys."""
    line = _table(spark, d, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber"))
    base = _table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return C.key_report("lines", base, line, ["l_orderkey", "l_linenumber"])


@_query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    """Orders must be unique by their key; order lines needn't be by part and supplier."""
    C.require_unique(_table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return C.duplicate_keys(_table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@_query("""
SELECT o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_custkey) AND NOT EXISTS (SELECT 1 FROM customer x WHERE lower(x.c_name) = lower(customer.c_name) AND x.c_mktsegment = 'BUILDING')""")
def anti_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Without what is on a list of ids or of names."""
    customer = _table(spark, d, "customer")
    rows = _table(spark, d, "orders").join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    names = customer.where("c_mktsegment = 'BUILDING'").select("c_name").distinct()
    return J.excluded(rows, _table(spark, d, "supplier").select("s_suppkey"), names, "o_custkey", "c_name").select("o_orderkey", "o_custkey")


@_query("""
WITH r AS (SELECT doc_id % 50 AS k, CASE WHEN doc_id % 4 = 0 THEN 'TOT' ELSE 'T' || CAST(doc_id % 4 AS VARCHAR) END AS team, max_by(quality, doc_id) AS quality, max(doc_id) AS last_id FROM labels GROUP BY 1, 2),
l AS (SELECT doc_id, doc_id % 50 AS k, 'T' || CAST(doc_id % 7 AS VARCHAR) AS team FROM documents)
SELECT doc_id, CASE WHEN a.last_id IS NOT NULL THEN a.quality ELSE t.quality END AS quality, coalesce(a.last_id, t.last_id) AS last_id
FROM l LEFT JOIN r a ON a.k = l.k AND a.team = l.team LEFT JOIN r t ON t.k = l.k AND t.team = 'TOT'""")
def fallback_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The record of a team, or of the totals row; the last of each key counts."""
    labels = _table(spark, d, "labels")
    known = labels.select((F.col("doc_id") % 50).alias("k"), F.when(F.col("doc_id") % 4 == 0, "TOT").otherwise(F.concat(F.lit("T"), (F.col("doc_id") % 4).cast("string"))).alias("team"), "quality", F.col("doc_id").alias("last_id"))
    known = J.last_of_key(known, ["k", "team"], ["last_id"])
    rows = _table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 50).alias("k"), F.concat(F.lit("T"), (F.col("doc_id") % 7).cast("string")).alias("team"))
    return J.fallback_lookup(rows, known, ["k", "team"], "team", "TOT", ["quality", "last_id"]).drop("k", "team")


_LOG = """SELECT event_id AS seq, CASE WHEN user_id % 2 = 0 THEN 'hadoop' ELSE 'pyspark' END AS tool, event_type AS query, value AS wall_ms, user_id AS rows,
  CASE WHEN event_id % 2 = 0 THEN 'parquet' ELSE 'tsv' END AS fmt FROM events"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a benchmark log: two tools, two formats, event types as queries."""
    tool = S.tool_name(F.when(F.col("user_id") % 2 == 0, "Hadoop_Streaming").otherwise(" PySpark "))
    fmt = S.format_name(F.when(F.col("event_id") % 2 == 0, "Parquet").otherwise("TSV"))
    return _table(spark, d, "events").select(F.col("event_id").alias("seq"), tool.alias("tool"), F.col("event_type").alias("query"), F.col("value").alias("wall_ms"), F.col("user_id").alias("rows"), fmt.alias("fmt"))


@_query(f"""
WITH l AS ({_LOG}) SELECT tool, query, round(avg(wall_ms), 6) AS mean, round(quantile_cont(wall_ms, 0.5), 6) AS median, round(quantile_cont(wall_ms, 0.95), 6) AS p95, round(min(wall_ms), 6) AS min,
  round(max(wall_ms), 6) AS max, round(stddev_samp(wall_ms), 6) AS std, round(stddev_samp(wall_ms) / avg(wall_ms), 6) AS cv, count(wall_ms) AS count,
  round(avg(rows), 6) AS rows_mean, round(avg(rows) / (avg(wall_ms) / 1000.0::double), 6) AS throughput FROM l GROUP BY 1, 2""")
def bench_stats(spark: SparkSession, d: str) -> DataFrame:
    """A14, B-1, B-2: statistics of a benchmark log by tool and query."""
    return B.run_statistics(_log(spark, d), ["tool", "query"])


@_query(f"""
WITH l AS ({_LOG}), t AS (SELECT query, avg(wall_ms) FILTER (tool = 'hadoop') AS h, avg(wall_ms) FILTER (tool = 'pyspark') AS p,
  quantile_cont(wall_ms, 0.5) FILTER (tool = 'hadoop') AS hm, quantile_cont(wall_ms, 0.5) FILTER (tool = 'pyspark') AS pm FROM l GROUP BY 1)
SELECT query, round(h / p, 6) AS speedup_mean, round(hm / pm, 6) AS speedup_median FROM t WHERE h IS NOT NULL AND p IS NOT NULL""")
def pivot_speedup(spark: SparkSession, d: str) -> DataFrame:
    """A15, B-3: ratios of mean and median times of two tools."""
    return B.speedup(_log(spark, d), "query", "tool", "hadoop", "pyspark")


@_query(f"""
WITH l AS ({_LOG}), t AS (SELECT query, avg(wall_ms) FILTER (fmt = 'tsv') AS h, avg(wall_ms) FILTER (fmt = 'parquet') AS p FROM l GROUP BY 1)
SELECT round(sum(h) / sum(p), 6) AS overall FROM t WHERE h IS NOT NULL AND p IS NOT NULL""")
def storage_speedup(spark: SparkSession, d: str) -> DataFrame:
    """A18, B-4: overall ratio of two storage formats."""
    return B.overall_speedup(_log(spark, d), "query", "fmt", "tsv", "parquet")


@_query(f"""
WITH l AS ({_LOG}), t AS (SELECT seq, tool, query, CAST(row_number() OVER (PARTITION BY tool, query ORDER BY seq) AS INTEGER) AS run, round(rows / (wall_ms / 1000.0::double), 6) AS throughput FROM l)
SELECT *, round(throughput - lag(throughput) OVER (PARTITION BY tool, query ORDER BY seq), 6) AS change FROM t""")
def run_throughput(spark: SparkSession, d: str) -> DataFrame:
    """B-5, W6: throughput of each run, and its change."""
    trend = B.throughput_trend(_log(spark, d), ["tool", "query"], "seq", F.col("rows"), F.col("wall_ms"))
    return trend.select("seq", "tool", "query", "run", "throughput", "change")


@_query("""
SELECT event_id, user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS INTEGER) AS run FROM events""")
def run_index(spark: SparkSession, d: str) -> DataFrame:
    """Arrival index within a key, carried over cells of the order."""
    return O.numbered(_table(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"], "run")


@_query("""
WITH a AS (SELECT o_orderkey AS orderkey, year(o_orderdate) AS year FROM orders), b AS (SELECT l_orderkey AS orderkey, year(l_shipdate) AS year FROM lineitem WHERE l_linenumber = 1)
SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def dataset_diff(spark: SparkSession, d: str) -> DataFrame:
    """Rows that one of two tables has more often: orders by the year they were placed in, and by the year their first line was shipped in."""
    placed = _table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.year("o_orderdate").alias("year"))
    shipped = _table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("orderkey"), F.year("l_shipdate").alias("year"))
    return C.difference(placed, shipped)


@_query("""
WITH a AS (SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS custkey, CAST(10 AS BIGINT) AS n FROM customer)
SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def dataset_diff_by_digest(spark: SparkSession, d: str) -> DataFrame:
    """The same by digests of buckets, after which only buckets that differ are compared: customers' numbers of orders against ten each."""
    counted = _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n"))
    expected = _table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.lit(10).cast("long").alias("n"))
    return C.difference_by_digest(counted, expected)


@_query("""
SELECT c_custkey, c_name, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS last_filled
FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def semi_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Keys that were seen, with attributes of the last detail."""
    orders = _table(spark, d, "orders")
    seen = _table(spark, d, "customer").join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    detail = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_filled"))
    return seen.join(detail, "c_custkey", "left").select("c_custkey", "c_name", "last_filled")


@_query(f"""
SELECT o_orderkey, o_totalprice FROM orders WHERE {_SEASON} = 1998 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100""")
def latest_k_global(spark: SparkSession, d: str) -> DataFrame:
    """One season's rows by score, the first hundred."""
    rows = _orders(spark, d).where("season = 1998")
    return rows.orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@_query("""
SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 50""")
def page_slice(spark: SparkSession, d: str) -> DataFrame:
    """The third page of 25, and how many rows there are."""
    order = [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")]
    return W.page(_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), order, 3, 25, total="total")


@_query("""
SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(k AS BIGINT) AS rank, (SELECT count(*) FROM lineitem) AS total FROM (
  SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k > 5000 AND k <= 5050""")
def page_deep(spark: SparkSession, d: str) -> DataFrame:
    """Page 101 of 50 by price; only the cells of the order that hold it are sorted."""
    lines = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return W.page_by_rank(lines, [O.descending(F.col("l_extendedprice")), "l_orderkey", "l_linenumber"], 101, 50, total="total")


@_query(f"""
SELECT CAST({_SEASON} AS INTEGER) AS season, n_name, CAST(round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice)) AS INTEGER) AS avg_price, count(o_totalprice) AS orders
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
def avg_rounded_int(spark: SparkSession, d: str) -> DataFrame:
    """Means rounded to integers by season and name."""
    nation = _table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = _orders(spark, d).join(_table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(nation, "c_nationkey")
    return A.rounded_mean(rows, ["season", "n_name"], "o_totalprice", "avg_price", "orders", scale=2)


@_query(f"""
WITH o AS (SELECT o_orderkey, CAST({_SEASON} AS INTEGER) AS season, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 4 + 2 AS VARCHAR) || 'TM' ELSE 'T' || CAST(o_custkey % 30 AS VARCHAR) END AS team FROM orders)
SELECT season, team, count(*) AS n FROM o WHERE NOT regexp_matches(upper(trim(team)), '^[0-9]+TM$') AND season <= 1999 GROUP BY 1, 2""")
def prefix_label_filter(spark: SparkSession, d: str) -> DataFrame:
    """Without rows of several teams, up to a season read from a label's first four characters."""
    team = F.when(F.col("o_orderkey") % 5 == 0, F.concat((F.col("o_orderkey") % 4 + 2).cast("string"), F.lit("TM"))).otherwise(F.concat(F.lit("T"), (F.col("o_custkey") % 30).cast("string")))
    rows = _orders(spark, d).select(S.season_label(F.col("season")).alias("label"), team.alias("team"))
    rows = rows.where(~S.several_teams(F.col("team"))).withColumn("season", S.season_of(F.col("label"))).where("season <= 1999")
    return rows.groupBy("season", "team").agg(F.count(F.lit(1)).alias("n"))


@_query("""
WITH t AS (SELECT p_partkey, p_size, trim(unnest(string_split(replace(p_name, ' ', ' , '), ','))) AS token FROM part),
v AS (SELECT token AS code, 5 + count(*) % 7 AS low, 20 + count(*) % 9 AS high FROM t GROUP BY 1)
SELECT p_partkey, token, count(*) AS n FROM t JOIN v ON code = token AND p_size BETWEEN low AND high GROUP BY 1, 2""")
def list_member_join(spark: SparkSession, d: str) -> DataFrame:
    """Membership in a delimited list and a range, as an explode and an equi join."""
    listed = _table(spark, d, "part").select("p_partkey", "p_size", F.replace("p_name", F.lit(" "), F.lit(" , ")).alias("listed"))
    members = J.list_members(listed, "listed", "token").drop("listed")
    codes = members.groupBy("token").agg((5 + F.count(F.lit(1)) % 7).alias("low"), (20 + F.count(F.lit(1)) % 9).alias("high"))
    return members.join(codes, "token").where("p_size between low and high").groupBy("p_partkey", "token").agg(F.count(F.lit(1)).alias("n"))


@_query(f"""
WITH o AS (SELECT CAST({_SEASON} AS INTEGER) AS season, c_nationkey AS team, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders JOIN customer ON c_custkey = o_custkey),
b AS (SELECT DISTINCT season, team FROM o), f AS (SELECT season, team, count(*) AS filled, CAST(sum(price) AS DOUBLE) AS filled_sum FROM o WHERE o_orderstatus = 'F' GROUP BY 1, 2),
p AS (SELECT season, team, count(*) AS open_ FROM o WHERE o_orderstatus = 'O' GROUP BY 1, 2), q AS (SELECT season, team, count(*) AS partial_ FROM o WHERE o_orderstatus = 'P' AND team % 2 = 0 GROUP BY 1, 2),
s AS (SELECT s_nationkey AS team, count(*) AS suppliers FROM supplier GROUP BY 1), n AS (SELECT n_nationkey AS team, n_name FROM nation WHERE n_nationkey % 3 <> 0)
SELECT b.season, b.team, coalesce(lower(n_name), 'team ' || CAST(b.team AS VARCHAR)) AS name, filled, open_, partial_, suppliers, filled_sum / filled AS per_game
FROM b LEFT JOIN f USING (season, team) LEFT JOIN p USING (season, team) LEFT JOIN q USING (season, team) LEFT JOIN s USING (team) LEFT JOIN n USING (team)""")
def wide_left_chain(spark: SparkSession, d: str) -> DataFrame:
    """J6, J5, N2's shape: a base and five left joins on normalised keys, with a fallback."""
    orders = _orders(spark, d).join(_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("team")), "o_custkey")
    keys = ["season", "team"]
    # one aggregation gives all three summaries
    status = lambda s: F.when(F.col("o_orderstatus") == s, 1)
    sums = orders.groupBy(*keys).agg(
        F.nullif(F.count(status("F")), F.lit(0).cast("long")).alias("filled"),
        F.nullif(F.count(status("O")), F.lit(0).cast("long")).alias("open_"),
        F.nullif(F.count(F.when(F.col("team") % 2 == 0, status("P"))), F.lit(0).cast("long")).alias("partial_"),
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(18,2)"))).cast("double").alias("filled_sum"),
    )
    suppliers = _table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("team")).agg(F.count(F.lit(1)).alias("suppliers"))
    names = _table(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("team"), "n_name")
    joined = sums.join(suppliers, "team", "left").join(names, "team", "left")
    name = F.coalesce(F.lower("n_name"), F.concat(F.lit("team "), F.col("team").cast("string")))
    return joined.select(*keys, name.alias("name"), "filled", "open_", "partial_", "suppliers", F.try_divide("filled_sum", "filled").alias("per_game"))


@_query("""
SELECT o_custkey, count(*) AS games, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS made, round(100.0::double * sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*), 1) AS pct,
  round(100.0::double * (sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) + 0.5::double * sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)) / count(*), 1) AS efg FROM orders GROUP BY 1""")
def career_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Sums of a career, then rates of the sums."""
    one = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, 1).otherwise(0)).cast("long")
    sums = _table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("games"), one("F").alias("made"), one("P").alias("threes"))
    return sums.select("o_custkey", "games", "made", S.made_percent(F.col("made"), F.col("games")).alias("pct"), S.effective_percent(F.col("made"), F.col("threes"), F.col("games")).alias("efg"))


@_query("""
SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def latest_season(spark: SparkSession, d: str) -> DataFrame:
    """Each key's last record, without a sort."""
    return A.latest_by(_table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice", "o_orderstatus"])


@_query(f"""
WITH g AS ({_GAMES}), p AS (SELECT least(home, away) AS a, greatest(home, away) AS b, CASE WHEN home <= away THEN home_pts - away_pts ELSE away_pts - home_pts END AS diff FROM g WHERE home <> away)
SELECT a, b, count(*) AS games, count(*) FILTER (diff > 0) AS a_w, count(*) FILTER (diff < 0) AS b_w, round(avg(diff), 4) AS avg_diff FROM p GROUP BY 1, 2""")
def head2head(spark: SparkSession, d: str) -> DataFrame:
    """Games, wins and mean difference of each pair, whichever played at home."""
    from tessera.plans.queries import head_to_head

    return head_to_head(_games(spark, d))


@_query(f"""
WITH g AS ({_GAMES}), r AS (SELECT home % 2 AS conf, home AS team, l_shipdate, l_orderkey, l_linenumber, l_suppkey, away, CASE WHEN home_pts > away_pts THEN 1 ELSE 0 END AS won, home_pts FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY conf, team ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, away, home_pts) AS k,
  row_number() OVER (PARTITION BY conf, team, won ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, away, home_pts) AS kw FROM r),
i AS (SELECT *, row_number() OVER (PARTITION BY conf, team, won, k - kw ORDER BY k) AS streak FROM o),
t AS (SELECT conf, team, CAST(sum(won) AS BIGINT) AS w, CAST(sum(1 - won) AS BIGINT) AS l, arg_max(CASE WHEN won = 1 THEN 'W' ELSE 'L' END || CAST(streak AS VARCHAR), k) AS streak FROM i GROUP BY 1, 2)
SELECT conf, team, w, l, (max(w - l) OVER (PARTITION BY conf) - (w - l)) / 2.0::double AS gb, streak FROM t""")
def standings(spark: SparkSession, d: str) -> DataFrame:
    """Wins, losses, games behind and streak by conference."""
    games = _games(spark, d)
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "away", "home_pts"]
    results = games.select((F.col("home") % 2).alias("conf"), F.col("home").alias("team"), F.when(F.col("home_pts") > F.col("away_pts"), 1).otherwise(0).alias("won"), *order)
    return W.standings(results, "conf", "team", order, "won", F.trunc("l_shipdate", "month"))


@_query(f"""
WITH g AS ({_GAMES}), r AS (SELECT home AS team, l_shipdate, l_orderkey, l_linenumber, away, CASE WHEN home_pts > away_pts THEN 1 ELSE 0 END AS won FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k, row_number() OVER (PARTITION BY team, won ORDER BY l_shipdate, l_orderkey, l_linenumber) AS kw FROM r)
SELECT team, l_orderkey, l_linenumber, won, CAST(row_number() OVER (PARTITION BY team, won, k - kw ORDER BY k) AS INTEGER) AS streak FROM o""")
def game_streaks(spark: SparkSession, d: str) -> DataFrame:
    """The running streak of every home game, a team's games being split over tasks."""
    games = _games(spark, d).select(F.col("home").alias("team"), "l_shipdate", "l_orderkey", "l_linenumber", F.when(F.col("home_pts") > F.col("away_pts"), 1).otherwise(0).alias("won"))
    found = O.streaks(games, ["team"], ["l_shipdate", "l_orderkey", "l_linenumber"], "won", F.trunc("l_shipdate", "month"))
    return found.select("team", "l_orderkey", "l_linenumber", "won", "streak")


_SEARCH = """
WITH e AS (SELECT 'customer' AS _entity, CAST(c_custkey AS VARCHAR) AS _id, c_name AS _title, c_mktsegment AS _subtitle, CAST(c_nationkey AS VARCHAR) AS _extra FROM customer
  UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type FROM part UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, '', CAST(s_nationkey AS VARCHAR) FROM supplier)
SELECT _entity, _id, _title, _subtitle, _extra FROM e
WHERE contains(lower(_title || ' ' || _subtitle || ' ' || _extra), '{0}') AND contains(lower(_title || ' ' || _subtitle || ' ' || _extra), '{1}')
ORDER BY (CASE WHEN contains(lower(_title), '{0}') THEN 1 ELSE 0 END + CASE WHEN contains(lower(_title), '{1}') THEN 1 ELSE 0 END) DESC, _entity, _title, _id LIMIT 200"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Customers, parts and suppliers as entities to search."""
    text = lambda c: F.col(c).cast("string")
    customer = _table(spark, d, "customer").select(F.lit("customer").alias("_entity"), text("c_custkey").alias("_id"), F.col("c_name").alias("_title"), F.col("c_mktsegment").alias("_subtitle"), text("c_nationkey").alias("_extra"))
    part = _table(spark, d, "part").select(F.lit("part").alias("_entity"), text("p_partkey").alias("_id"), F.col("p_name").alias("_title"), F.col("p_brand").alias("_subtitle"), F.col("p_type").alias("_extra"))
    supplier = _table(spark, d, "supplier").select(F.lit("supplier").alias("_entity"), text("s_suppkey").alias("_id"), F.col("s_name").alias("_title"), F.lit("").alias("_subtitle"), text("s_nationkey").alias("_extra"))
    return customer.unionByName(part).unionByName(supplier)


@_query(_SEARCH.format("blue", "1"))
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    """All tokens must occur; the more in the title, the higher."""
    from tessera.plans.queries import search

    return search(_entities(spark, d), "1 Blue", limit=200)


@_query(_SEARCH.format("conom", "red"))
def entity_search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Q21: the same search by an index of trigrams, of which it reads the rarest ones' lists only."""
    from tessera.plans.queries import search, search_index

    entities = _entities(spark, d)
    index = search_index(entities, staging_path(spark, "search-index"))
    return search(entities, "Red ConOM", limit=200, index=index)


@_query(None)
def home_win_model(spark: SparkSession, d: str) -> DataFrame:
    """M1, M2: chances of the home side by logistic regression on form, rest and home record."""
    from tessera.plans.winmodel import fit_home_win, game_features

    games = _games(spark, d).groupBy(F.to_date("l_shipdate").alias("game_date"), F.col("home").alias("home_id"), F.col("away").alias("away_id")).agg(F.sum("home_pts").alias("home_pts"), F.sum("away_pts").alias("away_pts"), F.min("l_orderkey").alias("game_id"))
    features = game_features(staged(games.where("home_id <> away_id"), "games"))  # which reads them several times
    return fit_home_win(features)[1]
