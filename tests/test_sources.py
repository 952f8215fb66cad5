"""Readers and sinks, with malformed and missing input."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.plans.views import register
from tessera.sources import registry as G
from tessera.sources import sinks as K
from tessera.sources.schemas import SCHEMAS, short
from tests import fixtures as X


def test_json_lines_skip_blanks_and_mistakes(spark, tmp_path):
    lines = [json.dumps({"game_id": "g1", "season": 2019, "home": {"team_id": "1", "score": 99}}), "", "{broken", json.dumps({"game_id": "g2"})]
    (tmp_path / "g.json").write_text("\n".join(lines))
    got = [(r["game_id"], r["season"], r["home"]["score"] if r["home"] else None) for r in G.json_lines(str(tmp_path), SCHEMAS["games"])(spark).where("game_id is not null").orderBy("game_id").collect()]
    assert got == [("g1", "2019", "99"), ("g2", None, None)]


def test_tsv_and_csv(spark, tmp_path, rows):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/p.txt").write_text("2019\t1\t110\tg1\n2019\t2\tx\tg2\n")
    assert rows(G.of_format("tsv", str(tmp_path / "a"), SCHEMAS["team_game_points_tsv"])(spark)) == [("2019", "1", 110, "g1"), ("2019", "2", None, "g2")]
    (tmp_path / "b.csv").write_text("Team,extra,g\nLAL,1,12.0\nBOS,2,\n")
    assert rows(G.of_format("csv", str(tmp_path / "b.csv"), short("s: team", "i: g gs"))(spark)) == [("BOS", None, None), ("LAL", 12, None)]
    with pytest.raises(ValueError):
        G.of_format("xls", "x", SCHEMAS["teams_dim"])


def test_fallback_chain(spark, tmp_path):
    broken = G.jdbc("t", url="jdbc:none:x", driver="no.such.Driver")
    assert G.first_available(broken, lambda s: s.range(3))(spark).count() == 3
    with pytest.raises(RuntimeError, match="no source"):
        G.first_available(broken)(spark)


def test_registry_publishes_views_in_order(spark, tmp_path):
    reg = G.Registry()
    reg.folder(str(tmp_path / "none"))
    for name in ("player_totals", "common_player_info", "player_per_game", "player_advanced", "player_season_info", "seasons_stats", "games", "team_summaries", "team_abbrev", "team_details", "nba_head_coaches", "team_stats_per_game", "team_totals"):
        reg.source(name, lambda s, name=name: getattr(X, name)(s))
    for name in ("team_stats_per_100", "opponent_stats_per_100", "player_bio", "team_details_flat", "games_flat", "player_play_by_play", "player_box_score"):
        reg.source(name, lambda s, name=name: X.table(s, name, []))
    names = register(reg).publish(spark, "gav_")
    assert len(names) == 18
    assert spark.sql("select count(*) from gav_global_game g join gav_dim_team_season t on g.season = t.season").first()[0] > 0


def test_trimmed(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert G.trimmed(df, ["b", "c"]).first() == ("x", None) and G.trimmed(df, ["c"], F.lit("")).first() == ("",)


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([("2019", 2, None), ("2020", 1, "x")], "season string, n int, v string")
    K.write_parquet(df, f"{tmp_path}/p", ["season"])
    assert rows(G.parquet(f"{tmp_path}/p", df.schema)(spark).select("season", "n")) == [("2019", 2), ("2020", 1)]
    df.createOrReplaceTempView("exported")
    K.export_view(spark, "exported", f"{tmp_path}/e")
    assert "2019\t2\t\\N" in "".join(f.read_text() for f in (tmp_path / "e").glob("part-*"))
    K.export_json(df, f"{tmp_path}/j", [F.col("n")], most=1)
    assert spark.read.json(f"{tmp_path}/j").first()["count"] == 1
    K.append_log(spark, f"{tmp_path}/log", {"tool": "t", "wall_ms": 1.0})
    K.append_log(spark, f"{tmp_path}/log", {"tool": "u", "wall_ms": 2.0})
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    assert K.snapshot(df, "snap", f"{tmp_path}/s").count() == 2 and spark.table("snap").count() == 2
    assert K.load_and_count(df, f"{tmp_path}/l", 2) == 2
    with pytest.raises(ValueError):
        K.load_and_count(df, f"{tmp_path}/l", 3)


def test_materialize_if_absent(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for reuse in (True, True, False):
        assert K.materialize_if_absent(spark, f"{tmp_path}/m", build, reuse).count() == 3
    assert len(built) == 2 and not K.exists(spark, f"{tmp_path}/none")
