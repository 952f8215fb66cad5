"""Every branch of the scalar functions, on hand-written values."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S


def check(spark, f, cases, kind="string"):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], f"i int, a {kind}")
    got = [r[0] for r in df.orderBy("i").select(f(F.col("a"))).collect()]
    assert got == [w for _, w in cases]


def test_tables_are_whole():
    assert len(S.ACCENTED) == len(S.PLAIN) == 30
    codes = [c for cs in S.FRANCHISES.values() for c in cs]
    assert len(codes) == len(set(codes)) == 44 and len(S.FRANCHISES) == 16
    old = [c for cs in S.CANONICAL.values() for c in cs]
    assert len(old) == len(set(old)) and not set(old) & set(S.CANONICAL)


@pytest.mark.parametrize(
    "f, cases",
    [
        (S.to_int, [("12", 12), (" 7 ", 7), ("12.0", None), ("x", None), ("", None), (None, None)]),
        (S.to_int_loose, [("12.0", 12), ("x", None), (None, None)]),
        (S.to_double, [("1.5", 1.5), ("", None), (None, None)]),
        (S.blank_to_null, [("  ", None), (" a ", "a"), (None, None)]),
        (lambda c: S.first_match(c, "^[0-9]+"), [("12a", "12"), ("a", None), (None, None)]),
        (S.norm_name, [("Nikola Jokić", "nikolajokic"), ("J.R. Smith", "jrsmith"), ("Luka Dončić", "lukadoncic"), ("đŽ", "dz"), (None, None)]),
        (S.last_name_key, [("Luka Dončić", "doncic"), ("Nene", "nene"), (None, None)]),
        (S.first_letters_key, [("Luka Dončić", "lu"), ("Ñandu X", None), (None, None)]),
        (S.height_cm, [("6-7", 201), ("6'7", None), ("6-", None), (None, None)]),
        (S.weight_kg, [("220", 100), ("220 lbs", 100), ("x", None), (None, None)]),
        (S.attendance, [("19,234", 19234), ("19.234", 19234), ("1.234.567", 1234567), ("19234.0", 19234), ("", None), ("n/a", None), (None, None)]),
        (S.number_with_commas, [("812,292", 812292.0), ("x", None), (None, None)]),
        (S.season_label, [("2019", "2019-20"), ("1999", "1999-00"), ("x", None), (None, None)]),
        (S.nickname, [("Portland Trail Blazers", "Trail Blazers"), ("Los Angeles Lakers", "Lakers"), ("Heat", "Heat"), (None, None)]),
        (S.date_prefix, [("2020-01-02T03:04", "2020-01-02"), (None, None)]),
        (S.several_teams, [("2TM", True), (" 5tm ", True), ("TOT", False), (None, None)]),
        (S.tool_name, [("PySpark", "pyspark"), ("hadoop_streaming", "hadoop"), ("Other", "other"), (None, None)]),
        (S.format_name, [("Parquet", "parquet"), ("TSV", "tsv"), ("csv", "tsv"), ("orc", "orc"), (None, None)]),
    ],
)
def test_text(spark, f, cases):
    check(spark, f, cases)


def test_dates_keep_the_written_day(spark):
    d = datetime.date
    cases = [("2020-01-01T23:30:00-05:00", d(2020, 1, 1)), ("2020-02-03", d(2020, 2, 3)), ("2020-02-33", None), ("soon", None), (None, None)]
    check(spark, S.tolerant_date, cases)


def test_season(spark):
    df = spark.createDataFrame([("2019", None), ("2019-20", None), (None, "2020-07-01"), (None, "2020-06-30"), ("x", "2020-06-30"), (None, None)], "s string, d string")
    got = [r[0] for r in df.select(S.season_of(F.col("s"), S.tolerant_date(F.col("d")))).collect()]
    assert got == [2019, 2019, 2020, 2019, 2019, None]


@pytest.mark.parametrize(
    "f, cases",
    [
        (S.percent_scale, [(0.58, 58.0), (58.0, 58.0), (1.0, 100.0), (None, None)]),
        (lambda c: S.clamp01(c, 10.0), [(-1.0, 0.0), (5.0, 0.5), (10.0, 1.0), (99.0, 1.0), (None, 0.0)]),
        (lambda c: S.ramp(c, 10, 30), [(10.0, 0.0), (20.0, 0.5), (30.0, 1.0), (None, 0.0)]),
        (lambda c: S.safe_ratio(c, F.lit(0)), [(1.0, None), (None, None)]),
        (lambda c: S.least_known(c, F.lit(2.0)), [(1.0, 1.0), (3.0, 2.0), (None, None)]),
        (lambda c: S.per_36(c, F.lit(18.0)), [(10.0, 20.0), (None, None)]),
        (lambda c: S.per_36(F.lit(10.0), c), [(0.0, None), (None, None)]),
        (lambda c: S.made_percent(c, F.lit(8.0)), [(3.0, 37.5)]),
        (lambda c: S.effective_percent(c, F.lit(2.0), F.lit(8.0)), [(3.0, 50.0)]),
        (lambda c: S.per_game(c, F.lit(3)), [(10.0, 3.3), (None, None)]),
    ],
)
def test_numbers(spark, f, cases):
    check(spark, f, cases, "double")


def test_head_counts_of_every_form(spark):
    told = {"19,234.0": 19234, "1234.567": 1234567, "1.234.567": 1234567, "19 234": 19234, " 19,234 ": 19234, "19234.0": 19234, "": None, "n/a": None, "1,234,567": 1234567}
    got = spark.createDataFrame([(t,) for t in told], "t string").select("t", S.attendance(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == told
