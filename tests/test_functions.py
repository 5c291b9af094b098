import datetime as dt
import math

from pyspark.sql import functions as F

from puckline.functions import scalar as fx


def test_toi_minutes(spark):
    d = spark.createDataFrame([("12:30",), (None,), ("bad",), ("x:30",), ("1:02:03",), ("0:00",)], "toi string")
    got = [r[0] for r in d.select(fx.toi_minutes("toi")).collect()]
    assert got[0] == 12.5 and got[1] == 0.0 and got[2] == 0.0 and got[3] == 0.5
    assert abs(got[4] - (1 + 2 / 60)) < 1e-12 and got[5] == 0.0


def test_season_of_date_and_label(spark):
    d = spark.createDataFrame([(dt.date(2023, 8, 31),), (dt.date(2023, 9, 1),)], "d date")
    got = d.select(fx.season_of_date("d").alias("s"), fx.season_label(fx.season_of_date("d")).alias("l")).collect()
    assert [(r.s, r.l) for r in got] == [(20222023, "22/23"), (20232024, "23/24")]


def test_hockey_date_around_5am_eastern(spark):
    cases = [  # (utc timestamp, expected hockey date)
        ("2024-01-10 09:59:00", dt.date(2024, 1, 9)),   # 04:59 EST
        ("2024-01-10 10:00:00", dt.date(2024, 1, 10)),  # 05:00 EST
        ("2024-07-10 08:59:00", dt.date(2024, 7, 9)),   # 04:59 EDT
        ("2024-07-10 09:00:00", dt.date(2024, 7, 10)),  # 05:00 EDT
        ("2024-03-10 08:59:00", dt.date(2024, 3, 9)),   # DST start day, 04:59 EDT
        ("2024-03-10 09:00:00", dt.date(2024, 3, 10)),  # 05:00 EDT
        ("2024-11-03 09:59:00", dt.date(2024, 11, 2)),  # DST end day, 04:59 EST
        ("2024-11-03 10:00:00", dt.date(2024, 11, 3)),
    ]
    d = spark.createDataFrame([(c[0],) for c in cases], "ts string")
    got = [r[0] for r in d.select(fx.hockey_date(F.to_timestamp("ts"))).collect()]
    assert got == [c[1] for c in cases]


def test_skaters_parse(spark):
    d = spark.createDataFrame([("1541",), ("1451",), ("0651",), (None,), ("15",), ("1A41",)], "c string")
    got = [(r.a, r.h) for r in d.select(fx.skaters("c", "away").alias("a"), fx.skaters("c", "home").alias("h")).collect()]
    assert got == [(5, 4), (4, 5), (6, 5), (5, 5), (5, 5), (5, 4)]


def test_float_div_follows_ieee(spark):
    d = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (3.0, 2.0)], "n double, d double")
    got = [r[0] for r in d.select(fx.float_div("n", "d")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] is None and got[4] == 1.5


def test_position_display(spark):
    d = spark.createDataFrame([("C",), ("G",), ("X",)], "p string")
    assert [r[0] for r in d.select(fx.position_display("p")).collect()] == ["Center", "Goalie", "X"]


def test_split_matchup(spark):
    d = spark.createDataFrame([("AAA @ BBB",), ("bad",)], "m string")
    got = [tuple(r[0]) for r in d.select(fx.split_matchup("m")).collect()]
    assert got == [("AAA", "BBB"), (None, None)]


def test_roster_snapshot(spark):
    from puckline.sources.landing import roster_snapshot
    r = spark.createDataFrame([("AAA", 1, "A B", "C", None)],
                              "team_abbrev string, player_id bigint, full_player_name string, "
                              "position_code string, headshot_url string")
    row = roster_snapshot(r, 20232024, True).collect()[0]
    assert (row.season, row.is_current) == (20232024, True)
