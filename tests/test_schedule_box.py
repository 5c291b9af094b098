import datetime as dt

from pyspark.sql import functions as F

from puckline.operators import boxscore as bx
from puckline.operators import schedule as sc
from puckline.schemas import SCHEDULE


def sched(spark, rows):
    full = [(g, d, s, t, a, 0, h, 0, None, None) for g, d, s, t, a, h in rows]
    return spark.createDataFrame(full, SCHEDULE)


def test_days_rest_rules(spark):
    rows = [  # game, date, season, type, away, home
        (1, "2023-10-10", 20232024, 2, "AAA", "BBB"),
        (2, "2023-10-10", 20232024, 2, "AAA", "CCC"),   # AAA twice on one date -> -1 for the later game
        (3, "2023-10-11", 20232024, 2, "BBB", "AAA"),   # next day -> 0
        (4, "2023-10-20", 20232024, 2, "AAA", "BBB"),   # long gap -> capped at 3
        (5, "2023-10-13", 20232024, 2, "CCC", "BBB"),   # BBB: 10-11 -> 10-13 = 1
    ]
    got = {r.game_id: (r.home_days_rest, r.away_days_rest)
           for r in sc.with_days_rest(sched(spark, rows)).collect()}
    assert got[1] == (None, None)          # first games of both teams
    assert got[2] == (None, -1)            # CCC first game; AAA second game the same day
    assert got[3] == (0, 0)                # AAA after 10-10; BBB after 10-10
    assert got[5] == (1, 2)                # BBB: 10-11 -> 10-13; CCC: 10-10 -> 10-13
    assert got[4] == (3, 3)


def test_days_rest_matches_direct_lag(spark):
    from puckline.sources import proxies as px
    from pyspark.sql import Window
    s = px.schedule(spark, "/root/testdata/sf0.001")
    tg = s.select("season", "game_id", F.to_date("date").alias("d"),
                  F.explode(F.array("home_abbrev", "away_abbrev")).alias("team"))
    w = Window.partitionBy("season", "team").orderBy("d", "game_id")
    tg = tg.withColumn("prev", F.lag("d").over(w)).select(
        F.col("game_id").alias("g"), F.col("team").alias("t"),
        # least() skips nulls, so the first game is guarded explicitly
        F.when(F.col("prev").isNotNull(), F.least(F.datediff("d", "prev") - 1, F.lit(3))).alias("rest"))
    ours = sc.with_days_rest(s)
    home = ours.join(tg, (F.col("game_id") == F.col("g")) & (F.col("home_abbrev") == F.col("t")))
    assert home.count() == s.count()
    assert home.filter(~F.col("home_days_rest").eqNullSafe(F.col("rest"))).count() == 0
    away = ours.join(tg, (F.col("game_id") == F.col("g")) & (F.col("away_abbrev") == F.col("t")))
    assert away.filter(~F.col("away_days_rest").eqNullSafe(F.col("rest"))).count() == 0


def test_season_schedule_dedupes_and_filters(spark):
    rows = [(1, "2023-10-10", 20232024, 2, "A", "B"), (1, "2023-10-10", 20232024, 2, "A", "B"),
            (2, "2023-09-20", 20232024, 1, "A", "C"), (3, "2024-04-20", 20232024, 3, "B", "C")]
    got = [r.game_id for r in sc.season_schedule(sched(spark, rows)).collect()]
    assert got == [1, 3]
    assert sc.allowed_game_types(["R", "X"]) == [2]


def test_combine_fills_and_toi(spark):
    box = spark.createDataFrame(
        [(1, 7, "P7", "A", "B", "home", "C", 1, "12:30", 20, None, None, None, None, None, 0, 0),
         (1, 8, "P8", "B", "A", "away", "G", 0, None, 0, 30, 28, 2, 0.93, "O", 0, 1)],
        "game_id bigint, player_id bigint, player_name string, team string, opponent string, location string, "
        "position string, plus_minus int, toi string, shifts int, shots_against int, saves int, "
        "goals_against int, save_pct double, decision string, game_winning_goal int, ot_loss int")
    stats = spark.createDataFrame([(1, 7, 2, 1)], "game_id bigint, player_id bigint, goals int, assists int")
    from puckline.schemas import PBP_INT_STATS
    for c in PBP_INT_STATS:
        if c not in stats.columns:
            stats = stats.withColumn(c, F.lit(0))
    stats = stats.withColumn("faceoff_pct", F.lit(0.5))
    sch = spark.createDataFrame([(1, "2023-10-10", 2, None)],
                                "game_id bigint, date string, home_days_rest int, away_days_rest int")
    out = {r.player_id: r for r in bx.combine_boxscores(box, stats, sch).collect()}
    assert out[7].goals == 2 and out[7].toi_minutes == 12.5 and out[7].days_rest == 2 and out[7].faceoff_pct == 0.5
    assert out[8].goals == 0 and out[8].faceoff_pct == 0.0 and out[8].toi_minutes == 0.0 and out[8].days_rest is None
    assert len(bx.combine_boxscores(box, stats, sch).columns) == 38
    zero = {r.player_id: r for r in bx.combine_boxscores(box, None, sch).collect()}
    assert zero[7].goals == 0 and zero[7].points == 0


def test_integrity_checks(spark):
    d = spark.createDataFrame([("C", 40.0, 10), ("G", 70.0, 0), ("D", 0.0, 5), ("D", 10.0, 5)],
                              "position string, toi_minutes double, shifts int")
    got = {r.check: r.n for r in bx.integrity_checks(d).collect()}
    assert got == {"skaters_over_35_min": 1, "goalies_over_66_min": 1, "shifts_without_toi": 1}


def test_recent_games_window(spark):
    rows = [(1, "2024-01-08"), (2, "2024-01-09"), (3, "2024-01-15"), (4, "2024-01-16")]
    s = spark.createDataFrame([(g, d, 20232024, 2, "A", 1, "B", 2, None, None) for g, d in rows], SCHEDULE)
    got = sorted(r.game_id for r in sc.recent_games(s, dt.date(2024, 1, 16), 7).collect())
    assert got == [2, 3]
