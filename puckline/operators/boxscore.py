"""Boxscore operators: dedupe, box x stats join, the combined player-game table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puckline.functions.scalar import toi_minutes
from puckline.operators.common import pick_first
from puckline.schemas import COMPREHENSIVE_COLUMNS, PBP_INT_STATS

KEY = ["game_id", "player_id"]


def dedupe_boxscores(box: DataFrame, order: Sequence[Column | str] | None = None) -> DataFrame:
    """One row per (game_id, player_id).  ``order`` decides which copy wins
    (e.g. newest ingest first); the default is a total order over all columns."""
    order = list(order) if order else [c for c in box.columns if c not in KEY]
    return pick_first(box, KEY, order)


def join_box_stats(box: DataFrame, stats: DataFrame) -> DataFrame:
    """Boxscore rows left-joined with play-by-play stats; the boxscore's own
    game-winning-goal column gives way to the computed one."""
    if "game_winning_goal" in box.columns:
        box = box.drop("game_winning_goal")
    return box.join(stats, KEY, "left")


def join_coverage(box: DataFrame, stats: DataFrame) -> DataFrame:
    """Join sanity numbers: total skater goals and rows left without stats."""
    j = join_box_stats(box, stats)
    return j.agg(
        F.coalesce(F.sum(F.when(F.col("position") != "G", F.col("goals"))), F.lit(0))
         .cast("bigint").alias("total_skater_goals"),
        F.count_if(F.col("goals").isNull()).cast("bigint").alias("rows_without_stats"),
        F.count(F.lit(1)).cast("bigint").alias("rows"))


def combine_boxscores(box: DataFrame, stats: DataFrame | None, schedule_rest: DataFrame,
                      keep: Sequence[str] = ()) -> DataFrame:
    """The 38-column comprehensive player-game table.

    Missing stats become 0 (0.0 for the faceoff ratio), the date and the
    player's own team rest days come from the schedule, ``toi`` becomes
    minutes.  Both joins are left joins; the schedule, one row per game, comes
    first: boxscore rows that lie by game already (as after their dedupe) are
    not shuffled for it.  ``stats=None`` (no play-by-play yet) gives all-zero
    stats.  ``keep`` names further columns of ``box`` to carry along.
    """
    sched = schedule_rest.select("game_id", "date", "home_days_rest", "away_days_rest")
    box = box.join(sched, "game_id", "left")
    if stats is None:
        j = box.drop("game_winning_goal").withColumns(
            {c: F.lit(None).cast("int") for c in PBP_INT_STATS}
            | {"faceoff_pct": F.lit(None).cast("double")})
    else:
        j = join_box_stats(box, stats)
    fills = {c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in PBP_INT_STATS}
    fills["faceoff_pct"] = F.coalesce(F.col("faceoff_pct"), F.lit(0.0)).cast("double")
    j = j.withColumns(fills)
    j = j.withColumns({
        "days_rest": F.when(F.col("location") == "home", F.col("home_days_rest"))
                      .otherwise(F.col("away_days_rest")),
        "toi_minutes": toi_minutes("toi"),
    })
    return j.select(*COMPREHENSIVE_COLUMNS, *keep)


def integrity_checks(combined: DataFrame) -> DataFrame:
    """Anomaly counts as (check, n) rows, computed in one pass."""
    skater = F.col("position") != "G"
    toi = F.col("toi_minutes")
    counts = combined.agg(
        F.count_if(skater & (toi > 35)).alias("skaters_over_35_min"),
        F.count_if((F.col("position") == "G") & (toi > 66)).alias("goalies_over_66_min"),
        F.count_if((F.col("shifts") > 0) & (toi == 0)).alias("shifts_without_toi"))
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("n"))
        for c in ["skaters_over_35_min", "goalies_over_66_min", "shifts_without_toi"]])))
