"""Schedule operators: season schedule, rest days, recent games, sampling."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from puckline.functions.scalar import FINISHED_STATES, GAME_TYPE_CODES
from puckline.operators.common import pick_first
from puckline.schemas import SCHEDULE


def allowed_game_types(game_types: Sequence[str] = ("R", "P")) -> list[int]:
    """Letters to numeric game types; unknown letters mean regular season."""
    return sorted({GAME_TYPE_CODES.get(t, 2) for t in game_types})


def filter_game_types(schedule: DataFrame, game_types: Sequence[str] = ("R", "P")) -> DataFrame:
    return schedule.filter(F.col("game_type").isin(allowed_game_types(game_types)))


def season_schedule(team_schedules: DataFrame, game_types: Sequence[str] = ("R", "P")) -> DataFrame:
    """Merge per-team schedule rows into one row per game, keep the allowed
    game types, order by date and game id.  A game listed by both teams is kept
    once (the copies are identical; ties are broken by a total column order)."""
    cols = [f.name for f in SCHEDULE.fields]
    games = pick_first(team_schedules.select(*cols), ["game_id"], cols[1:])
    return filter_game_types(games, game_types).orderBy("date", "game_id")


def with_days_rest(schedule: DataFrame, cap: int = 3, per: Sequence[str] = ("season",)) -> DataFrame:
    """Add ``home_days_rest`` / ``away_days_rest``: days since the team's
    previous game minus one, capped at ``cap``; null for a team's first game.

    Scoped by ``per`` (default: season, as each season's schedule is processed
    on its own).  Same-day games of a team are ordered by game id: the later
    one gets -1.

    Plan: the lag runs over distinct (team, date) rows - at most one per team
    per calendar day - so every window partition is bounded by the calendar,
    not by the data volume.  Those rows are joined back to the schedule by
    (team, date) from both sides; the small side is broadcast by AQE when its
    measured size allows, else the join is a shuffle join.  The schedule
    itself is never sorted per team.
    """
    per = list(per)
    day = F.to_date("date")
    team_days = (schedule.select(*per, "game_id", day.alias("_day"),
                                 F.inline(F.array(F.struct(F.col("home_abbrev").alias("team")),
                                                  F.struct(F.col("away_abbrev").alias("team")))))
                 .groupBy(*per, "team", "_day").agg(F.min("game_id").alias("_first_game")))
    w = Window.partitionBy(*per, "team").orderBy("_day")
    team_days = team_days.withColumn("_prev_day", F.lag("_day").over(w))

    def side(prefix: str) -> DataFrame:
        return team_days.select(*[F.col(p).alias(f"_{prefix}_{p}") for p in per],
                                F.col("team").alias(f"_{prefix}_team"),
                                F.col("_day").alias(f"_{prefix}_day"),
                                F.col("_first_game").alias(f"_{prefix}_first"),
                                F.col("_prev_day").alias(f"_{prefix}_prev"))

    out = schedule.withColumn("_day", day)
    for prefix in ("home", "away"):
        s = side(prefix)
        cond = [out["_day"] == s[f"_{prefix}_day"], out[f"{prefix}_abbrev"] == s[f"_{prefix}_team"]]
        cond += [out[p] == s[f"_{prefix}_{p}"] for p in per]
        out = out.join(s, cond, "left")
        gap = F.least(F.datediff(F.col("_day"), F.col(f"_{prefix}_prev")) - 1, F.lit(cap))
        rest = (F.when(F.col("game_id") != F.col(f"_{prefix}_first"), F.lit(-1))
                .when(F.col(f"_{prefix}_prev").isNull(), F.lit(None))
                .otherwise(gap))
        out = out.withColumn(f"{prefix}_days_rest", rest.cast("int"))
    return out.select(*schedule.columns, "home_days_rest", "away_days_rest")


def recent_games(scores: DataFrame, as_of: _dt.date | str, days: int = 7, keep: Sequence[str] = ()) -> DataFrame:
    """Finished games dated in the ``days`` days before ``as_of`` (exclusive).

    ``scores`` is the flattened score feed (see ``sources.landing``); ``keep``
    names further columns of it to carry along."""
    as_of = F.lit(str(as_of)).cast("date")
    d = F.to_date("date")
    return (scores.filter(d.between(F.date_sub(as_of, days), F.date_sub(as_of, 1)))
            .select(*[f.name for f in SCHEDULE.fields], *keep))


def sample_games(schedule: DataFrame, as_of: _dt.date | str, n: int = 32) -> DataFrame:
    """Test sample: the first played game of each home team, at most ``n``.

    Picked with a grouped ``min`` (map-side partial aggregation), then a
    top-``n`` by date and game id."""
    played = schedule.filter(F.col("date") < F.lit(str(as_of)))
    first = pick_first(played, ["home_abbrev"], ["date", "game_id"])
    return first.orderBy("date", "game_id").limit(n).select(*schedule.columns)
