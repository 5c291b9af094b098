"""The dashboard fact table and its long (stat, value) form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puckline.functions.scalar import season_of_date
from puckline.operators.common import pick_first
from puckline.schemas import FACT_NUMERIC, FACT_STRING

# The prop catalogue (player type, stat, default line).
SKATER_PROPS = ["shots", "shot_attempts", "points", "goals", "assists", "toi_minutes",
                "blocked_shots", "hits", "plus_minus"]
GOALIE_PROPS = ["saves", "shots_against", "goals_against"]
PROP_STATS = SKATER_PROPS + GOALIE_PROPS
DEFAULT_LINES = {"shots": 1.5, "blocked_shots": 1.5, "saves": 24.5, "shots_against": 25.5,
                 "goals_against": 2.5}
SKATER_DEFAULT_LINE = 0.5
GOALIE_DEFAULT_LINE = 2.0
UNKNOWN = "Unknown"
NO_REST = 99


def default_line(stat: str, player_type: str) -> float:
    if player_type == "Goalie":
        return DEFAULT_LINES.get(stat, GOALIE_DEFAULT_LINE) if stat in GOALIE_PROPS else GOALIE_DEFAULT_LINE
    return DEFAULT_LINES.get(stat, SKATER_DEFAULT_LINE) if stat in ("shots", "blocked_shots") else SKATER_DEFAULT_LINE


def roster_dim(roster: DataFrame) -> DataFrame:
    """Current roster with the dashboard's column names, one row per (player, team)."""
    named = roster.select("team_abbrev", "player_id",
                          F.col("full_player_name").alias("player_name"),
                          "position_code", "headshot_url")
    return pick_first(named, ["player_id", "team_abbrev"], ["player_name", "position_code", "headshot_url"])


def roster_names(roster: DataFrame) -> DataFrame:
    """One roster name per player id (smallest name if a player is listed twice)."""
    r = roster.filter(F.col("player_id").isNotNull()).select(
        "player_id", F.col("full_player_name").alias("roster_name"))
    return pick_first(r, ["player_id"], ["roster_name"])


def win_flag(df: DataFrame) -> Column:
    """1 when the player's side outscored the other side, else 0 (null scores -> 0)."""
    loc, h, a = F.col("location"), F.col("home_score"), F.col("away_score")
    return (F.when((loc == "home") & (h > a), 1).when((loc == "away") & (a > h), 1)
            .otherwise(0).cast("int"))


def build_facts(boxscores: DataFrame, schedule: DataFrame | None, roster: DataFrame | None) -> DataFrame:
    """Combined boxscores -> dashboard facts: roster names win over boxscore
    names, stats as double (null -> 0), text null -> ``Unknown``, rows without a
    readable date dropped, schedule context joined by game, ``win`` and ``b2b``.

    Without a schedule the season comes from the date, the game type is 2,
    scores are null and ``win`` is 0; without a ``days_rest`` column the rest
    is unknown (99).
    """
    if "days_rest" not in boxscores.columns:
        boxscores = boxscores.withColumn("days_rest", F.lit(None).cast("int"))
    df = boxscores
    if roster is not None:
        df = (df.join(roster_names(roster), "player_id", "left")
              .withColumn("player_name", F.coalesce("roster_name", "player_name"))
              .drop("roster_name").select(*boxscores.columns))
    date = (F.try_to_date(F.col("date"), "yyyy-MM-dd")
            if dict(df.dtypes)["date"] == "string" else F.col("date"))
    casts = {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
             for c in FACT_NUMERIC if c in df.columns}
    casts.update({c: F.coalesce(F.col(c), F.lit(UNKNOWN)) for c in FACT_STRING if c in df.columns})
    casts["date"] = date
    df = df.withColumns(casts).filter(F.col("date").isNotNull())
    if schedule is None:
        df = df.withColumns({
            "season": season_of_date("date"), "game_type": F.lit(None).cast("bigint"),
            **{c: F.lit(None).cast("bigint") for c in ("home_score", "away_score")},
            **{c: F.lit(None).cast("string") for c in ("home_abbrev", "away_abbrev")}})
    else:
        df = _with_schedule(df, schedule)
    df = df.withColumns({
        "win": win_flag(df),
        "season": F.coalesce(F.col("season"), F.lit(0)).cast("bigint"),
        "game_type": F.coalesce(F.col("game_type"), F.lit(2)).cast("int"),
        "days_rest": F.coalesce(F.col("days_rest"), F.lit(NO_REST)).cast("int"),
    })
    return df.withColumn("b2b", F.col("days_rest") == 0)


def _with_schedule(df: DataFrame, schedule: DataFrame) -> DataFrame:
    """Season, type, scores and sides of each row's game (null for an unknown game)."""
    sched_cols = ["game_id", "season", "game_type", "home_score", "away_score",
                  "home_abbrev", "away_abbrev"]
    sched = pick_first(schedule.select(*sched_cols, "date", "start_time", "venue"),
                       ["game_id"], ["date", "season", "game_type", "home_abbrev", "away_abbrev",
                                     "home_score", "away_score", "start_time", "venue"])
    sched = (sched.withColumn("_d", F.try_to_date(F.col("date"), "yyyy-MM-dd"))
             .filter(F.col("_d").isNotNull()).select(*sched_cols))
    return df.join(sched, "game_id", "left")


def stats_long(facts: DataFrame, stats: Sequence[str] = tuple(PROP_STATS),
               keep: Sequence[str] = ("game_id", "player_id", "date", "season", "team",
                                      "opponent", "location", "position")) -> DataFrame:
    """Wide stat columns -> (stat, value) rows, so every prop runs in one pass."""
    pairs = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value"))
                      for s in stats])
    return facts.select(*keep, F.inline(pairs))
