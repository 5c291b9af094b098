"""Idempotent merges of new data into stored tables (backfill and refresh)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puckline.operators.boxscore import KEY, combine_boxscores
from puckline.operators.common import pick_first
from puckline.operators.pbp import player_game_stats
from puckline.schemas import SCHEDULE_GROUPS


def newest_first(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two versions of a table, one row per ``keys``; incoming rows
    win over stored ones, and a total column order breaks remaining ties."""
    cols = existing.columns
    u = (existing.select(*cols).withColumn("_older", F.lit(1))
         .unionByName(incoming.select(*cols).withColumn("_older", F.lit(0))))
    order = ["_older"] + [c for c in cols if c not in keys]
    return pick_first(u, keys, order).drop("_older")


def merge_schedule(stored: DataFrame, landed: DataFrame) -> DataFrame:
    """Field-level last writer wins, one row per game.

    Both sides hold the schedule columns (scores null until known); ``stored``
    has a landing time per group of fields (``SCHEDULE_GROUPS``), ``landed`` one
    per row (``landed_at``).  Each group takes the latest values that are not
    all null; of equal times the landed row's, of several landed rows a total
    order decides.  Rows of unknown age (null) give way to dated ones."""
    def group(at: Column, fields: Sequence[str], new: int) -> Column:
        known = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in fields])
        return F.when(known, F.struct(at.alias("at"), F.lit(new).alias("new"), *fields))

    old = stored.select("game_id", *[group(F.col(at), fields, 0).alias(at) for at, fields in SCHEDULE_GROUPS.items()])
    new = landed.select("game_id", *[group(F.col("landed_at"), fields, 1).alias(at) for at, fields in SCHEDULE_GROUPS.items()])
    last = old.unionByName(new).groupBy("game_id").agg(*[F.max(at).alias(at) for at in SCHEDULE_GROUPS])
    return last.select("game_id", *[F.col(at)[c].alias(c) for at, fields in SCHEDULE_GROUPS.items() for c in fields],
                       *[F.col(at)["at"].alias(at) for at in SCHEDULE_GROUPS])


def merge_rosters(history: DataFrame, landed: DataFrame, listed: DataFrame) -> DataFrame:
    """Roster stays after new team rosters landed.

    ``landed``: (team_abbrev, season, landed_at), one row per team whose roster
    landed; ``listed``: its players (``ROSTER`` columns).  A listed player who is
    as stored stays; one who is new, or whose data changed, begins a stay; one
    who is listed no more ends it.  Teams that did not land are not in the
    result; a roster older than what is stored of its team changes nothing."""
    facts = ["full_player_name", "position_code", "headshot_url", "season"]
    known = history.groupBy("team_abbrev").agg(F.greatest(F.max("valid_from"), F.max("valid_to")).alias("_known"))
    fresh = landed.join(known, "team_abbrev", "left").filter(
        F.col("_known").isNull() | (F.col("landed_at") >= F.col("_known"))).select("team_abbrev", "season", "landed_at")
    mine = history.join(fresh.select("team_abbrev", F.col("landed_at").alias("at")), "team_abbrev")
    past = mine.filter(F.col("valid_to").isNotNull()).drop("at")
    was = mine.filter(F.col("valid_to").isNull()).drop("valid_to")
    now = listed.join(fresh, "team_abbrev").select(
        "team_abbrev", "player_id", F.col("landed_at").alias("_at"), F.struct(*facts).alias("_now"))
    both = was.withColumn("_was", F.struct(*facts)).join(now, ["team_abbrev", "player_id"], "full")
    same = F.col("_was").isNotNull() & F.col("_now").isNotNull() & (F.col("_was") == F.col("_now"))
    open_stay = F.struct("_was.*", F.col("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    ended = F.struct("_was.*", F.col("valid_from"), F.coalesce("at", "_at").alias("valid_to"))
    begun = F.struct("_now.*", F.col("_at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    stays = F.when(same, F.array(open_stay)).when(F.col("_was").isNull(), F.array(begun)).when(
        F.col("_now").isNull(), F.array(ended)).otherwise(F.array(ended, begun))
    new = both.select("team_abbrev", "player_id", F.inline(stays)).filter(
        F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))
    return past.select(*history.columns).unionByName(new.select(*history.columns))


def roster_asof(history: DataFrame, at: Column | str) -> DataFrame:
    """Players of every roster at a moment."""
    at = F.lit(at).cast("timestamp") if isinstance(at, str) else at
    return history.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def backfill_merge(existing_box: DataFrame, new_box: DataFrame, existing_pbp: DataFrame,
                   new_pbp: DataFrame, schedule_rest: DataFrame) -> DataFrame:
    """Merge stored and newly landed raw rows, then rebuild the combined table.

    Boxscores are keyed by (game, player) and events by (game, event): a game
    fetched twice is counted once (D4), and the stored events are always part
    of the aggregation (D5)."""
    box = newest_first(existing_box, new_box, KEY)
    pbp = newest_first(existing_pbp, new_pbp, ["game_id", "event_id"])
    return combine_boxscores(box, player_game_stats(pbp), schedule_rest)


def upsert_games(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace every stored row of the games present in ``incoming`` and keep
    all other rows (D18: a game whose fetch failed keeps its old rows).

    No global sort: the stored files are ordered by (game_id, player_id)
    within each written partition (``storage.write_seasons``), which needs no
    shuffle of the whole table."""
    games = incoming.select("game_id").distinct()
    kept = existing.join(games, "game_id", "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))
