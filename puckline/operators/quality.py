"""Data-quality checks and diagnostics: goal reconciliation, name search,
complete / missing games."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puckline.operators.pbp import GOAL, without_shootout


def goal_reconciliation(pbp: DataFrame, stats: DataFrame) -> DataFrame:
    """Raw non-shootout goal events vs aggregated goals for every
    (game, player) that has either; ``matches`` flags agreement."""
    raw = (without_shootout(pbp)
           .filter((F.col("event_type") == GOAL) & F.col("scoring_player_id").isNotNull())
           .groupBy("game_id", F.col("scoring_player_id").alias("player_id"))
           .agg(F.count(F.lit(1)).alias("raw_goals")))
    agg = stats.filter(F.col("goals") > 0).select("game_id", "player_id",
                                                  F.col("goals").cast("bigint").alias("agg_goals"))
    j = raw.join(agg, ["game_id", "player_id"], "full")
    r, a = F.coalesce("raw_goals", F.lit(0)), F.coalesce("agg_goals", F.lit(0))
    return j.select("game_id", "player_id", r.alias("raw_goals"), a.alias("agg_goals"),
                    (r == a).alias("matches"))


def first_goal_events(pbp: DataFrame, n: int = 10) -> DataFrame:
    """Each scorer's first ``n`` non-shootout goal events (by game, event id)."""
    from pyspark.sql import Window
    goals = (without_shootout(pbp).filter((F.col("event_type") == GOAL)
                                          & F.col("scoring_player_id").isNotNull()))
    w = Window.partitionBy("scoring_player_id").orderBy("game_id", "event_id")
    return (goals.withColumn("goal_rank", F.row_number().over(w))
            .filter(F.col("goal_rank") <= n)
            .select("scoring_player_id", "goal_rank", "game_id", "event_id", "event_type",
                    "situation_code"))


def player_search(box: DataFrame, text: str) -> DataFrame:
    """Distinct (player_id, player_name) whose name contains ``text``,
    case-insensitively and literally (no regex)."""
    hit = F.lower(F.col("player_name")).contains(F.lit(text.lower()))
    return box.filter(hit).select("player_id", "player_name").distinct()


#: Length of the longest grams of a name that are indexed.
GRAM = 3


def name_postings(players: DataFrame) -> DataFrame:
    """Inverted index over distinct names: (size, gram, player_id, player_name)
    for every substring of up to ``GRAM`` characters of the lower-cased name
    (the empty one too, which every name has)."""
    names = players.filter(F.col("player_name").isNotNull()).select("player_id", "player_name").distinct()
    low = F.lower(F.col("player_name"))
    grams = F.array(F.struct(F.lit(0).alias("size"), F.lit("").alias("gram")))

    def of_size(k: int) -> Column:
        starts = F.when(F.length(low) >= k, F.sequence(F.lit(1), F.length(low) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.struct(F.lit(k).alias("size"), F.substr(low, at, F.lit(k)).alias("gram")))

    grams = F.concat(grams, *[of_size(k) for k in range(1, GRAM + 1)])
    return names.select("player_id", "player_name", F.inline(F.array_distinct(grams))).select("size", "gram", "player_id", "player_name")


def search_names(postings: DataFrame, text: str) -> DataFrame:
    """Distinct (player_id, player_name) whose name contains ``text``,
    case-insensitively and literally: names that have all its grams, verified.
    Only the postings of those grams are read."""
    low = text.lower()
    size = min(GRAM, len(low))
    grams = sorted({low[i:i + size] for i in range(len(low) - size + 1)})
    held = postings.filter((F.col("size") == size) & F.col("gram").isin(grams)).groupBy("player_id", "player_name").agg(
        F.count_distinct("gram").alias("_n"))
    return held.filter((F.col("_n") == len(grams)) & F.lower(F.col("player_name")).contains(F.lit(low))).select("player_id", "player_name")


def complete_games(pbp: DataFrame, box: DataFrame) -> DataFrame:
    """Games that have both play-by-play and boxscore rows."""
    return pbp.select("game_id").distinct().join(box.select("game_id").distinct(), "game_id")


def _game_ids(rows: DataFrame) -> DataFrame:
    """The distinct games of raw rows, laid out anew: rows that lie by game already would otherwise
    be sorted and reduced in the tasks that join the ids, which then hold every source's rows at once."""
    return rows.select("game_id").distinct().hint("rebalance", F.col("game_id"))


def missing_games(schedule: DataFrame, pbp: DataFrame, box: DataFrame,
                  as_of: _dt.date | str) -> DataFrame:
    """Played games (dated before ``as_of``) still lacking play-by-play or
    boxscore rows, with which of the two is present."""
    played = schedule.filter(F.col("date") < F.lit(str(as_of))).select("game_id", "date")
    p = _game_ids(pbp).withColumn("has_pbp", F.lit(True))
    b = _game_ids(box).withColumn("has_box", F.lit(True))
    j = played.join(p, "game_id", "left").join(b, "game_id", "left")
    j = j.withColumns({"has_pbp": F.coalesce("has_pbp", F.lit(False)),
                       "has_box": F.coalesce("has_box", F.lit(False))})
    return j.filter(~(F.col("has_pbp") & F.col("has_box")))


def game_ledger(box: DataFrame, pbp: DataFrame) -> DataFrame:
    """(game_id, season, has_box, has_pbp) of every game with raw rows."""
    both = box.select("game_id", "season", F.lit(True).alias("b"), F.lit(False).alias("p")).unionByName(
        pbp.select("game_id", "season", F.lit(False).alias("b"), F.lit(True).alias("p")))
    return both.groupBy("game_id", "season").agg(F.bool_or("b").alias("has_box"), F.bool_or("p").alias("has_pbp"))


def missing_in_ledger(schedule: DataFrame, ledger: DataFrame, as_of: _dt.date | str) -> DataFrame:
    """``missing_games`` from a stored ledger: no raw row is read."""
    played = schedule.filter(F.col("date") < F.lit(str(as_of))).select("game_id", "date")
    j = played.join(ledger.select("game_id", "has_pbp", "has_box"), "game_id", "left")
    j = j.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_pbp", "has_box")})
    return j.filter(~(F.col("has_pbp") & F.col("has_box")))
