"""Small relational building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep one row per ``keys``: the smallest by ``order`` (a total order).

    ``row_number() = 1`` is planned with a partial WindowGroupLimit before the
    shuffle: each map task keeps only its first row per key, so a key with
    very many copies is reduced map-side instead of being shipped to one task.
    (A ``min_by`` over a struct would plan as a slower SortAggregate.)
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(o) if isinstance(o, str) else o for o in order])
    return (df.withColumn("_pick", F.row_number().over(w)).filter(F.col("_pick") == 1)
            .drop("_pick"))


def sides(df: DataFrame, *, keep: Sequence[str]) -> DataFrame:
    """Schedule rows -> one row per (game, side): team, opponent, location,
    goals for / against.  A single generator in the scan stage; no join."""
    home = F.struct(F.col("home_abbrev").alias("team"), F.col("away_abbrev").alias("opponent"),
                    F.lit("home").alias("location"), F.col("home_score").alias("goals_for"),
                    F.col("away_score").alias("goals_against"))
    away = F.struct(F.col("away_abbrev").alias("team"), F.col("home_abbrev").alias("opponent"),
                    F.lit("away").alias("location"), F.col("away_score").alias("goals_for"),
                    F.col("home_score").alias("goals_against"))
    return df.select(*keep, F.inline(F.array(home, away)))
