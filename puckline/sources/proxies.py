"""Hockey-shaped tables derived by Spark from the driver's TPC-H-like tables.

The inputs are ``orders`` (one game per order), ``lineitem`` (one player-game
row per line item) and ``events`` (forty play-by-play events per game).  The
derivations are row-wise expressions plus two joins, so their size grows with
the inputs; nothing is generated on the driver.  Games are merged with player
rows and events by sort: by file size (and, of a few columns, by shuffled size) Spark would estimate
several times too little and send a copy of games or events through the driver for every use of a table.  ``puckline.oracle`` holds the
same derivations as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _code(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(c.cast("string"), 2, "0"))


def games(spark: SparkSession, sf_dir: str, orders_filter: Column | None = None) -> DataFrame:
    """Schedule rows plus team ids (``FIXTURES`` F3).  ``orders_filter`` is
    applied to the raw orders columns, so it is pushed into the Parquet scan."""
    return _games(spark, sf_dir, orders_filter).drop("day")


def _games(spark: SparkSession, sf_dir: str, orders_filter: Column | None = None) -> DataFrame:
    """``games`` with the date as a date too."""
    o = read_table(spark, sf_dir, "orders")
    if orders_filter is not None:
        o = o.filter(orders_filter)
    day = F.to_date("o_orderdate")
    year, month = F.year(day).cast("bigint"), F.month(day)
    hk = F.col("o_custkey") % 25
    ak = (F.col("o_custkey") % 25 + 1 + F.col("o_orderkey") % 24) % 25
    gid = F.col("o_orderkey")
    return o.select(
        gid.alias("game_id"),
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        F.when(month >= 9, year * 10000 + year + 1)
         .otherwise((year - 1) * 10000 + year).alias("season"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 3)
         .when(F.col("o_orderpriority") == "5-LOW", 1)
         .otherwise(2).cast("bigint").alias("game_type"),
        _code("T", ak).alias("away_abbrev"),
        (F.floor(F.col("o_totalprice") / 10).cast("bigint") % 6).alias("away_score"),
        _code("T", hk).alias("home_abbrev"),
        (F.floor("o_totalprice").cast("bigint") % 6).alias("home_score"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"),
                 F.lpad((gid % 24).cast("string"), 2, "0"), F.lit(":30:00Z")).alias("start_time"),
        F.when(gid % 10 == 0, F.lit(None).cast("string")).otherwise(_code("V", hk)).alias("venue"),
        (hk + 100).alias("home_team_id"),
        (ak + 100).alias("away_team_id"),
        day.alias("day"),
    )


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored schedule table (games without the team ids)."""
    return games(spark, sf_dir).drop("home_team_id", "away_team_id")


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essential boxscore rows, with duplicate (game_id, player_id) keys kept."""
    li = read_table(spark, sf_dir, "lineitem")
    # Team names are built from the ids of the merged rows: a game is shuffled as two numbers.
    g = games(spark, sf_dir).select("game_id", "home_team_id", "away_team_id")
    j = li.join(g.hint("merge"), li.l_orderkey == g.game_id).withColumns(
        {side: _code("T", F.col(f"{side}_team_id") - 100) for side in ("home", "away")})
    supp, part = F.col("l_suppkey"), F.col("l_partkey")
    even = supp % 2 == 0
    pos = (F.when(supp % 5 == 0, "C").when(supp % 5 == 1, "L").when(supp % 5 == 2, "R")
           .when(supp % 5 == 3, "D").otherwise("G"))
    qty = F.col("l_quantity").cast("int")
    toi = (F.when(part % 97 == 0, F.lit(None).cast("string"))
           .when(part % 89 == 0, "bad").when(part % 83 == 0, "x:30")
           .otherwise(F.concat((qty + F.when(supp % 5 == 4, 20).otherwise(0)).cast("string"),
                               F.lit(":"), F.lpad((part % 60).cast("string"), 2, "0"))))
    goalie = supp % 5 == 4
    dec = (F.when(F.col("l_linenumber") % 3 == 0, "W")
           .when(F.col("l_linenumber") % 3 == 1, "L").otherwise("O"))
    sa = (F.lit(22) + part % 15).cast("int")
    sv = (F.lit(20) + part % 15).cast("int")
    return j.select(
        F.col("l_orderkey").alias("game_id"),
        (supp % 40).alias("player_id"),
        _code("P", supp % 40).alias("player_name"),
        F.when(even, F.col("home")).otherwise(F.col("away")).alias("team"),
        F.when(even, F.col("away")).otherwise(F.col("home")).alias("opponent"),
        F.when(even, "home").otherwise("away").alias("location"),
        pos.alias("position"),
        (F.col("l_linenumber") - 4).cast("int").alias("plus_minus"),
        toi.alias("toi"),
        (F.col("l_linenumber") * 4).cast("int").alias("shifts"),
        F.when(goalie, sa).alias("shots_against"),
        F.when(goalie, sv).alias("saves"),
        F.when(goalie, (part % 5).cast("int")).alias("goals_against"),
        F.when(goalie, sv.cast("double") / sa.cast("double")).alias("save_pct"),
        F.when(goalie, dec).alias("decision"),
        F.lit(0).alias("game_winning_goal"),
        F.when(goalie & (dec == "O"), 1).otherwise(0).alias("ot_loss"),
        F.col("l_linenumber").cast("int").alias("src_line"),
        part.alias("src_part"),
        qty.alias("src_qty"),
        F.col("l_extendedprice").alias("src_price"),
    )


BOX_SOURCE_COLUMNS = ["src_line", "src_part", "src_qty", "src_price"]


def _event_type() -> Column:
    return (F.when(F.col("event_type") == "purchase", "goal")
    .when(F.col("event_type") == "view",
          F.when(F.col("event_id") % 2 == 0, "shot-on-goal").otherwise("missed-shot"))
    .when(F.col("event_type") == "click",
          F.when(F.col("event_id") % 2 == 0, "hit").otherwise("takeaway"))
    .when(F.col("event_type") == "error", "penalty")
    .otherwise(F.when(F.col("event_id") % 3 == 0, "blocked-shot")
               .when(F.col("event_id") % 3 == 1, "faceoff").otherwise("giveaway")))


def pbp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw play-by-play events (``FIXTURES`` F4)."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    g = games(spark, sf_dir).select("game_id", "home_team_id", "away_team_id")
    x = (e.withColumn("game_id", F.floor(F.col("event_id") / 40).cast("bigint"))
         .join(g.hint("merge"), "game_id")
         .select("event_id", "game_id", (F.col("user_id") % 40).alias("u"),
                 "home_team_id", "away_team_id", _event_type().alias("et")))
    eid, u, et = F.col("event_id"), F.col("u"), F.col("et")
    goal = et == "goal"
    # Running score inside a game: the proxy has exactly forty events per game.
    running = Window.partitionBy("game_id").orderBy("event_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    home_goal = F.when(goal & (eid % 2 == 0), 1).otherwise(0)
    away_goal = F.when(goal & (eid % 2 == 1), 1).otherwise(0)
    shot_like = et.isin("shot-on-goal", "missed-shot", "blocked-shot")
    return x.select(
        "game_id", "event_id", et.alias("event_type"),
        F.when(eid % 9 == 0, "1551").when(eid % 9 == 1, "1541").when(eid % 9 == 2, "1451")
         .when(eid % 9 == 3, "1560").when(eid % 9 == 4, "0651").when(eid % 9 == 5, "15")
         .when(eid % 9 == 6, F.lit(None).cast("string")).when(eid % 9 == 7, "1A41")
         .otherwise("1531").alias("situation_code"),
        F.when(eid % 29 == 0, F.lit(None).cast("bigint"))
         .when(eid % 2 == 0, F.col("home_team_id")).otherwise(F.col("away_team_id"))
         .alias("event_owner_team_id"),
        "home_team_id", "away_team_id",
        F.when(goal, u).alias("scoring_player_id"),
        F.when(goal & (eid % 3 != 0), (u + 7) % 40).alias("assist1_player_id"),
        F.when(goal & (eid % 3 == 2), (u + 13) % 40).alias("assist2_player_id"),
        F.when(shot_like, u).alias("shooting_player_id"),
        F.when(et == "blocked-shot", (u + 3) % 40).alias("blocking_player_id"),
        F.when(et == "hit", u).alias("hitting_player_id"),
        F.when((et == "penalty") & (eid % 11 != 0), u).alias("committed_player_id"),
        F.when(et == "faceoff", u).alias("winning_player_id"),
        F.when(et == "faceoff", (u + 5) % 40).alias("losing_player_id"),
        F.when(et == "penalty", F.when(eid % 4 == 0, 5).otherwise(2)).otherwise(0)
         .cast("int").alias("duration"),
        F.when(et.isin("giveaway", "takeaway"), u).alias("player_id"),
        F.when(goal, F.sum(home_goal).over(running)).cast("int").alias("home_score"),
        F.when(goal, F.sum(away_goal).over(running)).cast("int").alias("away_score"),
        F.when(eid % 40 >= 38, "SO").when(eid % 40 >= 35, "OT").otherwise("REG").alias("period_type"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard fact rows with dense stat values (``FIXTURES`` F5)."""
    b = box(spark, sf_dir)
    # ``toi`` follows from player, part and quantity: it would break no tie, and need not be built to sort by it.
    # Rows that differ in their price alone are the same fact, so prices are not shuffled.
    first = Window.partitionBy("game_id", "player_id").orderBy("src_line", "src_part", "src_qty")
    b = b.withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    g = _games(spark, sf_dir).select("game_id", F.col("day").alias("date"), "season", "game_type", "home_score",
                                     "away_score", "home_abbrev", "away_abbrev")
    j = b.join(g.hint("merge"), "game_id")
    line, part, qty = F.col("src_line"), F.col("src_part"), F.col("src_qty")
    goalie = F.col("position") == "G"

    def d(c: Column) -> Column:
        return c.cast("double")

    return j.select(
        "game_id", "date", "season", "game_type", "player_id",
        "player_name", "team", "opponent", "location", "position",
        d(qty % 8).alias("shots"), d(line % 3).alias("goals"), d(part % 3).alias("assists"),
        d(line % 3 + part % 3).alias("points"), d(qty % 8 + part % 5).alias("shot_attempts"),
        d(part % 5).alias("missed_shots"), d(qty % 4).alias("blocked_shots"),
        d(part % 6).alias("hits"), d(F.col("plus_minus")).alias("plus_minus"),
        d(F.col("shifts")).alias("shifts"), d(qty).alias("toi_minutes"),
        F.when(goalie, d(20 + part % 15)).otherwise(0.0).alias("saves"),
        F.when(goalie, d(22 + part % 15)).otherwise(0.0).alias("shots_against"),
        F.when(goalie, d(part % 5)).otherwise(0.0).alias("goals_against"),
        F.when(F.col("game_id") % 7 == 0, 99).otherwise((F.col("game_id") % 4).cast("int"))
         .alias("days_rest"),
        "home_score", "away_score", "home_abbrev", "away_abbrev",
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current roster: one team per player; some players are left out on purpose."""
    b = box(spark, sf_dir).filter(F.col("player_id") % 13 != 0)
    return (b.groupBy("player_id", "player_name")
            .agg(F.min("position").alias("position_code"))
            .select(_code("T", F.col("player_id") % 25).alias("team_abbrev"), "player_id",
                    F.concat(F.lit("Player "), F.col("player_name")).alias("full_player_name"),
                    "position_code", F.lit(None).cast("string").alias("headshot_url")))
