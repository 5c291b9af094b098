"""Landed JSON documents -> typed tables.

A landing table has envelope columns (what the reference took from the
request: game id, team, season or date) and ``doc``, the raw JSON text, e.g.
``spark.read.text`` of one document per line plus the path parts.  Parsing
uses ``from_json`` with the explicit schemas of ``puckline.schemas``; arrays
are flattened with ``explode`` / ``inline`` in the scan stage, without shuffles.
Missing fields take the reference's defaults.

A document may land several times; ``newest_documents`` keeps the last one by
``landed_at``.  ``unreadable`` finds documents that do not parse, so that jobs
can set them aside instead of losing them.

``landed_*`` builders derive such documents from the proxy tables (one per
game, or per team for rosters), so every flatten operator can be checked
against the flat proxy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from puckline.functions.scalar import FINISHED_STATES, season_of_date
from puckline.operators.common import pick_first
from puckline.schemas import (BOXSCORE_DOC, PBP_DOC, ROLE_COLUMNS, ROSTER_DOC, SCHEDULE_DOC,
                              SCORE_DOC, SEASONS_DOC, STANDINGS_DOC)
from puckline.sources import proxies as px

# ------------------------------------------------------------------ documents


def newest_documents(landed: DataFrame, keys: Sequence[str] = ("game_id",)) -> DataFrame:
    """The last landed document per key (by ``landed_at`` if there is such a
    column; equal times, or none, by the text)."""
    last = [F.col("landed_at").desc_nulls_last()] if "landed_at" in landed.columns else []
    return pick_first(landed, list(keys), [*last, "doc"])


def unreadable(landed: DataFrame, schema: T.StructType) -> DataFrame:
    """Documents that are null or no JSON of the given shape."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType(), True)])
    parsed = F.from_json("doc", marked, {"columnNameOfCorruptRecord": "_corrupt"})
    return landed.filter(F.col("doc").isNull() | parsed["_corrupt"].isNotNull())


#: What the folders and names of landed files say: kind -> (column of the folder, column of the name).
ENVELOPES = {"schedule": ("season", "team"), "scores": ("season", "date"), "rosters": ("season", "team_abbrev"),
             "boxscores": ("season", "game_id"), "pbp": ("season", "game_id")}


def read_landing(spark: SparkSession, landing: str, kind: str, seasons: Sequence[int]) -> DataFrame:
    """Documents of a landing folder: one JSON text per file
    ``<landing>/<kind>/<season>/<name>.json``, the name being the team, date or
    game id.  ``landed_at`` is when the file was last written.  Only the folders
    of ``seasons`` are listed; a folder that is not there has no documents."""
    folder, name = ENVELOPES[kind]
    paths = [p for s in seasons if _exists(spark, p := f"{landing.rstrip('/')}/{kind}/{s}")]
    types = {"season": "bigint", "game_id": "bigint"}
    columns = [(folder, types.get(folder, "string")), (name, types.get(name, "string")), ("doc", "string"), ("landed_at", "timestamp")]
    if not paths:
        return spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in columns))
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(paths)
    parts = F.split(F.col("_metadata.file_path"), "/")
    stem = F.url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))
    return files.select(F.get(parts, F.size(parts) - 2).try_cast(types.get(folder, "string")).alias(folder),
                        stem.try_cast(types.get(name, "string")).alias(name), F.col("value").alias("doc"),
                        F.col("_metadata.file_modification_time").alias("landed_at"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# ------------------------------------------------------------------ flatten


def flatten_schedule(landed: DataFrame, keep: Sequence[str] = (), missing_score: int | None = 0) -> DataFrame:
    """Team schedule documents (envelope: team, season) -> schedule rows.
    A game appears once per team document that lists it.  ``keep`` names
    further envelope columns to carry along."""
    g = landed.select("season", *keep, F.explode(F.from_json("doc", SCHEDULE_DOC)["games"]).alias("g"))
    return g.select(
        F.col("g.id").alias("game_id"), F.col("g.gameDate").alias("date"),
        F.col("season").cast("bigint").alias("season"), F.col("g.gameType").alias("game_type"),
        F.col("g.awayTeam.abbrev").alias("away_abbrev"),
        F.coalesce(F.col("g.awayTeam.score"), F.lit(missing_score)).cast("bigint").alias("away_score"),
        F.col("g.homeTeam.abbrev").alias("home_abbrev"),
        F.coalesce(F.col("g.homeTeam.score"), F.lit(missing_score)).cast("bigint").alias("home_score"),
        F.col("g.startTimeUTC").alias("start_time"), F.col("g.venue.default").alias("venue"), *keep)


def flatten_scores(landed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Daily score feed documents (envelope: date) -> finished games only,
    schedule columns with null start time and venue; scores stay nullable.
    ``keep`` names further envelope columns to carry along."""
    g = landed.select("date", *keep, F.explode(F.from_json("doc", SCORE_DOC)["games"]).alias("g"))
    g = g.filter(F.col("g.gameState").isin(FINISHED_STATES))
    return g.select(
        F.col("g.id").alias("game_id"), F.col("date").cast("string").alias("date"),
        F.col("g.season").alias("season"), F.col("g.gameType").alias("game_type"),
        F.col("g.awayTeam.abbrev").alias("away_abbrev"), F.col("g.awayTeam.score").alias("away_score"),
        F.col("g.homeTeam.abbrev").alias("home_abbrev"), F.col("g.homeTeam.score").alias("home_score"),
        F.lit(None).cast("string").alias("start_time"), F.lit(None).cast("string").alias("venue"), *keep)


def flatten_roster(landed: DataFrame) -> DataFrame:
    """Roster documents (envelope: team_abbrev) -> one row per listed player;
    the three position groups are concatenated, absent groups count as empty."""
    d = F.from_json("doc", ROSTER_DOC)
    empty = F.array().cast(ROSTER_DOC["forwards"].dataType)
    players = F.concat(*[F.coalesce(d[g], empty) for g in ("forwards", "defensemen", "goalies")])
    p = landed.select("team_abbrev", F.explode(players).alias("p"))
    first = F.coalesce(F.col("p.firstName.default"), F.lit(""))
    last = F.coalesce(F.col("p.lastName.default"), F.lit(""))
    return p.select("team_abbrev", F.col("p.id").alias("player_id"),
                    F.trim(F.concat(first, F.lit(" "), last)).alias("full_player_name"),
                    F.col("p.positionCode").alias("position_code"),
                    F.col("p.headshot").alias("headshot_url"))


def roster_snapshot(roster: DataFrame, season: int, is_current: bool) -> DataFrame:
    """Roster rows tagged for storage: a season's roster, or the current one."""
    return roster.withColumns({"season": F.lit(season).cast("bigint"),
                               "is_current": F.lit(is_current)})


def _box_rows(side: str, team: Column, opponent: Column, location: str) -> Column:
    stats = F.col(f"d.playerByGameStats.{side}")
    empty = F.array().cast(BOXSCORE_DOC["playerByGameStats"].dataType[side].dataType["forwards"].dataType)

    def tag(arr: Column, goalie: bool) -> Column:
        return F.transform(F.coalesce(arr, empty), lambda p: F.struct(
            p.alias("p"), F.lit(goalie).alias("goalie"), team.alias("team"),
            opponent.alias("opponent"), F.lit(location).alias("location")))

    return F.concat(tag(stats["forwards"], False), tag(stats["defense"], False),
                    tag(stats["goalies"], True))


def flatten_boxscore(landed: DataFrame) -> DataFrame:
    """Boxscore documents (envelope: game_id) -> player-game rows for both
    sides; goalie-only columns are null for skaters, goalies get position G
    and ``ot_loss`` from decision ``O``."""
    d = landed.select("game_id", F.from_json("doc", BOXSCORE_DOC).alias("d"))
    away = F.coalesce(F.col("d.awayTeam.abbrev"), F.lit(""))
    home = F.coalesce(F.col("d.homeTeam.abbrev"), F.lit(""))
    rows = d.select("game_id", F.inline(F.concat(_box_rows("awayTeam", away, home, "away"),
                                                 _box_rows("homeTeam", home, away, "home"))))
    g = F.col("goalie")

    def pick(field: str, default, goalie_only: bool = False, skater_value=None) -> Column:
        v = F.coalesce(F.col(f"p.{field}"), F.lit(default))
        if goalie_only:
            return F.when(g, v)
        return F.when(g, F.lit(skater_value)).otherwise(v) if skater_value is not None else v

    decision = F.coalesce(F.col("p.decision"), F.lit(""))
    return rows.select(
        "game_id", F.col("p.playerId").alias("player_id"),
        F.coalesce(F.col("p.name.default"), F.lit("")).alias("player_name"),
        "team", "opponent", "location",
        F.when(g, F.lit("G")).otherwise(F.col("p.position")).alias("position"),
        F.when(g, F.lit(0)).otherwise(F.coalesce(F.col("p.plusMinus"), F.lit(0))).cast("int").alias("plus_minus"),
        F.coalesce(F.col("p.toi"), F.lit("0:00")).alias("toi"),
        F.when(g, F.lit(0)).otherwise(F.coalesce(F.col("p.shifts"), F.lit(0))).cast("int").alias("shifts"),
        pick("shotsAgainst", 0, True).cast("int").alias("shots_against"),
        pick("saves", 0, True).cast("int").alias("saves"),
        pick("goalsAgainst", 0, True).cast("int").alias("goals_against"),
        pick("savePctg", 0.0, True).cast("double").alias("save_pct"),
        F.when(g, decision).alias("decision"),
        F.when(g, F.lit(0)).otherwise(F.coalesce(F.col("p.gameWinningGoals"), F.lit(0)))
         .cast("int").alias("game_winning_goal"),
        F.when(g & (decision == "O"), 1).otherwise(0).cast("int").alias("ot_loss"))


_DETAIL = {
    "scoring_player_id": "scoringPlayerId", "assist1_player_id": "assist1PlayerId",
    "assist2_player_id": "assist2PlayerId", "shooting_player_id": "shootingPlayerId",
    "blocking_player_id": "blockingPlayerId", "hitting_player_id": "hittingPlayerId",
    "committed_player_id": "committedByPlayerId", "winning_player_id": "winningPlayerId",
    "losing_player_id": "losingPlayerId", "player_id": "playerId",
}


def flatten_pbp(landed: DataFrame) -> DataFrame:
    """Play-by-play documents (envelope: game_id) -> one row per play with the
    usual defaults ('' type and situation, 0 duration, REG period).  A play
    without an id gets -1, -2, ... by its place, which no other play has."""
    d = landed.select("game_id", F.from_json("doc", PBP_DOC).alias("d"))
    p = d.select("game_id", F.col("d.homeTeam.id").alias("home_team_id"),
                 F.col("d.awayTeam.id").alias("away_team_id"),
                 F.posexplode("d.plays").alias("at", "p"))
    det = "p.details."
    return p.select(
        "game_id", F.coalesce("p.eventId", (-1 - F.col("at")).cast("bigint")).alias("event_id"),
        F.coalesce(F.col("p.typeDescKey"), F.lit("")).alias("event_type"),
        F.coalesce(F.col("p.situationCode"), F.lit("")).alias("situation_code"),
        F.col(det + "eventOwnerTeamId").alias("event_owner_team_id"),
        "home_team_id", "away_team_id",
        *[F.col(det + _DETAIL[c]).alias(c) for c in ROLE_COLUMNS],
        F.coalesce(F.col(det + "duration"), F.lit(0)).cast("int").alias("duration"),
        F.col(det + "homeScore").alias("home_score"), F.col(det + "awayScore").alias("away_score"),
        F.coalesce(F.col("p.periodDescriptor.periodType"), F.lit("REG")).alias("period_type"))


def flatten_seasons(landed: DataFrame) -> DataFrame:
    """Season metadata -> (season, standings_end, is_latest); the latest season
    is the last element of the list."""
    s = landed.select(F.from_json("doc", SEASONS_DOC)["seasons"].alias("s"))
    s = s.select(F.element_at("s", -1)["id"].alias("_latest"), F.explode("s").alias("x"))
    return s.select(F.col("x.id").alias("season"), F.col("x.standingsEnd").alias("standings_end"),
                    (F.col("x.id") == F.col("_latest")).alias("is_latest"))


def active_teams(standings: DataFrame, seasons: DataFrame) -> DataFrame:
    """Teams per season: distinct non-empty abbreviations in the standings
    documents of the season up to its standings end date, sorted."""
    t = standings.select("date", F.explode(F.from_json("doc", STANDINGS_DOC)["standings"]).alias("s"))
    t = t.select("date", F.col("s.teamAbbrev.default").alias("team")).filter(
        F.col("team").isNotNull() & (F.col("team") != ""))
    s = flatten_seasons(seasons)
    t = t.withColumn("season", season_of_date(F.to_date("date")))
    j = t.join(s, "season").filter(F.col("date") <= F.col("standings_end"))
    return (j.select("season", "team", "is_latest").distinct()
            .orderBy("season", "team"))


# ------------------------------------------------------------------ landed documents


def _j(*fields) -> Column:
    return F.to_json(F.struct(*fields))


def landed_team_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One schedule document per (game, team): each game is listed twice."""
    g = px.games(spark, sf_dir)
    game = F.struct(
        F.col("game_id").alias("id"), F.col("date").alias("gameDate"), F.col("game_type").alias("gameType"),
        F.struct(F.col("away_abbrev").alias("abbrev"), F.col("away_score").alias("score")).alias("awayTeam"),
        F.struct(F.col("home_abbrev").alias("abbrev"), F.col("home_score").alias("score")).alias("homeTeam"),
        F.col("start_time").alias("startTimeUTC"),
        F.struct(F.col("venue").alias("default")).alias("venue"))
    doc = _j(F.array(game).alias("games"))
    return g.select("season", doc.alias("doc"),
                    F.explode(F.array("home_abbrev", "away_abbrev")).alias("team"))


def game_state(game_id: Column) -> Column:
    return F.when(game_id % 11 == 0, F.lit("FUT")).otherwise(F.lit("FINAL"))


def landed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score feed documents (envelope: date), one game each."""
    g = px.games(spark, sf_dir)
    game = F.struct(
        F.col("game_id").alias("id"), "season", F.col("game_type").alias("gameType"),
        game_state(F.col("game_id")).alias("gameState"),
        F.struct(F.col("away_abbrev").alias("abbrev"), F.col("away_score").alias("score")).alias("awayTeam"),
        F.struct(F.col("home_abbrev").alias("abbrev"), F.col("home_score").alias("score")).alias("homeTeam"))
    return g.select("date", _j(F.array(game).alias("games")).alias("doc"))


def landed_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster documents, one per team."""
    r = px.roster(spark, sf_dir)
    name = F.col("full_player_name")
    player = F.struct(F.col("player_id").alias("id"),
                      F.struct(F.substring_index(name, " ", 1).alias("default")).alias("firstName"),
                      F.struct(F.substring_index(name, " ", -1).alias("default")).alias("lastName"),
                      F.col("position_code").alias("positionCode"), F.col("headshot_url").alias("headshot"))
    pos = F.col("position_code")

    def group(cond: Column) -> Column:
        return F.filter(F.collect_list(F.struct(cond.alias("k"), player.alias("p"))),
                        lambda x: x["k"])

    d = r.groupBy("team_abbrev").agg(
        group(pos.isin("C", "L", "R")).alias("f"), group(pos == "D").alias("d"),
        group(pos == "G").alias("g"))
    return d.select("team_abbrev", _j(
        F.transform("f", lambda x: x["p"]).alias("forwards"),
        F.transform("d", lambda x: x["p"]).alias("defensemen"),
        F.transform("g", lambda x: x["p"]).alias("goalies")).alias("doc"))


def landed_boxscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxscore documents (one per game) from the deduplicated proxy rows."""
    from puckline.operators.boxscore import dedupe_boxscores
    b = dedupe_boxscores(px.box(spark, sf_dir), ["src_line", "src_part", "src_qty", "src_price"])
    b = b.drop(*px.BOX_SOURCE_COLUMNS)
    player = F.struct(
        F.col("player_id").alias("playerId"), F.struct(F.col("player_name").alias("default")).alias("name"),
        "position", F.col("plus_minus").alias("plusMinus"), "toi", "shifts",
        F.col("game_winning_goal").alias("gameWinningGoals"), F.col("shots_against").alias("shotsAgainst"),
        "saves", F.col("goals_against").alias("goalsAgainst"), F.col("save_pct").alias("savePctg"),
        "decision")
    home_team = F.when(F.col("location") == "home", F.col("team")).otherwise(F.col("opponent"))
    away_team = F.when(F.col("location") == "away", F.col("team")).otherwise(F.col("opponent"))
    items = F.collect_list(F.struct(F.col("location").alias("loc"),
                                    F.col("position").alias("pos"), player.alias("p")))
    d = b.groupBy("game_id").agg(F.min(home_team).alias("home"), F.min(away_team).alias("away"),
                               items.alias("items"))

    def side(loc: str) -> Column:
        def grp(cond):
            return F.transform(F.filter("items", lambda x: (x["loc"] == loc) & cond(x["pos"])),
                               lambda x: x["p"])
        return F.struct(grp(lambda p: p.isin("C", "L", "R")).alias("forwards"),
                        grp(lambda p: p == "D").alias("defense"),
                        grp(lambda p: p == "G").alias("goalies"))

    doc = _j(F.col("game_id").alias("id"), F.struct(F.col("away").alias("abbrev")).alias("awayTeam"),
             F.struct(F.col("home").alias("abbrev")).alias("homeTeam"),
             F.struct(side("away").alias("awayTeam"), side("home").alias("homeTeam")).alias("playerByGameStats"))
    return d.select("game_id", doc.alias("doc"))


def landed_pbp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Play-by-play documents, one per game (the proxy has forty plays a game)."""
    e = px.pbp(spark, sf_dir)
    details = F.struct(F.col("event_owner_team_id").alias("eventOwnerTeamId"),
                       *[F.col(c).alias(_DETAIL[c]) for c in ROLE_COLUMNS],
                       "duration", F.col("home_score").alias("homeScore"),
                       F.col("away_score").alias("awayScore"))
    play = F.struct(F.col("event_id").alias("eventId"), F.col("event_type").alias("typeDescKey"),
                    F.col("situation_code").alias("situationCode"),
                    F.struct(F.col("period_type").alias("periodType")).alias("periodDescriptor"),
                    details.alias("details"))
    d = e.groupBy("game_id").agg(F.min("home_team_id").alias("h"), F.min("away_team_id").alias("a"),
                                 F.collect_list(play).alias("plays"))
    doc = _j(F.col("game_id").alias("id"), F.struct(F.col("a").alias("id")).alias("awayTeam"),
             F.struct(F.col("h").alias("id")).alias("homeTeam"), "plays")
    return d.select("game_id", doc.alias("doc"))


def landed_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standings documents (envelope: date), one per game listing both teams."""
    g = px.games(spark, sf_dir)
    teams = F.array(F.struct(F.struct(F.col("home_abbrev").alias("default")).alias("teamAbbrev")),
                    F.struct(F.struct(F.col("away_abbrev").alias("default")).alias("teamAbbrev")))
    return g.select("date", _j(teams.alias("standings")).alias("doc"))


def landed_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One season metadata document (one entry per season: its last game date)."""
    g = px.games(spark, sf_dir).groupBy("season").agg(F.max("date").alias("standingsEnd"))
    items = F.sort_array(F.collect_list(F.struct(F.col("season").alias("id"), "standingsEnd")))
    return g.agg(items.alias("seasons")).select(_j("seasons").alias("doc"))


__all__ = ["newest_documents", "unreadable", "flatten_schedule", "flatten_scores", "flatten_roster", "flatten_boxscore",
           "flatten_pbp", "flatten_seasons", "active_teams", "roster_snapshot"]
