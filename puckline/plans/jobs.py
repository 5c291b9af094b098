"""Backfill and refresh jobs.

Tables under ``out`` (``puckline.sources.snapshots``: every write is a new
version, old versions are the archive): ``schedule`` by season; ``games`` (the
ledger of what raw rows there are), ``essential_boxscores``, ``raw_pbp_events``
and ``comprehensive_boxscores`` by season and part, a part being the month of
the game's date; ``player_names``, the index of the names that landed boxscores
have had; ``roster`` by season and team and ``roster_history`` by team.
``quarantine/`` collects documents that do not parse.  Inputs are landed JSON
tables (see ``puckline.sources.landing``; an optional ``landed_at`` column says
which copy of a document is the newest) or a landing folder.

Both jobs merge what landed into the stored tables.  A job first lists the games
it changes: those with landed documents, and those whose date or rest days the
merged schedule changes.  Only the parts that hold such games, or held them, are
read, rebuilt from their raw rows and written.  So a game that lands twice
counts once, a partial landing loses nothing, running a job again gives the
same tables, and readers see a table as it was before or after a job.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from puckline import schemas
from puckline.operators.boxscore import combine_boxscores, dedupe_boxscores
from puckline.operators.common import pick_first
from puckline.operators.maintenance import merge_rosters, merge_schedule
from puckline.operators.pbp import player_game_stats
from puckline.operators.quality import game_ledger, missing_in_ledger, name_postings, search_names
from puckline.operators.schedule import filter_game_types, recent_games, sample_games, with_days_rest
from puckline.session import materialize
from puckline.sources import landing, snapshots

EVENT_KEY = ["game_id", "event_id"]
PART = ["season", "part"]


def _part(date: Column) -> Column:
    """The part of a game table that holds a game: its month."""
    return F.coalesce(F.substring(date, 1, 7), F.lit("unknown"))


def _read(spark: SparkSession, out: str, table: str, schema: T.StructType, keys: set[str] | None = None) -> DataFrame:
    return snapshots.read(spark, f"{out}/{table}", schema, ("part",), keep=None if keys is None else keys.__contains__)


def read_table(spark: SparkSession, out: str, table: str, version: int | None = None) -> DataFrame:
    """A stored table, as of its newest or an older version; a score that is not known reads as 0."""
    df = snapshots.read(spark, f"{out}/{table}", schemas.TABLES[table], ("part",), version)
    return df.fillna(0, ["home_score", "away_score"]) if table == "schedule" else df


def current_roster(spark: SparkSession, out: str) -> DataFrame:
    """Players who are on a team's roster by the last copy that landed of it."""
    stays = snapshots.read(spark, f"{out}/roster_history", schemas.ROSTER_HISTORY)
    return stays.filter(F.col("valid_to").isNull()).drop("valid_from", "valid_to").withColumn("is_current", F.lit(True))


def roster_history(spark: SparkSession, out: str) -> DataFrame:
    """All stays, for ``roster_asof`` or as the roster of requests."""
    return snapshots.read(spark, f"{out}/roster_history", schemas.ROSTER_HISTORY)


# ----------------------------------------------------------------- landed documents

def _landed_at(docs: DataFrame, default: str | None) -> DataFrame:
    at = F.lit(default).cast("timestamp")
    return docs.withColumn("landed_at", F.coalesce(F.col("landed_at").cast("timestamp"), at) if "landed_at" in docs.columns else at)


def _set_aside(docs: DataFrame, schema, out: str, kind: str) -> None:
    """Add the documents that do not parse to the quarantine, each once."""
    spark, path = docs.sparkSession, f"{out}/quarantine/{kind}"
    bad = landing.unreadable(docs, schema).drop("landed_at").distinct()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        known = spark.read.schema(bad.schema).parquet(path)
        same = [bad[c].eqNullSafe(known[c]) for c in bad.columns]
        bad = materialize(bad.join(known, same, "left_anti"))
    bad.write.mode("append").parquet(path)


def _set_all_aside(out: str, *landed: tuple[DataFrame, T.StructType, str]) -> None:
    for docs, schema, kind in landed:
        if docs is not None:
            _set_aside(docs, schema, out, kind)


# ----------------------------------------------------------------- schedule

def _store_schedule(spark: SparkSession, landed: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """Merge landed schedule rows (nullable scores, ``landed_at``) into the
    stored seasons they touch.

    Returns those seasons' schedule and the games it moves or gives other rest
    days: (game_id, season, part, old_season, old_part)."""
    path, cols = f"{out}/schedule", schemas.SCHEDULE_MERGED
    before = snapshots.versions(spark, path)
    seasons = {r.season for r in landed.select("season").distinct().collect()}  # one value per season
    # A game that lands under another season leaves its old one.
    stray = _read(spark, out, "schedule", cols).join(landed.select("game_id").distinct(), "game_id", "left_semi")
    seasons |= {r.season for r in stray.select("season").distinct().collect()}
    keys = {snapshots.key_of(season=s) for s in seasons}
    merged = merge_schedule(_read(spark, out, "schedule", cols, keys), landed)
    snapshots.commit(spark, path, with_days_rest(merged).select(*cols.names), ["season"], keys, ["game_id"])
    sched = _read(spark, out, "schedule", cols, keys)
    old = (snapshots.read(spark, path, cols, version=before[-1], keep=keys.__contains__) if before
           else spark.createDataFrame([], cols))
    facts = ["season", "date", "home_days_rest", "away_days_rest"]
    was = old.select("game_id", F.struct(*facts).alias("was"))
    moved = sched.select("game_id", F.struct(*facts).alias("now")).join(was, "game_id").filter(F.col("now") != F.col("was"))
    return sched, moved.select("game_id", F.col("now.season").alias("season"), _part(F.col("now.date")).alias("part"),
                               F.col("was.season").alias("old_season"), _part(F.col("was.date")).alias("old_part"))


# ----------------------------------------------------------------- game tables

def _keys(parts: DataFrame) -> set[str]:
    """Folders of (season, part) rows: one per touched month, so few."""
    return {snapshots.key_of(season=r.season, part=r.part) for r in parts.distinct().collect()}


def _store_games(spark: SparkSession, out: str, sched: DataFrame, moved: DataFrame, games: DataFrame,
                 boxscores: DataFrame, pbp: DataFrame) -> set[str]:
    """Replace the raw rows of every one of ``games`` (game_id) whose documents
    landed, and rebuild the parts that hold a changed game; their folders."""
    place = sched.select("game_id", "season", _part(F.col("date")).alias("part"))
    landed = place.join(games.select("game_id").distinct(), "game_id", "left_semi")
    new = {"essential_boxscores": dedupe_boxscores(landing.flatten_boxscore(landing.newest_documents(boxscores)).join(landed, "game_id")),
           "raw_pbp_events": landing.flatten_pbp(landing.newest_documents(pbp)).join(landed, "game_id")}
    new["raw_pbp_events"] = pick_first(new["raw_pbp_events"], EVENT_KEY, [c for c in new["raw_pbp_events"].columns if c not in EVENT_KEY])
    # Parsed once, read by the merge and by the list of changed games.
    new = {t: materialize(rows) for t, rows in new.items()}
    moved = materialize(moved)
    touched = moved.select("season", "part").unionByName(moved.select(F.col("old_season").alias("season"), F.col("old_part").alias("part")))
    for rows in new.values():
        touched = touched.unionByName(rows.select("season", "part"))
    keys = _keys(touched)
    if not keys:
        return keys
    for table, rows in new.items():
        schema = schemas.TABLES[table]
        kept = _read(spark, out, table, schema, keys).join(rows.select("game_id").distinct(), "game_id", "left_anti")
        placed = kept.drop("season").join(place, "game_id")  # a moved game goes to its new part
        snapshots.commit(spark, f"{out}/{table}", placed.select(*schema.names, "part").unionByName(rows.select(*schema.names, "part")),
                         PART, keys, ["game_id"])
    _index_names(spark, out, new["essential_boxscores"])
    box, ev = (_read(spark, out, t, schemas.TABLES[t], keys) for t in new)
    final = combine_boxscores(box.drop("season"), player_game_stats(ev.drop("season")), sched).join(place, "game_id")
    snapshots.commit(spark, f"{out}/comprehensive_boxscores", final, PART, keys, ["game_id", "player_id"])
    ledger = game_ledger(box, ev).join(place.select("game_id", "part"), "game_id")
    snapshots.commit(spark, f"{out}/games", ledger, PART, keys, ["game_id"])
    return keys


def _index_names(spark: SparkSession, out: str, box: DataFrame) -> None:
    """Add the names that are new; a landing without any leaves the index as it is."""
    path, schema = f"{out}/player_names", schemas.NAME_POSTINGS
    known = snapshots.read(spark, path, schema)
    names = box.select("player_id", "player_name").distinct()
    fresh = materialize(names.join(known.filter("size = 0").select("player_id", "player_name"), ["player_id", "player_name"], "left_anti"))
    if not fresh.isEmpty():
        snapshots.commit(spark, path, known.unionByName(name_postings(fresh)), ["size"], order=["gram"])


def search_players(spark: SparkSession, out: str, text: str) -> DataFrame:
    """Players by a part of their name, from the stored index."""
    return search_names(snapshots.read(spark, f"{out}/player_names", schemas.NAME_POSTINGS), text)


# ----------------------------------------------------------------- rosters

def write_rosters(spark: SparkSession, rosters: DataFrame, out: str, season: int, landed_at: str | None = None) -> None:
    """Roster documents -> the season's roster and the history of stays, of the
    teams that landed; other teams stay as they are.  Documents without a
    ``landed_at`` count as landed then (by default now)."""
    docs = _landed_at(rosters, landed_at or _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))
    _set_aside(rosters, schemas.ROSTER_DOC, out, "rosters")
    good = docs.join(landing.unreadable(docs, schemas.ROSTER_DOC).select("team_abbrev", "doc").distinct(), ["team_abbrev", "doc"],
                     "left_anti").filter(F.col("doc").isNotNull())
    newest = materialize(landing.newest_documents(good, ["team_abbrev"]).select("team_abbrev", "doc", "landed_at"))
    listed = landing.flatten_roster(newest)
    listed = pick_first(listed, ["team_abbrev", "player_id"], ["full_player_name", "position_code", "headshot_url"])
    snapshot = landing.roster_snapshot(listed, season, True)
    snapshots.commit(spark, f"{out}/roster", snapshot.select(*schemas.TABLES["roster"].names), ["season", "team_abbrev"], order=["player_id"])
    landed = newest.select("team_abbrev", F.lit(season).cast("bigint").alias("season"), "landed_at")
    history = roster_history(spark, out)
    snapshots.commit(spark, f"{out}/roster_history", merge_rosters(history, landed, listed), ["team_abbrev"], order=["player_id"])


# ----------------------------------------------------------------- jobs

def backfill(spark: SparkSession, team_schedules: DataFrame, boxscores: DataFrame,
             pbp: DataFrame, out: str, game_types: Sequence[str] = ("R", "P"),
             as_of: _dt.date | str | None = None, rosters: DataFrame | None = None,
             roster_season: int | None = None, only_missing: bool = True,
             sample: int | None = None) -> DataFrame:
    """Landed schedule / boxscore / play-by-play documents -> stored tables.

    Played games only (dated before ``as_of``).  With ``only_missing`` games
    that already have both raw tables are left as they are, so a repeated
    backfill only does the rest; ``sample`` takes at most that many games, one
    per home team, for a trial run.  What a refresh has learned since (scores)
    stays: schedule documents without a ``landed_at`` are of unknown age."""
    as_of = str(as_of or _dt.date.today())
    _set_all_aside(out, (boxscores, schemas.BOXSCORE_DOC, "boxscore"), (pbp, schemas.PBP_DOC, "pbp"),
                   (team_schedules, schemas.SCHEDULE_DOC, "schedule"))
    listed = landing.flatten_schedule(_landed_at(team_schedules, None), ["landed_at"], None)
    sched, moved = _store_schedule(spark, filter_game_types(listed, game_types), out)
    if rosters is not None:
        write_rosters(spark, rosters, out, roster_season or sched.agg(F.max("season")).first()[0], as_of)
    games = sched.filter(F.col("date") < as_of)
    if sample:
        games = sample_games(games, as_of, sample)
    if only_missing:
        games = missing_in_ledger(games, _read(spark, out, "games", schemas.GAME_LEDGER), as_of)
    _store_games(spark, out, sched, moved, games.select("game_id"), boxscores, pbp)
    return read_table(spark, out, "comprehensive_boxscores")


def refresh(spark: SparkSession, scores: DataFrame, boxscores: DataFrame, pbp: DataFrame,
            out: str, as_of: _dt.date | str, days: int = 7,
            game_types: Sequence[str] = ("R", "P"), rosters: DataFrame | None = None,
            roster_season: int | None = None) -> DataFrame:
    """Re-ingest the finished games of the last ``days`` days: their scores go
    into the stored schedule, their documents replace the raw rows, and the
    parts that hold them are rebuilt; what that replaces stays in the older
    versions.  A game whose documents did not land keeps its rows.  Documents
    without a ``landed_at`` count as landed on ``as_of``."""
    _set_all_aside(out, (boxscores, schemas.BOXSCORE_DOC, "boxscore"), (pbp, schemas.PBP_DOC, "pbp"), (scores, schemas.SCORE_DOC, "scores"))
    feed = landing.flatten_scores(_landed_at(scores, str(as_of)), ["landed_at"])
    recent = filter_game_types(recent_games(feed, as_of, days, ["landed_at"]), game_types)
    sched, moved = _store_schedule(spark, recent, out)
    if rosters is not None:
        write_rosters(spark, rosters, out, roster_season or sched.agg(F.max("season")).first()[0], str(as_of))
    _store_games(spark, out, sched, moved, recent.select("game_id"), boxscores, pbp)
    return read_table(spark, out, "comprehensive_boxscores")


def backfill_landing(spark: SparkSession, folder: str, out: str, seasons: Sequence[int], game_types: Sequence[str] = ("R", "P"),
                     as_of: _dt.date | str | None = None, only_missing: bool = True, sample: int | None = None) -> DataFrame:
    """``backfill`` of a landing folder's seasons (see ``landing.read_landing``), rosters included."""
    docs = {kind: landing.read_landing(spark, folder, kind, seasons) for kind in ("schedule", "boxscores", "pbp")}
    out_rows = backfill(spark, docs["schedule"], docs["boxscores"], docs["pbp"], out, game_types, as_of,
                        only_missing=only_missing, sample=sample)
    for season in sorted(seasons):
        write_rosters(spark, landing.read_landing(spark, folder, "rosters", [season]).drop("season"), out, season)
    return out_rows


def refresh_landing(spark: SparkSession, folder: str, out: str, seasons: Sequence[int], as_of: _dt.date | str, days: int = 7,
                    game_types: Sequence[str] = ("R", "P")) -> DataFrame:
    """``refresh`` of a landing folder's seasons; the newest season's rosters too."""
    docs = {kind: landing.read_landing(spark, folder, kind, seasons) for kind in ("scores", "boxscores", "pbp")}
    rosters = landing.read_landing(spark, folder, "rosters", [max(seasons)]).drop("season")
    return refresh(spark, docs["scores"], docs["boxscores"], docs["pbp"], out, as_of, days, game_types, rosters, max(seasons))


__all__ = ["backfill", "backfill_landing", "current_roster", "read_table", "refresh", "refresh_landing", "roster_history", "search_players", "write_rosters"]
