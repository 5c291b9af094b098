"""Incremental raw-table ingestion from a landing folder.

Landed documents arrive as JSON-lines files (``game_id``, ``season``, ``doc``,
``landed_at``) under ``<landing>/<kind>/``.  A file stream with ``trigger(availableNow=True)``
picks up every file not yet processed, flattens it (``sources.landing``) and
merges it into the season-partitioned raw table: the newest document of a game
replaces its rows, so a game fetched twice is stored once.  The checkpoint records processed
files, so a restarted job (lost driver or executors) resumes without double
ingestion; each micro-batch rewrites only the seasons it touches, through a
staging folder.

This is the streaming form of the refresh step; the reference polls an API
for the last N days instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from puckline import schemas
from puckline.operators.common import pick_first
from puckline.operators.maintenance import upsert_games
from puckline.session import shared_dir
from puckline.sources import landing, storage

ENVELOPE = "game_id bigint, season bigint, doc string, landed_at timestamp"

KINDS = {
    "boxscore": (landing.flatten_boxscore, ["game_id", "player_id"], "essential_boxscores"),
    "pbp": (landing.flatten_pbp, ["game_id", "event_id"], "raw_pbp_events"),
}


def merge_batch(batch: DataFrame, kind: str, table_path: str) -> None:
    """Flatten one micro-batch of documents and merge it into ``table_path``;
    of several copies of a game's document the last landed one counts."""
    spark = batch.sparkSession
    flatten, keys, table = KINDS[kind]
    newest = landing.newest_documents(batch)
    rows = flatten(newest.select("game_id", "doc")).join(newest.select("game_id", "season"), "game_id")
    rows = pick_first(rows, keys, [c for c in rows.columns if c not in keys]).select(*schemas.TABLES[table].names)
    touched = rows.select("season").distinct()
    stored = storage.scan_all_seasons(spark, table_path, schema=schemas.TABLES[table]).join(
        touched, "season", "left_semi").select(*rows.columns)
    path = shared_dir(spark, f"{kind}-batch")
    storage.write_seasons(storage.stage(upsert_games(stored, rows), path), table_path)
    storage.drop(spark, path)


def ingest(spark: SparkSession, landing_dir: str, kind: str, table_path: str, checkpoint: str) -> None:
    """Process every landed ``kind`` document not seen before, then stop.
    ``checkpoint`` (on shared storage) remembers what was seen: use the same
    one for every call."""
    stream = spark.readStream.schema(ENVELOPE).json(f"{landing_dir.rstrip('/')}/{kind}")
    q = (stream.writeStream.trigger(availableNow=True)
         .option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, _id: merge_batch(df, kind, table_path))
         .start())
    q.awaitTermination()


def land(docs: DataFrame, landing_dir: str, kind: str) -> None:
    """Append landed documents (game_id, season, doc) as JSON-lines files."""
    landed_at = F.col("landed_at") if "landed_at" in docs.columns else F.current_timestamp()
    docs.select("game_id", F.col("season").cast("bigint"), "doc", landed_at.alias("landed_at")).write.mode("append").json(
        f"{landing_dir.rstrip('/')}/{kind}")
