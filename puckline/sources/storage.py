"""Season-partitioned Parquet storage.

Tables are written with ``partitionBy("season")`` and dynamic partition
overwrite, so a job replaces only the seasons present in its output and reads
prune partitions (``PartitionFilters``) by season.  Tables of the warehouse
are read with the explicit schemas of ``puckline.schemas``: an empty or not
yet written table reads as no rows, and the season stays a bigint.  A result
that depends on the table it replaces is first written to a staging folder
(Spark cannot overwrite files it is still reading), then copied over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from puckline.operators.common import pick_first
from puckline.sources import snapshots


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop_path(spark, path)
    return fs.exists(p)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a staging folder that nothing reads any more."""
    p, fs = _hadoop_path(spark, path)
    fs.delete(p, True)


def scan_all_seasons(spark: SparkSession, path: str, seasons: Sequence[int] | None = None,
                     schema: T.StructType | None = None) -> DataFrame:
    """All season partitions of a table as one DataFrame (optionally pruned).
    With a schema, a table that does not exist yet reads as no rows.  Of a
    versioned table (``snapshots``) the newest version is read."""
    if snapshots.is_table(spark, path):
        return _newest_version(spark, path, seasons, schema)
    if schema is not None and not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", path)
    df = (reader.schema(schema) if schema is not None else reader).parquet(path)
    if seasons:
        df = df.filter(F.col("season").isin(list(seasons)))
    return df.withColumn("season", F.col("season").cast("bigint")) if "season" in df.columns else df


def _newest_version(spark: SparkSession, path: str, seasons: Sequence[int] | None, schema: T.StructType | None) -> DataFrame:
    wanted = None if seasons is None else {snapshots.key_of(season=s) for s in seasons}

    def keep(key: str) -> bool:
        return wanted is None or key.split("/")[0] in wanted

    if schema is not None:
        return snapshots.read(spark, path, schema, ("part",), keep=keep)
    live = snapshots.manifest(spark, path)
    paths = [f"{path}/data/snapshot={s}/{k}" for k, s in sorted(live.items()) if keep(k)]
    df = spark.read.option("basePath", f"{path}/data").parquet(*paths).drop("snapshot", "part")
    return df.withColumn("season", F.col("season").cast("bigint")) if "season" in df.columns else df


SCHEDULE_VIEW = ["game_id", "date", "season", "game_type", "home_abbrev", "away_abbrev",
                 "home_score", "away_score", "start_time", "venue"]


def scan_schedule_projected(schedule: DataFrame) -> DataFrame:
    """The dashboard's schedule view: ten columns, one row per game."""
    cols = SCHEDULE_VIEW
    return pick_first(schedule.select(*cols), ["game_id"], cols[1:])


def write_seasons(df: DataFrame, path: str) -> None:
    """Write (or replace) the season partitions present in ``df``.

    A rebalance by season lets AQE make files of a good size (a large season
    gets several, small ones are not scattered over all tasks); rows are
    ordered by the table's key inside each file (no global sort)."""
    key = [c for c in ("game_id", "player_id", "event_id") if c in df.columns]
    (df.hint("rebalance", F.col("season")).sortWithinPartitions("season", *key)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path))


def stage(df: DataFrame, path: str) -> DataFrame:
    """Materialise ``df`` at ``path`` and return a DataFrame reading it back.
    Cuts the lineage; a lost executor re-reads files instead of recomputing."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def archive_and_replace(new_rows: DataFrame, path: str, archive_path: str, staging_path: str,
                        snapshot_ts: str) -> DataFrame:
    """Replace the seasons present in ``new_rows`` at ``path``; the rows they
    replace are first kept at ``archive_path`` under ``snapshot_ts=...`` (a
    repeated call with the same stamp writes the same partitions again).
    Returns the archived rows (read back)."""
    spark = new_rows.sparkSession
    schema = T.StructType([*(f for f in new_rows.schema.fields if f.name != "season"),
                           T.StructField("season", T.LongType(), True)])
    staged = stage(new_rows, staging_path)
    touched = staged.select("season").distinct()
    current = scan_all_seasons(spark, path, schema=schema).join(touched, "season", "left_semi")
    archived = T.StructType([*schema.fields, T.StructField("snapshot_ts", T.StringType(), True)])
    first_try = scan_all_seasons(spark, archive_path, schema=archived).filter(
        F.col("snapshot_ts") == snapshot_ts).limit(1).count() == 0
    if first_try:  # a retry must not archive what its first try has written
        (current.withColumn("snapshot_ts", F.lit(snapshot_ts)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_ts", "season").parquet(archive_path))
    write_seasons(staged, path)
    drop(spark, staging_path)
    return (scan_all_seasons(spark, archive_path, schema=archived)
            .filter(F.col("snapshot_ts") == snapshot_ts).select(*new_rows.columns))
