"""Versioned tables: partition files under a snapshot id, a manifest, an atomic switch.

A table is a folder with

* ``data/snapshot=<id>/<partition folders>/``: files that are written once and
  never changed;
* ``manifests/<version>.json``: which snapshot holds each live partition.

A commit writes the partitions it replaces under a new snapshot id and then
publishes the next manifest by one rename that fails if the name is taken.
Readers resolve the newest manifest once, so they see the old or the new table
and never a mixture, also while a later commit runs; a writer that dies leaves
files that no manifest names.  Older manifests are the table's history (and its
archive) until ``expire`` removes them.

A manifest has one entry per partition (seasons, months, teams), which is what
the driver holds; rows never pass through it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Manifest = dict[str, str]


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str, folders: bool) -> list[str]:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() == folders)


def versions(spark: SparkSession, table: str) -> list[int]:
    """Published versions, oldest first."""
    return [int(n[:-5]) for n in _names(spark, f"{table}/manifests", False) if n.endswith(".json") and not n.startswith(".")]


def is_table(spark: SparkSession, table: str) -> bool:
    p, fs = _path(spark, f"{table}/manifests")
    return fs.exists(p)


def manifest(spark: SparkSession, table: str, version: int | None = None) -> Manifest:
    """Partition folder -> snapshot id of a version (the newest one; none yet: empty)."""
    known = versions(spark, table)
    if version is None and not known:
        return {}
    version = known[-1] if version is None else version
    lines = spark.read.option("wholetext", True).text(f"{table}/manifests/{version:012d}.json").first()
    return json.loads(lines.value)


def _publish(spark: SparkSession, table: str, version: int, live: Manifest) -> None:
    """Make ``live`` the table's version; an error if another writer has published it."""
    folder = f"{table}/manifests"
    draft, fs = _path(spark, f"{folder}/.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(live, sort_keys=True).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    none = jvm.java.lang.reflect.Array.newInstance(rename, 0)
    context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{folder}/{version:012d}.json"), none)


def _written(spark: SparkSession, folder: str, depth: int) -> list[str]:
    """Partition folders below a snapshot."""
    if depth == 0:
        return [""]
    return [f"{name}/{rest}".rstrip("/") for name in _names(spark, folder, True) if "=" in name
            for rest in _written(spark, f"{folder}/{name}", depth - 1)]


def key_of(**values) -> str:
    """The folder of a partition, as ``partitionBy`` names it."""
    return "/".join(f"{k}={v}" for k, v in values.items())


def commit(spark: SparkSession, table: str, rows: DataFrame, partition_by: Sequence[str],
           replaced: Iterable[str] = (), order: Sequence[str] = ()) -> int:
    """Replace the partitions that ``rows`` holds, and those named in
    ``replaced`` (which go if ``rows`` holds nothing of them); the version.

    ``rows`` may be derived from the table itself: the files it reads stay.
    One write; a rebalance by partition lets AQE make files of a good size."""
    before = versions(spark, table)
    live = manifest(spark, table)
    snapshot = uuid.uuid4().hex
    folder = f"{table}/data/snapshot={snapshot}"
    by = [F.col(c) for c in partition_by]
    (rows.hint("rebalance", *by).sortWithinPartitions(*partition_by, *order)
     .write.partitionBy(*partition_by).parquet(folder))
    new = _written(spark, folder, len(partition_by))
    live = {k: s for k, s in live.items() if k not in set(replaced)} | dict.fromkeys(new, snapshot)
    version = before[-1] + 1 if before else 1
    _publish(spark, table, version, live)
    return version


def read(spark: SparkSession, table: str, schema: T.StructType, partition_by: Sequence[str] = (),
         version: int | None = None, keep: Callable[[str], bool] | None = None) -> DataFrame:
    """The rows of one version; ``keep`` chooses partitions by their folder.

    ``schema`` lists the columns wanted; ``partition_by`` names partition columns
    that are not among them.  A table without a version, or a partition, has no rows."""
    live = manifest(spark, table, version)
    paths = [f"{table}/data/snapshot={s}/{k}" for k, s in sorted(live.items()) if keep is None or keep(k)]
    if not paths:
        return spark.createDataFrame([], schema)
    hidden = [T.StructField(c, T.StringType()) for c in ("snapshot", *partition_by) if c not in schema.names]
    full = T.StructType([*schema.fields, *hidden])
    return spark.read.schema(full).option("basePath", f"{table}/data").parquet(*paths).select(*schema.names)


def changed(spark: SparkSession, table: str, old: int, new: int) -> set[str]:
    """Partition folders whose files differ between two versions."""
    a, b = manifest(spark, table, old), manifest(spark, table, new)
    return {k for k in a.keys() | b.keys() if a.get(k) != b.get(k)}


def expire(spark: SparkSession, table: str, keep: int = 1) -> None:
    """Forget all but the ``keep`` newest versions and delete snapshots that none of
    them names (also those that a dead writer left).  No commit may run meanwhile."""
    known = versions(spark, table)
    if not known:
        return
    kept = known[-keep:]
    used = {s for v in kept for s in manifest(spark, table, v).values()}
    for v in known[:-keep]:
        p, fs = _path(spark, f"{table}/manifests/{v:012d}.json")
        fs.delete(p, False)
    for name in _names(spark, f"{table}/data", True):
        if name.removeprefix("snapshot=") not in used:
            p, fs = _path(spark, f"{table}/data/{name}")
            fs.delete(p, True)
