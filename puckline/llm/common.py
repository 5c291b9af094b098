"""Helpers shared by the operators: staged tables, row numbers, folds."""

from __future__ import annotations

import tempfile
import zipfile
from functools import reduce
from pathlib import Path

import puckline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from puckline.session import shared_dir

_shipped: set[str] = set()

#: Rows that one window partition of ``numbered`` holds on average at most.
ROWS_PER_CELL = 20_000


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(puckline.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="puckline-")) / "puckline_modules.zip"
    with zipfile.ZipFile(target, "w") as out:
        for module in sorted(root.rglob("*.py")):
            out.write(module, module.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


class Stages:
    """Intermediate tables of one operator call, written under the shared
    folder.  A table is written once and read by every later step, so no step
    is recomputed differently after an executor is lost and no lineage grows.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = shared_dir(spark, name)
        self.n = 0

    def put(self, df: DataFrame, *partition_by: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete staged tables that no later step and no result reads."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._stage_path)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null for a null id)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % n


def text_hashes(column: str) -> list[Column]:
    """h1 and h2: 96 bits that stand for a text in joins (a null text is an empty one)."""
    text = F.coalesce(F.col(column), F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.hash(text).alias("h2")]


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; keys appear once."""
    renamed = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def numbered(df: DataFrame, rows: int, by: list[str], level: str | None, group: str,
             order: list[str], out: str) -> DataFrame:
    """Gapless numbers from 0 within each ``by`` group, without sorting a whole
    group in one task.

    Rows come by ``level`` (ascending), then by a hash of ``group``, then by
    ``order``.  Rows of a (by, level) cell are dealt into as many hash buckets
    as the table needs for ``ROWS_PER_CELL`` rows each; bucket sizes are
    counted first, their running sums are the offsets, and only the rows of
    one bucket are numbered by a window.  Rows that share ``group`` stay in
    one bucket, so they get adjacent numbers; ``by`` and ``level`` must not be
    null.  ``df`` must be a staged table or a deterministic plan over one.
    """
    buckets = max(1, -(-rows // ROWS_PER_CELL))
    levels = [level] if level else []
    keyed = df.withColumn("_b", F.pmod(F.xxhash64(F.col(group)), F.lit(buckets)))
    cells = keyed.groupBy(*by, *levels, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(*levels, "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*by, *levels, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, *levels, "_b").orderBy(group, *order)
    return (keyed.join(offsets, [*by, *levels, "_b"])
            .withColumn(out, (F.row_number().over(inside) - 1 + F.col("_off")).cast("long"))
            .drop("_b", "_off"))


def labelled_sample(labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, label) of at most ``per_class`` labelled rows of each class.

    Rows without an id or a label, and ids whose fold is ``held_out``, are left
    out; an id with both labels counts as 1.  The rows with the smallest hashes
    of their ids are taken, so the sample does not depend on the layout.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", folds) != held_out))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    parts = [one.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1])
