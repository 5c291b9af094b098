"""Operator 3, mixing sources to target weights: Efraimidis-Spirakis sampling.

Each document draws an exponential key, -ln(u) / w, with u from a hash of the
document and w its quality weight; a source's documents are taken in key order
until their words reach the source's budget.  Whole epochs come first: a
target of 1.4 times a source takes every document once and then the first 0.4
of the words in key order.  The running sums are taken over key ranges: words
per range are summed first, and only the range in which the budget ends is
sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from puckline.llm.common import ROWS_PER_CELL, Stages, null_safe_join, text_hashes

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 64


def quality_weight(chars: F.Column, size: F.Column) -> F.Column:
    """Weight in (0, 1] from the mean word length: prose lies near 6 characters."""
    return F.when(size > 0, 1.0 / (1.0 + F.abs(chars.cast("double") / size - 6.0))).otherwise(1.0)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, n) -> the same with ``target``.

    Sources weigh ``weights`` in turn by code point, null last, and share
    ``share`` times all words; a target stops at ``most`` times its source's
    words and the excess goes to the others by weight.  With the sources
    ordered by size per weight, those that stop form a prefix, so one running
    sum finds the level of the rest.  One row per source, in one task.
    """
    first = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn(
        "w", F.element_at(cycle, ((F.row_number().over(first) - 1) % len(weights) + 1).cast("int")))
    by_level = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    summed = weighed.select(
        "*", F.sum("source_size").over(everything).alias("_all"), F.sum("w").over(everything).alias("_w"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("_below"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("_w_below"))
    # The level if every source before this one stops at its most.
    level = (F.lit(share) * F.col("_all") - F.lit(most) * F.col("_below")) / (F.col("_w") - F.col("_w_below"))
    levelled = summed.withColumn("_level", level)
    open_level = F.min(F.when(F.col("_level") * F.col("w") <= F.lit(most) * F.col("source_size"), F.struct(
        (F.col("source_size") / F.col("w")).alias("at"), F.col("_level").alias("level")))).over(everything)
    return levelled.withColumn("_open", open_level).select(
        "source", "source_size", "n",
        F.when(F.col("_open").isNull(), F.lit(most) * F.col("source_size"))
        .otherwise(F.least(F.lit(most) * F.col("source_size"), F.col("_open.level") * F.col("w")))
        .cast("double").alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        seed: str = "mix") -> DataFrame:
    """How many words a mix takes of every row of ``docs`` (doc_id, text, source).

    Returns doc_id, source, size (words; null and empty texts have none),
    source_size, target, times (epochs that the document is in), taken (``size``
    times ``times``) and the text's hashes h1 and h2.  The last document of a source is taken if at least half
    of it fits, so a source misses its target by half a document at most.
    Keys depend on seed, id and size only, so reruns agree; equal rows are
    interchangeable, and each counts.  A null source is a source of its own;
    an empty table gives an empty result.
    """
    st = Stages(docs.sparkSession, "mix")
    measured = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"), *text_hashes("text"))
    seeded = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"))
    u = (F.conv(F.substring(F.sha2(seeded, 256), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    rows = st.put(measured.select(
        "doc_id", "source", "size", "h1", "h2", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).alias("salt"),
        (-F.log(u) / quality_weight(F.col("chars"), F.col("size"))).alias("key")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    budget = st.put(source_targets(sizes, weights, share, most).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("epochs"),
        F.ceil(F.col("n") / ROWS_PER_CELL).alias("ranges"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    # A hot source's rows are spread by salt; the table of sources is repeated for each salt.
    salted = budget.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    dealt = st.put(null_safe_join(rows, salted, ["source", "salt"])
                   .withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * F.col("ranges"))))
    cells = dealt.groupBy("source", "range").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("source", "range", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("start"),
                          F.col("words").alias("range_words"))
    salted_starts = starts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    placed = null_safe_join(dealt, salted_starts, ["source", "range", "salt"])
    ends_here = (F.col("start") < F.col("rest")) & (F.col("start") + F.col("range_words") >= F.col("rest"))
    run = (Window.partitionBy("source").orderBy("key", "doc_id", "size")
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = placed.where(ends_here).withColumn(
        "more", (F.col("start") + F.sum("size").over(run) - F.col("size") / 2.0 <= F.col("rest")).cast("long"))
    others = placed.where(~ends_here).withColumn("more", (F.col("start") < F.col("rest")).cast("long"))
    times = (F.col("epochs") + F.col("more")).cast("long")
    return last.unionByName(others).select(
        "doc_id", "source", "size", "source_size", "target", times.alias("times"),
        (F.col("size") * times).cast("long").alias("taken"), "h1", "h2")


def materialise(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: every document of ``docs`` as often as ``mixed`` takes it.

    Rows that share doc_id, source and text are taken as often as all of them
    together.
    """
    key = ["doc_id", "source", "h1", "h2"]
    times = mixed.groupBy(*key).agg(F.sum("times").alias("times")).where("times > 0")
    hashed = docs.select("doc_id", "source", *text_hashes("text"), F.struct("*").alias("row"))
    one = null_safe_join(hashed, times, key).dropDuplicates(key)
    return one.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(length(text), 0) AS chars FROM documents
), k AS (
  SELECT *, -ln((('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, 13))::BIGINT
             + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
         / (CASE WHEN size > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + abs(chars::DOUBLE / size - 6.0::DOUBLE))
            ELSE 1.0::DOUBLE END) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([3.0::DOUBLE, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT arg_min(level, source_size / w) AS level FROM l WHERE level * w <= 2.0::DOUBLE * source_size
), t AS (
  SELECT l.source, source_size,
         CASE WHEN o.level IS NULL THEN 2.0::DOUBLE * source_size
              ELSE least(2.0::DOUBLE * source_size, o.level * w) END AS target
  FROM l, o
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0::DOUBLE
                 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
"""
