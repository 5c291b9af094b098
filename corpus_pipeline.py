"""The corpus pipeline: documents through the operators of puckline.llm, stage by stage.

Every stage takes all that the one before it kept.  All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from puckline.llm import decontaminate, langid, mixing, neardup, sharding
from puckline.llm.common import Stages, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text that is this far from every profile is no text in any learned language.
LEAST_SCORE = 0.2


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents without a letter, or near no language's profile, go."""
    found = langid.identify(docs, keep=COLUMNS[1:])
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each component of near-duplicates, the document with the smallest id stays."""
    return neardup.keep_one(docs.select(*COLUMNS))


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a window of a benchmark item go."""
    found = decontaminate.find_benchmark_words(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:])
    return found.where(F.size("spans") == 0).select("doc_id", *[F.col(f"carried_{c}").alias(c) for c in COLUMNS[1:]])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents as often as the mix takes them; one that it leaves out goes."""
    rows = docs.select(*COLUMNS)
    return mixing.materialise(rows, mixing.mix(rows))


def share_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every row that is left gets a shard and a slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_texts),
    ("mix", mix_sources),
    ("shard", share_out),
]

#: Language profiles and MinHash links have no SQL; tests/llm checks each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    st = Stages(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = st.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
