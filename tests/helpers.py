"""Small helpers for golden fixtures."""

from __future__ import annotations

from pyspark.sql import types as T

from puckline.schemas import PBP_RAW


def pbp_rows(spark, rows: list[dict]):
    """Play-by-play rows with the raw schema; missing fields are null."""
    names = [f.name for f in PBP_RAW.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], PBP_RAW)


def df(spark, rows, schema: str):
    return spark.createDataFrame(rows, schema)


def as_dicts(frame, key=None):
    out = [r.asDict() for r in frame.collect()]
    return sorted(out, key=key) if key else out


STRING = T.StringType()
