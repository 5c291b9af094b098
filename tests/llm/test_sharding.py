import zlib
from collections import Counter

import pytest

from puckline.llm import sharding
from tests.llm.conftest import AWKWARD


def check(rows, texts, shards):
    n = len(rows)
    assert n == len(texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    per = Counter(r.shard for r in rows)
    assert all(0 <= s < shards for s in per)
    assert {per.get(s, 0) for s in range(shards)} <= {n // shards, -(-n // shards)}
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)


def together(rows):
    """Groups of equal texts, and how many of them lie in one shard."""
    groups = {}
    for r in rows:
        groups.setdefault((r.size, r.text_crc32), []).append(r.shard)
    several = [g for g in groups.values() if len(g) > 1]
    return len(several), sum(len(set(g)) == 1 for g in several)


@pytest.mark.parametrize("cell", [20_000, 5])
def test_linked_documents_meet_in_even_shards(spark, monkeypatch, cell):
    from puckline.llm import common

    monkeypatch.setattr(common, "ROWS_PER_CELL", cell)
    texts = [(i, f"text {i // 3}" if i < 120 else f"alone {i}") for i in range(403)]
    rows = sharding.shard_documents(spark.createDataFrame(texts, "doc_id long, text string"), shards=8).collect()
    check(rows, texts, 8)
    groups, whole = together(rows)
    assert groups == 40 and whole >= 38


def test_everything_linked_and_one_hot_group(spark):
    texts = [(i, "hot" if i % 3 == 0 else f"pair {i // 6}") for i in range(600)]
    rows = sharding.shard_documents(spark.createDataFrame(texts, "doc_id long, text string"), shards=10).collect()
    check(rows, texts, 10)
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"hot")}) <= 8
    groups, whole = together(rows)
    assert whole >= 0.6 * groups


@pytest.mark.parametrize("cell", [20_000, 50])
def test_a_group_of_a_third_of_all_rows_fills_as_few_shards_as_it_needs(spark, monkeypatch, cell):
    from puckline.llm import common

    monkeypatch.setattr(common, "ROWS_PER_CELL", cell)
    texts = [(i, "hot" if i % 3 == 0 else f"few {i // 9}") for i in range(2400)]
    rows = sharding.shard_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check(rows, texts, 40)
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"hot")}) <= 14
    groups, whole = together(rows)
    assert whole >= 0.8 * groups


def test_awkward_documents(spark, awkward, no_documents):
    rows = sharding.shard_documents(awkward, shards=4).collect()
    check(rows, [(r[0], r[1]) for r in AWKWARD], 4)
    rows = sharding.shard_documents(awkward).collect()
    check(rows, [(r[0], r[1]) for r in AWKWARD], 40)
    assert sharding.shard_documents(no_documents).collect() == []


def test_plan_is_native(spark, documents):
    plan = sharding.shard_documents(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
