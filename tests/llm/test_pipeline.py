from collections import Counter

import pytest

import corpus_pipeline as cp
from puckline.llm.common import Stages
from tests.llm import test_decontaminate, test_langid, test_neardup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output, by name."""
    st, out = Stages(spark, "test"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        after = st.put(stage(spark, docs, SF))
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    return out


def test_stages_are_in_order(stages):
    assert list(stages) == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]
    for name in list(stages)[:-1]:
        assert stages[name][2] == list(cp.COLUMNS)


def test_language_stage(stages):
    from puckline.llm import langid

    before, after, _ = stages["language_id"]
    profiles = test_langid.plain_profiles([(r.doc_id, r.text, r.lang) for r in before], langid.PROFILE)
    want = []
    for r in before:
        lang, score = test_langid.plain_prediction(r.text, profiles, langid.PROFILE)
        if lang != "und" and score >= cp.LEAST_SCORE:
            want.append(r)
    assert Counter(want) == Counter(after)


def test_dedup_stage(stages):
    before, after, _ = stages["near_dedup"]
    kept = {r[0] for r in test_neardup.brute([(r.doc_id, r.text) for r in before]) if r[3]}
    assert Counter(after) == Counter(r for r in before if r.doc_id in kept)


def test_benchmark_stage(spark, stages):
    before, after, _ = stages["decontaminate"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r[0] for r in test_decontaminate.brute([(r.doc_id, r.text) for r in before], bench) if r[5]}
    assert dirty and Counter(after) == Counter(r for r in before if r.doc_id not in dirty)


def test_mix_stage(spark, stages):
    from puckline.llm import mixing

    before, after, _ = stages["mix"]
    times = {r.doc_id: r.times for r in mixing.mix(spark.createDataFrame(before, ", ".join(
        ["doc_id long", "text string", "lang string", "source string", "n_chars long"]))).collect()}
    want = Counter()
    for r in before:
        want[r] += times[r.doc_id]
    assert Counter(after) == +want


def test_shard_stage(stages):
    from tests.llm import test_sharding

    before, after, _ = stages["shard"]
    test_sharding.check(after, [(r.doc_id, r.text) for r in before], 40)


def test_run_is_the_stages_one_after_the_other(spark, stages):
    got = cp.run(spark, SF)
    assert got.columns == stages["shard"][2]
    assert Counter((r.doc_id, r.size) for r in got.collect()) == Counter((r.doc_id, r.size) for r in stages["shard"][1])


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_take_awkward_and_empty_tables(spark, awkward, no_documents, name):
    stage = dict(cp.STAGES)[name]
    rows = stage(spark, awkward, SF)
    assert rows.count() <= (2 if name == "mix" else 1) * awkward.count()
    assert stage(spark, no_documents, SF).count() == 0
