import random
import re

import numpy as np
import pytest

from puckline.llm import neardup
from tests.llm.conftest import AWKWARD, DOCUMENTS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """Rows as (doc_id, n_shingles, component_id, kept), null ids after all others."""
    sets = [plain_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out = []
    for i, r in enumerate(rows):
        component = least.get(find(i)) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), component, r[0] == component))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in neardup.near_duplicates(df)
                   .select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("block", [2_000, 8])
def test_chains_and_large_groups_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "CELL", block)
    rng = random.Random(3)
    rows = []
    for group in range(4):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(150)]
        for k in range(60):  # copies, edits of the base, and chains of edits
            words = edited(rng, base, k % 9)
            if k % 10 == 9:
                base = words
            rows.append((None if k == 30 else 1000 * group + rng.randrange(1000), " ".join(words)))
    rows += [(10_000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rng.shuffle(rows)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert run(documents) == brute(rows)


def test_awkward_documents(spark, awkward, no_documents):
    assert run(awkward) == brute(AWKWARD)
    assert run(no_documents) == []
    kept = neardup.keep_one(awkward)
    assert kept.columns == awkward.columns
    # Null or empty texts, each short text, and one of the six "cat" rows; the two rows without an id share no text.
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "5", "6", "7", "-8", "None"])


def test_one_row_of_each_component_whatever_its_ids(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words[:k]) for k in (60, 59, 58)]
    other = [" ".join(reversed(words[:k])) for k in (60, 59)]
    cases = [
        [(None, near[0]), (None, near[1]), (None, near[2]), (None, other[0]), (None, other[1])],
        [(5, near[0]), (5, near[1]), (5, other[0]), (5, other[1]), (5, near[1])],
        [(None, near[0]), (7, near[1]), (7, near[2]), (9, other[0]), (None, other[1])],
    ]
    for rows in cases:
        df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCUMENTS)
        out = [tuple(r)[:2] for r in neardup.keep_one(df).collect()]
        assert len(out) == 2 and set(out) <= set(rows)
        assert {t.split()[0] for _, t in out} == {"w0", other[0].split()[0]} or len({t in near for _, t in out}) == 2
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == [7, 9]


def test_threshold_is_exact():
    a = np.arange(100, dtype=np.uint64)
    assert neardup.is_link(a, a[:75]) and not neardup.is_link(a, a[:74])
    b = np.arange(12, 112, dtype=np.uint64)  # 88 shared of 112: 0.786
    assert neardup.is_link(a, b) and not neardup.is_link(a, b + np.uint64(3))  # 85 of 115: 0.739
    assert not neardup.is_link(a[:0], a[:0])


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    worst = 0.0
    for shared in (60, 75, 90):
        a = rng.integers(0, 2**63, 1_000, dtype=np.uint64)
        n = round(1_000 * 2 * shared / (100 + shared))
        b = np.unique(np.concatenate([a[:n], rng.integers(0, 2**63, 1_000 - n, dtype=np.uint64)]))
        x, y = (neardup.odd_sketch(neardup.samples(np.unique(s))).view(np.uint64) for s in (a, b))
        z = int(np.bitwise_count(x ^ y).sum())
        apart = np.log(1 - 2 * z / neardup.BITS) / np.log(1 - 2 / neardup.BITS)
        worst = max(worst, abs(1 - apart / (2 * neardup.SAMPLES) - shared / 100))
    assert worst < 0.1


def test_components_of_long_paths(spark):
    from puckline.llm.common import Stages

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300), (7, 7)] + [(500, 500 + i) for i in range(1, 50)]
    got = dict(tuple(r) for r in neardup.components(
        Stages(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100} | {500 + i: 500 for i in range(1, 50)}


def test_equal_sets_and_docs_of_a_hot_group(spark):
    rows = [(i, "one two three four five six seven", "en", "s", 1) for i in range(500)] + [(900, "eight", "en", "s", 1)]
    got = run(spark.createDataFrame(rows, DOCUMENTS))
    assert sum(r[3] for r in got) == 2 and {r[2] for r in got} == {0, 900}
