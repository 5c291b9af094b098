import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from puckline.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=10, every=100):
    usable = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v, _ in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % every == 0:
            hits = [(max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False)))), i)
                    for i, b in usable if i != q]
            for rank, (score, i) in enumerate(sorted(hits, key=lambda h: (-h[0], h[1]))[:k], 1):
                out.append((q, rank, i, score))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, **options).collect())


def test_matches_brute_force_over_blocks_shards_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_BLOCKS", 2)
    monkeypatch.setattr(topk, "CHUNK", 3)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(scale=0.1, size=8)).tolist(), 0) for i in range(1500)]
    assert run(spark, rows) == brute(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [nan, 1.0], 1), (400, [inf, 1.0], 1),
            (None, [1.0, 1.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [], 1), (500, [0.5], 1),
            (4, [-1.0, 0.0, 7.0], 1), (-100, [1e300, -1e300], 1)]
    assert run(spark, rows) == brute(rows)


def test_many_ties_go_to_small_ids(spark):
    rows = [(i, [0.25, -0.5], 0) for i in range(700)]
    assert run(spark, rows) == brute(rows)


def test_no_rows_and_no_queries(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 0), (2, [1.0], 0)]) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-50, 50), min_size=3, max_size=3), min_size=1, max_size=60),
       st.lists(st.integers(-50, 50), min_size=3, max_size=3))
def test_pruning_loses_nothing(vectors, query):
    ids = np.arange(len(vectors), dtype=np.int64)
    blocks = []
    for at in range(0, len(vectors), 4):
        forward = np.array(vectors[at:at + 4], dtype=float)
        blocks.append({"ids": ids[at:at + 4], "forward": forward, "most": forward.max(axis=0), "least": forward.min(axis=0)})
    best, found, _ = topk.search_shard(np.array([query], dtype=float), np.array([-1]), np.array([topk.LONG.min]), blocks, 3)
    scores = (np.array(vectors) @ np.array(query)).tolist()
    want = sorted(zip(scores, ids.tolist(), strict=True), key=lambda x: (-x[0], x[1]))[:3]
    assert list(zip(best[0].tolist(), found[0].tolist(), strict=True)) == want


def test_clustered_blocks_are_pruned():
    blocks = []
    for b in range(50):
        forward = np.full((4, 2), float(b))
        blocks.append({"ids": np.arange(4 * b, 4 * b + 4), "forward": forward, "most": forward[0], "least": forward[0]})
    *_, scored = topk.search_shard(np.array([[1.0, 1.0]]), np.array([-1]), np.array([topk.LONG.min]), blocks, 4)
    assert scored == 1
