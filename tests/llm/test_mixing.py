import re

import duckdb
import pytest

from puckline.llm import mixing
from tests.llm.conftest import AWKWARD, DOCUMENTS


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "source", "size", "source_size", "target", "times", "taken").collect()),
                  key=str)


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 100, 1), ("b", 1000, 1), ("c", 400, 1), (None, 0, 1)],
                                  "source string, source_size long, n long")
    got = {r.source: r.target for r in mixing.source_targets(sizes, (3, 1, 2), 1.5, 2.0).collect()}
    # 2,250 words by weights 3, 1, 2, 3: a stops at 200 and the null source at 0; b and c share 2,050,
    # c stops at 800, b gets the rest.
    assert got == {"a": 200.0, "c": 800.0, None: 0.0, "b": 1250.0}


def test_awkward_documents(spark, awkward, no_documents):
    got = rows(mixing.mix(awkward))
    assert len(got) == len(AWKWARD)
    assert all(r[2] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for r, t in
               zip(sorted(got, key=lambda r: str((r[0], r[1], r[2]))),
                   [x[1] for x in sorted(AWKWARD, key=lambda x: str((x[0], x[3], len((x[1] or "").split()))))], strict=True))
    assert all(0 <= r[6] <= 2 * r[2] for r in got)
    assert mixing.mix(no_documents).collect() == []


@pytest.mark.parametrize("cell", [20_000, 7])
def test_sums_are_near_targets_and_reruns_agree(spark, documents, monkeypatch, cell):
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", cell)
    first, again = rows(mixing.mix(documents)), rows(mixing.mix(documents.repartition(5)))
    assert first == again
    for source in {r[1] for r in first}:
        mine = [r for r in first if r[1] == source]
        assert abs(sum(r[6] for r in mine) - mine[0][4]) <= max(r[2] for r in mine) / 2


def test_matches_sql_with_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", 10)
    data = [(i, "w " * (i % 17) + "x" * (i % 5), "en", "hot" if i % 3 else f"s{i % 4}", 0) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(data, DOCUMENTS)).select(
        "doc_id", "size", "source_size", "target", "taken").toPandas().sort_values("doc_id", ignore_index=True)
    con = duckdb.connect()
    con.register("frame", spark.createDataFrame(data, DOCUMENTS).toPandas())
    con.sql("CREATE VIEW documents AS SELECT * FROM frame")
    want = con.sql(mixing.ORACLE_SQL).df().sort_values("doc_id", ignore_index=True)
    for c in got.columns:
        assert (got[c] == want[c]).all(), c


def test_materialised_mix_has_every_document_as_often_as_taken(spark, documents):
    from collections import Counter

    docs = documents.unionByName(documents.limit(20))
    mixed = mixing.mix(docs)
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id] += r.times
    assert Counter(r.doc_id for r in mixing.materialise(docs, mixed).collect()) == +want
