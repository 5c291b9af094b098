import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from puckline.llm import decontaminate as dc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, bench, window=10):
    windows = {}
    for item, text in bench:
        w = plain_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i:i + window]), set()).add(str("" if item is None else item))
    out = []
    for doc, text in docs:
        w = plain_words(text)
        hit, items = set(), set()
        for phrase, owners in windows.items():
            for i in range(len(w) - len(phrase) + 1):
                if tuple(w[i:i + len(phrase)]) == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    items |= owners
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(items), digest, bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, bench, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    return sorted((tuple(r) for r in dc.contamination(d, b, **options).collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words(text):
    assert [w.decode() for w in dc.words(text.encode())] == plain_words(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 5), min_size=1, max_size=4))
def test_index_finds_every_occurrence(text, phrase):
    text = np.array([*text, 0, *text[::2], 0])
    index = dc.FMIndex(text, 5)
    low, high = index.search(np.array([phrase]))
    found = sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist())
    assert found == [i for i in range(len(text)) if text[i:i + len(phrase)].tolist() == phrase]


def test_awkward_rows(spark):
    item = "One two three four five six seven eight nine ten eleven twelve"
    bench = [(1, item), (2, "short item"), (3, None), (4, "..."), (None, "five six"), (1, item), (5, "x y"), (6, "lone")]
    docs = [(1, item.upper()), (1, item.upper()), (2, "a short, ITEM here: short item"), (3, None), (4, ""), (None, "five-six"),
            (5, "zz one two three four five six seven eight nine ten zz"), (6, "one two three four five seven"),
            (7, "x y " * 50_000 + item), (8, "x\ty"), (9, "lone lone lonely"), (10, "ünï " + item + "é")]
    assert run(spark, docs, bench) == brute(docs, bench)
    assert run(spark, docs, bench, window=3) == brute(docs, bench, 3)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_slices_and_shards_agree(spark, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    want = brute(docs, bench)
    assert any(r[5] for r in want)
    assert run(spark, docs, bench) == want
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    whole = {r.doc_id: r for r in dc.find_benchmark_words(d, b, carry=("text",)).collect()}
    monkeypatch.setattr(dc, "SHARD_WORDS", 2_000)
    sliced = {r.doc_id: r for r in dc.find_benchmark_words(d, b, slice_words=1_000, carry=("text",)).collect()}
    assert whole == sliced


def test_extra_columns(spark, awkward, no_documents):
    bench = spark.createDataFrame([("i1", "cat sat on")], "item_id string, text string")
    rows = dc.contamination(awkward, bench).collect()
    assert sorted(str(r.doc_id) for r in rows if r.contaminated) == ["-8", "4", "4", "None"]
    assert dc.contamination(no_documents, bench).collect() == []


@pytest.mark.parametrize(("spans", "left"), [([(0, 2)], "  c, D!"), ([(1, 3)], "a  D!"), ([], "a (b) c, D!"), ([(0, 4)], "!")])
def test_cut_spans(spans, left):
    text = "a (b) c, D!"
    got = dc.cut_spans(text, spans)
    assert plain_words(got) == plain_words(left)


def test_repeated_items_do_not_fill_a_slice(spark, monkeypatch):
    sizes, phrases = [], dc.Phrases

    def counted(items, window):
        sizes.append(sum(len(text.split()) for _, text in items))
        return phrases(items, window)

    monkeypatch.setattr(dc, "Phrases", counted)
    passage = " ".join(f"word{i}" for i in range(20))
    bench = spark.createDataFrame([("q", passage)] * 500, "item_id string, text string")
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "nothing here")], "doc_id long, text string")
    found = {r.doc_id: r.items for r in dc.find_benchmark_words(docs, bench, slice_words=1_000).collect()}
    assert found == {1: ["q"], 2: []}
    assert max(sizes) <= 1_000
