import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from puckline.llm import licenses as lic
from puckline.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import AWKWARD, DOCUMENTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_base(text):
    words = plain_words(text)
    places = []
    for phrase, label in lic.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return words, places


def expand(items):
    """Every wording of a template without replaceable words."""
    out = [[]]
    for item in items:
        more = [[item]] if isinstance(item, str) else [[], *(w for choice in item for w in expand(choice))]
        out = [a + b for a in out for b in more]
    return out


def scan(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in lic.scan_licenses(df, **how).collect()}


def test_base_columns_against_plain_search(spark, documents):
    out = {}
    for r in lic.scan_licenses(documents).collect():
        out.setdefault(r.doc_id, r)
    for d in documents.collect():
        words, places = plain_base(d.text)
        r = out[d.doc_id]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert r.first_word == min((i for i, _ in places), default=None)
        assert r.last_word == max((i for i, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


@given(st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_automaton_accepts_every_wording_and_no_other(words):
    wording = "a [ b [ c | d ] ] a [ c c | d ] b"
    own = lic.Automaton([("x", wording)])
    wordings = expand(lic._parse(wording.split())[0][0])
    expected = set()
    for i in range(len(words)):
        ends = [i + len(w) for w in wordings if words[i:i + len(w)] == w]
        if ends:
            expected.add((i, max(ends), 0))
    assert set(own.find([w.encode() for w in words])) == expected


@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_replaceable_words_against_a_regular_expression(words):
    wording = "a <x:1-3> b [ c <y:0-2> a ] c"
    own = lic.Automaton([("x", wording)])
    pattern = re.compile(lic._pattern(lic._parse(wording.split())[0][0]))
    found = {start for start, _, _ in own.find([w.encode() for w in words])}
    assert found == {i for i in range(len(words)) if pattern.match("".join(f" {w} " for w in words[i:]))}


def test_templates(spark):
    texts = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "the apache license is long",
             "This work is licensed under the GNU General Public License, version 3.", "released under the mit licence",
             "Copyright (c) 2019-2021 Jane Q. Doe. All rights reserved.", "mit license mit license",
             "Neither licensed nor released", None, ""]
    out = scan(spark, texts)
    assert [out[i].labels for i in range(len(texts))] == [
        "mit", "cc-by,cc-by-nc-4.0", "apache", "gpl,gpl-3.0", "", "all-rights-reserved", "mit", "", "", ""]
    assert [out[i].score for i in range(len(texts))] == [1.0, 1.0, 0.5, 1.0, 0.0, 1.0, 0.5, 0.0, 0.0, 0.0]
    assert (out[6].n_base, out[6].first_word, out[6].last_word) == (2, 0, 2)


def test_mandatory_wording_must_match_exactly(spark):
    label, wording = next((x, w) for x, w in lic.TEMPLATES if x == "isc")
    words = wording.split()
    texts = [" ".join(words), "x " + " ".join(words).upper() + ". y", " ".join(words[:-1]),
             *(" ".join(words[:i] + ["other"] + words[i + 1:]) for i in range(1, len(words)))]
    out = scan(spark, texts)
    assert [out[i].labels for i in (0, 1)] == [label, label]
    assert all(out[i].labels == "" for i in range(2, len(texts)))


def test_every_template_accepts_its_own_wording(spark):
    def filled(items):
        return " ".join(x if isinstance(x, str) else " ".join(["some"] * x[0]) if isinstance(x, tuple) else filled(x[0])
                        for x in items)

    out = scan(spark, [filled(lic._parse(w.split())[0][0]) for _, w in lic.TEMPLATES])
    for i, (label, _) in enumerate(lic.TEMPLATES):
        assert label in out[i].labels.split(",")


def test_own_templates(spark):
    out = scan(spark, ["house rules apply here"], templates=[("house", "house rules [ apply ]")])
    assert out[0].labels == "house"
    with pytest.raises(ValueError):
        lic.automaton((("bad", "<x:1-2> b"),))


def test_matches_are_word_spans(spark):
    df = spark.createDataFrame([(1, "So: released under the MIT license, and more.")], "doc_id long, text string")
    row = lic.find_licenses(df).first()
    assert [(m.start, m.end, m.label, m.template) for m in row.matches] == [(1, 6, "mit", True), (4, 6, "mit", False)]


def test_awkward_documents(spark, awkward, no_documents):
    rows = lic.scan_licenses(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert sorted(r.n_words for r in rows) == sorted(len(plain_words(t[1])) for t in AWKWARD)
    assert lic.scan_licenses(no_documents).collect() == []
    long = spark.createDataFrame([(1, "mit " * 200_000 + "license", "en", "a", 1)], DOCUMENTS)
    r = lic.scan_licenses(long).first()
    assert (r.n_words, r.n_base, r.first_word) == (200_001, 1, 199_999)


def test_sql(spark, documents):
    more = ["gpl GNU  general-public license", "cc by", "CC-BY 4.0 licensed under a CC BY-SA 4.0", "", None, " . ", "x",
            "Permission to use, mit license", "Copyright 2020 all rights reserved é mit license\x00mit license"]
    extra = spark.createDataFrame([(10_000 + i, t, "en", "a", 1) for i, t in enumerate(more)], DOCUMENTS)
    docs = documents.unionByName(extra)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted(map(repr, con.execute(lic.ORACLE_SQL).fetchall()))
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(repr(tuple(r)) for r in lic.scan_licenses(docs).select(*cols).collect()) == want
    assert "op13_licenses" in QUERIES and "op13_licenses" in ORACLE
    assert docs.select(F.count("text")).first()[0] > 200
