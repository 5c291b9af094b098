import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from puckline.llm import langid
from tests.llm.conftest import AWKWARD, DOCUMENTS


def plain_grams(text):
    words = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    padded = f" {words} " if words else " "
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            gram = padded[i:i + n]
            if gram.strip() and " " not in gram[1:-1]:
                out[gram] += 1
    return out


def number(gram):
    return sum(ord(c) << (21 * (len(gram) - 1 - i)) for i, c in enumerate(gram))


def plain_prediction(text, profiles, most):
    if not text or not plain_grams(text):
        return "und", 0.0
    top = [g for g, _ in sorted(plain_grams(text).items(), key=lambda x: (-x[1], number(x[0])))[:most]]
    away = {lang: sum(abs(rank[g] - i) if g in rank else most for i, g in enumerate(top)) for lang, rank in profiles.items()}
    best = min(away, key=lambda x: (away[x], x))
    return best, 1 - away[best] / (most * len(top))


def plain_profiles(rows, most):
    counts = {}
    for doc, text, lang in rows:
        if doc is not None and text is not None and lang is not None and zlib.crc32(str(doc).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    return {lang: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], number(x[0])))[:most])}
            for lang, c in counts.items() if c}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abß é9.\n", max_size=40), st.sampled_from([1 << 20, 7]))
def test_grams(text, chunk):
    old, langid.CHUNK = langid.CHUNK, chunk
    try:
        grams, n = langid.count_grams(langid._codes(text))
    finally:
        langid.CHUNK = old
    assert dict(zip(grams.tolist(), n.tolist(), strict=True)) == {number(g): c for g, c in plain_grams(text).items()}


def test_matches_brute_force(spark, documents):
    rows = [(r.doc_id, r.text, r.lang) for r in documents.collect()]
    profiles = plain_profiles(rows, langid.PROFILE)
    got = {r.doc_id: r for r in langid.identify(documents).collect()}
    right = 0
    for doc, text, lang in rows:
        want, score = plain_prediction(text, profiles, langid.PROFILE)
        assert got[doc].lang_pred == want and abs(got[doc].score - score) < 1e-9
        assert got[doc].held_out == (zlib.crc32(str(doc).encode()) % 4 == 2)
        right += got[doc].held_out and want == lang
    held = [r for r in rows if got[r[0]].held_out]
    assert right >= 0.95 * len(held)


def test_slices_of_languages_agree(spark, documents, monkeypatch):
    from pyspark.sql import functions as F

    many = documents.withColumn("lang", F.concat("lang", (F.col("doc_id") % 3).cast("string")))
    whole = sorted(tuple(r) for r in langid.identify(many).collect())
    monkeypatch.setattr(langid, "SLICE", 3)
    assert sorted(tuple(r) for r in langid.identify(many).collect()) == whole


def test_awkward_documents(spark, awkward, no_documents):
    rows = langid.identify(awkward, keep=("text", "source")).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        letters = re.search(r"[^\W\d_]", r.text or "")
        assert (r.lang_pred == "und") == (not letters)
        assert 0 <= r.score <= 1
    assert langid.identify(no_documents).collect() == []
    nothing = spark.createDataFrame([(1, "abc", None, None, 1)], DOCUMENTS)
    assert [tuple(r) for r in langid.identify(nothing).collect()] == [(1, False, "und", 0.0)]


def test_only_the_first_grams_of_each_task_are_shuffled(spark, documents):
    plan = langid.learn_profiles(documents)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
