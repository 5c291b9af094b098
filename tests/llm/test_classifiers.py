import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from puckline.llm import quality, toxicity
from puckline.llm.common import labelled_sample
from tests.llm.conftest import AWKWARD, DOCUMENTS


def auc(pairs):
    bad = [s for s, y in pairs if y]
    good = [s for s, y in pairs if not y]
    return sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))


def toxic_corpus(spark, n=600):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        if toxic:
            words[:3] = rng.sample(["vile", "scum", "foul", "rot"], 3)
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_held_out_toxicity(spark):
    docs, labels, truth = toxic_corpus(spark)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [(got[i].score, t) for i, _, t in truth if got[i].held_out]
    assert auc(held) > 0.99
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in truth)
    assert all((got[i].predicted == 1) == (got[i].score >= 0.5) for i in got)
    toxic = next(got[i] for i, _, t in truth if t and got[i].held_out)
    assert all(e.split(":")[2] == "1" for e in toxic.evidence.split(","))


def test_toxic_words_outweigh_the_topic(spark):
    rng = random.Random(11)
    def word(prefix, n):
        return prefix + "".join("abcdefghij"[int(x)] for x in str(n))

    insults, rows, labels = [word("insult", i) for i in range(12)], [], []
    for i in range(900):
        topic, toxic = rng.randrange(20), i % 9 == 0
        words = [word("t", topic * 400 + rng.randrange(400)) for _ in range(60)] + [word("c", rng.randrange(50)) for _ in range(25)]
        words += rng.sample(insults, 2) if toxic else []
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, DOCUMENTS), frame).collect()}
    held = [(got[i].score, t) for i, _, t in labels if got[i].held_out]
    assert auc(held) > 0.95
    clean = sorted(s for s, t in held if not t)
    bound = clean[int(len(clean) * 0.9)]
    assert sum(s > bound for s, t in held if t) >= 0.9 * sum(t for _, t in held)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.lists(st.integers(0, 9), min_size=1, max_size=6)), min_size=1, max_size=300),
       st.lists(st.integers(0, 9), min_size=1, max_size=6))
def test_block_max_search_is_exact(examples, query):
    idf = np.linspace(1.0, 3.0, 10)

    def counted(words):
        t = sorted(set(words))
        return np.array(t), np.array([float(words.count(x)) for x in t])

    index = toxicity.Examples([(i, y, *counted(w)) for i, (y, w) in enumerate(examples)], idf, 0.3, k=5)
    terms, counts = counted(query)
    weight = toxicity._weights(terms, counts, idf)
    place, cosine = index.nearest(terms, weight)
    dense = np.zeros((len(index.ids), 10))
    for n, i in enumerate(index.ids):
        t, c = counted(examples[i][1])
        dense[n, t] = toxicity._weights(t, c, idf)
    all_ = np.sort(dense[:, terms] @ weight)[::-1]
    want = all_[all_ > 1e-15][:5]
    assert np.allclose(cosine, want)


@pytest.mark.parametrize("few,dense", [(0, 1), (3, 1), (3, 4), (64, 16)])
def test_documents_searched_together_against_brute_force(monkeypatch, few, dense):
    monkeypatch.setattr(toxicity, "FEW", few)
    monkeypatch.setattr(toxicity, "DENSE", dense)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = np.random.default_rng(6)
    n, idf = 80, np.linspace(0.0, 3.0, 80)

    def text(most):
        t = np.unique((n * rng.random(rng.integers(0, most)) ** 2).astype(np.int64))
        return t, rng.integers(1, 4, len(t)).astype(float)

    rows = [(i, int(i % 5 == 0), *text(12)) for i in range(300)]
    rows += [(300 + i, *r[1:]) for i, r in enumerate(rows[:40])]  # copies tie
    index = toxicity.Examples(rows, idf, 0.3, k=7)
    full = np.zeros((len(index.ids), n))
    for at, i in enumerate(index.ids):
        full[at, rows[i][2]] = toxicity._weights(*rows[i][2:], idf)
    queries = [text(30) for _ in range(90)]
    weights = [toxicity._weights(t, c, idf) for t, c in queries]
    left = rng.integers(-1, len(index.ids), len(queries))
    place, cosine = index.nearest_all(np.concatenate([t for t, _ in queries]), np.concatenate(weights),
                                      np.array([len(w) for w in weights]), left)
    for (t, _), w, out, p, c in zip(queries, weights, left, place, cosine, strict=True):
        want = full[:, t] @ w
        if out >= 0:
            want[out] = 0.0
        best = np.sort(want[want > 1e-12])[::-1][:7]
        found = p >= 0
        assert found.sum() == len(best) and np.allclose(c[found], best) and np.allclose(want[p[found]], best)
        assert (c[~found] == 0).all() and len(set(p[found])) == found.sum()
        same = np.abs(np.diff(c[found])) == 0
        assert (np.diff(p[found])[same] > 0).all()


def test_documents_share_their_passes_over_the_index(monkeypatch):
    rng = np.random.default_rng(7)
    docs = [(np.unique(rng.integers(0, 200, 20)), None) for _ in range(256)]
    docs = [(t, np.ones(len(t))) for t, _ in docs]
    index = toxicity.Examples([(i, i % 2, *d) for i, d in enumerate(docs)], np.ones(200), 0.5, k=5)
    passes, ranges = [], toxicity._ranges
    monkeypatch.setattr(toxicity, "_ranges", lambda *a: passes.append(1) or ranges(*a))
    scores = index.score_all(docs)
    assert 0 < len(passes) < len(docs) / 8  # three a document before
    assert [round(x[0], 12) for x in scores] == [round(index.score(*d)[0], 12) for d in docs]


WORDS = st.text(st.sampled_from("abzABZ019_ \n.'-\u00c4\u00df\u00e9\u0130\u03a3\u03c3\u03c2\u212a\u00b2\u2014\u4e2d\U0001f600\u0301\x00"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | WORDS, max_size=8), st.lists(WORDS, max_size=3), st.integers(1, 60))
def test_counted_words_are_those_of_the_pattern(texts, examples, together):
    pattern = re.compile(r"[^\W\d_]+")
    terms = sorted({w for t in examples + [t or "" for t in texts[::2]] for w in pattern.findall(t.lower())})
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    before, toxicity.BYTES_TOGETHER = toxicity.BYTES_TOGETHER, together
    try:
        (got,) = toxicity._vectoriser(terms)(iter([batch]))
    finally:
        toxicity.BYTES_TOGETHER = before
    for text, found, times in zip(texts, got.column("terms").to_pylist(), got.column("counts").to_pylist(), strict=True):
        held = Counter(pattern.findall((text or "").lower()))
        assert [(terms[i], n) for i, n in zip(found, times, strict=True)] == sorted((w, n) for w, n in held.items() if w in set(terms))


def test_texts_in_ascii_need_no_pattern(monkeypatch):
    class Counting:
        seen = 0

        def findall(self, text):
            self.seen += 1
            return re.findall(r"[^\W\d_]+", text)

    monkeypatch.setattr(toxicity, "_WORD", Counting())
    texts = ["The cat, the dog_2cat"] * 50 + ["sch\u00f6n\u2014sch\u00f6n und neu"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    (got,) = toxicity._vectoriser(["cat", "neu", "sch\u00f6n", "the"])(iter([batch]))
    assert got.column("counts").to_pylist() == [[2, 2]] * 50 + [[1, 2]] * 50
    assert toxicity._WORD.seen == 1  # once a text before


def test_a_near_copy_finds_its_example_by_any_words(spark):
    rng = random.Random(3)
    texts = [["".join(rng.choices("abcdefghij", k=6)) for _ in range(20)] for _ in range(40)]
    usable = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][:40]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in zip(usable, texts, strict=True)]
    rows += [(1000 + i, " ".join(t[1:]), "en", "s", 1) for i, t in zip(usable, texts, strict=True)]
    labels = spark.createDataFrame([(i, 1, int(n % 4 == 0)) for n, i in enumerate(usable)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, DOCUMENTS), labels).collect()}
    for n, i in enumerate(usable):
        nearest, cosine, label = got[1000 + i].evidence.split(",")[0].split(":")
        assert (int(nearest), int(label)) == (i, int(n % 4 == 0)) and float(cosine) > 0.9


def test_awkward_toxicity(spark, awkward, no_documents):
    docs, labels, _ = toxic_corpus(spark, 200)
    none = labels.limit(0)
    assert all(r.score == 0 for r in toxicity.score_toxicity(awkward, none).collect())
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (4, None, None), (5, 1, 7), (6, 0, 1), (6, 1, 0)], labels.schema))
    rows = toxicity.score_toxicity(awkward.select("doc_id", "text", "label", "n"), odd).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(no_documents, labels).collect() == []


def test_held_out_quality(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert auc([(-r.score, not truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]) > 0.95


def test_awkward_quality(spark, awkward, no_documents):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (6, 1, 0), (7, 0, 0), (None, 1, 1), (2, None, None)],
                                   "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = quality.score_quality(awkward, known).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_quality(no_documents, labels).collect() == []


def quality_corpus(spark, n=900, labelled=5):
    """Every fifth row is labelled; the sources c and d occur in rows without a label only."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good, given = i % 2, i % labelled == 0
        words = [rng.choice("aa bb cc dd".split()) if rng.random() < 0.5 else rng.choice(["fine", "calm"] if good else ["junk", "spam"])
                 for _ in range(rng.randrange(2, 9))]
        source = ("ab" if given else "cd")[good if rng.random() < 0.9 else 1 - good]
        rows.append((i, " ".join(words), rng.choice(["en", None]), source, rng.choice([None, 3, 900])))
        if given:
            labels.append((i, good))
    return spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, "doc_id long, quality int"), rows, dict(labels)


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def brute_force_quality(rows, labels, rounds, sure):
    """The same rounds in plain Python: dictionaries of counts over whole lists of rows."""
    words = {r[0]: sorted({zlib.crc32(w.encode()) % quality.WORDS for w in r[1].lower().split()}) for r in rows}
    style = {r[0]: [float(np.float32(x)) for x in quality.style_features(r[1])] for r in rows}
    meta = {r[0]: quality.meta_buckets(r[3], r[2], r[4]) for r in rows}
    known = [i for i in words if i in labels and not held(i)]
    spare = [i for i in known if zlib.crc32(f"spare:{i}".encode()) % 4 == 0]
    train = [i for i in known if i not in spare]
    pool = [i for i in words if i not in known and not held(i)]
    edges = [np.quantile(np.array([style[i][k] for i in train], np.float32), np.arange(1, 16) / 16) for k in range(16)]

    def keys(i):
        text = [("w", w) for w in words[i]] + [("s", k, sum(x >= e for e in edges[k])) for k, x in enumerate(style[i])]
        return text, [("m", m) for m in meta[i]]

    def fit(for_text, for_meta):
        seen = {}
        for view, taught in enumerate((for_text, for_meta)):
            for i, y in taught:
                seen["rows", view, y] = seen.get(("rows", view, y), 0) + 1
                for k in keys(i)[view]:
                    seen[k, y] = seen.get((k, y), 0) + 1

        def ratio(k, view):
            good, bad = ((seen.get((k, y), 0) + 0.5) / (seen.get(("rows", view, y), 0) + 1) for y in (1, 0))
            return np.log(good / bad)

        def evidence(i):
            text, m = keys(i)
            by_word = [ratio(k, 0) for k in text if k[0] == "w"]
            return [sum(by_word) / max(1, len(by_word)), *[ratio(k, 0) for k in text if k[0] == "s"], *[ratio(k, 1) for k in m]]

        x, y = np.array([evidence(i) for i in spare]), np.array([float(labels[i]) for i in spare])
        by_text, by_meta = quality.Logistic(x[:, :17], y), quality.Logistic(x[:, 17:], y)
        both = quality.Logistic(np.column_stack([by_text.logit(x[:, :17]), by_meta.logit(x[:, 17:])]), y)

        def score(ids):
            z = np.array([evidence(i) for i in ids])
            logits = np.column_stack([by_text.logit(z[:, :17]), by_meta.logit(z[:, 17:])])
            return [1 / (1 + np.exp(-v)) for v in (both.logit(logits), logits[:, 0], logits[:, 1])]

        p = score(spare)[0]
        return score, -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    own = [(i, labels[i]) for i in train]
    best, least = score, loss = fit(own, own)
    for _ in range(rounds):
        _, text, m = score(pool)
        sure_of = [[(i, int(p > 0.5)) for i, p in zip(pool, ps, strict=True) if p >= sure or p <= 1 - sure] for ps in (m, text)]
        score, loss = fit(own + sure_of[0], own + sure_of[1])
        if loss < least:
            best, least = score, loss
    return dict(zip(words, zip(*best(list(words)), strict=True), strict=True)), len(sure_of[0]), len(sure_of[1])


@pytest.mark.parametrize("rounds", [1, 3])
def test_rounds_against_brute_force(spark, rounds):
    docs, labels, rows, truth = quality_corpus(spark)
    want, by_meta, by_text = brute_force_quality(rows, truth, rounds, 0.8)
    assert by_meta > 100 and by_text > 100  # both views teach
    got = quality.score_quality(docs.repartition(5), labels, rounds=rounds, sure=0.8).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose((r.score, r.text_score, r.meta_score), want[r.doc_id], atol=1e-9)
        assert r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.5)


def test_text_teaches_metadata_of_sources_without_labels(spark):
    docs, labels, rows, _ = quality_corpus(spark, 1_500)
    alone, taught = ({r.doc_id: r for r in quality.score_quality(docs, labels, rounds=n, sure=0.8).collect()} for n in (0, 4))
    rest = [r for r in rows if r[3] in "cd" and held(r[0])]
    for scores, least, most in ((alone, 0.0, 0.7), (taught, 0.8, 1.0)):
        assert least <= auc([(-scores[i].meta_score, i % 2 == 0) for i, *_ in rest]) <= most


def test_every_sure_document_is_counted(spark):
    docs, labels, _, _ = quality_corpus(spark, 300)
    many = docs.crossJoin(spark.range(100).select()).selectExpr("doc_id", "false AS held_out", "text", "lang", "source", "n_chars")
    features = many.mapInArrow(quality._features, quality.FEATURES)
    edges = np.tile(np.arange(1, quality.BINS) / quality.BINS, (quality.N_STYLE, 1))
    counts = quality._counts(features, lambda b: (np.ones(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)), edges)
    assert counts[1, quality.TEXT_ROWS] == counts[0, quality.META_ROWS] == 30_000
    assert counts[0, quality.META0:quality.N_KEYS].sum() == 4 * 30_000 and counts[1, quality.STYLE0:quality.META0].sum() == 16 * 30_000


@pytest.mark.parametrize("text", ["", " ", "a", "É" * 50, "x | y | z\n" * 1000, "\ud83d"])
def test_features_are_finite(text):
    assert np.isfinite(quality.style_features(text)).all()
    assert (np.diff(quality.word_buckets(text)) > 0).all()
    assert len(quality.meta_buckets(None, None, None)) == len(quality.meta_buckets(text, "x", -5)) == quality.N_META


def test_sample_is_bounded_and_stable(spark):
    labels = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0) for i in range(300)], "doc_id long, toxic int")
    first = sorted(tuple(r) for r in labelled_sample(labels, "toxic", 5, 0, 20).collect())
    again = sorted(tuple(r) for r in labelled_sample(labels.repartition(7), "toxic", 5, 0, 20).collect())
    assert first == again and len(first) == 40
    assert all(zlib.crc32(str(i).encode()) % 5 for i, _ in first)
