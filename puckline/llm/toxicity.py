"""Operator 6, toxicity: nearest labelled examples by exact cosine of relevance-weighted TF-IDF.

A bounded sample of labelled documents is the set of examples; the vocabulary
is every word of theirs.  Document frequencies come from all documents.  A word's
weight also grows with its relevance (tf.rf: how much commoner it is among toxic
examples than among clean ones); no word weighs less for it, none is left out.  The
examples lie in blocks; an inverted index keeps, for each word, its postings
and its largest weight in every block that holds it.  Documents are searched
some at a time.  Words of many examples are products with rows of weights, words of
few examples are added outright, the others bound the blocks.  A document visits the
blocks with the largest bounds first, then those
that can still hold a nearer example than its k-th.  The k nearest vote, each
with its cosine as weight; votes are calibrated on the examples themselves,
each left out of its own search.

An example's vector covers all its words.  Words of a document that no example
holds are in no product; they would only scale the document's cosines, all by
the same factor, which changes neither the order nor the votes.  The cosines in
the evidence leave that factor out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puckline.llm.common import Stages, fold, labelled_sample

FOLDS, HELD_OUT = 5, 0
#: Bound of the labelled sample, per class, and of the examples among it.
SAMPLE, EXAMPLES = 10_000, 2_000
BLOCK = 128
#: How many neighbours may vote: the number that ranks the examples best, each left out of its own search.
K = (15, 30, 60, 100, 150)
#: A word that this part of the examples holds has its weights side by side instead of as postings.
DENSE = 16
#: A word that at most this many examples hold, few for a block, saves less by bounds than they cost.
FEW = BLOCK // 2
#: Documents that are searched together, and how many distinct words they may have between them.
TOGETHER, WORDS_TOGETHER = 64, 30_000
#: Words held by most examples; those whose heaviest of them is the same lie together.
FREQUENT = 64
_WORD = re.compile(r"[^\W\d_]+")
#: Bytes of lower-cased UTF-8: a letter of ASCII or a part of another character stays, others separate.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of text that are cut into words at once.
BYTES_TOGETHER = 4_000_000


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of the texts, by batch."""
    for batch in batches:
        found = set()
        for text in batch.column("text"):
            found.update(_WORD.findall((text.as_py() or "").lower()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])


def every_term(examples: DataFrame) -> list[str]:
    """All words of the examples (label, text); none unless both labels are there."""
    if examples.select("label").distinct().count() < 2:
        return []
    return sorted(r["word"] for r in examples.select("text").mapInArrow(_words, "word string").distinct().collect())


def _count_words(texts: list[str | None], vocabulary: pa.Array, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the vocabulary's terms in it, ascending, and how often: all terms, all counts, terms per text."""
    coded = [text.lower().encode() if text else b"" for text in texts]
    joined = np.frombuffer(b" " + b" ".join(coded).translate(_LETTERS) + b" ", dtype=np.uint8)
    held = joined != 32
    edges = np.flatnonzero(held[1:] != held[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    data, offsets = joined[held], np.concatenate([[0], np.cumsum(end - begin)])
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    term = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy().astype(np.int64)
    starts = 1 + np.cumsum([0, *(len(c) + 1 for c in coded[:-1])])
    of = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begin, starts), append=len(begin)))
    # What is no word of the vocabulary and has other than ASCII letters may be several words.
    other = np.flatnonzero((term < 0) & (np.maximum.reduceat(data, offsets[:-1]) >= 128)) if len(term) else term
    parts: dict[bytes, list[int]] = {}
    more = [(of[0:0], term[0:0])]
    for i, word in zip(of[other], words.take(pa.array(other)).to_pylist(), strict=True):
        if word not in parts:
            parts[word] = [number[w] for w in _WORD.findall(word.decode()) if w in number]
        if parts[word]:
            more.append((np.full(len(parts[word]), i), np.array(parts[word])))
    known = term >= 0
    of = np.concatenate([of[known], *(m[0] for m in more)])
    size = max(1, len(number))
    keys, times = np.unique(of * size + np.concatenate([term[known], *(m[1] for m in more)]), return_counts=True)
    return keys % size, times, np.bincount(keys // size, minlength=len(texts))


def _together(sizes: list[int], rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most ``rows`` rows, and of at most ``most`` in size unless one row has more."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and (i - first == rows or total + size > most):
            yield first, i
            first, total = i, 0
        total += size
    if len(sizes) > first:
        yield first, len(sizes)


def _vectoriser(terms: list[str]):
    """(..., text) -> (..., terms array<int>, counts array<int>) over the vocabulary."""
    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(terms)}
        vocabulary = pa.array([w.encode() for w in terms], pa.binary())
        for batch in batches:
            texts = batch.column("text").to_pylist()
            parts = [_count_words(texts[i:j], vocabulary, number)
                     for i, j in _together([len(t or "") for t in texts], len(texts), BYTES_TOGETHER)]
            found, times, sizes = (np.concatenate([np.empty(0, np.int64), *p]) for p in (zip(*parts, strict=True) if parts else ((), (), ())))
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            keep = [c for c in batch.schema.names if c != "text"]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *lists], names=[*keep, "terms", "counts"])

    return vectorise


def _weights(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vector of (1 + ln tf) * idf over the vocabulary's terms of a text."""
    w = (1.0 + np.log(counts)) * idf[terms]
    norm = np.sqrt((w * w).sum())
    return w / norm if norm > 0 else w


def _relevance(toxic: np.ndarray, clean: np.ndarray, size: tuple[float, float]) -> np.ndarray:
    """log2(2 + how many times commoner among toxic examples), of words that so many toxic and clean
    examples of ``size`` (clean, toxic) hold; 1 more clean example is assumed, so rare words gain little."""
    return np.log2(2.0 + (toxic / max(1.0, size[1])) / ((clean + 1.0) / (size[0] + 1.0)))


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges, one range after the other."""
    size = end - begin
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _ranking(votes: np.ndarray, labels: np.ndarray) -> float:
    """Chance that a row with label 1 has a larger vote than one with label 0 (equal ones count half)."""
    low, high = np.sort(votes[labels == 0]), votes[labels == 1]
    wins = np.searchsorted(low, high, "left") + np.searchsorted(low, high, "right")
    return float(wins.sum()) / (2 * len(low) * len(high))


class Examples:
    """Block-max inverted index of labelled unit vectors."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]], idf: np.ndarray, share: float, k: int | tuple[int, ...] = K,
                 relevance: bool = False):
        """rows: (doc_id, label, terms, counts); ``share``: the part of toxic ones among all labelled rows;
        ``relevance``: whether the words' relevance weighs too."""
        choices = (k,) if isinstance(k, int) else k
        size = {c: sum(r[1] == c for r in rows) for c in (0, 1)}
        # How many examples of each label hold a word, if that weighs.
        self.holders = [np.bincount(np.concatenate([np.empty(0, dtype=np.int64), *(r[2] for r in rows if r[1] == c)]), minlength=len(idf))
                        .astype(float) for c in (0, 1)] if relevance and all(size.values()) else None
        self.sizes = (size[0], size[1])
        idf = idf if self.holders is None else idf * _relevance(self.holders[1], self.holders[0], self.sizes)
        self.idf, self.k, self.share = idf, max(choices), share
        vectors = [(i, label, t, _weights(t, c, idf)) for i, label, t, c in rows]
        empty = [v for v in vectors if not v[3].any()]
        full = [v for v in vectors if v[3].any()]
        held = np.bincount(np.concatenate([np.empty(0, dtype=np.int64), *(v[2] for v in full)]), minlength=len(idf))
        frequent = np.zeros(len(idf), dtype=bool)
        frequent[np.argsort(-held, kind="stable")[:FREQUENT]] = True

        def cluster(v) -> int:
            weight = np.where(frequent[v[2]], v[3], 0.0)
            return int(v[2][weight.argmax()]) if weight.any() else -1

        # Examples of one language share frequent words, so other blocks' bounds are low.
        full = sorted(full, key=lambda v: (cluster(v), int(v[2][v[3].argmax()]), -v[3].max(), v[0]))
        self.ids = np.array([v[0] for v in full], dtype=np.int64)
        self.labels = np.array([v[1] for v in full], dtype=np.float64)
        # A class that the sample holds more of than the labelled rows do votes the less.
        self.class_weight = np.array([(1 - share) / max(1, size[0]), share / max(1, size[1])])
        self.blocks = -(-len(full) // BLOCK)
        place = np.repeat(np.arange(len(full)), [len(v[2]) for v in full])
        term = np.concatenate([np.empty(0, dtype=np.int64), *(v[2] for v in full)])
        order = np.lexsort((place, term))
        term, self.docs = term[order], place[order]
        self.weight = np.concatenate([np.empty(0), *(v[3] for v in full)])[order]
        # Words of many examples: a row of weights over all places.
        self.dense_row = np.full(len(idf), -1, dtype=np.int64)
        common = np.flatnonzero(held * DENSE >= max(DENSE, len(full)))
        self.dense_row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.blocks * BLOCK))
        at = self.dense_row[term] >= 0
        self.dense[self.dense_row[term[at]], self.docs[at]] = self.weight[at]
        term, self.docs, self.weight = term[~at], self.docs[~at], self.weight[~at]
        # All postings of a word of few examples.
        at = np.searchsorted(term, np.arange(len(idf) + 1))
        self.few_begin, self.few_end = at[:-1], np.where(held <= FEW, at[1:], at[:-1])
        # A run is what one block has of another word's postings.
        block = self.docs // BLOCK
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(term))[:len(begin)]
        largest = np.maximum.reduceat(self.weight, begin) if len(term) else np.empty(0)
        at = held[term[begin]] > FEW
        self.begin, self.end, self.block, self.largest = begin[at], end[at], block[begin[at]], largest[at]
        self.runs = np.searchsorted(term[self.begin], np.arange(len(idf) + 1))
        weights = [self.class_weight[v[1]] for v in empty]
        toxic = sum(w for v, w in zip(empty, weights, strict=True) if v[1])
        # A text without any word of the vocabulary scores as such examples do.
        self.without = toxic / sum(weights) if empty else share
        self.steps_x = self.steps_y = None
        self._calibrate(full, choices)

    def nearest(self, terms: np.ndarray, weight: np.ndarray, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Up to k examples of positive cosine, nearest first, ties by place; and their cosines."""
        place, cosine = self.nearest_all(terms, weight, np.array([len(terms)]), np.array([leave_out]))
        return place[0][place[0] >= 0], cosine[0][place[0] >= 0]

    def _add(self, score: np.ndarray, of: np.ndarray, weight: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Add postings, given as ranges with their document and its weight, to the documents' scores."""
        at, size = _ranges(begin, end), end - begin
        if len(at):
            score += np.bincount(np.repeat(of * score.shape[1], size) + self.docs[at], np.repeat(weight, size) * self.weight[at],
                                 minlength=score.size).reshape(score.shape)

    def nearest_all(self, terms: np.ndarray, weight: np.ndarray, sizes: np.ndarray,
                    leave_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same for several documents, whose terms and weights follow one another: a row of k places
        and cosines for each, -1 and 0 after the last.

        A block's bound is the most that a document's words of many and of few examples
        give to one of its places, and the sum of the other words' largest weights in it."""
        n, k = len(sizes), self.k
        of = np.repeat(np.arange(n), sizes)
        row = self.dense_row[terms]
        common = np.zeros((n, len(self.dense)))
        common[of[row >= 0], row[row >= 0]] = weight[row >= 0]
        score = common @ self.dense
        self._add(score, of, weight, self.few_begin[terms], self.few_end[terms])
        first, last = self.runs[terms], self.runs[terms + 1]
        runs, of, w = _ranges(first, last), np.repeat(of, last - first), np.repeat(weight, last - first)
        block, begin, end = self.block[runs], self.begin[runs], self.end[runs]
        bound = score.reshape(n, self.blocks, BLOCK).max(axis=2, initial=0.0)
        bound += np.bincount(of * self.blocks + block, w * self.largest[runs], minlength=bound.size).reshape(bound.shape)

        head = np.argsort(-bound, axis=1, kind="stable")[:, :-(-2 * k // BLOCK)]
        visited = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(visited, head, True, axis=1)
        now = visited[of, block]
        self._add(score, of[now], w[now], begin[now], end[now])
        if leave_out is not None:
            score[np.flatnonzero(leave_out >= 0), leave_out[leave_out >= 0]] = 0.0
        kth = np.zeros(n)
        seen = np.take_along_axis(score.reshape(n, self.blocks, BLOCK), head[:, :, None], axis=1).reshape(n, -1)
        if seen.shape[1] >= k:
            kth = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k]
        now = (~visited & (bound > 0) & (bound >= kth[:, None] * (1 - 1e-12)))[of, block]
        self._add(score, of[now], w[now], begin[now], end[now])
        if leave_out is not None:
            score[np.flatnonzero(leave_out >= 0), leave_out[leave_out >= 0]] = 0.0

        # What is left of a block that was not visited is below the k-th.
        place, cosine = np.full((n, k), -1, dtype=np.int64), np.zeros((n, k))
        for i in range(n):
            fit = np.flatnonzero(score[i] >= kth[i]) if kth[i] > 0 else np.flatnonzero(score[i] > 0)
            value = score[i, fit]
            if len(fit) > k:
                enough = value >= np.partition(value, len(fit) - k)[len(fit) - k]
                fit, value = fit[enough], value[enough]
            top = np.argsort(-value, kind="stable")[:k]
            place[i, :len(top)], cosine[i, :len(top)] = fit[top], value[top]
        return place, cosine

    def _left_out(self, label: int, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """An example's weights such that its products with others are those of words whose relevance does not count it."""
        if self.holders is None:
            return weight
        toxic, clean = self.holders[1][terms], self.holders[0][terms]
        without = _relevance(toxic - label, clean - (1 - label), (self.sizes[0] - (1 - label), self.sizes[1] - label))
        return weight * (without / _relevance(toxic, clean, self.sizes)) ** 2

    def _votes(self, place: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Of each row of neighbours: the toxic ones' part of the votes."""
        label = self.labels[place]
        w = self.class_weight[label.astype(int)] * cosine
        total = w.sum(axis=1)
        return np.where(place[:, 0] >= 0, (w * label).sum(axis=1) / np.where(total > 0, total, 1.0), self.without)

    def _calibrate(self, full: list[tuple], choices: tuple[int, ...]) -> None:
        """The number of voters, and an isotonic fit of labels on votes, each example voting without itself."""
        n = len(self.ids)
        if not n or not self.labels.any() or self.labels.all():
            return
        near = []
        for i, j in _together([len(v[2]) for v in full], TOGETHER, WORDS_TOGETHER):
            some = full[i:j]
            near.append(self.nearest_all(np.concatenate([v[2] for v in some]), np.concatenate([self._left_out(*v[1:]) for v in some]),
                                         np.array([len(v[2]) for v in some]), np.arange(i, j)))
        place, cosine = (np.concatenate(x) for x in zip(*near, strict=True))
        by_k = {k: self._votes(place[:, :k], cosine[:, :k]) for k in choices}
        self.k = max(choices, key=lambda k: (_ranking(by_k[k], self.labels), -k))
        votes = by_k[self.k]
        weight = self.class_weight[self.labels.astype(int)]
        pools: list[list[float]] = []  # weight, weighted label, weighted vote
        for i in np.argsort(votes, kind="stable"):
            pools.append([weight[i], weight[i] * self.labels[i], weight[i] * votes[i]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.steps_x = np.array([p[2] / p[0] for p in pools])
        self.steps_y = np.array([p[1] / p[0] for p in pools])

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, str]:
        return self.score_all([(terms, counts)])[0]

    def score_all(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, str]]:
        """Of each (terms, counts): calibrated probability, and the three nearest examples as doc_id:cosine:label."""
        out = []
        for i, j in _together([len(terms) for terms, _ in docs], TOGETHER, WORDS_TOGETHER):
            weights = [_weights(terms, counts, self.idf) for terms, counts in docs[i:j]]
            sizes = np.array([len(w) for w in weights])
            if not len(self.ids):
                out += [(self.without, "")] * (j - i)
                continue
            place, cosine = self.nearest_all(np.concatenate([terms for terms, _ in docs[i:j]]), np.concatenate(weights), sizes)
            votes = self._votes(place, cosine)
            if self.steps_x is not None:
                votes = np.where(place[:, 0] >= 0, np.interp(votes, self.steps_x, self.steps_y), votes)
            near = place[:, :3]
            for vote, *found in zip(np.clip(votes, 0.0, 1.0).tolist(), near.tolist(), self.ids[near].tolist(), cosine[:, :3].tolist(),
                                    self.labels[near].astype(int).tolist(), strict=True):
                out.append((vote, ",".join([f"{d}:{c:.4f}:{y}" for p, d, c, y in zip(*found, strict=True) if p >= 0])))
        return out


def _scorer(examples: Examples):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, str]] = {}
        for batch in batches:
            keys, new = [], {}
            (all_terms, ends), (all_counts, _) = (
                (batch.column(c).flatten().to_numpy(), np.cumsum(batch.column(c).value_lengths().to_numpy()).tolist()) for c in ("terms", "counts"))
            for begin, end in zip([0, *ends[:-1]], ends, strict=True):
                terms, counts = all_terms[begin:end], all_counts[begin:end]
                keys.append(hashlib.blake2b(terms.tobytes() + counts.tobytes(), digest_size=16).digest())
                if keys[-1] not in known:
                    new[keys[-1]] = (terms.astype(np.int64), counts.astype(np.float64))
            known |= zip(new, examples.score_all(list(new.values())), strict=True)
            found = [known[k] for k in keys]
            if len(known) > 100_000:
                known.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.float64()),
                 pa.array([int(x[0] >= 0.5) for x in found], pa.int32()), pa.array([x[1] for x in found], pa.string())],
                names=["doc_id", "held_out", "score", "predicted", "evidence"])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, examples: int = EXAMPLES) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) from ``labels`` (doc_id, toxic).

    Labels count only if crc32(doc_id) mod 5 is not 0; of at most
    ``sample`` rows of each label the first ``examples`` that have a text are
    the examples, and the vocabulary is every word of theirs.  Returns doc_id, held_out (that remainder is 0; false
    for a null id), score, predicted (score >= 0.5) and evidence (the nearest
    examples).  Null texts, empty texts and texts without a word of the
    vocabulary get the toxic share of such examples.  Without labels of both
    kinds every score is the toxic share of the labels, or 0 if there are none.
    Repeated rows get a row each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    st = Stages(spark, "toxicity")
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT))
    share = usable.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    chosen = st.put(labelled_sample(labels, "toxic", FOLDS, HELD_OUT, sample))
    # At most 2 * sample rows of two numbers: the size bound of this broadcast.
    taught = st.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                    .join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]))
    kept = [taught.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for c in (0, 1)]
    shown = st.put(kept[0].unionByName(kept[1]).select("doc_id", "label", "text"))
    terms = every_term(shown.select("label", "text"))

    schema = "terms array<int>, counts array<int>"
    vectors = st.put(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
        .mapInArrow(_vectoriser(terms), f"doc_id long, held_out boolean, {schema}"))
    n = vectors.count()
    in_docs = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    idf = np.array([np.log((1.0 + n) / (1.0 + in_docs.get(t, 0))) for t in range(len(terms))])

    vectorised = shown.mapInArrow(
        _vectoriser(terms), f"doc_id long, label int, {schema}")
    rows = [(r.doc_id, r.label, np.array(r.terms, dtype=np.int64), np.array(r.counts, dtype=np.float64))
            for r in vectorised.collect()]
    st.drop(chosen, taught, shown)
    return vectors.mapInArrow(_scorer(Examples(sorted(rows, key=lambda r: r[0]), idf, share, relevance=True)),
                              "doc_id long, held_out boolean, score double, predicted int, evidence string")
