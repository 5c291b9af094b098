"""Operator 4, quality classifier: co-training of two views.

The text view is naive Bayes over a document's words (hashed) and over what its
characters, words and lines look like; the metadata view is naive Bayes over
source, language and stated length, and reads nothing of the text.  Each view
is calibrated on spare labels.  Round after round each view labels every
unlabelled document of the whole corpus that it is sure of, and the other view
is fitted anew to the labelled rows and these documents.  The calibrated views
of the best round are combined and applied to all documents.

A view is a table of feature counts per label, so a fit is one sum over the
corpus: tasks count what they label, the sums are grouped by feature, and the
driver holds counts of a fixed number of features, never rows of the corpus.
Counts are whole numbers, so the layout of the data does not change a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puckline.llm.common import Stages, fold, labelled_sample

FOLDS, HELD_OUT = 5, 0
#: Bound of the labelled sample (per class), a quarter of which only calibrates.
SAMPLE = 5_000
#: Rounds of teaching, and how sure (calibrated) a view must be of a label it teaches.
ROUNDS, SURE = 4, 0.95
#: Hash buckets of words and of metadata values; bins of a number that describes the text.
WORDS, VALUES, BINS = 1 << 16, 1 << 14, 16
N_STYLE, N_META = 16, 4
#: Numbers of evidence of the text view.
N_TEXT = 1 + N_STYLE
#: Places of the features in the table of counts: words, style bins, metadata, and the views' row counts.
STYLE0, META0 = WORDS, WORDS + N_STYLE * BINS
N_KEYS = META0 + VALUES
TEXT_ROWS, META_ROWS = N_KEYS, N_KEYS + 1
_WORDISH = np.zeros(256, dtype=np.int64)  # classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 , or ., 7 non-ASCII
for _b in range(256):
    _WORDISH[_b] = (1 if 97 <= _b <= 122 else 2 if 65 <= _b <= 90 else 3 if 48 <= _b <= 57 else 5 if _b == 10
                    else 4 if _b in (9, 11, 12, 13, 32) else 6 if _b in (44, 46) else 7 if _b >= 128 else 0)
FEATURES = "doc_id long, held_out boolean, words array<int>, style array<float>, meta array<int>"


def word_buckets(text: str) -> np.ndarray:
    """The hashed distinct words of a text, lower-cased, ascending."""
    seen = {zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in set(text.lower().split())}
    return np.array(sorted(seen), dtype=np.int32)


def style_features(text: str) -> np.ndarray:
    """Shares of character classes, word lengths and repetition; zeros for a text without words."""
    out = np.zeros(N_STYLE)
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return out
    classes = np.bincount(_WORDISH, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=8)
    out[:8] = classes / len(raw)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    out[8] = min(lengths.mean(), 40.0) / 10
    out[9] = min(lengths.std(), 40.0) / 10
    out[10] = len(counts) / len(words) ** 0.75
    out[11] = max(counts.values()) / len(words)
    out[12] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
    out[13] = 1 - len(set(lines)) / len(lines)
    out[14] = float((lengths <= 3).mean())
    out[15] = sum(not w[-1].isalnum() for w in words) / len(words)
    return out


def meta_buckets(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Hashed source, language, both together, and the stated length in half powers of two."""
    length = "none" if n_chars is None else str(int(2 * np.log2(max(0, n_chars) + 1)))
    values = [f"source {source!r}", f"lang {lang!r}", f"both {source!r} {lang!r}", f"length {length}"]
    return [zlib.crc32(v.encode("utf-8", "surrogatepass")) % VALUES for v in values]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, styles, metas = [], [], []
        for text, source, lang, n in zip(batch.column("text"), batch.column("source").to_pylist(),
                                         batch.column("lang").to_pylist(), batch.column("n_chars").to_pylist(), strict=True):
            t = text.as_py() or ""
            words.append(word_buckets(t))
            styles.append(style_features(t).astype(np.float32))
            metas.append(meta_buckets(source, lang, n))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(words, pa.list_(pa.int32())),
             pa.array(styles, pa.list_(pa.float32())), pa.array(metas, pa.list_(pa.int32()))],
            names=["doc_id", "held_out", "words", "style", "meta"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """Ridge logistic regression by Newton steps, on standardised features: calibrates and combines."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._z(x)
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = _sigmoid(z @ self.w)
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty),
                                   z.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._z(x) @ self.w


class Views:
    """Both views fitted to counts: log ratios of how often good and bad rows have a feature.

    ``counts`` has a row per label and a column per feature, then the number of
    rows that each view has seen.  ``edges`` cut the style numbers into bins.
    """

    def __init__(self, counts: np.ndarray, edges: np.ndarray):
        rows = np.concatenate([np.repeat(counts[:, [TEXT_ROWS]], META0, axis=1),
                               np.repeat(counts[:, [META_ROWS]], VALUES, axis=1)], axis=1)
        share = (counts[:, :N_KEYS] + 0.5) / (rows + 1.0)
        self.ratio = np.log(share[1] / share[0])
        self.edges = edges
        self.text = self.meta = self.combine = None

    def evidence(self, batch: pa.RecordBatch) -> np.ndarray:
        """Per row: the mean ratio of its words, the ratios of its style bins, those of its metadata."""
        return np.column_stack([
            _mean_by_row(self.ratio[batch.column("words").flatten().to_numpy()], _lengths(batch)),
            self.ratio[STYLE0 + _style_keys(batch, self.edges)], self.ratio[META0 + _meta_keys(batch)]])

    def calibrate(self, evidence: np.ndarray, y: np.ndarray) -> float:
        """Fit each view's calibration and their combination to spare labels; returns the loss there."""
        self.text, self.meta = Logistic(evidence[:, :N_TEXT], y), Logistic(evidence[:, N_TEXT:], y)
        logits = self._logits(evidence)
        self.combine = Logistic(logits, y)
        p = np.clip(_sigmoid(self.combine.logit(logits)), 1e-9, 1 - 1e-9)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    def _logits(self, evidence: np.ndarray) -> np.ndarray:
        return np.column_stack([self.text.logit(evidence[:, :N_TEXT]), self.meta.logit(evidence[:, N_TEXT:])])

    def scores(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chances that a row is good: both views together, by text, by metadata."""
        logits = self._logits(self.evidence(batch))
        return _sigmoid(self.combine.logit(logits)), _sigmoid(logits[:, 0]), _sigmoid(logits[:, 1])


def _lengths(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _mean_by_row(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(rows, weights=values, minlength=len(lengths)) / np.maximum(lengths, 1)


def _style_keys(batch: pa.RecordBatch, edges: np.ndarray) -> np.ndarray:
    style = batch.column("style").flatten().to_numpy().reshape(-1, N_STYLE)
    bins = [np.searchsorted(edges[i], style[:, i], side="right") for i in range(N_STYLE)]
    return np.column_stack(bins) + np.arange(N_STYLE) * BINS


def _meta_keys(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("meta").flatten().to_numpy().reshape(-1, N_META)


def _counter(label: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], edges: np.ndarray):
    """Sums the features of a task's rows by label.  ``label`` gives what each
    row teaches the text view and the metadata view: 1, 0, or -1 for nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, N_KEYS + 2), dtype=np.int64)
        for batch in batches:
            for_text, for_meta = label(batch)
            words, lengths = batch.column("words").flatten().to_numpy(), _lengths(batch)
            style, meta = _style_keys(batch, edges), _meta_keys(batch)
            by_word = np.repeat(for_text, lengths)
            for c in (0, 1):
                total[c, :WORDS] += np.bincount(words[by_word == c], minlength=WORDS)
                total[c, STYLE0:META0] += np.bincount(style[for_text == c].ravel(), minlength=N_STYLE * BINS)
                total[c, META0:N_KEYS] += np.bincount(meta[for_meta == c].ravel(), minlength=VALUES)
                total[c, TEXT_ROWS] += (for_text == c).sum()
                total[c, META_ROWS] += (for_meta == c).sum()
        keys = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[0, keys]), pa.array(total[1, keys])],
                                         names=["key", "bad", "good"])

    return count


def _counts(rows: DataFrame, label, edges: np.ndarray) -> np.ndarray:
    """Counts per label and feature over all ``rows``: at most N_KEYS + 2 rows reach the driver."""
    summed = (rows.mapInArrow(_counter(label, edges), "key long, bad long, good long")
              .groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow())
    out = np.zeros((2, N_KEYS + 2), dtype=np.int64)
    for c, name in enumerate(("bad", "good")):
        out[c, summed.column("key").to_numpy()] = summed.column(name).to_numpy()
    return out


def _given(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    label = batch.column("label").to_numpy()
    return label, label


def _taught(views: Views, sure: float):
    """What the views are sure of: the metadata view teaches the text view, and the other way round."""

    def label(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        _, text, meta = views.scores(batch)
        by_text, by_meta = (np.where(p >= sure, 1, np.where(p <= 1 - sure, 0, -1)) for p in (text, meta))
        return by_meta, by_text

    return label


def _evidence(views: Views):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = views.evidence(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(list(found), pa.list_(pa.float64()))],
                names=["doc_id", "label", "evidence"])

    return rows


def _fitted(counts: np.ndarray, edges: np.ndarray, spare: DataFrame) -> tuple[Views, float]:
    """Views of these counts, calibrated on the spare rows (some half of ``sample``: 21 numbers of each)."""
    views = Views(counts, edges)
    rows = spare.mapInArrow(_evidence(views), "doc_id long, label int, evidence array<double>").toPandas().sort_values("doc_id")
    loss = views.calibrate(np.array(rows["evidence"].tolist()), rows["label"].to_numpy().astype(np.float64))
    return views, loss


def co_train(known: DataFrame, unlabelled: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> Views | None:
    """Views trained on each other's sure documents.

    ``known`` holds features with ``label`` and ``spare`` (calibrates only),
    one row per id; ``unlabelled`` the features of the rest.  Every row that a
    view is sure of teaches the other one, judged anew in each round, until
    the counts no longer change or ``rounds`` are over.  The round whose
    combination fits the spare labels best is returned; None if the training
    or the spare rows lack a label.
    """
    kinds = {tuple(r) for r in known.select("label", "spare").distinct().collect()}
    if len(kinds) < 4:
        return None
    train, spare = known.where("NOT spare").drop("spare"), known.where("spare").drop("spare")
    style = train.select("style").toArrow().column("style").combine_chunks().flatten().to_numpy().reshape(-1, N_STYLE)
    edges = np.quantile(style, np.arange(1, BINS) / BINS, axis=0).T
    own = _counts(train, _given, edges)
    best, least = _fitted(own, edges, spare)
    views, before = best, own
    for _ in range(rounds):
        counts = own + _counts(unlabelled, _taught(views, sure), edges)
        if (counts == before).all():
            break
        views, loss = _fitted(counts, edges, spare)
        before = counts
        if loss < least:
            best, least = views, loss
    return best


def _scorer(views: Views | None, prior: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, text, meta = views.scores(batch) if views else [np.full(batch.num_rows, prior)] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                 pa.array(text), pa.array(meta)],
                names=["doc_id", "held_out", "score", "predicted", "text_score", "meta_score"])

    return score


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS,
                  sure: float = SURE) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text, lang, source, n_chars) from ``labels`` (doc_id, quality).

    Labels count only if crc32(doc_id) mod 5 is not 0; at most ``sample`` ids
    of each label are used (a quarter of them only calibrate).  All other rows
    outside the held-out fold are unlabelled ones, those with a null id too.
    Returns doc_id, held_out (that remainder is 0; false for a null id), score
    and predicted (score >= 0.5), and the score of either view.  Null texts
    are empty ones, null names and lengths are values of their own.  Of rows
    that repeat a labelled id the least by its features is used.  Without
    labels of both kinds every score is the share of good labels, or 0.
    Repeated rows get a row each; an empty table gives an empty result.
    """
    st = Stages(docs.sparkSession, "quality")
    features = st.put(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(_features, FEATURES))
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT))
    prior = usable.agg(F.avg(F.col("quality").cast("double"))).first()[0] or 0.0
    # At most 2 * sample rows of two numbers: the size bound of these broadcasts.
    chosen = st.put(labelled_sample(labels, "quality", FOLDS, HELD_OUT, sample))
    known = st.put(features.join(F.broadcast(chosen), "doc_id")
                   .groupBy("doc_id", "label").agg(F.min(F.struct("words", "style", "meta")).alias("f"))
                   .select("doc_id", "label", "f.*",
                           (F.crc32(F.concat(F.lit("spare:"), F.col("doc_id").cast("string")).cast("binary")) % 4 == 0).alias("spare")))
    unlabelled = (features.where("NOT held_out").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
                  .select("words", "style", "meta"))
    views = co_train(known, unlabelled, rounds, sure)
    st.drop(chosen, known)
    return features.mapInArrow(
        _scorer(views, float(prior)),
        "doc_id long, held_out boolean, score double, predicted int, text_score double, meta_score double")
