"""Operator 9, language ID: rank-order profiles and out-of-place distances.

Every language has a profile: its most frequent letter n-grams (one to three
letters, a space at word edges), ranked.  A document's own ranking is compared
with each profile: an n-gram adds the difference of its two ranks, or the
profile's length if the profile lacks it.  The nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from puckline.llm.common import Stages, fold

PROFILE = 300
FOLDS, HELD_OUT = 4, 2
#: Languages whose profiles go to the tasks at once.
SLICE = 256
SPACE = 32
#: n-grams that are counted at once.
CHUNK = 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, other runs as one space, a space at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.full(len(raw) + 2, SPACE, dtype=np.uint32)
    codes[1:-1] = np.where(_letters()[raw], raw, SPACE)
    space = codes == SPACE
    return codes[np.concatenate([[True], ~(space[1:] & space[:-1])])]


def _grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams as numbers, 21 bits a character; no space but at the ends, none alone."""
    wide = codes.astype(np.uint64)
    letter = codes != SPACE
    pairs = (wide[:-1] << np.uint64(21)) | wide[1:]
    parts = [wide[letter], pairs[letter[:-1] | letter[1:]]]
    if len(wide) > 2:
        parts.append(((pairs[:-1] << np.uint64(21)) | wide[2:])[letter[1:-1]])
    return np.concatenate(parts)


def _add(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum (n-grams, counts) pairs by n-gram, n-grams ascending."""
    if len(counts) == 1:
        return counts[0]
    grams, where = np.unique(np.concatenate([g for g, _ in counts]), return_inverse=True)
    return grams, np.bincount(where, weights=np.concatenate([n for _, n in counts])).astype(np.int64)


def count_grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams and their counts; long texts in chunks that overlap by two."""
    if len(codes) <= CHUNK:
        return np.unique(_grams(codes), return_counts=True)
    parts = []
    for at in range(0, len(codes) - 2, CHUNK):
        piece = codes[at:at + CHUNK + 2]
        grams, n = np.unique(_grams(piece), return_counts=True)
        if at + len(piece) < len(codes):  # the next chunk counts what the last two begin
            twice, m = np.unique(_grams(piece[-2:]), return_counts=True)
            n[np.searchsorted(grams, twice)] -= m
        parts.append((grams[n > 0], n[n > 0]))
    return _add(parts)


def top_grams(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams in order; equal counts by n-gram."""
    grams, n = count_grams(codes)
    if len(grams) > most:
        # Only counts that can be among the first: those of the most-th and above.
        floor = np.partition(n, len(n) - most)[len(n) - most]
        grams, n = grams[n >= floor], n[n >= floor]
    return grams[np.argsort(-n, kind="stable")[:most]]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n), summed within the task as far as memory allows."""
    pending: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    texts: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}

    def close(lang):
        pending.setdefault(lang, []).append(count_grams(np.concatenate(texts.pop(lang))))
        size[lang] = 0

    def emit():
        for lang, parts in pending.items():
            grams, n = _add(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n, pa.int64())],
                names=["lang", "gram", "n"])
        pending.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            codes = _codes(text.as_py())
            texts.setdefault(lang, []).append(codes)
            size[lang] = size.get(lang, 0) + len(codes)
            if size[lang] >= CHUNK // 2:
                close(lang)
        if sum(map(len, texts.values())) > 100_000 or sum(len(g) for x in pending.values() for g, _ in x) > 2_000_000:
            for lang in list(texts):
                close(lang)
            yield from emit()
    for lang in list(texts):
        close(lang)
    yield from emit()


def learn_profiles(labelled: DataFrame, most: int = PROFILE) -> DataFrame:
    """(lang, text) -> (lang, gram, rank): each language's ``most`` n-grams.

    Counts cover every text; rows with a null lang or text teach nothing.
    """
    counted = (labelled.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL")
               .mapInArrow(_count_batches, "lang string, gram long, n long"))
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    # The number is filtered as it is, so that only each task's first ``most`` are shuffled and sorted.
    return (summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
            .select("lang", "gram", (F.col("rank") - 1).alias("rank")))


class Profiles:
    """Ranks of n-grams by language, for many look-ups at once."""

    def __init__(self, rows: list[tuple[str, int, int]], most: int):
        self.most = most
        self.langs = sorted({lang for lang, _, _ in rows})
        self.grams = np.array(sorted({gram for _, gram, _ in rows}), dtype=np.uint64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int32)
        column = {lang: i for i, lang in enumerate(self.langs)}
        row = {int(gram): i for i, gram in enumerate(self.grams)}
        for lang, gram, rank in rows:
            self.ranks[row[gram], column[lang]] = rank

    def nearest(self, text: str | None) -> tuple[str, float]:
        """Language and 1 - distance / largest distance; equal distances by name."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        codes = _codes(text)
        if len(codes) < 2 or not (codes != SPACE).any():
            return UNKNOWN, 0.0
        top = top_grams(codes, self.most)
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == top, at, len(self.grams))
        ranks = self.ranks[at]
        away = np.abs(ranks - np.arange(len(top), dtype=np.int32)[:, None])
        away[ranks < 0] = self.most
        total = away.sum(axis=0)
        best = int(total.argmin())
        return self.langs[best], 1.0 - float(total[best]) / (self.most * len(top))


def _predictor(profiles: Profiles, column: str):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.nearest(text.as_py()) for text in batch.column(column)]
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in rest), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())], names=[*rest, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, most: int = PROFILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of every row of ``docs`` (doc_id, text, lang).

    Profiles come from rows with a lang and a doc_id whose crc32(doc_id) mod 4
    is not 2.  Returns doc_id, held_out (that remainder is 2; false for a null
    id), lang_pred and score; a null text, a text without a letter, and any
    text if nothing could be learned are ``und`` with score 0.  Repeated rows
    count each; an empty table gives an empty result.  ``keep`` names further
    columns to carry along.
    """
    spark = docs.sparkSession
    st = Stages(spark, "langid")
    remainder = fold("doc_id", FOLDS)
    profiles = st.put(learn_profiles(docs.where(remainder != HELD_OUT), most))
    langs = profiles.select("lang").distinct().count()
    slices = max(1, -(-langs // SLICE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder == HELD_OUT, F.lit(False))
                       .alias("held_out"), *([] if "text" in keep else ["text"]),
                       *[F.col(c).alias(f"_keep_{c}") for c in keep])
    column = "_keep_text" if "text" in keep else "text"
    if slices == 1:
        table = Profiles([tuple(r) for r in profiles.collect()], most)
        out = _predict(rows, table, column)
    else:  # nearest within each slice of languages, then the nearest of those
        best, rows = [], st.put(rows.withColumn("_rid", F.monotonically_increasing_id()))
        for k in range(slices):
            mine = profiles.where(F.pmod(F.xxhash64("lang"), F.lit(slices)) == k)
            one = Profiles([tuple(r) for r in mine.collect()], most)
            best.append(st.put(_predict(rows.select("_rid", F.col(column).alias("text")), one, "text")))
        all_best = best[0]
        for part in best[1:]:
            all_best = all_best.unionByName(part)
        nearest = (all_best.where(F.col("lang_pred") != UNKNOWN).groupBy("_rid")
                   .agg(F.min(F.struct((-F.col("score")).alias("away"), F.col("lang_pred"))).alias("x"))
                   .select("_rid", F.col("x.lang_pred").alias("lang_pred"), (-F.col("x.away")).alias("score")))
        out = (rows.drop("text").join(nearest, "_rid", "left").drop("_rid")
               .withColumns({"lang_pred": F.coalesce("lang_pred", F.lit(UNKNOWN)),
                             "score": F.coalesce("score", F.lit(0.0))}))
    return out.select("doc_id", "held_out", "lang_pred", "score", *[F.col(f"_keep_{c}").alias(c) for c in keep])


def _predict(rows: DataFrame, profiles: Profiles, column: str) -> DataFrame:
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(_predictor(profiles, column), f"{schema}, lang_pred string, score double")
