"""Operator 7, benchmark decontamination: an FM-index per training shard.

A shard is a run of documents that one task holds at a time (``SHARD_WORDS``
words at most, or one document).  Its words, as numbers of the phrases'
vocabulary, are suffix-sorted; the Burrows-Wheeler transform goes into a
wavelet matrix.  All phrases are searched backwards at once by wavelet ranks;
the rows found are walked back to the nearest sampled suffix position, and the
occurrences of a document are merged into removal spans.

A word outside the phrases' vocabulary cannot be part of an occurrence, nor
can a stretch shorter than the shortest phrase; such words only separate the
stretches that are indexed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puckline.llm.common import Stages

WINDOW = 10
#: Words of one shard: bounds the index that a task holds.
SHARD_WORDS = 1_000_000
#: Every 8th suffix position is kept.
SAMPLE = 8
#: Benchmark words whose windows are searched in one pass; more are searched slice by slice.
SLICE_WORDS = 200_000

# A-Z become a-z, every other ASCII character but 0-9 and a-z a space; bytes of
# other characters (0x80 and above in UTF-8) stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text; null has none."""
    return text.translate(_FOLD).split() if text else []


class WaveletMatrix:
    """Ranks of symbols in a sequence, level by level from the highest bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.ones, self.zeros = [], []
        current = symbols
        for level in range(bits - 1, -1, -1):
            bit = (current >> level) & 1
            ones = np.zeros(len(current) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(current) - int(ones[-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbols: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs before each of its positions."""
        start = np.zeros(len(symbols), dtype=np.int64)
        ends = list(positions)
        for depth, level in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[depth], self.zeros[depth]
            up = ((symbols >> level) & 1).astype(bool)
            start, *ends = (np.where(up, zeros + ones[x], x - ones[x]) for x in (start, *ends))
        return [end - start for end in ends]


class FMIndex:
    """Self-index of a sequence of stretches of symbols >= 1, each followed by a 0."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        suffixes = self._suffix_array(text)
        self.bwt = text[suffixes - 1]  # the suffix at 0 has the final 0 before it
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(sigma).bit_length()))
        self.first = np.zeros(sigma + 2, dtype=np.int64)
        np.cumsum(np.bincount(text, minlength=sigma + 1), out=self.first[1:])
        # Kept: every SAMPLE-th position and the start of every stretch, so no walk crosses a 0.
        kept = (np.arange(n) % SAMPLE == 0) | (np.concatenate([[0], text[:-1]]) == 0)
        mark = kept[suffixes]
        self.sampled = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(mark, out=self.sampled[1:])
        self.mark, self.positions = mark, suffixes[mark]

    @staticmethod
    def _suffix_array(text: np.ndarray) -> np.ndarray:
        """Prefix doubling; each 0 is a symbol of its own, in order of position."""
        n = len(text)
        zeros = text == 0
        count = int(zeros.sum())
        rank = np.where(zeros, np.cumsum(zeros) - 1, text.astype(np.int64) + count - 1)
        step = 1
        while True:
            following = np.zeros(n, dtype=np.int64)
            if step < n:
                following[:-step] = rank[step:] + 1
            key = rank * np.int64(max(n, int(rank.max()) + 1) + 1) + following
            order = np.argsort(key, kind="stable")
            new = np.empty(n, dtype=np.int64)
            sorted_key = key[order]
            new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank, step = new, step * 2
            if int(rank.max()) == n - 1:
                return order

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of equal length, one per row of ``phrases``."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), len(self.bwt), dtype=np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbols = phrases[live, column]
            a, b = self.wavelet.rank(symbols, low[live], high[live])
            low[live], high[live] = self.first[symbols] + a, self.first[symbols] + b
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps back to the nearest kept position."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        walking = np.nonzero(~self.mark[rows])[0]
        while len(walking):
            symbols = self.bwt[rows[walking]]
            (before,) = self.wavelet.rank(symbols, rows[walking])
            rows[walking] = self.first[symbols] + before
            steps[walking] += 1
            walking = walking[~self.mark[rows[walking]]]
        return self.positions[self.sampled[rows]] + steps


class Phrases:
    """Windows of benchmark texts as word numbers, and the items they come from."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            number = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            for i in range(max(1, len(number) - window + 1) if number else 0):
                owners[tuple(number[i:i + window])].add(item)
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for phrase in owners:
            by_length[len(phrase)].append(phrase)
        self.groups = [(np.array(group, dtype=np.int64), [owners[p] for p in group])
                       for _, group in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)

    def stretches(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """Runs of known words that are long enough to hold a phrase."""
        edge = np.flatnonzero(np.diff(np.concatenate([[False], numbers > 0, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        fit = ends - starts >= self.shortest
        return list(zip(starts[fit].tolist(), ends[fit].tolist(), strict=True))


def _hits(docs: list[np.ndarray], phrases: Phrases) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """For each document of one shard: merged spans of hit words, and the items found."""
    pieces, starts, where = [], [], []  # stretches, their place in the index, (document, first word)
    at = 0
    for d, numbers in enumerate(docs):
        for begin, end in phrases.stretches(numbers):
            pieces += [numbers[begin:end], np.zeros(1, dtype=np.int64)]
            starts.append(at)
            where.append((d, begin))
            at += end - begin + 1
    found: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set[str]] = [set() for _ in docs]
    if pieces:
        index = FMIndex(np.concatenate(pieces), len(phrases.numbers))
        for group, owners in phrases.groups:
            low, high = index.search(group)
            some = np.flatnonzero(high > low)
            counts = (high - low)[some]
            rows = np.repeat(low[some] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            positions = index.locate(rows)
            stretch = np.searchsorted(starts, positions, side="right") - 1
            for phrase, position, s in zip(np.repeat(some, counts).tolist(), positions.tolist(), stretch.tolist(),
                                           strict=True):
                d, begin = where[s]
                first = begin + position - starts[s]
                found[d].append((first, first + group.shape[1]))
                items[d] |= owners[phrase]
    return [(merge(spans), item) for spans, item in zip(found, items, strict=True)]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, touching ones joined."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


_SCHEMA = "n_words long, spans array<struct<first:int,last:int>>, items array<string>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _searcher(phrases: Phrases):
    """Arrow batches of (..., words_of) -> (..., n_words, spans, items)."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = phrases.numbers.get
        for batch in batches:
            sizes, hits, shard, held = [], [], [], 0
            keep = [c for c in batch.schema.names if c != "words_of"]
            for text in batch.column("words_of"):
                word = words(text.as_py())
                shard.append(np.fromiter((get(w, 0) for w in word), dtype=np.int64, count=len(word)))
                sizes.append(len(word))
                held += len(word)
                if held >= SHARD_WORDS:
                    hits += _hits(shard, phrases)
                    shard, held = [], 0
            hits += _hits(shard, phrases)
            spans = [[{"first": a, "last": b} for a, b in h[0]] for h in hits]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(spans, _SPANS),
                 pa.array([sorted(h[1]) for h in hits], pa.list_(pa.string()))],
                names=[*keep, "n_words", "spans", "items"])

    return search


def find_benchmark_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                         slice_words: int = SLICE_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Search the windows of ``benchmark`` (item_id, text) in ``docs`` (doc_id, text).

    Returns one row per document row: doc_id, n_words, spans (merged half-open
    ranges of hit words) and items (ids found, sorted).  Null and empty texts
    have no words, and an item without words has no window.  Repeated items
    and documents count each by themselves; a null item_id is reported as an
    empty string, a null doc_id stays null.  Empty tables give empty spans or
    an empty result.  The benchmark is searched in slices of about
    ``slice_words`` words, equal items once; only one slice at a time is sent to
    the tasks.
    ``carry`` names further columns to keep (under ``carried_<name>``).
    """
    spark = docs.sparkSession
    st = Stages(spark, "decontaminate")
    bench = st.put(benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.col("text").cast("binary").alias("text"), F.octet_length("text").alias("bytes")).dropDuplicates(["item", "text"]))
    # A word has a byte and a separator at least.
    most_words = (bench.agg(F.sum(F.ceil((F.col("bytes") + 1) / 2))).first()[0] or 0)
    slices = max(1, -(-int(most_words) // slice_words))
    text = F.col("text").cast("binary").alias("words_of")
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       text, *[F.col(c).alias(f"carried_{c}") for c in carry])
    out = ["doc_id", "n_words", "spans", "items", *[f"carried_{c}" for c in carry]]
    if slices > 1:
        base = st.put(base)
    parts = []
    for k in range(slices):
        mine = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k)
        phrases = Phrases([(r.item, bytes(r.text)) for r in mine.collect() if r.text is not None], window)
        rows = base if slices == 1 else base.select("rid", "words_of")
        kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "words_of")
        searched = rows.mapInArrow(_searcher(phrases), f"{kept}, {_SCHEMA}")
        if slices == 1:
            return searched.select(*out)
        parts.append(st.put(searched))
    all_parts = parts[0]
    for part in parts[1:]:
        all_parts = all_parts.unionByName(part)
    joined = all_parts.groupBy("rid").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Merge the slices' spans: at most one entry per slice and place, folded in order.
    merged = F.aggregate(
        "all", F.array().cast("array<struct<first:int,last:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] >= x["first"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                     F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"),
                                      F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last")))))
        .otherwise(F.concat(acc, F.array(x))))
    return base.join(joined.withColumn("spans", merged), "rid").select(*out)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: counts of words, hit words and items, and the items' digest."""
    found = find_benchmark_words(docs, benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["last"] - x["first"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` and what stands between them."""
    raw = text.encode()
    folded = raw.translate(_FOLD)
    bounds, at = [], 0
    for word in folded.split():
        at = folded.index(word, at)
        bounds.append((at, at + len(word)))
        at += len(word)
    out, done = [], 0
    for first, last in spans:
        out.append(raw[done:bounds[first][0]])
        done = bounds[last - 1][1]
    return b"".join([*out, raw[done:]]).decode()
