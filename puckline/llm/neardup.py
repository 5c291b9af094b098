"""Operator 10, MinHash near-dedup: odd sketches verify banded candidates.

A document's set is its distinct five-word shingles, as 64-bit numbers.  Its
MinHash samples are folded into an odd sketch: sample i with value v flips bit
hash(i, v), so the XOR of two sketches shows how many samples differ, and its
population count estimates a high similarity well.  Documents that share a
band of samples are candidates; the sketch drops pairs far below the
threshold, and the others are confirmed on the full sets.

Only links that join components are needed, so the members of a bucket are
first compared with one leader each.  Buckets whose members are then still in
several components are compared block by block until every pair of different
components has been decided.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puckline.llm.common import Stages, null_safe_join, text_hashes

SHINGLE = 5
PERCENT = 75
#: A pair of similarity 0.75 shares none of 32 bands of 4 samples with a chance of 5e-6.
BANDS, ROWS = 32, 4
#: Samples and bits of a sketch.
SAMPLES, BITS = 512, 2048
#: Sketches that differ in more bits are dropped: as many as a similarity of 0.62 gives, five
#: standard deviations (of samples and sketch together) below 0.75.
MOST_BITS = round(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - 0.62))))
#: Members of a bucket that one task compares with as many others.
BLOCK = 2_000
#: Members that meet one copy of their leader's set.
CELL = 2_000

_UPPER = bytes(range(65, 91))
_FOLD = bytes(b + 32 if b in _UPPER else b for b in range(256))
_RANDOM = np.random.default_rng(20)


def _odd(count: int, bits: int) -> np.ndarray:
    return _RANDOM.integers(0, 2**bits, count, dtype=np.uint64) | np.uint64(1)


_WORD_MUL, _BAND_MUL = _odd(SHINGLE, 64), _odd(ROWS, 64)
_SAMPLE_MUL = _odd(SAMPLES, 32).astype(np.uint32)[:, None]
_SAMPLE_ADD = _odd(SAMPLES, 32).astype(np.uint32)[:, None]
_SAMPLE_SALT, _BAND_SALT = _odd(SAMPLES, 64), _odd(BANDS, 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    """Word -> 64-bit hash, remembered while the table stays small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: bytes | None, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct shingles of the words [^\\x20\\x09-\\x0D]+, A-Z in lower case.

    Fewer than five words are one shingle; no words, or a null text, none.
    """
    word = text.translate(_FOLD).split() if text else []
    if not word:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, word), dtype=np.uint64, count=len(word))
    wide = min(SHINGLE, len(h))
    total = np.full(len(h) - wide + 1, wide, dtype=np.uint64)
    for j in range(wide):
        total += h[j:len(h) - wide + 1 + j] * _WORD_MUL[j]
    return np.unique(_mix(total))


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples: for each of 512 permutations the least number of the set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 512):
        out = np.minimum(out, (low[None, at:at + 512] * _SAMPLE_MUL + _SAMPLE_ADD).min(axis=1))
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    """One 64-bit number per band; the band's number is mixed in."""
    return _mix((sample[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64) * _BAND_MUL).sum(axis=1) + _BAND_SALT).view(np.int64)


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parity of how many samples fall on each bit, as 32 64-bit numbers."""
    bit = (_mix(sample.astype(np.uint64) * _SAMPLE_SALT + _SAMPLE_SALT) >> np.uint64(64 - BITS.bit_length() + 1))
    return np.packbits(np.bincount(bit.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def is_link(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets are similar enough, by exact counts."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        sizes, digests, keys, sketches = [], [], [], []
        for text in batch.column("text"):
            shingles = shingle_set(text.as_py(), hashes)
            sizes.append(len(shingles))
            if len(shingles):
                sample = samples(shingles)
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                keys.append(band_keys(sample))
                sketches.append(odd_sketch(sample))
            else:
                digests.append(None)
                keys.append(None)
                sketches.append(None)
        keep = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in keep), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
             pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
            names=[*keep, "n", "digest", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        sets = [shingle_set(text.as_py(), hashes).tobytes() for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(sets, pa.binary())], names=["sid", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, sid, shingles), a leader's own row before its members' -> the pairs that are links."""
    whole = np.empty(0, np.uint64)
    for batch in batches:
        ok = np.zeros(batch.num_rows, dtype=bool)
        for i, (a, sid, x) in enumerate(zip(batch.column("a").to_pylist(), batch.column("sid").to_pylist(),
                                            batch.column("shingles"), strict=True)):
            shingles = np.frombuffer(x.as_py(), np.uint64)
            if sid == a:
                whole = shingles
            else:
                ok[i] = is_link(whole, shingles)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("sid")], names=["a", "b"]).filter(pa.array(ok))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys together, from a stream in which they are adjacent."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            mine = tuple(key[begin].tolist())
            if held and mine != current:
                yield pa.Table.from_batches(held)
                held = []
            current = mine
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


class _Block:
    """Members of one bucket (or of two of its blocks), ready to be compared."""

    def __init__(self, group: pa.Table):
        self.sid = group.column("sid").to_numpy()
        self.size = group.column("n").to_numpy()
        self.block = group.column("block").to_numpy()
        flat = group.column("sketch").combine_chunks().flatten().to_numpy()
        self.sketch = flat.view(np.uint64).reshape(len(self.sid), -1)
        self.between = group.column("low")[0].as_py() != group.column("high")[0].as_py()
        self.comp = group.column("comp").to_numpy().copy()

    def partners(self, i: int) -> np.ndarray:
        """Later members in other components that the sizes and sketches do not rule out."""
        rest = np.arange(i + 1, len(self.sid))
        fit = self.comp[rest] != self.comp[i]
        if self.between:
            fit &= self.block[rest] != self.block[i]
        rest = rest[fit]
        least, most = np.minimum(self.size[rest], self.size[i]), np.maximum(self.size[rest], self.size[i])
        rest = rest[100 * least >= PERCENT * most]
        if not len(rest):
            return rest
        apart = np.bitwise_count(self.sketch[rest] ^ self.sketch[i]).sum(axis=1)
        return rest[apart <= MOST_BITS]


_TASK = ["key", "low", "high"]


def _still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that have a partner left in another component."""
    for group in _groups(batches, _TASK):
        block = _Block(group)
        open_ = np.zeros(len(block.sid), dtype=bool)
        for i in range(len(block.sid)):
            partners = block.partners(i)
            open_[partners] = True
            open_[i] |= len(partners) > 0
        if open_.any():
            found = group.select([*_TASK, "sid", "n", "block", "comp", "sketch"]).filter(pa.array(open_))
            yield from found.combine_chunks().to_batches()


def _link_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join components, confirmed on the full sets."""
    for group in _groups(batches, _TASK):
        block = _Block(group)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
        # Shingles as small numbers, so that one look-up table marks a member's set.
        known, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum([len(s) for s in sets])
        mine = np.split(flat, ends[:-1])
        mark = np.zeros(len(known), dtype=np.int64)
        links = []
        for i in range(len(sets)):
            partners = block.partners(i)
            if not len(partners):
                continue
            mark[mine[i]] = 1
            sizes = block.size[partners]
            both = np.add.reduceat(mark[np.concatenate([mine[j] for j in partners])],
                                   np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            mark[mine[i]] = 0
            for j in partners[100 * both >= PERCENT * (block.size[i] + sizes - both)].tolist():
                if block.comp[i] != block.comp[j]:
                    links.append((block.sid[i], block.sid[j]))
                    block.comp[block.comp == block.comp[j]] = block.comp[i]
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()),
                                              pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])


def components(st: Stages, edges: DataFrame) -> DataFrame:
    """(a, b) links -> (sid, root): the smallest member of each linked sid's component.

    Large-star and small-star rounds by turns: every node passes its smallest
    neighbour on to its larger and then to its smaller neighbours, until all
    edges lead straight to the roots.
    """
    current = st.put(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                     .where("u != v").distinct())

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = st.put(large.where("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
        following = st.put(small.distinct())
        now = state(following)
        st.drop(current, large)
        current = following
        if tuple(now) == tuple(before):
            return current.select(F.col("u").alias("sid"), F.col("v").alias("root"))
        before = now


def _beside_leaders(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Full sets of (leader a, member b) pairs, in cells of some CELL members of
    one leader: a cell holds its leader's set once, before those of the members."""
    cells = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells"))
    members = pairs.join(cells, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("cells")).alias("cell"), F.lit(True).alias("member"), F.col("b").alias("sid"))
    leaders = cells.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"),
                           F.lit(False).alias("member"), F.col("a").alias("sid"))
    return (members.unionByName(leaders).join(sets, "sid")
            .repartition("a", "cell").sortWithinPartitions("a", "cell", "member"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of near-duplicate documents among all rows of ``docs`` (doc_id, text).

    Two rows are linked if 100 * shared >= 75 * all of their shingles; rows
    without words are linked with nothing.  Returns doc_id, n_shingles,
    component_id (the smallest doc_id of the component), kept (doc_id is
    component_id), and the text's hashes ``h1`` and ``h2``.  A null doc_id comes
    after all others: a component that has no other id has a null component_id
    and its rows are kept.  Repeated rows get a row each.  An empty table
    gives an empty result.
    """
    st = Stages(docs.sparkSession, "neardup")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"),
                       *text_hashes("text"))
    signed = st.put(base.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(
        _signatures,
        "doc_id long, h1 long, h2 int, rid long, n long, digest binary, bands array<long>, sketch array<long>"))

    # Equal sets are one member, named by its first row.
    first = (signed.where("n > 0").groupBy("digest")
             .agg(F.min("rid").alias("sid"), F.min("doc_id").alias("least_id")))
    named = st.put(first)
    distinct = st.put(signed.drop("digest").join(named.select("sid"), F.col("rid") == F.col("sid"))
                      .select("sid", "doc_id", "h1", "h2", "n", "sketch", "bands"))

    # Buckets with several members; the first member leads.
    banded = distinct.select("sid", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("sid").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = st.put(banded.join(buckets, "key"))
    sketches = distinct.select("sid", "n", "sketch")

    # Full sets of all that share a bucket, from their texts.
    wanted = distinct.join(members.select("sid").distinct(), "sid").select("sid", "doc_id", "h1", "h2")
    sets = st.put(null_safe_join(base, wanted, ["doc_id", "h1", "h2"])
                  .dropDuplicates(["sid"]).select("sid", "text").mapInArrow(_sets, "sid long, shingles binary"))

    # Every member against its leader.
    led = members.where("sid != leader").select(F.col("leader").alias("a"), F.col("sid").alias("b")).distinct()
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                        F.lit(0), lambda acc, x: acc + x)
    side = {s: sketches.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
            for s in ("a", "b")}
    near = st.put(led.join(side["a"], "a").join(side["b"], "b")
                  .where((100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & (apart <= MOST_BITS))
                  .select("a", "b"))
    links = st.put(_beside_leaders(near, sets).mapInArrow(_confirm, "a long, b long"))
    roots = components(st, links)

    # Buckets that still hold several components: all their pairs but the leader's.
    placed = st.put(members.join(roots, "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root"))
    several = (placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"))
               .where("c1 != c2").select("key"))
    blocks = F.ceil(F.col("m") / BLOCK)
    rest = (placed.where((F.col("m") > 2) & (F.col("sid") != F.col("leader"))).join(several, "key")
            .withColumn("block", F.pmod(F.xxhash64("sid", "key"), blocks))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)))
            .select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                    "block", "sid", "comp")
            .join(sketches, "sid"))

    def by_task(df: DataFrame) -> DataFrame:
        return df.repartition(*_TASK).sortWithinPartitions(*_TASK)

    columns = "key long, low long, high long, sid long, n long, block long, comp long, sketch array<long>"
    open_ = st.put(by_task(rest).mapInArrow(_still_open, columns))
    more = by_task(open_.join(sets, "sid")).mapInArrow(_link_members, "a long, b long")
    all_links = st.put(roots.select(F.col("sid").alias("a"), F.col("root").alias("b")).unionByName(more))
    st.drop(distinct, members, sets, near, links, placed, open_)
    roots = components(st, all_links)
    st.drop(all_links)

    rooted = named.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_digest = rooted.join(least, "root").select("digest", "component_id", "root")
    return (signed.select("doc_id", "h1", "h2", "n", "digest").join(of_digest, "digest", "left")
            .withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
            .select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "h1", "h2",
                    F.when(F.col("n") > 0, F.col("root")).alias("root")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: exactly one row of each
    component, the one with the smallest doc_id (a null id last, equal ids by
    the hash of the text).  Rows that share doc_id and text are one document;
    documents without words are linked with nothing and stay.
    """
    found = near_duplicates(docs)
    key = ["doc_id", "h1", "h2"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), *key)).alias("k")
    linked = found.where(F.col("root").isNotNull()).groupBy("root").agg(first).select("k.doc_id", "k.h1", "k.h2")
    kept = linked.unionByName(found.where(F.col("root").isNull()).select(*key).distinct())
    hashed = docs.select(F.col("doc_id"), *text_hashes("text"), F.struct("*").alias("row"))
    return null_safe_join(hashed, kept, key, "left_semi").dropDuplicates(key).select("row.*")
