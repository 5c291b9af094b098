"""Operator 11, cross-tokenizer alignment: tokens of two tokenizers over the same bytes.

Tokenizer A is a byte-level BPE, tokenizer B a sentencepiece model with byte
fallback.  A's character offsets and B's piece spans are the coarse cuts; where
a token holds only a part of a character (a byte of a multibyte character, a
byte-fallback token) its decoded bytes say where it ends.  Byte offsets at
which tokens of both end cut them into groups; a token of A and one of B are
linked if their byte ranges overlap.

A text is cut into chunks that both tokenizers encode on their own (before a
space or a line break that follows a visible character, and between a letter
and a full stop or comma), so a chunk's tokens, groups and links are worked out
once and looked up for its repetitions.  The
cut is used only if the vocabularies prove it: A splits words by its pattern
and no piece of B goes on after such a place.  Otherwise the whole text is one
chunk.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from puckline.llm.common import Stages

#: Default vocabulary files.
FILE_A = "/opt/tokenizers/byte_bpe_50k.json"
FILE_B = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Before white space that follows a visible character (ASCII, letters, digits: none of them is white
#: space for any tokenizer), and before a full stop or comma that follows a Latin letter.
CUT = re.compile(r"(?<=[!-~\w])(?= +[^ ]|\n[!-~\w])|(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,])")
#: Chunks kept of each of two generations, and the longest chunk that is kept.
KEPT, LONGEST = 250_000, 100
#: Chunks that are encoded as one text.
JOINED = 4096
#: Characters of texts that are encoded at once.
AT_ONCE = 1 << 20
#: Id pairs whose counts go to the tasks at once.
PAIRS = 2_000_000
#: Distinct id pairs that a task sums before it hands them on.
PENDING = 1_000_000


def _byte_of() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 stands for itself, the other bytes for the code points from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, from the contents of their files."""

    def __init__(self, file_a: bytes, file_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(file_a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        byte_of = _byte_of()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = all(c in byte_of for c in token)
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_b = len(pieces)
        self.length_a, self.length_b = (np.array([len(t) for t in x]) for x in (self.bytes_a, self.bytes_b))
        self.code = np.dtype("<u4" if len(self.bytes_a) * self.size_b < 1 << 32 else "<u8")
        self.cuts = self._cuts_hold(json.loads(file_a), pieces)
        self.new: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def _cuts_hold(self, conf: dict, pieces: list[str]) -> bool:
        """Whether no token of either reaches over a place where ``CUT`` cuts."""
        first = conf.get("pre_tokenizer") or {}
        words = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
        plain = conf.get("normalizer") is None and conf.get("post_processor") is None
        usual = [p for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))]
        inside = any(SPACE in p.lstrip(SPACE) or "\n" in p or " " in p or CUT.search(p) for p in usual)
        # A prefix is added, white space stays, and nothing else is normalised.
        steady = all(self.b.normalize(x) == SPACE + x.replace(" ", SPACE) for x in ("a  b ", "  a", "a\n b", "ﬁ²", "é"))
        return bool(words and plain and steady and not inside)

    def chunks(self, text: str) -> list[str]:
        """Chunks of a space and the text."""
        whole = f" {text}"
        return CUT.split(whole) if self.cuts else [whole]

    def tokens(self, chunks: list[str]) -> Iterator[tuple | None]:
        """(A ids, A ends, B ids, B ends) of each chunk, ends in bytes; None if
        the tokens' bytes are not the chunk's."""
        in_a = self.a.encode_batch(chunks, add_special_tokens=False)
        in_b = self.b.encode([_for_b(c)[0] for c in chunks], return_type="proto", num_threads=1)
        for chunk, a, b in zip(chunks, in_a, in_b, strict=True):
            raw = chunk.encode()
            ids_a, ids_b = a.ids, [p.id for p in b.pieces]
            _, own, shift = _for_b(chunk)
            if len(raw) == len(chunk):
                coarse_a = a.offsets
            else:
                at = [0, *accumulate(len(c.encode()) for c in chunk)]
                coarse_a = [(at[s], at[e]) for s, e in a.offsets]
            coarse_b = [(max(0, p.begin + shift), p.end + shift) for p in b.pieces][own:]
            if coarse_b:  # the first piece holds the space that B adds
                coarse_b[0] = (0, coarse_b[0][1])
            ids_b = ids_b[own:]
            ends_a = _refine(raw, [self.bytes_a[i] for i in ids_a], coarse_a)
            ends_b = _refine(raw, [self.bytes_b[i] for i in ids_b], coarse_b)
            yield None if ends_a is None or ends_b is None else (ids_a, ends_a, ids_b, ends_b)

    def _entry(self, found: tuple | None) -> tuple | None:
        """(links as packed codes, groups as text, A tokens, B tokens) of a chunk."""
        if found is None:
            return None
        ids_a, ends_a, ids_b, ends_b = found
        links, groups = link(ids_a, ends_a, ids_b, ends_b)
        codes = np.array([a * self.size_b + b for a, b in links], dtype=self.code).tobytes()
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y, _ in groups)
        return codes, text, len(ids_a), len(ids_b)

    def _joined(self, chunks: list[str]) -> list[tuple | None]:
        """Entries of chunks that begin with white space and end in a visible
        character, encoded as one text: it is cut again between them.  Each stretch between neighbouring
        token ends of either is one link; common ends are the groups' ends."""
        text = "".join(chunks)
        raw = text.encode()
        a = self.a.encode(text, add_special_tokens=False)
        given, own, shift = _for_b(text)
        b = self.b.encode(given, return_type="proto", num_threads=1).pieces
        ids_a = np.array(a.ids, dtype=np.int64)
        ids_b = np.array([p.id for p in b], dtype=np.int64)
        spans_b = np.array([(p.begin, p.end) for p in b], dtype=np.int64)[own:] + shift
        ids_b = ids_b[own:]
        spans_b[:1, 0] = 0
        if not (b"".join([self.bytes_a[i] for i in a.ids]) == raw == b"".join([self.bytes_b[i] for i in ids_b.tolist()])):
            return [self._entry(x) for x in self.tokens(chunks)]
        code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        at = np.zeros(len(code) + 1, dtype=np.int64)  # of characters, in bytes
        np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), out=at[1:])
        ends_a = _refined(at[np.array(a.offsets, dtype=np.int64)], self.length_a[ids_a])
        ends_b = _refined(spans_b, self.length_b[ids_b])
        cuts = np.union1d(ends_a, ends_b)
        codes = (ids_a[np.searchsorted(ends_a, cuts)] * self.size_b + ids_b[np.searchsorted(ends_b, cuts)]).astype(self.code).tobytes()
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        in_a, in_b = ([0, *(np.searchsorted(x, common) + 1).tolist()] for x in (ends_a, ends_b))
        text_a, text_b = list(map(str, a.ids)), list(map(str, ids_b.tolist()))
        groups = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}"
                  for i, j, k, m in zip(in_a, in_a[1:], in_b, in_b[1:], strict=False)]
        ends = at[np.cumsum([len(c) for c in chunks])]
        n_a, n_b, n_cuts, n_groups = ([0, *(np.searchsorted(x, ends) + 1).tolist()] for x in (ends_a, ends_b, cuts, common))
        width = self.code.itemsize
        return [(codes[n_cuts[k] * width:n_cuts[k + 1] * width], ";".join(groups[n_groups[k]:n_groups[k + 1]]),
                 n_a[k + 1] - n_a[k], n_b[k + 1] - n_b[k]) for k in range(len(chunks))]

    def _encoded(self, chunks: list[str]) -> Iterator[tuple[str, tuple | None]]:
        """Chunks and their entries."""
        visible = [c for c in chunks if self.cuts and c[0] in " \n" and (c[-1].isalnum() or "!" <= c[-1] <= "~")]
        for k in range(0, len(visible), JOINED):
            part = visible[k:k + JOINED]
            yield from zip(part, self._joined(part), strict=True)
        rest = set(chunks) - set(visible)
        yield from zip(rest, map(self._entry, self.tokens(list(rest))), strict=True)

    def look_up(self, texts: list[list[str]]) -> dict[str, tuple | None]:
        """What is known of all chunks of ``texts``; new ones are encoded in one go."""
        wanted = set().union(*texts)
        out, missing = {}, []
        for c in wanted:
            if c in self.new:
                out[c] = self.new[c]
            elif c in self.old:
                out[c] = self.new[c] = self.old[c]
            else:
                missing.append(c)
        for c, entry in self._encoded(missing):
            out[c] = entry
            if len(c) <= LONGEST:
                self.new[c] = entry
        if len(self.new) > KEPT:
            self.old, self.new = self.new, {}
        return out

    def entries(self, texts: list[str | None]) -> Iterator[list[tuple]]:
        """Entries of the chunks of each text; none for a text that is null,
        empty or not what its tokens' bytes say."""
        cut = [self.chunks(t) if t else [] for t in texts]
        known = self.look_up(cut)
        for text, chunks in zip(texts, cut, strict=True):
            found = [known[c] for c in chunks]
            if None in found:  # the bytes are compared as a whole
                whole = self._entry(next(self.tokens([f" {text}"])))
                found = [] if whole is None else [whole]
            yield found


def _for_b(chunk: str) -> tuple[str, int, int]:
    """What B is given for a chunk, how many first pieces are not the chunk's,
    and where its first byte is.  B puts a space before what it encodes: the
    chunk's own if it begins with one; else a line break, the chunk's or one
    that is put before it, keeps that space apart."""
    if chunk[0] == " ":
        return chunk[1:], 0, 1
    return (chunk, 1, 0) if chunk[0] == "\n" else (f"\n{chunk}", 2, -1)


def _refine(raw: bytes, tokens: list[bytes], coarse: list[tuple[int, int]]) -> list[int] | None:
    """Ends of tokens in bytes; None if the tokens' bytes are not ``raw``.

    A coarse span as long as its token is right; a token that holds a part of
    the span's characters ends where its decoded bytes do."""
    if b"".join(tokens) != raw:
        return None
    ends, at = [], 0
    for token, (begin, end) in zip(tokens, coarse, strict=True):
        at = end if begin == at and end - begin == len(token) else at + len(token)
        ends.append(at)
    return ends


def _refined(coarse: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``_refine`` for the spans of many tokens that spell their text."""
    return np.where(coarse[:, 1] - coarse[:, 0] == length, coarse[:, 1], np.cumsum(length))


def link(ids_a: list[int], ends_a: list[int], ids_b: list[int], ends_b: list[int]) -> tuple[list, list]:
    """Pairs of tokens whose byte ranges overlap, and the groups (A ids, B ids,
    end) between offsets where tokens of both end."""
    links, groups = [], []
    i = j = first_a = first_b = 0
    while i < len(ids_a):
        links.append((ids_a[i], ids_b[j]))
        end_a, end_b = ends_a[i], ends_b[j]
        i += end_a <= end_b
        j += end_b <= end_a
        if end_a == end_b:
            groups.append((ids_a[first_a:i], ids_b[first_b:j], end_a))
            first_a, first_b = i, j
    return links, groups


_aligners: dict[tuple[bytes, bytes], Aligner] = {}


def _aligner(file_a: bytes, file_b: bytes) -> Aligner:
    """One aligner for each worker process and pair of files."""
    key = (hashlib.sha256(file_a).digest(), hashlib.sha256(file_b).digest())
    if key not in _aligners:
        _aligners[key] = Aligner(file_a, file_b)
    return _aligners[key]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``AT_ONCE`` characters."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= AT_ONCE:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encoder(files, with_groups: bool):
    """(rid, doc_id, text) -> counts, digest and packed links of every row."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(*files.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts = part.column("text").to_pylist()
                rows = []
                for begin, end in _slices(texts):
                    for found in own.entries(texts[begin:end]):
                        groups = ";".join([e[1] for e in found])
                        codes = np.frombuffer(b"".join([e[0] for e in found]), dtype=own.code)
                        pairs, times = np.unique(codes, return_counts=True)
                        rows.append((sum([e[2] for e in found]), sum([e[3] for e in found]), groups.count("|"), len(codes),
                                     hashlib.sha256(groups.encode()).hexdigest() if found else "",
                                     pairs.tobytes(),
                                     times.astype("<u4").tobytes(), groups))
                n_a, n_b, n_groups, n_links, digest, pairs, times, groups = zip(*rows, strict=True)
                columns = [part.column("rid"), part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)),
                           pa.array(digest, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
                names = ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                if with_groups:
                    columns, names = [*columns, pa.array(groups, pa.string())], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return encode


def _counter(code: np.dtype):
    """Packed pairs of documents -> (pair, documents), summed within the task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pairs, where = np.unique(np.concatenate([p for p, _ in pending]), return_inverse=True)
            return pairs, np.bincount(where, weights=np.concatenate([n for _, n in pending])).astype(np.int64)

        def emit(pairs, n):
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            held = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), dtype=code)
            pairs, n = np.unique(held, return_counts=True)
            pending.append((pairs, n.astype(np.int64)))
            rows += len(pairs)
            if rows > PENDING:
                pending = [summed()]
                rows = len(pending[0][0])
                if rows > PENDING // 2:
                    yield emit(*pending.pop())
                    rows = 0
        if pending:
            yield emit(*summed())

    return count


def _scorer(table, code: np.dtype):
    """Packed pairs and times -> links whose pair is its A id's most frequent, and the sum of counts."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = table.value
        for batch in batches:
            packed = batch.column("pairs").to_pylist()
            row = np.repeat(np.arange(len(packed)), [len(x) // code.itemsize for x in packed])
            pairs = np.frombuffer(b"".join(packed), dtype=code)
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), dtype="<u4").astype(np.int64)
            at = np.searchsorted(known, pairs)
            at[at == len(known)] = 0
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), dtype=bool)
            row, times, at = row[hit], times[hit], at[hit]
            sums = np.zeros((2, len(packed)), dtype=np.int64)
            np.add.at(sums[0], row, times * best[at])
            np.add.at(sums[1], row, times * n[at])
            rest = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(sums[0]), pa.array(sums[1])],
                                             names=[*rest, "n_best", "count_sum"])

    return score


def pair_counts(encoded: DataFrame, size_b: int, code: np.dtype) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked, and whether no pair of its A id has more.

    A pair is A id * ``size_b`` + B id.  An A id has at most ``size_b`` pairs,
    so the window over one is bounded by B's vocabulary."""
    held = encoded.select("pairs").mapInArrow(_counter(code), "pair long, n long")
    summed = held.groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.floor(F.col("pair") / F.lit(size_b)))
    return summed.withColumn("best", F.col("n") == F.max("n").over(of_a))


def _scored(spark: SparkSession, rows: DataFrame, counts: DataFrame, code: np.dtype) -> DataFrame:
    kept = [f for f in rows.schema.fields if f.name not in ("pairs", "times")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    held = counts.toArrow()
    pairs = held.column("pair").to_numpy()
    order = np.argsort(pairs)
    table = (pairs[order].astype(code), held.column("n").to_numpy()[order], held.column("best").to_numpy()[order])
    return rows.mapInArrow(_scorer(spark.sparkContext.broadcast(table), code), f"{schema}, n_best long, count_sum long")


def align(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B, with_groups: bool = False) -> DataFrame:
    """Align the tokens of both tokenizers over every text of ``docs`` (doc_id, text).

    Returns, for every row, doc_id, n_a and n_b (tokens), n_groups, n_links,
    n_best (links whose id pair is linked in as many documents as any pair of
    its A id), count_sum (documents that hold a link's pair, summed over the
    links) and groups_sha256 (of ``a1,a2|b1;a3|b2``); ``with_groups`` adds that
    text as ``groups``.  A null or empty text, and a text that the tokens of
    one tokenizer do not spell, has no tokens: zeros and an empty digest.
    Repeated rows count each, null ids like others, an empty table gives an
    empty result; further columns are ignored.

    The files are read by the driver and sent to the tasks.  The pair counts go
    to the tasks ``PAIRS`` at a time; more pairs take further passes over the
    packed links, whose results are added up.
    """
    spark = docs.sparkSession
    st = Stages(spark, "tokenalign")
    contents = (Path(file_a).read_bytes(), Path(file_b).read_bytes())
    own = _aligner(*contents)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = ("rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "pairs binary, times binary" + ", groups string" * with_groups)
    encoded = st.put(rows.mapInArrow(_encoder(spark.sparkContext.broadcast(contents), with_groups), schema))
    counts = st.put(pair_counts(encoded, own.size_b, own.code))
    slices = max(1, -(-counts.count() // PAIRS))
    if slices == 1:
        out = _scored(spark, encoded, counts, own.code)
    else:
        parts = [_scored(spark, encoded.select("rid", "pairs", "times"),
                         counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k), own.code) for k in range(slices)]
        added = parts[0]
        for part in parts[1:]:
            added = added.unionByName(part)
        added = added.groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        out = encoded.drop("pairs", "times").join(added, "rid")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
                      *["groups"] * with_groups)
