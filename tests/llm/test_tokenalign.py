import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from puckline.llm import tokenalign as ta
from tests.llm.conftest import AWKWARD, DOCUMENTS

PARTS = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "é", "一", "\U0001f600", "▁", "'s", "<s>", "</s>", "<|endoftext|>",
         "<0x0A>", "12", "\x00", "　", "\xa0", "﻿", "x_", ".", ",", "--", "ﬁ", "​", "don't", "Ⅷ", "²", "!", "word. Next", "ö,"]


def contents():
    return open(ta.FILE_A, "rb").read(), open(ta.FILE_B, "rb").read()


@pytest.fixture(scope="module")
def plain():
    """Brute force: whole texts, byte owners, no cuts and no spans."""
    a = Tokenizer.from_file(ta.FILE_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=ta.FILE_B)
    byte_of = ta._byte_of()

    def one(text):
        if not text:
            return None
        whole = f" {text}".encode()
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                   for i in ids_b for p in [b.id_to_piece(i)]]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return None
        own_a = [k for k, x in enumerate(bytes_a) for _ in x]
        own_b = [k for k, x in enumerate(bytes_b) for _ in x]
        links = sorted(set(zip(own_a, own_b, strict=True)))
        cuts = [i + 1 for i in range(len(whole))
                if i + 1 == len(whole) or own_a[i] != own_a[i + 1] and own_b[i] != own_b[i + 1]]
        groups, at = [], 0
        for c in cuts:
            groups.append(",".join(str(ids_a[k]) for k in sorted(set(own_a[at:c]))) + "|"
                          + ",".join(str(ids_b[k]) for k in sorted(set(own_b[at:c]))))
            at = c
        return len(ids_a), len(ids_b), [(ids_a[i], ids_b[j]) for i, j in links], groups

    return one


def expected(plain, rows):
    found = [(i, plain(t)) for i, t in rows]
    held = Counter(p for _, x in found if x for p in set(x[2]))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    for doc_id, x in found:
        if x is None:
            yield (doc_id, 0, 0, 0, 0, 0, 0, "")
            continue
        n_a, n_b, links, groups = x
        yield (doc_id, n_a, n_b, len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
               hashlib.sha256(";".join(groups).encode()).hexdigest())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_brute_force(spark, documents, plain):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert rows_of(ta.align(documents)) == sorted(expected(plain, rows), key=repr)


def test_odd_texts_against_brute_force(spark, plain):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 25)))) for i in range(1500)]
    out = rows_of(ta.align(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == sorted(expected(plain, rows), key=repr)
    assert any(r[1] == 0 for r in out)


def test_cuts_change_nothing(monkeypatch):
    own, whole = ta.Aligner(*contents()), ta.Aligner(*contents())
    assert own.cuts
    whole.cuts = False
    monkeypatch.setattr(ta, "JOINED", 3)
    monkeypatch.setattr(ta, "KEPT", 20)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 25))) for _ in range(4000)]

    def joined(found):
        return b"".join(e[0] for e in found), ";".join(e[1] for e in found), sum(e[2] for e in found), sum(e[3] for e in found)

    for k in range(0, len(texts), 100):
        part = texts[k:k + 100]
        assert [joined(x) for x in own.entries(part)] == [joined(x) for x in whole.entries(part)]


def test_no_cuts_where_a_piece_reaches_over(monkeypatch):
    own = ta.Aligner(*contents())
    pieces = [own.b.id_to_piece(i) for i in range(own.size_b)]
    conf = {"pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}}
    assert own._cuts_hold(conf, pieces)
    pieces[-1] = "of▁the"
    assert not own._cuts_hold(conf, pieces)
    assert not own._cuts_hold({}, pieces[:-1])


def test_pair_counts_in_slices(spark, documents, monkeypatch):
    whole = rows_of(ta.align(documents))
    monkeypatch.setattr(ta, "PAIRS", 5000)
    monkeypatch.setattr(ta, "PENDING", 2000)
    assert rows_of(ta.align(documents)) == whole


def test_groups_spell_the_digest(spark, documents):
    out = ta.align(documents, with_groups=True).select(
        "groups_sha256", F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("").alias("again"),
        "n_groups", F.size(F.split("groups", ";")).alias("n")).collect()
    assert all(r.groups_sha256 == r.again and r.n_groups in (r.n, 0) for r in out)


def test_awkward_documents(spark, awkward, no_documents, plain):
    rows = [(r[0], r[1]) for r in AWKWARD]
    assert rows_of(ta.align(awkward)) == sorted(expected(plain, rows), key=repr)
    assert ta.align(no_documents).collect() == []
    none = spark.createDataFrame([(1, None, "en", "a", 0)], DOCUMENTS)
    assert rows_of(ta.align(none)) == [(1, 0, 0, 0, 0, 0, 0, "")]
