import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from puckline.llm import convtrie as ct

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    """Brute force: every prefix in a dictionary."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        root = c - int(c / 20) * 20  # the remainder has the sign of c
        built = own.get(c - root, [])[:h] + turns[h:]
        for d in range(len(built) + 1):
            members.setdefault(tuple(built[:d]), []).append((c, d == len(built)))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in below)
    for p, found in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, end in found if end))
        yield (min(found)[0], len(p), min(members[p[:-1]])[0] if p else None, len(found), len(kids.get(p, [])), leaves[p], saved[p],
               hashlib.sha256(ends.encode()).hexdigest())


def some_rows(seed, n=300, turns=6):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-200, 2000), n):
        for k in range(rng.choice([1, 2, 3, turns])):
            out.append((c, k, rng.choice(["user", "assistant"]), rng.choice(["a b", "a", "c  d e", "", "b b"])))
    return out


def same(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = sorted((tuple(r) for r in ct.prefix_trie(df).select(COLUMNS).collect()), key=repr)
    assert out == sorted(plain_trie(rows), key=repr)


def test_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    same(spark, rows)


@pytest.mark.parametrize("turns_per_shard,fan,wide", [(200_000, 64, 16), (40, 64, 2), (25, 3, 1), (7, 2, 3)])
def test_shards_and_matrices_of_any_size(spark, monkeypatch, turns_per_shard, fan, wide):
    monkeypatch.setattr(ct, "TURNS_PER_SHARD", turns_per_shard)
    monkeypatch.setattr(ct, "FAN", fan)
    monkeypatch.setattr(ct, "WIDE", wide)
    monkeypatch.setattr(ct, "IDS_PER_ROW", 3)
    same(spark, some_rows(turns_per_shard))


def test_one_sequence_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ct, "TURNS_PER_SHARD", 60)
    monkeypatch.setattr(ct, "FAN", 4)
    monkeypatch.setattr(ct, "IDS_PER_ROW", 5)
    rows = [(c, k, "user", f"same {k}") for c in range(0, 4000, 20) for k in range(3)]
    rows += [(c, k, "user", f"same {k}" if k < 2 else f"own {c}") for c in range(5, 500, 20) for k in range(40)]
    same(spark, rows)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ct, "BROADCAST_NODES", 0)
    monkeypatch.setattr(ct, "TURNS_PER_SHARD", 100)
    same(spark, some_rows(5))


def test_awkward_conversations(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, "", "x"), (None, 0, "user", "x"),
            (None, None, None, None), (3, 5, "user", "y z"), (3, -1, "user", "long " * 50_000), (-41, 0, "user", "x"), (-40, 0, "user", "x"),
            (19, 0, "a", "b"), (119, 0, "ab", ""), (119, 1, "a", "b"), (9_000_000_000_000_000_000, 0, "user", "x")]
    same(spark, rows)
    clash = spark.createDataFrame(rows, SCHEMA).select(
        "*", *[F.lit("x").alias(c) for c in ("turns", "id", "words", "path", "root", "head", "shard", "depth", "key", "kind")])
    assert sorted(map(repr, ct.prefix_trie(clash).collect())) == sorted(
        map(repr, ct.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert ct.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ct.prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)).collect() == []


def test_sql(spark):
    con = duckdb.connect()
    for df in (spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"), spark.createDataFrame(some_rows(9), SCHEMA)):
        con.register("conversations", df.toArrow())
        want = sorted(map(repr, con.execute(ct.ORACLE_SQL).fetchall()))
        assert sorted(repr(tuple(r)) for r in ct.prefix_trie(df).select(COLUMNS).collect()) == want
