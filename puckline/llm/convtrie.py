"""Operator 12, conversation prefix trie: padded turn-id matrices, sorted with numpy.

Conversations are rebuilt and become rows (conv_id, path, words): a path holds
16 bytes per turn, the MD5 of its role and text, so paths compare as bytes and
the texts are shuffled no further.  Rows are dealt to shards by ranges of
(path, conv_id).  A shard ranks its turns, pads them to a matrix a few depths
wide at a time, sorts it with ``lexsort`` and compares neighbouring rows; the
change masks, OR-accumulated over the columns, mark where a node of each depth
begins, and ``reduceat`` aggregates the rows of all nodes of a depth at once.

Only nodes on the path of a shard's first or last row can reach into another
shard.  They stay open: neighbouring shards' open nodes are merged ``FAN``
shards at a time, which closes all but those at the ends of the merged range,
until one range is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puckline.llm.common import Stages

#: Every ``ROOTED``-th conversation gives the first turns of those up to the next; at most ``HEAD`` - 1 of them.
ROOTED, HEAD = 20, 4
#: Turns that a shard holds on average, and shards whose open nodes are merged at once.
TURNS_PER_SHARD = 200_000
FAN = 64
#: Depths of one padded matrix.
WIDE = 16
#: Conversation ids in one row, where they are hashed over several shards.
IDS_PER_ROW = 4096
#: Open nodes up to this number are broadcast to the nodes below them.
BROADCAST_NODES = 100_000
ID = 16
NOTHING = hashlib.sha256(b"").hexdigest()
WORDS = "[^\\x20\\x09-\\x0D]+"

NODE = ("depth long, key binary, parent_key binary, conv_id long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, ends_sha256 string")
PART = f"shard long, block long, {NODE}, words long, side int, ids string, kind string"
_ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32()}
_TYPES = {name: _ARROW[kind] for name, kind in (x.split() for x in PART.split(", "))}
FIRST, LAST = 1, 2


def _batch(n: int, **columns) -> pa.RecordBatch:
    """A batch of PART rows; columns that are not given are null."""
    arrays = [pa.array(columns[c], kind) if c in columns else pa.nulls(n, kind) for c, kind in _TYPES.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(_TYPES))


# ----------------------------------------------------------------- conversations

def rebuild(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words): every conversation's turns after its first
    turns were exchanged for those of its root (see ``prefix_trie``); words
    are counted per turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"),
                    F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("id"),
                    F.regexp_count(text, F.lit(WORDS)).alias("words"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    root = F.col("conv_id") - F.col("conv_id") % ROOTED
    heads = whole.where(root == F.col("conv_id")).select(F.col("conv_id").alias("root"), F.slice("turns", 1, HEAD - 1).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    joined = whole.withColumn("root", root).join(heads, "root", "left")
    empty = F.slice("turns", 1, 0)
    built = F.concat(F.slice(F.coalesce("head", empty), F.lit(1), taken), F.slice("turns", taken + 1, F.size("turns")))
    return joined.select("conv_id", built.alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("path"),
        F.transform("turns", lambda t: t["words"]).alias("words"))


# ----------------------------------------------------------------- one shard

def _ranks(paths: list[bytes]) -> np.ndarray:
    """Turns of all paths as numbers from 1 in the order of their digests."""
    pairs = np.frombuffer(b"".join(paths), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    ranked = pairs[order]
    new = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(axis=1)]) if len(ranked) else np.zeros(0, dtype=bool)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


class Level:
    """The nodes of one depth, in order, and the conversations that end there."""

    def __init__(self, parent, conv, n, words, ends_node, ends_conv, tracked):
        self.parent, self.conv, self.n, self.words = parent, conv, n, words
        self.ends_node, self.ends_conv = ends_node, ends_conv
        self.tracked = tracked  # node of the first and of the last row, or -1


def levels(conv: np.ndarray, paths: list[bytes], words: np.ndarray, tracked: tuple[int, int]) -> list[Level]:
    """Nodes by depth; ``words`` holds those of all turns, path after path."""
    length = np.array([len(p) // ID for p in paths], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    turn = _ranks(paths)
    by_conv = np.sort(conv[length == 0])
    out = [Level(np.zeros(1, np.int64), conv.min(keepdims=True), np.array([len(conv)]), np.zeros(1, np.int64),
                 np.zeros(len(by_conv), np.int64), by_conv, (0, 0))]
    rows = np.flatnonzero(length > 0)
    node = np.zeros(len(conv), dtype=np.int64)  # of each row at the depth before
    depth = 0
    while len(rows):
        at = depth + np.arange(WIDE)
        inside = at < length[rows, None]
        matrix = np.where(inside, turn[np.minimum(first[rows, None] + at, len(turn) - 1)], 0)
        order = np.lexsort((conv[rows], *matrix.T[::-1], node[rows]))
        rows, matrix = rows[order], matrix[order]
        above = node[rows]
        changed = np.column_stack([above[1:] != above[:-1], matrix[1:] != matrix[:-1]])
        begins = np.ones((len(rows), WIDE), dtype=bool)
        begins[1:] = np.logical_or.accumulate(changed, axis=1)[:, 1:]
        for column in range(WIDE):
            alive = matrix[:, column] > 0
            if not alive.any():
                break
            depth += 1
            start = np.flatnonzero(begins[:, column])
            lives = alive[start]
            number = np.where(lives, np.cumsum(lives) - 1, -1)
            here = np.repeat(number, np.diff(start, append=len(rows)))
            top = rows[start[lives]]
            ends = alive & (length[rows] == depth)
            tracked_node = np.full(len(conv), -1, dtype=np.int64)
            tracked_node[rows] = here
            out.append(Level(above[start[lives]], np.minimum.reduceat(conv[rows], start)[lives],
                             np.add.reduceat(alive.astype(np.int64), start)[lives], words[first[top] + depth - 1],
                             here[ends], conv[rows][ends], tuple(tracked_node[list(tracked)].tolist())))
            above = here
        node[rows] = above
        rows = rows[length[rows] > depth]
    return out


def prefix_keys(path: bytes) -> list[bytes]:
    """Keys of a path's nodes, from the root on."""
    digest, out = hashlib.md5(usedforsecurity=False), []
    for d in range(0, len(path) + ID, ID):
        out.append(digest.copy().digest())
        digest.update(path[d:d + ID])
    return out


def _digests(level: Level) -> list[str]:
    """SHA-256 of the ids that end at each node."""
    out = [NOTHING] * len(level.n)
    if len(level.ends_node):
        begin = np.flatnonzero(np.concatenate([[True], level.ends_node[1:] != level.ends_node[:-1]])).tolist()
        ids = list(map(str, level.ends_conv.tolist()))
        for k, z in zip(begin, [*begin[1:], len(ids)], strict=True):
            out[level.ends_node[k]] = hashlib.sha256(",".join(ids[k:z]).encode()).hexdigest()
    return out


def shard_nodes(shard: int, conv: np.ndarray, paths: list[bytes], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """PART rows of one shard: closed nodes, open ones, and the ids that end at open ones."""
    low, high = (pick(range(len(paths)), key=paths.__getitem__) for pick in (min, max))
    keys = [dict(enumerate(prefix_keys(paths[r]))) for r in (low, high)]
    found = levels(conv, paths, words, (low, high))
    kids = leaves = saved = np.zeros(0, dtype=np.int64)
    for depth in range(len(found) - 1, -1, -1):
        level = found[depth]
        size = len(level.n)
        is_open = np.zeros(size, dtype=bool)
        is_open[[k for k in level.tracked if k >= 0]] = True
        if depth + 1 == len(found):
            kids, leaves, saved = (np.zeros(size, dtype=np.int64) for _ in range(3))
        closed = np.flatnonzero(~is_open)
        leaves = leaves + (~is_open & (kids == 0))
        saved = saved + np.where(is_open, 0, (level.n - 1) * level.words)
        up = found[depth - 1] if depth else None
        above_open = {k: keys[side][depth - 1] for side, k in enumerate(up.tracked) if k >= 0} if depth else {}
        if len(closed):
            parents = level.parent[closed].tolist()
            sums = _digests(level)
            yield _batch(
                len(closed), depth=np.full(len(closed), depth), parent_key=[above_open.get(p) for p in parents],
                conv_id=level.conv[closed], parent_conv_id=[None if p in above_open else c for p, c in
                                                            zip(parents, up.conv[level.parent[closed]].tolist(), strict=True)],
                n_convs=level.n[closed], n_children=kids[closed], n_leaves=leaves[closed], saved_tokens=saved[closed],
                ends_sha256=[sums[k] for k in closed.tolist()], kind=["closed"] * len(closed))
        for k in np.flatnonzero(is_open).tolist():
            side = sum(bit for bit, t in zip((FIRST, LAST), level.tracked, strict=True) if t == k)
            key = keys[0 if side & FIRST else 1][depth]
            yield _batch(1, shard=[shard], depth=[depth], key=[key], parent_key=[above_open[level.parent[k]] if depth else None],
                         conv_id=[level.conv[k]], n_convs=[level.n[k]], n_children=[kids[k]], n_leaves=[leaves[k]],
                         saved_tokens=[saved[k]], words=[level.words[k]], side=[side], kind=["open"])
            mine = list(map(str, level.ends_conv[level.ends_node == k].tolist()))
            for at in range(0, len(mine), IDS_PER_ROW):
                yield _batch(1, shard=[shard], block=[at], key=[key], ids=[",".join(mine[at:at + IDS_PER_ROW])], kind=["ends"])
        if depth:
            more = [np.zeros(len(up.n), dtype=np.int64) for _ in range(3)]
            for into, part in zip(more, (np.ones(size, dtype=np.int64), leaves, saved), strict=True):
                np.add.at(into, level.parent[closed], part[closed])
            kids, leaves, saved = more


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task is one shard: a range of (path, conv_id)."""
    shard, conv, paths, words = None, [], [], []
    for batch in batches:
        if batch.num_rows:
            shard = batch.column("shard")[0].as_py()
            conv.append(batch.column("conv_id").to_numpy())
            paths += batch.column("path").to_pylist()
            words.append(batch.column("words").flatten().to_numpy())
    if paths:
        yield from shard_nodes(shard, np.concatenate(conv), paths, np.concatenate(words).astype(np.int64))


# ----------------------------------------------------------------- shards together

def _merger(last: bool):
    """Open nodes of neighbouring shards -> closed nodes, and those of the merged range that stay open."""
    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        group = key[0].as_py()
        nodes: dict[bytes, dict] = {}
        shards = rows.column("shard").to_pylist()
        lowest, highest = min(shards), max(shards)
        for row in rows.select([c for c in _TYPES if c not in ("kind", "ids", "block", "ends_sha256")]).to_pylist():
            first = FIRST if row["side"] & FIRST and row["shard"] == lowest else 0
            final = LAST if row["side"] & LAST and row["shard"] == highest else 0
            node = nodes.setdefault(row["key"], row | {"side": 0, "new": True})
            node["side"] |= first | final
            if not node.pop("new", False):
                node["conv_id"] = min(node["conv_id"], row["conv_id"])
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    node[c] += row[c]
        done, kept = [], []
        for node in sorted(nodes.values(), key=lambda x: -x["depth"]):
            above = nodes.get(node["parent_key"])
            if node["side"] and not last:
                kept.append(node | {"shard": group, "kind": "open"})
                continue
            node["n_leaves"] += node["n_children"] == 0
            node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
            closed = above is not None and (last or not above["side"])
            done.append(node | {"kind": "closed", "parent_conv_id": above["conv_id"] if closed else None,
                                "parent_key": None if closed else node["parent_key"]})
            if above is not None:
                above["n_children"] += 1
                above["n_leaves"] += node["n_leaves"]
                above["saved_tokens"] += node["saved_tokens"]
        out = [{c: x.get(c) for c in _TYPES} for x in done + kept]
        return pa.Table.from_pylist(out, schema=pa.schema(list(_TYPES.items())))

    return merge


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ids in order of their nodes -> (key, ends_sha256); the ids of one node pass by, they are not gathered."""
    current, digest = None, None

    def emit():
        return pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != current:
                if digest is not None:
                    yield emit()
                current, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
    if digest is not None:
        yield emit()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of all rebuilt conversations (conv_id, turn, role, text), one row per node.

    A conversation c is its turns in order (a null turn number first; equal
    numbers by the MD5 of role and text; a null role or text is empty).  Its
    first h = crc32(c) mod 4 turns are exchanged for the first h (all if fewer)
    of conversation c - c % 20 (% as in SQL: the sign of c), none if there is
    none.  A node of depth d is a distinct sequence of d (role, text), the root
    has depth 0; turns are told apart by their MD5.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (tokens of the subtree that a shared
    prefix saves) and ends_sha256 (of the ids that end at the node).  Rows
    without a conv_id take no part, repeated rows are turns of their own, an
    empty table has no node, further columns are ignored.  A conversation is
    one row of 20 bytes per turn, whatever its texts.
    """
    spark = conversations.sparkSession
    st = Stages(spark, "convtrie")
    rebuilt = st.put(rebuild(conversations))
    turns = rebuilt.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = max(1, -(-turns // TURNS_PER_SHARD))
    dealt = rebuilt.repartitionByRange(shards, "path", "conv_id").withColumn("shard", F.spark_partition_id().cast("long"))
    parts = st.put(dealt.mapInArrow(_shards, PART), "kind")
    names = [x.split()[0] for x in NODE.split(", ")]
    opened = parts.where("kind = 'open'")
    shards = (opened.agg(F.max("shard")).first()[0] or 0) + 1
    merged = []
    while True:
        shards = -(-shards // FAN)
        grouped = opened.groupBy(F.floor(F.col("shard") / FAN).cast("long").alias("group"))
        step = st.put(grouped.applyInArrow(_merger(shards == 1), PART), "kind")
        merged.append(step.where("kind = 'closed'").select(names))
        if shards == 1:
            break
        opened = step.where("kind = 'open'")
    ends = (parts.where("kind = 'ends'").repartition("key").sortWithinPartitions("key", "shard", "block")
            .select("key", "ids").mapInArrow(_hash_ids, "key binary, ends_sha256 string"))
    once_open = merged[0]
    for more in merged[1:]:
        once_open = once_open.unionByName(more)
    once_open = st.put(once_open.drop("ends_sha256").join(ends, "key", "left")
                       .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))))
    nodes = parts.where("kind = 'closed'").select(names).unionByName(once_open.select(names))
    above = once_open.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    if above.count() <= BROADCAST_NODES:
        above = F.broadcast(above)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below_open = nodes.where(F.col("parent_key").isNotNull()).join(above, "parent_key").withColumn("parent_conv_id", F.col("_above"))
    return nodes.where(F.col("parent_key").isNull()).select(out).unionByName(below_open.select(out))


#: DuckDB has no crc32: the table of its bytes is built first.
ORACLE_SQL = f"""
WITH bytes AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
turns AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, max(k) AS own, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''),
           lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(any_value(t)[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % {HEAD} AS h
  FROM turns CROSS JOIN bytes GROUP BY c),
heads AS (SELECT a.c, a.h, least(a.h, coalesce(b.own, 0)) AS given FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % {ROOTED}),
rebuilt AS (
  SELECT i.c, t.k AS d, role, text FROM heads i JOIN turns t ON t.c = i.c - i.c % {ROOTED} AND t.k <= i.h
  UNION ALL
  SELECT i.c, i.given + t.k - i.h, role, text FROM heads i JOIN turns t ON t.c = i.c AND t.k > i.h),
paths AS (
  SELECT c, d, len(string_split_regex(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' '))
           - CAST(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')) = '' AS INT) AS words,
         md5(string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d)) AS p
  FROM rebuilt UNION ALL SELECT c, 0, 0, '' FROM convs),
lasts AS (SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) AS deep FROM paths),
nodes AS (
  SELECT d, p, any_value(up) AS up, min(c) AS c, count(*) AS n, (count(*) - 1) * max(words) AS own,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = deep), '')) AS ends
  FROM lasts GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (d, p)),
below AS (
  SELECT a.d, a.p, sum(CAST(n.n_children = 0 AS INT)) AS n_leaves, sum(n.own) AS saved
  FROM full_nodes n JOIN paths a ON a.c = n.c AND a.d <= n.d GROUP BY 1, 2)
SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, u.c AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs,
       CAST(n.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM full_nodes n JOIN below b USING (d, p) LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.up
"""
