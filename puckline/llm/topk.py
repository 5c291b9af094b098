"""Operator 1, exact top-k search: block-at-a-time pruning.

Vectors are cut into blocks of adjacent ids.  A block keeps its vectors (the
forward index) and, for every term (component), its largest and smallest
weight.  For a query, the summed term maxima bound every score in a block;
blocks are taken by falling bound and scored through their forward index until
the bound falls below the query's k-th score.

Blocks are dealt to shards and queries to chunks, and a task holds one shard
and one chunk.  Each chunk first meets a single shard, which gives every query
a k-th score to start from; the other shards then prune with that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from puckline.llm.common import Stages

K, SCALE, EVERY = 10, 1024.0, 100
#: Vectors of a block, blocks of a shard, queries of a chunk: what a task holds.
BLOCK, SHARD_BLOCKS, CHUNK = 256, 32, 512
LONG = np.iinfo(np.int64)


def _matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Rows of equal length; a missing component weighs nothing."""
    wide = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), wide))
    for row, v in zip(out, vectors, strict=True):
        row[:len(v)] = v
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, weights) in order -> blocks of up to BLOCK vectors."""
    ids: list[int] = []
    vectors: list[np.ndarray] = []

    def close():
        forward = _matrix(vectors)
        row = {"wide": forward.shape[1], "ids": np.array(ids, dtype=np.int64).tobytes(), "forward": forward.tobytes(),
               "most": forward.max(axis=0).tobytes(), "least": forward.min(axis=0).tobytes()}
        ids.clear()
        vectors.clear()
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([
            ("wide", pa.int32()), ("ids", pa.binary()), ("forward", pa.binary()), ("most", pa.binary()),
            ("least", pa.binary())]))

    for batch in batches:
        for vec_id, weights in zip(batch.column("vec_id").to_pylist(), batch.column("weights"), strict=True):
            ids.append(vec_id)
            vectors.append(weights.values.to_numpy(zero_copy_only=False))
            if len(ids) == BLOCK:
                yield close()
    if ids:
        yield close()


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; beyond the range of a long, the nearest long."""
    wide = min(queries.shape[1], vectors.shape[1])
    q, v = queries[:, :wide], vectors[:, :wide]
    if not wide or np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * wide < 2.0**53:
        return (q @ v.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(q) @ exact(v).T, LONG.min, LONG.max).astype(np.int64)


def _bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Largest score that each query can have in a block, rounding included."""
    wide = min(queries.shape[1], len(most))
    q = queries[:, :wide]
    terms = np.maximum(q * most[:wide], q * least[:wide])
    return terms.sum(axis=1) + np.abs(terms).sum(axis=1) * 1e-12


def search_shard(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, blocks: list[dict], k: int):
    """Per query: the k best (score, id) of a shard's blocks that reach ``floor``.

    Equal scores go to the smaller id; an id equal to the query's own is no
    candidate.  A block is left out once its bound is below the k-th score.
    """
    bounds = np.array([_bounds(queries, b["most"], b["least"]) for b in blocks])
    best_ids = [np.empty(0, dtype=np.int64) for _ in own]
    best = [np.empty(0, dtype=np.int64) for _ in own]
    kth = floor.astype(np.float64).copy()
    order = np.argsort(-bounds, axis=0, kind="stable")
    scored = 0
    for turn in range(len(blocks)):
        at = order[turn]
        live = np.flatnonzero(bounds[at, np.arange(len(own))] >= kth)
        if not len(live):
            break
        for b in np.unique(at[live]):
            mine = live[at[live] == b]
            ids = blocks[b]["ids"]
            scores = products(queries[mine], blocks[b]["forward"])
            scored += len(mine)
            for i, row in zip(mine.tolist(), scores, strict=True):
                fit = np.flatnonzero((row >= kth[i]) & (ids != own[i]))
                if len(fit):
                    all_ids = np.concatenate([best_ids[i], ids[fit]])
                    all_scores = np.concatenate([best[i], row[fit]])
                    top = np.lexsort((all_ids, -all_scores.astype(object) if all_scores.min() == LONG.min
                                      else -all_scores))[:k]
                    best_ids[i], best[i] = all_ids[top], all_scores[top]
                    if len(top) == k:
                        kth[i] = max(kth[i], float(best[i][-1]) if abs(int(best[i][-1])) < 2**53 else -np.inf)
    return best, best_ids, scored


def _searcher(k: int):
    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        queries = _matrix([w.values.to_numpy(zero_copy_only=False) for w in left.column("weights")])
        own = left.column("query_id").to_numpy()
        blocks = []
        for b in right.to_pylist():
            blocks.append({"ids": np.frombuffer(b["ids"], np.int64),
                           "forward": np.frombuffer(b["forward"]).reshape(-1, b["wide"]) if b["wide"]
                           else np.zeros((len(b["ids"]) // 8, 0)),
                           "most": np.frombuffer(b["most"]), "least": np.frombuffer(b["least"])})
        if not len(own) or not blocks:
            return pa.table({"rid": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()),
                             "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        best, ids, _ = search_shard(queries, own, left.column("floor").to_numpy(), blocks, k)
        times = [len(x) for x in best]
        return pa.table({"rid": pa.array(np.repeat(left.column("rid").to_numpy(), times), pa.int64()),
                         "query_id": pa.array(np.repeat(own, times), pa.int64()),
                         "vec_id": pa.array(np.concatenate(ids), pa.int64()),
                         "score": pa.array(np.concatenate(best), pa.int64())})

    return search


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The k best candidates of every query among ``vectors`` (vec_id, embedding).

    A component x counts as floor(1024 * x).  Queries are the rows whose
    vec_id is divisible by ``every``; a query's candidates are all rows with
    another vec_id.  Returns query_id, rank (from 1), vec_id and score, ties
    to the smaller vec_id.  Rows with a null vec_id, and vectors that are null
    or hold null or non-finite components, take no part.  Of vectors of
    unequal length the shorter one weighs nothing beyond its end; an empty
    vector scores 0.  Repeated rows are candidates (and queries) each.  Scores
    beyond a long become the nearest long.  No queries or no candidates: an
    empty result.
    """
    st = Stages(vectors.sparkSession, "topk")
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: x.cast("double") * SCALE).alias("scaled"))
    # Whole numbers kept as doubles: floor() would give a long and overflow.
    weights = whole.select("vec_id", F.transform(
        "scaled", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)).alias("weights"))
    blocks = st.put(weights.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(
        _blocks, "wide int, ids binary, forward binary, most binary, least binary"))
    queries = st.put(weights.where(F.col("vec_id") % every == 0)
                     .select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").alias("query_id"), "weights"))
    shards = max(1, -(-blocks.count() // SHARD_BLOCKS))
    chunks = max(1, -(-queries.count() // CHUNK))
    dealt = st.put(blocks.withColumn(
        "shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")))
    asked = queries.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(chunks)).cast("int")) \
                   .withColumn("home", F.col("chunk") % shards)
    pair = ["shard", "chunk"]

    def meet(q: DataFrame, b: DataFrame) -> DataFrame:
        return q.groupBy(*pair).cogroup(b.groupBy(*pair)).applyInArrow(
            _searcher(k), "rid long, query_id long, vec_id long, score long")

    all_chunks = F.sequence(F.lit(0), F.lit(chunks - 1))
    best_first = Window.partitionBy("rid").orderBy(F.col("score").desc(), "vec_id")
    home = st.put(meet(
        asked.select("rid", "query_id", "weights", F.col("home").alias("shard"), "chunk",
                     F.lit(LONG.min).cast("long").alias("floor")),
        dealt.withColumn("chunk", F.explode(F.filter(all_chunks, lambda c: c % shards == F.col("shard"))))))
    floor = (home.groupBy("rid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor")))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
    rest = meet(
        asked.join(floor, "rid", "left").select(
            "rid", "query_id", "weights", F.explode(others).alias("shard"), "chunk",
            F.coalesce("floor", F.lit(LONG.min).cast("long")).alias("floor")),
        dealt.withColumn("chunk", F.explode(F.filter(all_chunks, lambda c: c % shards != F.col("shard")))))
    found = home.unionByName(rest)
    return (found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
