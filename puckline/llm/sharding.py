"""Operator 8, sharding: balanced label propagation (DataFrame functions only).

Documents with equal texts are linked.  Every linked document starts in a
random shard.  Documents of a group are alike, so a group is one row that
counts its documents in each shard, and a round moves counts: a group's
smallest shares move into its largest ones, as many as their shards have room
for and never more than a shard's quota in one.  A shard accepts movers,
largest share first, only up to its row quota plus a slack (by default, as
much again).  Each accepted move makes a larger share larger and a smaller one
smaller, so the rounds end, and they go on until no row moves.  At the end each
shard keeps its linked rows up to the exact quota, largest share first; rows
above it are dealt out anew, whole groups together, and the unlinked rows fill
what is left, so that the shards' row counts are at most one apart whatever
the groups look like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from puckline.llm import common
from puckline.llm.common import Stages, numbered

LAW = "rows"


def _quotas(n: int, shards: int) -> list[int]:
    """Rows that each shard gets: the first ``n % shards`` take one more."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _before(df: DataFrame, rows: int, by: str, level: str, weight: str, out: str) -> DataFrame:
    """Running sums of ``weight`` before each row of a ``by`` group, without
    sorting a whole group in one task; rows come by ``level`` (ascending), then
    by a hash of ``gid``.  The sums of (by, level, bucket) cells give the offsets."""
    buckets = max(1, -(-rows // common.ROWS_PER_CELL))
    keyed = df.withColumn("_b", F.pmod(F.xxhash64("gid"), F.lit(buckets)))
    cells = keyed.groupBy(by, level, "_b").agg(F.sum(weight).alias("_n"))
    earlier = Window.partitionBy(by).orderBy(level, "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(by, level, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    inside = (Window.partitionBy(by, level, "_b").orderBy("gid", "key")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (keyed.join(offsets, [by, level, "_b"])
            .withColumn(out, F.coalesce(F.sum(weight).over(inside), F.lit(0)) + F.col("_off"))
            .drop("_b", "_off"))


def _level(count: str) -> Column:
    """Large counts first, alike within a factor of two."""
    return (-F.floor(F.log2(F.col(count)))).cast("int")


def _wishes(state: DataFrame, room: list[int], quotas: list[int]) -> DataFrame:
    """(gid, cells) -> the same, cells largest first, with the moves that each
    group wishes: ``flows`` of m rows from shard src to shard dst.

    The first shares of a group are targets, as few as can take all the others
    (``takes``: room and quota permitting); the last ones leave first.
    """
    return (state.withColumn("cells", F.sort_array("cells", asc=False))
            .withColumns({"room": _longs(room), "quota": _longs(quotas)})
            .withColumn("takes", F.expr(
                "transform(cells, c -> greatest(0L, least(room[c.shard], quota[c.shard] - c.cnt)))"))
            .withColumns({
                "upto": F.expr("transform(sequence(1, size(cells)), "
                               "i -> aggregate(slice(takes, 1, i), 0L, (x, y) -> x + y))"),
                "rest": F.expr("transform(sequence(1, size(cells)), "
                               "i -> aggregate(slice(cells, i + 1, size(cells)), 0L, (x, y) -> x + y.cnt))")})
            .withColumn("p", F.expr("cast(array_position(zip_with(upto, rest, (x, y) -> x >= y), true) as int)"))
            .withColumn("flows", F.expr("""
                filter(flatten(transform(slice(sequence(1, size(cells)), p + 1, size(cells)),
                    j -> transform(sequence(1, p), i -> struct(
                        cells[j - 1].shard as src, cells[i - 1].shard as dst, cells[i - 1].cnt as share,
                        least(rest[j - 1] + cells[j - 1].cnt, upto[i - 1])
                            - greatest(rest[j - 1], upto[i - 1] - takes[i - 1]) as m)))),
                    f -> f.m > 0)"""))
            .select("gid", "cells", "flows"))


def _moved(wished: DataFrame, flows: str) -> DataFrame:
    """(gid, cells) after the moves in the column ``flows`` (null: none)."""
    return wished.withColumn(flows, F.coalesce(flows, F.expr("filter(flows, f -> false)"))).select("gid", F.expr(f"""
        filter(transform(cells, c -> struct(
            c.cnt + aggregate({flows}, 0L, (x, f) ->
                x + case when f.dst = c.shard then f.m when f.src = c.shard then -f.m else 0L end) as cnt,
            c.tie as tie, c.shard as shard)), c -> c.cnt > 0)""").alias("cells"))


def _propagate(st: Stages, state: DataFrame, n: int, shards: int, slack: float) -> DataFrame:
    """Rounds over (gid, cells) until no row moves."""
    quotas = _quotas(n, shards)
    # One number per shard, and at most one per pair of shards.
    load = {r["shard"]: r["load"] for r in state.select(F.inline("cells"))
            .groupBy("shard").agg(F.sum("cnt").alias("load")).collect()}
    while True:
        room = [max(0, -int(-q * (1 + slack) // 1) - load.get(s, 0)) for s, q in enumerate(quotas)]
        wished = st.put(_wishes(state, room, quotas))
        st.drop(state)
        flows = wished.select("gid", F.inline("flows"))
        sums = flows.groupBy("src", "dst").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("rows")).collect()
        if not sums:
            return wished.select("gid", "cells")
        asked = dict.fromkeys(range(shards), 0)
        for r in sums:
            asked[r["dst"]] += r["m"]
        if all(asked[s] <= room[s] for s in asked):
            state = st.put(_moved(wished, "flows"))
        else:
            ranked = _before(flows.withColumns({"level": _level("share"), "key": F.col("src")}),
                             sum(r["rows"] for r in sums), "dst", "level", "m", "before")
            got = F.least("m", F.element_at(_longs(room), F.col("dst") + 1) - F.col("before"))
            accepted = st.put(ranked.select("gid", "src", "dst", "share", got.alias("m")).where("m > 0"))
            sums = accepted.groupBy("src", "dst").agg(F.sum("m").alias("m")).collect()
            agreed = accepted.groupBy("gid").agg(F.collect_list(F.struct("src", "dst", "share", "m")).alias("agreed"))
            state = st.put(_moved(wished.join(agreed, "gid", "left"), "agreed"))
            st.drop(accepted)
        st.drop(wished)
        for r in sums:
            load[r["src"]] -= r["m"]
            load[r["dst"]] = load.get(r["dst"], 0) + r["m"]


def shard_documents(docs: DataFrame, shards: int = 40, slack: float = 1.0) -> DataFrame:
    """Assign every row of ``docs`` (doc_id, text) to a shard.

    Returns doc_id, size (UTF-8 bytes of the text plus 16; a null text has
    none), text_crc32, law, shard, slot (gapless from 0 in each shard) and
    grown_shard (null under this law).  Each row counts by itself: repeated
    rows and rows with a null id get slots of their own; null and empty texts
    are equal.  An empty table gives an empty result.  A group larger than a
    shard fills as few shards as its rows and the other groups allow.
    """
    st = Stages(docs.sparkSession, "shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    read = st.put(docs.select(
        F.monotonically_increasing_id().alias("nid"), F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(text.cast("binary")).alias("gid")))
    n = read.count()
    quotas = _quotas(n, shards)
    groups = read.groupBy("gid").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    rows = st.put(read.join(groups, "gid", "left"))
    linked = rows.where(F.col("members").isNotNull())
    n_linked = linked.count()
    shares = (linked.groupBy("gid", F.pmod(F.xxhash64("nid"), F.lit(shards)).cast("int").alias("shard"))
              .agg(F.count(F.lit(1)).alias("cnt")))
    state = st.put(shares.groupBy("gid").agg(F.collect_list(
        F.struct("cnt", F.xxhash64("gid", "shard").alias("tie"), "shard")).alias("cells")))
    state = _propagate(st, state, n, shards, slack) if n_linked else state

    # Linked rows keep their shard up to its quota, largest share of a group first.
    level = _level("cnt")
    seated = _before(state.select("gid", F.inline("cells")).withColumns({"level": level, "key": F.col("shard")}),
                     n_linked, "shard", "level", "cnt", "slot")
    left = F.element_at(_longs(quotas), F.col("shard") + 1) - F.col("slot")
    kept = st.put(seated.select("gid", "shard", "slot", F.least("cnt", left).alias("keep")).where("keep > 0"))
    # One number per shard: seats that the kept rows leave.
    taken = {r["shard"]: r["taken"] for r in kept.groupBy("shard").agg(F.sum("keep").alias("taken")).collect()}
    starts, total, begin = [], 0, []
    for s, quota in enumerate(quotas):
        starts.append(total)
        begin.append(taken.get(s, 0))
        total += quota - taken.get(s, 0)

    # A group's rows, by number: first those that keep a shard, then the others in a row.
    seats = kept.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("shard", "slot", "keep"))).alias("seats"),
                                    F.sum("keep").alias("kept"))
    sizes = state.select("gid", F.expr("aggregate(cells, 0L, (x, c) -> x + c.cnt)").alias("members"))
    plan = st.put(sizes.join(seats, "gid", "left").select(
        "gid", "seats", F.coalesce("kept", F.lit(0)).alias("kept"),
        (F.col("members") - F.coalesce("kept", F.lit(0))).alias("rest"),
        F.lit(0).alias("one"), F.lit(0).alias("key")))
    spread = _before(plan.where("rest > 0").withColumn("level", F.lit(0)), n_linked, "one", "level", "rest", "pos")
    plan = st.put(plan.drop("one", "key").join(spread.select("gid", "pos"), "gid", "left"))

    # The numbers: rows of a large group are numbered in parts.
    salted = linked.withColumn("salt", F.pmod(F.xxhash64("nid"), F.ceil(F.col("members") / common.ROWS_PER_CELL)))
    earlier = Window.partitionBy("gid").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = (salted.where(F.col("members") > common.ROWS_PER_CELL).groupBy("gid", "salt")
             .agg(F.count(F.lit(1)).alias("_n"))
             .select("gid", "salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off")))
    number = F.row_number().over(Window.partitionBy("gid", "salt").orderBy("nid")) - 1
    of_group = (salted.withColumn("i", number).join(parts, ["gid", "salt"], "left")
                .withColumn("i", F.col("i") + F.coalesce("_off", F.lit(0))).join(plan, "gid"))
    with_seat = (of_group
                 .withColumn("upto", F.expr("transform(sequence(1, size(seats)), "
                                            "k -> aggregate(slice(seats, 1, k), 0L, (x, y) -> x + y.keep))"))
                 .withColumn("k", F.when(F.col("i") < F.col("kept"), F.expr("size(filter(upto, x -> x <= i))"))))
    own = "doc_id", "size", "text_crc32"
    placed = with_seat.select(
        *own, F.expr("case when k is not null then seats[k].shard end").alias("shard"),
        F.expr("case when k is not null then seats[k].slot + i - (upto[k] - seats[k].keep) end").alias("slot"),
        (F.col("pos") + F.col("i") - F.col("kept")).alias("pos"))
    alone = numbered(rows.where(F.col("members").isNull()).withColumn("one", F.lit(0)), n, ["one"], None, "nid", [], "i")
    first = n_linked - sum(taken.values())
    placed = placed.unionByName(alone.select(
        *own, F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"),
        (F.col("i") + first).alias("pos")))
    # The last shard whose seats start at or before the position (a shard
    # without free seats starts where the next one does and is passed over).
    lows = _longs(starts)
    index = F.greatest(F.lit(1), F.size(F.filter(lows, lambda x: x <= F.col("pos"))))
    return placed.select(
        *own, F.lit(LAW).alias("law"), F.coalesce("shard", index - 1).cast("int").alias("shard"),
        F.coalesce("slot", F.col("pos") - F.element_at(lows, index) + F.element_at(_longs(begin), index))
        .cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    ).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
