"""Hot keys: one game / one (game, player) key holding a large share of rows."""

from pyspark.sql import functions as F

from puckline.operators import pbp as pb
from puckline.operators.common import pick_first
from puckline.sources import proxies as px

SF = "/root/testdata/sf0.001"


def test_hot_key_dedupe_is_exact_and_cut_map_side(spark):
    base = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"),  # a third on k=7
        (F.lit(100000) - F.col("id")).alias("order_col"), F.col("id").alias("payload"))
    out = pick_first(base.repartition(8), ["k"], ["order_col"])
    hot = out.filter("k = 7").collect()
    assert len(hot) == 1 and hot[0].payload == 29997  # the smallest order_col among k=7 rows
    assert out.count() == base.select("k").distinct().count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    before_shuffle = plan.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in before_shuffle  # partial top-1 per key before the exchange


def test_hot_game_stats_equal_sum_of_parts(spark):
    # Copy one game's events many times under new event ids: the hot game's
    # counts must scale exactly, and the aggregation runs map-side first.
    ev = px.pbp(spark, SF)
    hot_game = ev.agg(F.min("game_id")).first()[0]
    one = ev.filter(F.col("game_id") == hot_game)
    copies = one.select("*", F.explode(F.sequence(F.lit(1), F.lit(49))).alias("copy"))
    copies = copies.withColumn("event_id", F.col("event_id") + F.col("copy") * 1000000) \
        .withColumn("period_type", F.lit("REG")).drop("copy")
    skewed = ev.unionByName(copies)
    got = pb.player_game_stats(skewed).filter(F.col("game_id") == hot_game)
    single = pb.player_game_stats(one.withColumn("period_type", F.lit("REG")))
    a = {r.player_id: (r.goals, r.hits, r.shots) for r in got.collect()}
    b = {r.player_id: (r.goals, r.hits, r.shots) for r in single.collect()}
    orig = {r.player_id: (r.goals, r.hits, r.shots) for r in pb.player_game_stats(one).collect()}
    for pid, (g, h, s) in b.items():
        og, oh, os_ = orig.get(pid, (0, 0, 0))
        assert a[pid] == (og + 49 * g, oh + 49 * h, os_ + 49 * s)
