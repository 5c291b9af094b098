"""What is shuffled, sorted and rounded per request and player: narrow rows, and as few as possible."""

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puckline.functions.scalar import round_half_up_int
from puckline.operators import dvp as dv
from puckline.operators import props as pr
from puckline.sources import proxies as px
from tests.test_props_dvp import day, facts_df, requests_df, roster_df
from tests.test_scale_r03 import _plan, _season

SF = "/root/testdata/sf0.001"


def _inputs(spark):
    facts, roster = _season(spark), roster_df(spark, [("A", 9, "Nine", "C", None)])
    asks = (("Skater", "shots", 1.5), ("Skater", "shots", None), ("Skater", None, 0.5), ("Goalie", "saves", 14.5), ("Skater", "shots", 0.5))
    parts = [requests_df(spark, [(m, day(40), "A", "B", *ask) for m in range(3)]).withColumn("prop_id", F.lit(i))
             for i, ask in enumerate(asks)]
    return facts, roster, reduce(DataFrame.unionByName, parts)


def _requests_side(plan: str) -> str:
    """The plan below the first side of the join of requests and players."""
    join = next(line for line in plan.splitlines() if "SortMergeJoin" in line and "home" in line and "player_id" not in line)
    return plan[plan.index(join) + len(join):]


def test_requests_are_shuffled_without_their_stat_and_line(spark):  # F1
    plan = _plan(spark, pr.prop_table(*_inputs(spark), day(99)))
    shuffled = next(line for line in _requests_side(plan).splitlines() if "Project" in line)
    assert "pair" in shuffled and "matchup_id" in shuffled
    assert "stat#" not in shuffled and "threshold#" not in shuffled and "player_type#" not in shuffled


def test_stat_and_line_come_back_to_their_requests(spark):  # F1, F3
    facts, roster, req = _inputs(spark)
    twice = req.unionByName(req.filter("matchup_id = 1"))
    for inclusive in (True, False):
        got = pr.prop_table(facts, roster, twice, day(99), inclusive=inclusive)
        asked = twice.select(*pr.REQUEST, "player_type", "stat", "threshold")
        want = {(r.matchup_id, r.prop_id): (r.stat, r.threshold) for r in asked.collect()}
        rows = got.collect()
        assert all((r.stat, r.threshold) == want[r.matchup_id, r.prop_id] for r in rows)
        # Skaters 1 and 3 for four requests, goalie 2 for one, in four matchups (one asked twice).
        assert len(rows) == 4 * (4 * 2 + 1)
        games = 81 + 1 if inclusive else 80
        assert {r.season_games for r in rows} == {games}
        shots = [i % 4 for i in range(games)]
        assert {r.season_hits for r in rows if r.threshold == 1.5} == {sum(x >= 1.5 for x in shots)}
        assert {r.season_hits for r in rows if r.stat is None or r.threshold is None} == {0}


def test_only_games_before_the_date_are_shuffled_alike(spark):  # F3
    plan = _plan(spark, pr.prop_table(*_inputs(spark), day(99), game_types=("R",), inclusive=False))
    shuffled = next(line for line in _requests_side(plan).splitlines() if "Project" in line)
    assert "pair" in shuffled and "stat#" not in shuffled


def test_prices_and_dates_as_text_are_not_shuffled_for_facts(spark):  # F1 to F5
    plan = _plan(spark, px.facts(spark, SF).select("player_id", "date", "team", "shots"))
    assert "l_extendedprice" not in plan and "date_format" not in plan


def test_percents_are_rounded_half_up_without_decimals(spark):  # F2
    values = [0.0, 0.49999999999999994, 0.5, 1.5, 2.5, 49.49999999999999, 49.5, 66.66666666666667, 99.5, 100.0, -0.5, -1.5, -2.4, None]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", round_half_up_int("x").alias("r"))
    for x, r in df.collect():
        assert r == (None if x is None else int(Decimal(repr(x)).quantize(Decimal(1), ROUND_HALF_UP)))
    assert "round(" not in _plan(spark, df)


def test_overview_sorts_counts_and_formats_afterwards(spark):  # F4
    shown = pr.matchup_overview(*_inputs(spark), day(99))
    below = _plan(spark, shown).split("rangepartitioning")[1]
    assert "(Formatted)" not in below and "_pct" not in below
    keys = [(r["L10 %"] is None, -(r["L10 %"] or 0.0), r.matchup_id, r.prop_id, r.player_id, r.Team) for r in shown.collect()]
    assert len(keys) == 3 * 9 and keys == sorted(keys)


def test_overview_puts_players_with_few_games_last(spark):  # F4
    rows = [dict(game_id=i, date=day(i), player_id=p, team="A", opponent="B", location="home", shots=2.0 if p == 1 or i % 2 else 0.0)
            for p, n in ((1, 12), (2, 12), (3, 5)) for i in range(12 - n, 12)]
    roster = roster_df(spark, [("A", p, f"P{p}", "C", None) for p in (1, 2, 3, 4)])
    req = requests_df(spark, [(1, day(20), "A", "B", "Skater", "shots", 1.5)])
    shown = pr.matchup_overview(facts_df(spark, rows), roster, req, day(20)).collect()
    assert [(r.player_id, r["L10 %"]) for r in shown] == [(1, 100.0), (2, 50.0), (3, None), (4, None)]


def test_dvp_pairs_asked_are_found_once(spark):  # F5
    scope = spark.range(1).select(F.lit(20232024).cast("bigint").alias("season"), F.lit("shots").alias("stat"))
    assert "Range" not in _plan(spark, dv.dvp_metrics(_season(spark), scope))


def test_players_are_held_and_requests_streamed(spark):  # F5
    facts, roster, req = _inputs(spark)
    plan = _plan(spark, pr.targets_for(facts, roster, req, day(99)))
    first = _requests_side(plan)
    assert first.index("matchup_id") < first.index("player_id")
