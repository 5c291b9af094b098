import datetime as dt
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from puckline.operators import dvp as dv
from puckline.operators import props as pr
from puckline.operators import views as vw
from puckline.operators.facts import PROP_STATS
from puckline.session import materialize
from puckline.sources import proxies as px

FACT_COLS = ["game_id", "date", "season", "game_type", "player_id", "player_name", "team", "opponent",
             "location", "position", "days_rest"] + PROP_STATS


def facts_df(spark, rows):
    """rows: dicts with overrides; every stat defaults to 0.0."""
    full = []
    for r in rows:
        base = dict(game_type=2, player_name=f"P{r['player_id']}", position="C", days_rest=1,
                    season=20232024, **{s: 0.0 for s in PROP_STATS})
        base.update(r)
        full.append(tuple(base[c] for c in FACT_COLS))
    schema = ("game_id bigint, date date, season bigint, game_type int, player_id bigint, player_name string, "
              "team string, opponent string, location string, position string, days_rest int, "
              + ", ".join(f"{s} double" for s in PROP_STATS))
    return spark.createDataFrame(full, schema)


def requests_df(spark, rows):
    """rows: (matchup_id, selected_date, home, away, player_type, stat, threshold); prop 0."""
    return spark.createDataFrame([(r[0], 0, *r[1:]) for r in rows],
                                 "matchup_id bigint, prop_id int, selected_date date, home string, away string, "
                                 "player_type string, stat string, threshold double")


def roster_df(spark, rows):
    return spark.createDataFrame(rows, "team_abbrev string, player_id bigint, full_player_name string, "
                                       "position_code string, headshot_url string")


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_rates_rounding_and_na_rules(spark):
    # Player 1: 8 home games vs B, 1 hit -> 12.5 %; player 2: 8 games, 3 hits -> 37.5 %; 4 games for player 3.
    rows = []
    for i in range(8):
        rows.append(dict(game_id=100 + i, date=day(i), player_id=1, team="A", opponent="B", location="home",
                         shots=2.0 if i == 0 else 0.0))
        rows.append(dict(game_id=100 + i, date=day(i), player_id=2, team="B", opponent="A", location="away",
                         shots=2.0 if i < 3 else 0.0))
    for i in range(4):
        rows.append(dict(game_id=200 + i, date=day(i), player_id=3, team="A", opponent="C", location="home",
                         shots=5.0))
    rows.append(dict(game_id=300, date=day(20), player_id=1, team="A", opponent="B", location="home"))
    rows.append(dict(game_id=300, date=day(20), player_id=2, team="B", opponent="A", location="away"))
    rows.append(dict(game_id=300, date=day(20), player_id=3, team="A", opponent="B", location="home"))
    facts = facts_df(spark, rows)
    req = requests_df(spark, [(1, day(19), "A", "B", "Skater", "shots", 1.5)])
    roster = roster_df(spark, [("A", 1, "P1", "C", None)])
    t = {r.player_id: r for r in pr.prop_table(facts, roster, req, day(30)).collect()}
    # selected date before hockey_today -> players who played that day: none on day 19
    assert t == {}
    req = requests_df(spark, [(1, day(20), "A", "B", "Skater", "shots", 1.5)])
    tab = pr.prop_table(facts, roster, req, day(30))
    t = {r.player_id: r for r in tab.collect()}
    assert (t[1].season_games, t[1].season_hits, t[1].season_pct) == (9, 1, 100 / 9)
    assert (t[3].l5_games, t[3].l5_hits) == (5, 4)
    f = {r.player_id: r for r in pr.prop_table_formatted(tab).collect()}
    assert f[3]["L10 (Formatted)"] == "n/a" and f[3]["L10 %"] is None
    assert f[3]["L5 (Formatted)"] == "80%"
    assert f[1]["Away (Season) (Formatted)"] == "n/a" and f[1]["Away %"] is None
    assert t[1].away_season_games == 0 and t[1].away_season_pct is None
    assert f[1]["H2H (Formatted)"] == "11% (9g)"
    assert t[3].h2h_games == 1 and t[3].h2h_pct == 0.0


def test_half_up_table_and_half_even_kpi(spark):
    rows = [dict(game_id=100 + i, date=day(i), player_id=1, team="A", opponent="B", location="home",
                 shots=2.0 if i == 0 else 0.0) for i in range(8)]
    rows += [dict(game_id=200 + i, date=day(i), player_id=2, team="B", opponent="A", location="away",
                  shots=2.0 if i < 3 else 0.0) for i in range(8)]
    facts = facts_df(spark, rows)
    req = requests_df(spark, [(1, day(7), "A", "B", "Skater", "shots", 1.5)])
    tab = pr.prop_table_formatted(pr.prop_table(facts, roster_df(spark, [("A", 9, "X", "C", None)]), req, day(30)))
    got = {r.player_id: r["Season (Formatted)"] for r in tab.collect()}
    assert got == {1: "13% (8g)", 2: "38% (8g)"}
    sel = spark.createDataFrame([(1, 0, 1, "A", 0, day(7), "A", "B", "shots", 1.5, "B", "season", "any", "any"),
                                 (1, 0, 2, "B", 0, day(7), "A", "B", "shots", 1.5, "A", "season", "any", "any")],
                                "matchup_id bigint, prop_id int, player_id bigint, team_abbrev string, spec_id int, "
                                "selected_date date, home string, away string, stat string, threshold double, opponent_team string, "
                                "game_filter string, location_filter string, rest_filter string")
    k = {r.player_id: r for r in vw.kpi_rates(vw.player_log_filtered(facts, sel), sel).collect()}
    assert (k[1].season_text, k[2].season_text) == ("12%", "38%")


def test_rates_equal_a_direct_join(spark):
    sf = "/root/testdata/sf0.001"
    facts, roster = px.facts(spark, sf), px.roster(spark, sf)
    g = px.games(spark, sf).filter(F.col("date").between("1998-01-01", "1999-06-30"))
    req = pr.requests_for_games(g, pr.default_props())
    fast = pr.prop_table(facts, roster, req, "2001-12-31")
    t = pr.targets_for(facts, roster, req, "2001-12-31")
    h = (t.drop("player_name").join(facts.drop("team"), "player_id")
         .filter(F.col("date") <= F.col("selected_date"))
         .withColumn("hit", pr.stat_value(F.col("stat")) >= F.col("threshold")))
    w = Window.partitionBy(*pr.TARGET).orderBy(F.col("date").desc())
    h = h.withColumn("rk", F.dense_rank().over(w))
    brute = h.groupBy(*pr.TARGET).agg(
        F.count_if(F.col("season") == F.col("req_season")).alias("sg"),
        F.count_if((F.col("season") == F.col("req_season")) & F.col("hit")).alias("sh"),
        F.count_if(F.col("opponent") == F.col("h2h_opponent")).alias("hg"),
        F.count_if((F.col("rk") <= 10) & F.col("hit")).alias("h10"),
        F.count_if(F.col("rk") <= 20).alias("g20"),
        F.count_if((F.col("season") == F.col("req_season")) & (F.col("location") == "away")).alias("ga"))
    j = fast.join(brute, pr.TARGET, "left")
    assert fast.count() > 50
    bad = j.filter(
        (F.col("season_games") != F.coalesce("sg", F.lit(0)))
        | ~F.col("season_hits").eqNullSafe(F.when(F.col("season_games") > 0, F.col("sh")))
        | (F.col("h2h_games") != F.coalesce("hg", F.lit(0)))
        | ~F.col("l10_hits").eqNullSafe(F.col("h10"))
        | (F.col("l20_games") != F.coalesce("g20", F.lit(0)))
        | (F.col("away_season_games") != F.coalesce("ga", F.lit(0))))
    assert bad.count() == 0


def _history(spark, n=6):
    rows = []
    for i in range(n):
        rows.append(dict(game_id=i, date=day(i), player_id=1, team="A", opponent="B", location="home", shots=2.0))
        rows.append(dict(game_id=i, date=day(i), player_id=2, team="B", opponent="A", location="away", shots=0.0))
    return facts_df(spark, rows)


def test_player_on_both_rosters_gets_one_row_per_team(spark):
    facts = _history(spark)
    roster = roster_df(spark, [("A", 1, "P1", "C", None), ("B", 1, "P1", "C", None)])
    req = requests_df(spark, [(1, day(9), "A", "B", "Skater", "shots", 1.5)])
    rows = pr.prop_table(facts, roster, req, day(9)).collect()
    assert sorted((r.team_abbrev, r.season_games, r.h2h_games) for r in rows) == [("A", 6, 6), ("B", 6, 0)]
    shown = pr.matchup_overview(facts, roster, req, day(9)).collect()
    assert sorted(r["Team"] for r in shown) == ["A", "B"]


def test_roster_row_listed_twice_counts_once(spark):
    facts = _history(spark)
    roster = roster_df(spark, [("A", 1, "P1", "C", None), ("A", 1, "P1", "C", None), ("A", 1, "P1", "C", "h")])
    req = requests_df(spark, [(1, day(9), "A", "B", "Skater", "shots", 1.5)])
    assert pr.prop_table(facts, roster, req, day(9)).count() == 1
    assert pr.matchup_overview(facts, roster, req, day(9)).count() == 1


def test_more_than_a_hundred_props_keep_apart(spark):
    facts = _history(spark)
    games = spark.createDataFrame([(1, "2024-01-10", "A", "B"), (2, "2024-01-10", "A", "B")],
                                  "game_id bigint, date string, home_abbrev string, away_abbrev string")
    req = pr.requests_for_games(games, [("Skater", "shots", i / 100) for i in range(250)])
    roster = roster_df(spark, [("A", 1, "P1", "C", None)])
    table = pr.prop_table(facts, roster, req, day(0))
    assert table.count() == table.select(*pr.TARGET).distinct().count() == 500
    assert table.filter("season_hits <> IF(threshold <= 2.0, 6, 0)").count() == 0


def test_unknown_stat_is_an_error(spark):
    req = requests_df(spark, [(1, day(9), "A", "B", "Skater", "pim", 1.5)])
    with pytest.raises(Exception, match="not a prop stat: pim"):
        pr.prop_table(_history(spark), roster_df(spark, [("A", 1, "P1", "C", None)]), req, day(9)).collect()


def _plan(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rates_read_the_history_once_a_side(spark, tmp_dir):
    import os
    sf = "/root/testdata/sf0.001"
    path = os.path.join(tmp_dir, "facts")
    px.facts(spark, sf).write.parquet(path)
    facts, roster = spark.read.parquet(path), px.roster(spark, sf)
    req = pr.requests_for_games(px.games(spark, sf), pr.default_props())
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = pr.prop_table(facts, roster, req, "1997-08-24")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # One scan and one repartition of the history for season and last-N rates, one for head-to-head.
    assert sum("FileScan parquet" in line and "blocked_shots" in line for line in plan.splitlines()) == 2
    assert plan.count("REPARTITION_BY_COL") <= 2


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("game_types", [None, ("P",)])
def test_rates_with_cutoff_and_game_types(spark, inclusive, game_types):
    """Many lines per stat (several slots), the cutoff and the game types against a filter per target."""
    sf = "/root/testdata/sf0.001"
    facts, roster = materialize(px.facts(spark, sf)), px.roster(spark, sf)
    games = px.games(spark, sf).filter(F.col("date").between("1997-07-01", "1997-08-30"))
    props = [("Skater", s, v) for s in ("shots", "points", "hits") for v in (0.5, 1.5, 2.0, 3.5, 6.5)] + [("Goalie", "saves", 24.5)]
    req = materialize(pr.requests_for_games(games, props))
    out = pr.rates(facts, roster, req, "1997-08-24", game_types=game_types, inclusive=inclusive)
    t = materialize(pr.targets_for(facts, roster, req, "1997-08-24"))
    f = facts if game_types is None else facts.filter(F.col("game_type") == 3)
    on = (t.player_id == f.player_id) & ((f.date <= t.selected_date) if inclusive else (f.date < t.selected_date))
    own = F.col("season") == F.col("req_season")
    past = (t.join(f.select("player_id", "date", "season", "opponent", "location", *pr.PROP_STATS), on).drop(f.player_id)
            .withColumn("hit", pr.stat_value(F.col("stat")) >= F.col("threshold"))
            .withColumn("nth", F.dense_rank().over(Window.partitionBy(*pr.TARGET).orderBy(F.col("date").desc()))))

    def both(g, h, cond):
        return [F.count_if(cond).alias(g), F.count_if(cond & F.col("hit")).alias(h)]

    brute = past.groupBy(*pr.TARGET).agg(
        *both("sg", "sh", own), *both("gh", "hh", own & (F.col("location") == "home")),
        *both("ga", "ha", own & (F.col("location") == "away")), *both("go", "ho", F.col("opponent") == F.col("h2h_opponent")),
        *[c for n in pr.LAST_N for c in both(f"g{n}", f"h{n}", F.col("nth") <= n)])
    cols = [c for c in brute.columns if c not in pr.TARGET]
    want = t.select(*pr.TARGET).join(brute, pr.TARGET, "left").select(*pr.TARGET, *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])
    got = out.select(*pr.TARGET, *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])
    assert got.count() == want.count() > 1000
    assert got.exceptAll(want).count() == 0


def test_whole_filter_space_against_single_views(spark):
    """view_logs, log_charts and view_kpis say what the selection operators say for each view alone."""
    sf = "/root/testdata/sf0.001"
    facts = materialize(px.facts(spark, sf))
    t = materialize(pr.targets_for(facts, px.roster(spark, sf), pr.requests_for_games(px.games(spark, sf), pr.default_props()), "1997-08-24"))
    some = t.filter(F.pmod(F.xxhash64("matchup_id", "player_id", "prop_id"), F.lit(500)) == 0)
    some = some.unionByName(some.limit(3).withColumns({"h2h_opponent": F.lit(None).cast("string"), "prop_id": F.lit(99)}))
    specs = [(f"{g}:{loc}/{rest}", g, loc, rest) for g in vw.GAME_FILTERS for loc, rest in vw.COMBINATIONS]
    items = F.array(*[F.struct(F.lit(i).alias("spec_id"), F.lit(g).alias("game_filter"), F.lit(loc).alias("location_filter"),
                               F.lit(rest).alias("rest_filter")) for i, g, loc, rest in specs])
    sel = materialize(some.select("*", F.col("h2h_opponent").alias("opponent_team"), F.inline(items)))
    log = materialize(vw.player_log_filtered(facts, sel.drop("player_name", "position_code")))
    # The logs.
    season = F.col("req_season")
    ids = sel.select(*vw.SEL, "location_filter", "rest_filter", vw.scope_of(F.col("game_filter"), season, F.col("opponent_team")).alias("at"))
    logs = vw.view_logs(facts).select(*vw.LOG, "game_id")
    looked_up = ids.select("*", "at.*").join(logs, vw.LOG).select(*vw.SEL, "game_id")
    alone = log.select(*vw.SEL, "game_id")
    assert alone.count() == looked_up.count() > 1000
    assert alone.exceptAll(looked_up).count() == 0
    # The KPIs.
    kpis = vw.view_kpis(facts, some)
    points = F.array(*[F.lit(f"{loc}/{rest}") for loc, rest in vw.COMBINATIONS])
    names = ["season", "h2h", "l5", "l10"]
    zipped = F.arrays_zip(points.alias("point"), *[F.split(f"{k}_rates", r"\|").alias(k) for k in names])
    wide = kpis.select("player_id", "season", "opponent_team", "stat", "threshold", "game_filter", F.inline(zipped))
    single = vw.kpi_rates(log, sel).join(sel.select(*vw.SEL, "req_season", "opponent_team", "stat", "threshold", "game_filter",
                                                    F.concat_ws("/", "location_filter", "rest_filter").alias("point")), vw.SEL)
    shown = [F.when(F.col(f"{k}_text") == "n/a", F.lit("n/a")).otherwise(
        F.concat(f"{k}_text", F.lit(" ("), F.col(f"{k}_games").cast("string"), F.lit("g)"))).alias(k) for k in names]
    want = single.select("player_id", F.col("req_season").alias("season"), "opponent_team", "stat", "threshold", "game_filter", "point", *shown)
    assert wide.exceptAll(want.distinct()).count() == 0 and want.distinct().exceptAll(wide).count() == 0
    # A chart's points, from the oldest of 25.
    charts = {(*(r[c] for c in vw.LOG), r.stat): r for r in vw.log_charts(vw.view_logs(facts), some).collect()}
    at = {tuple(r[c] for c in vw.SEL): r for r in sel.select("*", vw.scope_of(F.col("game_filter"), season, F.col("opponent_team")).alias("at")).collect()}
    series = {}
    for r in vw.chart_series(log).collect():
        series.setdefault(tuple(r[c] for c in vw.SEL), []).append(r)
    for key, rows in series.items():
        s = at[key]
        c = charts[s.player_id, s["at"].log_kind, s["at"].log_value, s.location_filter, s.rest_filter, s.stat]
        rows.sort(key=lambda r: -r.log_rank)
        assert c.points == "|".join(f"{r.label} {'+' if r.hit else '-'}" for r in rows)
        assert (c.games, c.hits, c.y_max) == (len(rows), sum(r.hit for r in rows), rows[0].y_max)
    assert len(series) > 500


def test_player_log_reads_the_facts_twice_at_most(spark, tmp_dir):
    import os
    sf = "/root/testdata/sf0.001"
    path = os.path.join(tmp_dir, "facts")
    px.facts(spark, sf).write.parquet(path)
    sel = spark.createDataFrame([], "matchup_id bigint, prop_id int, player_id bigint, team_abbrev string, spec_id int, "
                                    "selected_date date, home string, away string, stat string, threshold double, "
                                    "opponent_team string, game_filter string, location_filter string, rest_filter string")
    sel.write.parquet(os.path.join(tmp_dir, "sel"))
    log = vw.player_log_filtered(spark.read.parquet(path), spark.read.parquet(os.path.join(tmp_dir, "sel")))
    assert _plan(spark, log).count("FileScan parquet") <= 3  # facts, most recent facts, selections


def test_dvp_nan_factor_and_default_matchup(spark):
    rows = []
    for i, (team, opp) in enumerate([("A", "B"), ("B", "A"), ("A", "C"), ("C", "A")]):
        rows.append(dict(game_id=i, date=day(i), player_id=10 + i, team=team, opponent=opp, location="home",
                         position="C", goals_against=0.0, shots=float(i)))
    facts = facts_df(spark, rows)
    d = dv.dvp_metrics(facts, (["goals_against", "shots"], [20232024])).collect()
    ga = [r for r in d if r.stat == "goals_against"]
    assert all(math.isnan(r.schedule_strength_factor) for r in ga)
    assert all(math.isnan(r.schedule_adjusted_dvp) and r.dvp_rank == 1 for r in ga)
    shots = {r.team: r for r in d if r.stat == "shots"}
    assert shots["A"].dvp_formatted.startswith(("+", "-")) or shots["A"].dvp_formatted == "0.0"
    players = spark.createDataFrame([(1, 5, 20232024, "shots", "A", "Z", "C"), (2, 6, 20232024, "shots", "A", "B", "C")],
                                    "request_id bigint, player_id bigint, season bigint, stat string, team string, "
                                    "opponent string, position string")
    m = {r.request_id: r for r in dv.dvp_matchup(players, dv.dvp_metrics(facts, (["shots"], [20232024]))).collect()}
    assert (m[1].dvp_value, m[1].dvp_rank, m[1].dvp_formatted) == (0.0, 16, "0.0")
    assert m[2].dvp_rank == shots["A"].dvp_rank and m[2].position_name == "Center"


def test_eligible_players_roster_vs_history(spark):
    facts = facts_df(spark, [dict(game_id=1, date=day(0), player_id=1, team="A", opponent="B", location="home"),
                             dict(game_id=1, date=day(0), player_id=2, team="B", opponent="A", location="away",
                                  position="G")])
    roster = roster_df(spark, [("A", 7, "Seven", "C", None), ("A", 8, "Eight", "G", None),
                               ("Z", 9, "Nine", "C", None)])
    req = requests_df(spark, [(1, day(0), "A", "B", "Skater", "shots", 1.5),
                              (2, day(0), "A", "B", "Goalie", "saves", 24.5)])
    past = sorted((r.matchup_id, r.player_id) for r in pr.eligible_players(req, facts, roster, day(1)).collect())
    assert past == [(1, 1), (2, 2)]
    fut = sorted((r.matchup_id, r.player_id) for r in pr.eligible_players(req, facts, roster, day(0)).collect())
    assert fut == [(1, 7), (2, 8)]
