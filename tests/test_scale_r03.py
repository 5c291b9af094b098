"""Work that must not grow with requests or logs: listed players, joins of requests, newest games of logs."""

from pyspark.sql import functions as F

from puckline.operators import props as pr
from puckline.operators import views as vw
from puckline.sources import proxies as px
from tests.test_props_dvp import day, facts_df, requests_df, roster_df


def _plan(spark, df) -> str:
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def _season(spark, n=120):
    """Two games a day between A and B, two players each; one of a game's rows per player."""
    rows = []
    for i in range(n):
        for p, team, opp, loc, pos in ((1, "A", "B", "home", "C"), (2, "A", "B", "home", "G"), (3, "B", "A", "away", "C")):
            rows.append(dict(game_id=i, date=day(i // 2), player_id=p, team=team, opponent=opp, location=loc, position=pos,
                             days_rest=i % 5, shots=float(i % 4), saves=float(i % 30)))
    return facts_df(spark, rows)


def test_players_are_listed_once_per_day_and_teams(spark):
    facts = _season(spark)
    req = requests_df(spark, [(m, day(0), "A", "B", t, s, 1.5) for m in range(50) for t, s in (("Skater", "shots"), ("Goalie", "saves"))])
    listed = pr.matchup_players(req, facts, roster_df(spark, [("A", 9, "Nine", "C", None)]), day(99))
    assert sorted(r.player_id for r in listed.collect()) == [1, 2, 3]
    got = pr.eligible_players(req, facts, roster_df(spark, [("A", 9, "Nine", "C", None)]), day(99))
    assert got.count() == 50 * 3


def test_requests_without_a_matchup_list_nobody_and_lines_are_met_once(spark):
    facts, roster = _season(spark), roster_df(spark, [("A", 9, "Nine", "C", None)])
    req = requests_df(spark, [(m, day(0), "A", "B", "Skater", "shots", 1.5) for m in (1, 2, None)])
    assert pr.eligible_players(req, facts, roster, day(99)).count() == 4
    lines = pr.lines_for(facts, roster, req, day(99))
    assert sorted((r.player_id, r.stat, r.threshold) for r in lines.collect()) == [(1, "shots", 1.5), (3, "shots", 1.5)]


def test_requests_are_never_broadcast(spark):
    sf = "/root/testdata/sf0.001"
    req = pr.requests_for_games(px.games(spark, sf), pr.default_props())
    plan = _plan(spark, pr.targets_for(px.facts(spark, sf), px.roster(spark, sf), req, "1997-08-24"))
    merges = [line for line in plan.splitlines() if "SortMergeJoin" in line and "goalie" in line]
    assert len(merges) == 1


def test_games_are_never_broadcast_to_player_rows(spark):
    assert "BroadcastHashJoin" not in _plan(spark, px.facts(spark, "/root/testdata/sf0.001"))


def test_newest_logs_offer_few_games_and_rank_alike(spark):
    facts = _season(spark, 1000)
    few, whole = vw.newest_logs(facts, 25), vw.view_logs(facts)
    assert few.count() * 3 < whole.count()
    cols = [*vw.LOG, "game_id", "log_rank"]
    got, want = (vw.ranked_logs(x, 25).select(*cols) for x in (few, whole))
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_player_log_carries_the_value_of_every_stat(spark):
    from puckline.operators.facts import PROP_STATS
    from puckline.registry import QUERIES
    log = QUERIES["player_log_filtered"](spark, "/root/testdata/sf0.001")
    assert set(PROP_STATS) <= set(log.columns)
    assert log.filter(F.col("saves") > 0).count() > 0


def test_a_game_is_written_to_its_logs_by_one_generator(spark):
    plan = _plan(spark, vw.view_logs(_season(spark)))
    assert plan.count("Generate ") == 2 and "lambda" not in plan  # dated games, last games


def test_logs_of_games_without_season_opponent_location_or_rest(spark):
    rows = [dict(game_id=i, date=day(i), player_id=1, team="A", opponent="B", location="home", position="C", days_rest=i) for i in range(6)]
    rows += [dict(rows[0], game_id=6, date=day(6), season=None, opponent=None, location=None, days_rest=None),
             dict(rows[0], game_id=7, date=day(7), location="neutral", days_rest=-1, player_id=None)]
    facts = facts_df(spark, rows)
    logs = vw.view_logs(facts)
    assert logs.columns == [*facts.columns, *vw.SCOPE, "location_filter", "rest_filter"]
    got = sorted((r.game_id, r.log_kind, r.log_value or "", r.location_filter, r.rest_filter) for r in logs.collect())
    want = []
    for r in facts.collect():
        newer = sum(1 for o in rows if o["player_id"] == r.player_id and o["game_id"] > r.game_id)
        scopes = [("season", str(r.season or "")), ("h2h", r.opponent or ""), ("all", "")] + [(f"L{n}", "") for n in vw.LAST_GAMES if newer < n]
        rest = {0: ["0"], 1: ["1"], 2: ["2"], None: [], -1: []}.get(r.days_rest, ["3+"])
        want += [(r.game_id, *s, loc, x) for s in scopes for loc in ["any"] + ["home"] * (r.location == "home") for x in ["any", *rest]]
    assert got == sorted(want)


def test_facts_are_deduplicated_without_the_text_of_their_minutes(spark):
    facts = px.facts(spark, "/root/testdata/sf0.001").select("game_id", "player_id", "shots")
    assert "x:30" not in _plan(spark, facts)


def test_events_are_never_broadcast(spark):
    assert "BroadcastHashJoin" not in _plan(spark, px.pbp(spark, "/root/testdata/sf0.001").select("game_id").distinct())


def test_missing_games_join_ids_apart_from_the_rows_they_come_from(spark):
    from puckline.operators import boxscore as bx
    from puckline.operators import quality as qa
    sf = "/root/testdata/sf0.001"
    box = bx.dedupe_boxscores(px.box(spark, sf), ["src_line", "src_part", "src_qty", "src_price"])
    plan = _plan(spark, qa.missing_games(px.schedule(spark, sf), px.pbp(spark, sf), box, "2001-12-31"))
    assert plan.count("REBALANCE_PARTITIONS_BY_COL") == 2  # a stage each for events and for boxscore rows


def test_missing_games_of_repeated_and_null_ids(spark):
    from puckline.operators import quality as qa
    schedule = spark.createDataFrame([(1, "2001-01-01"), (2, "2001-01-02"), (2, "2001-01-02"), (3, "2001-01-03"), (None, "2001-01-04"), (4, None),
                                      (5, "2002-01-01")], "game_id bigint, date string")
    pbp = spark.createDataFrame([(1,), (1,), (3,), (None,)], "game_id bigint")
    box = spark.createDataFrame([(1,), (2,), (2,), (None,)], "game_id bigint")
    got = sorted((tuple(r) for r in qa.missing_games(schedule, pbp, box, "2001-12-31").collect()), key=str)
    assert got == sorted([(2, "2001-01-02", False, True)] * 2 + [(3, "2001-01-03", True, False), (None, "2001-01-04", False, False)], key=str)
