"""Golden fixtures for power-play, game-winning-goal and the aggregation."""

from pyspark.sql import functions as F

from puckline.operators import pbp as pb
from tests.helpers import pbp_rows

HOME, AWAY = 1, 2


def ev(i, t, **kw):
    base = dict(game_id=kw.pop("game_id", 10), event_id=i, event_type=t, situation_code="1551",
                event_owner_team_id=HOME, home_team_id=HOME, away_team_id=AWAY, duration=0,
                period_type="REG")
    base.update(kw)
    return base


def test_ppg_flag_cases(spark):
    rows = [
        ev(1, "goal", situation_code="1541", event_owner_team_id=AWAY, scoring_player_id=7),  # away PP goal
        ev(2, "goal", situation_code="1451", event_owner_team_id=HOME, scoring_player_id=8),  # home PP goal
        ev(3, "goal", situation_code="0651", event_owner_team_id=AWAY, scoring_player_id=7),  # 6 vs 5, home not short
        ev(4, "goal", situation_code="1560", event_owner_team_id=HOME, scoring_player_id=8),  # home 6 vs 5: not PPG
        ev(5, "goal", situation_code=None, event_owner_team_id=HOME, scoring_player_id=8),
        ev(6, "goal", situation_code="1A41", event_owner_team_id=AWAY, scoring_player_id=7),  # away 5 vs 4
        ev(7, "goal", situation_code="1541", event_owner_team_id=None, scoring_player_id=7),  # unknown owner
        ev(8, "hit", situation_code="1541", event_owner_team_id=AWAY, hitting_player_id=7),
    ]
    got = {r.event_id: r.is_ppg_event for r in pb.with_ppg_flag(pbp_rows(spark, rows)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: None, 8: False}


def test_gwg_home_win_and_shootout_tie(spark):
    # Game 10: home wins 4-2; the winner is the home goal making it 3.
    g10 = [ev(1, "goal", home_score=1, away_score=0, scoring_player_id=1),
           ev(2, "goal", event_owner_team_id=AWAY, home_score=1, away_score=1, scoring_player_id=5),
           ev(3, "goal", home_score=2, away_score=1, scoring_player_id=2),
           ev(4, "goal", event_owner_team_id=AWAY, home_score=2, away_score=2, scoring_player_id=5),
           ev(5, "goal", home_score=3, away_score=2, scoring_player_id=3),
           ev(6, "goal", home_score=4, away_score=2, scoring_player_id=4)]
    # Game 11: 1-1 after overtime, decided in a shootout -> no GWG; SO events dropped.
    g11 = [ev(1, "goal", game_id=11, home_score=1, away_score=0, scoring_player_id=1),
           ev(2, "goal", game_id=11, event_owner_team_id=AWAY, home_score=1, away_score=1, scoring_player_id=5,
              period_type="OT"),
           ev(3, "goal", game_id=11, home_score=2, away_score=1, scoring_player_id=2, period_type="SO")]
    # Game 12: no goals at all.
    g12 = [ev(1, "hit", game_id=12, hitting_player_id=9)]
    events = pb.without_shootout(pbp_rows(spark, g10 + g11 + g12))
    got = {(r.game_id, r.event_id): r.is_gwg_event for r in pb.gwg_goals(events).collect()}
    assert [k for k, v in got.items() if v] == [(10, 5)]
    assert got[(11, 1)] is None or got[(11, 1)] is False
    stats = {(r.game_id, r.player_id): r for r in pb.player_game_stats(pbp_rows(spark, g10 + g11 + g12)).collect()}
    assert stats[(10, 3)].game_winning_goal == 1
    assert sum(r.game_winning_goal for r in stats.values()) == 1
    assert (11, 2) not in stats  # the shootout goal is not counted at all
    assert stats[(12, 9)].hits == 1


def test_null_period_dropped_and_null_owner_not_counted(spark):
    rows = [ev(1, "goal", period_type=None, scoring_player_id=1, home_score=1, away_score=0),
            ev(2, "goal", event_owner_team_id=None, situation_code="1451", scoring_player_id=2,
               home_score=1, away_score=0)]
    stats = {r.player_id: r for r in pb.player_game_stats(pbp_rows(spark, rows)).collect()}
    assert 1 not in stats
    assert stats[2].goals == 1 and stats[2].ppg == 0 and stats[2].game_winning_goal == 0


def test_aggregation_derived_columns_and_faceoffs(spark):
    rows = [ev(1, "goal", scoring_player_id=1, assist1_player_id=2, assist2_player_id=3, home_score=1, away_score=0,
               situation_code="1451"),
            ev(2, "shot-on-goal", shooting_player_id=1),
            ev(3, "missed-shot", shooting_player_id=1),
            ev(4, "blocked-shot", shooting_player_id=1, blocking_player_id=4),
            ev(5, "penalty", committed_player_id=4, duration=2),
            ev(6, "penalty", committed_player_id=4, duration=5),
            ev(7, "faceoff", winning_player_id=2, losing_player_id=5),
            ev(8, "giveaway", player_id=3), ev(9, "takeaway", player_id=3), ev(10, "hit", hitting_player_id=6)]
    s = {r.player_id: r for r in pb.player_game_stats(pbp_rows(spark, rows)).collect()}
    p1 = s[1]
    assert (p1.goals, p1.shots, p1.missed_shots, p1.offensive_blocked_shots, p1.shot_attempts) == (1, 2, 1, 1, 4)
    assert (p1.ppg, p1.ppp, p1.points, p1.game_winning_goal) == (1, 1, 1, 1)
    assert (s[2].assists, s[2].ppa, s[2].faceoff_wins, s[2].faceoff_pct) == (1, 1, 1, 1.0)
    assert (s[4].blocked_shots, s[4].pim) == (1, 7)
    assert (s[5].faceoff_losses, s[5].faceoff_pct) == (1, 0.0)
    assert s[6].faceoff_pct == 0.0  # 0 / 0 faceoffs is 0.0, not null or an error
    assert (s[3].giveaways, s[3].takeaways, s[3].assists) == (1, 1, 1)


def test_points_equal_goals_plus_assists_on_proxy(spark):
    from puckline.sources import proxies as px
    s = pb.player_game_stats(px.pbp(spark, "/root/testdata/sf0.01"))
    assert s.filter(F.col("points") != F.col("goals") + F.col("assists")).count() == 0
    per_game = s.groupBy("game_id").agg(F.sum("game_winning_goal").alias("g"))
    assert per_game.filter("g > 1").count() == 0


def test_first_goal_events_and_requests_from_matchups(spark):
    import datetime as dt

    from puckline.operators import props as pr
    from puckline.operators.quality import first_goal_events
    rows = [ev(i, "goal", scoring_player_id=1, home_score=i, away_score=0) for i in range(1, 13)]
    rows.append(ev(13, "goal", scoring_player_id=1, period_type="SO"))
    got = first_goal_events(pbp_rows(spark, rows), 10).collect()
    assert [r.event_id for r in sorted(got, key=lambda r: r.goal_rank)] == list(range(1, 11))
    sel = spark.createDataFrame([(5, dt.date(2024, 1, 2), "AAA @ BBB")], "selection_id bigint, date string, matchup string")
    req = pr.requests_for_matchups(sel, [("Skater", "shots", 1.5)]).collect()
    assert (req[0].home, req[0].away, req[0].matchup_id) == ("BBB", "AAA", 5)
