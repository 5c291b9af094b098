"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each query reads the driver's base tables through the proxy derivations in
``puckline.sources.proxies`` (or landed documents derived from them) and runs
the library operator over all rows.  Fixed parameters are shared with
``puckline.oracle``.  Doubles that come out of averages are rounded to 6
decimals in the registered output (summation order differs between engines).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from puckline.functions import scalar as fx
from puckline.operators import boxscore as bx
from puckline.operators import dvp as dv
from puckline.operators import facts as fc
from puckline.operators import maintenance as mt
from puckline.operators import pbp as pb
from puckline.operators import props as pr
from puckline.operators import quality as qa
from puckline.operators import schedule as sc
from puckline.operators import views as vw
from puckline.operators.facts import GOALIE_PROPS, PROP_STATS
from puckline.operators.common import sides
from puckline.session import apply_conf, shared_dir
from puckline.sources import landing as ld
from puckline.sources import proxies as px
from puckline.sources import storage as st

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}

# Fixed parameters shared with the oracle SQL.
HOCKEY_TODAY = "1997-08-24"          # requests before it -> players who played, the others -> roster
HOCKEY_TODAY_ROSTER = "1990-01-01"   # before all games: every request lists the roster
ARCHIVE_SEASON = 19961997            # the season that write_roundtrip reads back and refresh_archive replaces
AS_OF = "1997-08-23"
REFRESH_DAYS = 7
UPSERT_DAYS = 365                    # a window that holds games with play-by-play
SEARCH_TEXT = "p0"
SAMPLE_AS_OF = "1999-01-01"
MISSING_AS_OF = "2001-12-31"
BACKFILL_SPLIT = "1997-06-01"        # stored raw rows: games before the old landing cut
BACKFILL_OLD_CUT = "1997-08-16"      # new landing: games from the split on (overlap)
ALL_DVP = (PROP_STATS, None)          # every prop stat, every season
BOX_ORDER = ["src_line", "src_part", "src_qty", "src_price"]


def register(name: str):
    """Register ``fn`` under ``name``; the registered callable first applies
    the package's runtime settings (UTC session zone, ANSI, AQE) to the session
    it is given, so results do not depend on the caller's defaults."""
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            apply_conf(spark)
            return fn(spark, sf)
        run.__name__ = run.__qualname__ = f"query_{name}"
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def r6(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


# ------------------------------------------------------------ shared inputs

def _events(spark, sf):
    return pb.without_shootout(px.pbp(spark, sf))


def _box(spark, sf, games=None):
    """Stored boxscores: proxy rows (of ``games`` only, if given) deduplicated, helper columns dropped."""
    rows = px.box(spark, sf)
    if games is not None:  # before the dedupe, which keeps or drops no whole game
        rows = rows.join(games, "game_id", "left_semi")
    return bx.dedupe_boxscores(rows, BOX_ORDER).drop(*px.BOX_SOURCE_COLUMNS)


def _stats(spark, sf):
    return pb.player_game_stats(px.pbp(spark, sf))


def _combined(spark, sf):
    return bx.combine_boxscores(_box(spark, sf), _stats(spark, sf),
                                sc.with_days_rest(px.schedule(spark, sf)))


def _requests(spark, sf):
    """Every prop of the catalogue for every game."""
    return pr.requests_for_games(px.games(spark, sf), pr.default_props())


def _targets(spark, sf, today=HOCKEY_TODAY):
    return pr.targets_for(px.facts(spark, sf), px.roster(spark, sf), _requests(spark, sf), today)


def _lines(spark, sf):
    """What the targets ask, once for all matchups of a day and pair of teams."""
    return pr.lines_for(px.facts(spark, sf), px.roster(spark, sf), _requests(spark, sf), HOCKEY_TODAY)


def _logs(spark, sf):
    """The player view's logs: every player, scope, location and rest filter."""
    return vw.view_logs(px.facts(spark, sf))


def _newest(spark, sf, n):
    """The logs without games that lie behind their ``n`` newest."""
    return vw.newest_logs(px.facts(spark, sf), n)


# ------------------------------------------------------------ sources and sinks

@register("scan_parquet")
def q_scan_parquet(spark, sf):
    # Season 1996-97 as a date range on the raw column: pushed into the scan.
    d = F.col("o_orderdate")
    season = (d >= F.lit(_dt.datetime(1996, 9, 1))) & (d < F.lit(_dt.datetime(1997, 9, 1)))
    return px.games(spark, sf, season).drop("home_team_id", "away_team_id")


@register("scan_all_seasons")
def q_scan_all_seasons(spark, sf):
    path = shared_dir(spark, "facts")
    st.write_seasons(px.facts(spark, sf), path)
    return st.scan_all_seasons(spark, path)


@register("scan_schedule_projected")
def q_scan_schedule_projected(spark, sf):
    return st.scan_schedule_projected(px.schedule(spark, sf))


@register("roster_dim")
def q_roster_dim(spark, sf):
    return fc.roster_dim(px.roster(spark, sf))


@register("write_roundtrip")
def q_write_roundtrip(spark, sf):
    path = shared_dir(spark, "schedule")
    st.write_seasons(sc.with_days_rest(px.schedule(spark, sf)), path)
    return st.scan_all_seasons(spark, path, seasons=[ARCHIVE_SEASON])


@register("refresh_archive")
def q_refresh_archive(spark, sf):
    base = shared_dir(spark, "warehouse")
    box = _box(spark, sf).join(px.schedule(spark, sf).select("game_id", "season").hint("merge"), "game_id")
    combined = bx.combine_boxscores(box, _stats(spark, sf), sc.with_days_rest(px.schedule(spark, sf)), ["season"])
    st.write_seasons(combined, f"{base}/comprehensive")
    # The season that lands again is read from the table, not computed a second time.
    stored = st.scan_all_seasons(spark, f"{base}/comprehensive", [ARCHIVE_SEASON], combined.schema)
    new = stored.withColumn("shifts", F.col("shifts") + 1)
    return st.archive_and_replace(new, f"{base}/comprehensive", f"{base}/archive",
                                  f"{base}/staging", "20240101_000000")


@register("flatten_schedule")
def q_flatten_schedule(spark, sf):
    return ld.flatten_schedule(ld.landed_team_schedules(spark, sf))


@register("flatten_scores")
def q_flatten_scores(spark, sf):
    return ld.flatten_scores(ld.landed_scores(spark, sf))


@register("flatten_roster")
def q_flatten_roster(spark, sf):
    return ld.flatten_roster(ld.landed_rosters(spark, sf))


@register("flatten_boxscore")
def q_flatten_boxscore(spark, sf):
    return ld.flatten_boxscore(ld.landed_boxscores(spark, sf))


@register("flatten_pbp")
def q_flatten_pbp(spark, sf):
    return ld.flatten_pbp(ld.landed_pbp(spark, sf))


@register("active_teams")
def q_active_teams(spark, sf):
    return ld.active_teams(ld.landed_standings(spark, sf), ld.landed_seasons(spark, sf))


# ------------------------------------------------------------ filters

@register("filter_predicates")
def q_filter_predicates(spark, sf):
    s = px.schedule(spark, sf)
    return s.filter(((F.col("home_score") > F.col("away_score")) & (F.col("venue") != "V05"))
                    | ~(F.col("game_type") == 2))


@register("semi_filter_games")
def q_semi_filter_games(spark, sf):
    return _box(spark, sf).join(px.pbp(spark, sf).select("game_id").distinct(), "game_id", "left_semi")


@register("filter_game_types")
def q_filter_game_types(spark, sf):
    return sc.filter_game_types(px.schedule(spark, sf), ("R", "P"))


@register("player_log_filtered")
def q_player_log_filtered(spark, sf):
    """Every log of the player view (105 filter combinations of any season and opponent look one up),
    with the values of every stat that a view can show."""
    return _logs(spark, sf).select(*vw.LOG, "game_id", "date", "season", "opponent", "location", "days_rest", *PROP_STATS)


@register("recent_games")
def q_recent_games(spark, sf):
    return sc.recent_games(ld.flatten_scores(ld.landed_scores(spark, sf)), AS_OF, REFRESH_DAYS)


@register("player_search")
def q_player_search(spark, sf):
    """Through the inverted index of names (which the jobs keep as a table)."""
    return qa.search_names(qa.name_postings(_box(spark, sf)), SEARCH_TEXT)


# ------------------------------------------------------------ joins

@register("join_box_stats")
def q_join_box_stats(spark, sf):
    return bx.join_box_stats(_box(spark, sf), _stats(spark, sf))


@register("dvp_matchup")
def q_dvp_matchup(spark, sf):
    t = _targets(spark, sf)
    players = t.select(*pr.TARGET, F.col("req_season").alias("season"), "stat",
                       F.col("team_abbrev").alias("team"), F.col("h2h_opponent").alias("opponent"),
                       F.col("position_code").alias("position"))
    scope = _lines(spark, sf).select(F.col("req_season").alias("season"), "stat").distinct()
    # The table is rounded, not what is looked up in it: it has fewer rows.
    out = dv.dvp_matchup(players, r6(dv.dvp_metrics(px.facts(spark, sf), scope), ["avg_allowed"]))
    return _safe_dvp(out, "dvp_exact").drop("dvp_exact", "team")


@register("history_asof")
def q_history_asof(spark, sf):
    return pr.history_asof(px.facts(spark, sf), _lines(spark, sf))


@register("history_asof_before")
def q_history_asof_before(spark, sf):
    return pr.history_asof(px.facts(spark, sf), _lines(spark, sf), inclusive=False)


@register("requests_for_matchups")
def q_requests_for_matchups(spark, sf):
    options = vw.matchup_options(px.schedule(spark, sf))
    return pr.requests_for_matchups(options.withColumnRenamed("first_game_id", "selection_id"), pr.default_props())


# ------------------------------------------------------------ aggregations

@register("player_game_stats")
def q_player_game_stats(spark, sf):
    return _stats(spark, sf)


@register("dvp_team_defense")
def q_dvp_team_defense(spark, sf):
    return r6(dv.dvp_team_defense(px.facts(spark, sf), ALL_DVP), ["avg_allowed"])


@register("dvp_position_avg")
def q_dvp_position_avg(spark, sf):
    return r6(dv.dvp_position_avg(px.facts(spark, sf), ALL_DVP), ["league_avg"])


def _rates(spark, sf, columns):
    return pr.rates(px.facts(spark, sf), px.roster(spark, sf), _requests(spark, sf), HOCKEY_TODAY).select(*pr.TARGET, *columns)


@register("rate_season")
def q_rate_season(spark, sf):
    return _rates(spark, sf, pr.season_cols())


@register("rate_h2h")
def q_rate_h2h(spark, sf):
    return _rates(spark, sf, pr.h2h_cols())


@register("rate_last_n")
def q_rate_last_n(spark, sf):
    return _rates(spark, sf, pr.last_n_cols())


@register("rate_location")
def q_rate_location(spark, sf):
    return _rates(spark, sf, pr.location_cols())


@register("chart_summary")
def q_chart_summary(spark, sf):
    return r6(vw.log_summaries(_newest(spark, sf, vw.CHART_GAMES)),
              ["avg_shot_attempts", "avg_missed_shots", "avg_toi_minutes", "avg_shifts"])


# ------------------------------------------------------------ windows, sorts

@register("schedule_days_rest")
def q_schedule_days_rest(spark, sf):
    return sc.with_days_rest(px.schedule(spark, sf))


@register("pbp_gwg_flag")
def q_pbp_gwg_flag(spark, sf):
    return pb.gwg_goals(_events(spark, sf)).select(
        "game_id", "event_id", "scoring_player_id", "final_home_score", "final_away_score",
        "winning_team_id", "is_gwg_event")


@register("sort_schedule")
def q_sort_schedule(spark, sf):
    return px.schedule(spark, sf).orderBy("date", "game_id")


@register("top_n_games")
def q_top_n_games(spark, sf):
    return vw.top_n_games(px.facts(spark, sf), 10).select("player_id", "game_id", "date", "game_rank")


@register("chart_series")
def q_chart_series(spark, sf):
    return r6(vw.log_charts(_newest(spark, sf, vw.CHART_GAMES), _lines(spark, sf)), ["avg_value"])


@register("game_log")
def q_game_log(spark, sf):
    return vw.ranked_logs(_newest(spark, sf, vw.LOG_GAMES), vw.LOG_GAMES).select(*vw.LOG, "game_id", "date", "log_rank", *PROP_STATS)


@register("sample_games")
def q_sample_games(spark, sf):
    return sc.sample_games(px.schedule(spark, sf), SAMPLE_AS_OF, 32)


# ------------------------------------------------------------ sets

@register("dedupe_boxscores")
def q_dedupe_boxscores(spark, sf):
    return bx.dedupe_boxscores(px.box(spark, sf), BOX_ORDER)


@register("season_schedule")
def q_season_schedule(spark, sf):
    return sc.season_schedule(ld.flatten_schedule(ld.landed_team_schedules(spark, sf)))


@register("union_home_away")
def q_union_home_away(spark, sf):
    return sides(px.schedule(spark, sf), keep=["game_id", "date", "season"])


@register("complete_games")
def q_complete_games(spark, sf):
    return qa.complete_games(px.pbp(spark, sf), _box(spark, sf))


@register("missing_games")
def q_missing_games(spark, sf):
    return qa.missing_games(px.schedule(spark, sf), px.pbp(spark, sf), _box(spark, sf), MISSING_AS_OF)


# ------------------------------------------------------------ reshape, scalar

@register("pbp_unpivot")
def q_pbp_unpivot(spark, sf):
    return pb.unpivot_roles(_events(spark, sf), ["game_id", "event_id", "event_type"])


@register("stats_long")
def q_stats_long(spark, sf):
    return fc.stats_long(px.facts(spark, sf))


@register("pbp_strength")
def q_pbp_strength(spark, sf):
    return pb.with_strength(px.pbp(spark, sf)).select(
        "game_id", "event_id", "situation_code", "away_skaters", "home_skaters")


@register("season_of_date")
def q_season_of_date(spark, sf):
    s = px.schedule(spark, sf)
    sid = fx.season_of_date(F.to_date("date"))
    return s.select("game_id", "date", "season", sid.alias("season_id"),
                    fx.season_label(sid).alias("season_label"))


@register("toi_minutes")
def q_toi_minutes(spark, sf):
    return px.box(spark, sf).select("game_id", "player_id", "src_line", "toi",
                                    fx.toi_minutes("toi").alias("toi_minutes"))


@register("hockey_date")
def q_hockey_date(spark, sf):
    s = px.schedule(spark, sf)
    ts = F.try_to_timestamp(F.col("start_time"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return s.select("game_id", "start_time", fx.hockey_date(ts).alias("hockey_date"))


# ------------------------------------------------------------ composites

@register("pbp_ppg_flag")
def q_pbp_ppg_flag(spark, sf):
    return pb.with_ppg_flag(_events(spark, sf)).select(
        "game_id", "event_id", "event_type", "away_skaters", "home_skaters", "is_ppg_event")


@register("combine_boxscores")
def q_combine_boxscores(spark, sf):
    return _combined(spark, sf)


@register("backfill_merge")
def q_backfill_merge(spark, sf):
    g = px.schedule(spark, sf).select("game_id", "date")
    box, ev = px.box(spark, sf), px.pbp(spark, sf)
    box = bx.dedupe_boxscores(box, BOX_ORDER).drop(*px.BOX_SOURCE_COLUMNS).join(g, "game_id")
    ev = ev.join(g, "game_id")
    old = F.col("date") < BACKFILL_OLD_CUT
    new = F.col("date") >= BACKFILL_SPLIT
    cols_b = [c for c in box.columns if c != "date"]
    cols_e = [c for c in ev.columns if c != "date"]
    return mt.backfill_merge(box.filter(old).select(*cols_b), box.filter(new).select(*cols_b),
                             ev.filter(old).select(*cols_e), ev.filter(new).select(*cols_e),
                             sc.with_days_rest(px.schedule(spark, sf)))


@register("refresh_upsert")
def q_refresh_upsert(spark, sf):
    """The games of the refresh window land again, with one more shift per player."""
    sched = sc.with_days_rest(px.schedule(spark, sf))
    ids = sc.recent_games(ld.flatten_scores(ld.landed_scores(spark, sf)), AS_OF, UPSERT_DAYS).select("game_id")
    landed = _box(spark, sf, ids).withColumn("shifts", F.col("shifts") + 1)
    incoming = bx.combine_boxscores(
        landed, pb.player_game_stats(px.pbp(spark, sf).join(ids, "game_id", "left_semi")), sched)
    return mt.upsert_games(_combined(spark, sf), incoming)


@register("build_facts")
def q_build_facts(spark, sf):
    return fc.build_facts(_combined(spark, sf), px.schedule(spark, sf), px.roster(spark, sf))


@register("win_flag")
def q_win_flag(spark, sf):
    f = px.facts(spark, sf)
    return f.select("game_id", "player_id", "location", "home_score", "away_score",
                    fc.win_flag(f).alias("win"))


def _safe_dvp(df, exact):
    """Rounded values and texts where no rounding tie and no signed zero can
    make two engines differ; null elsewhere."""
    x = F.col(exact)
    return df.withColumns({"dvp_value": F.when(_steady(x, 100), F.col("dvp_value")),
                           "dvp_formatted": F.when(_steady(x, 10), F.col("dvp_formatted"))})


def _steady(x, scale):
    """Whether ``x`` times ``scale`` is neither a rounding tie nor near a signed zero."""
    return ~(F.abs(x * scale - F.floor(x * scale) - 0.5) < 1e-6) & (F.abs(x) >= 0.05)


def _dvp(spark, sf, stats=PROP_STATS, key="team"):
    d = dv.dvp_metrics(px.facts(spark, sf), (stats, None), key)
    return r6(_safe_dvp(d, "schedule_adjusted_dvp"),
              ["schedule_adjusted_dvp", "avg_allowed", "league_avg", "schedule_strength_factor"])


@register("dvp_schedule_strength")
def q_dvp_schedule_strength(spark, sf):
    return r6(dv.dvp_schedule_strength(px.facts(spark, sf), ALL_DVP),
              ["schedule_strength_factor"])


@register("dvp_metrics")
def q_dvp_metrics(spark, sf):
    return _dvp(spark, sf)


@register("dvp_metrics_opponent")
def q_dvp_metrics_opponent(spark, sf):
    return _dvp(spark, sf, key="opponent")


@register("dvp_metrics_nan")
def q_dvp_metrics_nan(spark, sf):
    return _dvp(spark, sf, GOALIE_PROPS)


@register("eligible_players")
def q_eligible_players(spark, sf):
    return pr.eligible_players(_requests(spark, sf), px.facts(spark, sf), px.roster(spark, sf),
                               HOCKEY_TODAY)


@register("eligible_players_roster")
def q_eligible_players_roster(spark, sf):
    return pr.eligible_players(_requests(spark, sf), px.facts(spark, sf), px.roster(spark, sf),
                               HOCKEY_TODAY_ROSTER)


@register("prop_table")
def q_prop_table(spark, sf):
    return pr.prop_table(px.facts(spark, sf), px.roster(spark, sf), _requests(spark, sf),
                         HOCKEY_TODAY)


@register("prop_table_regular_before")
def q_prop_table_regular_before(spark, sf):
    """Regular-season games before the selected date only."""
    return pr.prop_table(px.facts(spark, sf), px.roster(spark, sf), _requests(spark, sf), HOCKEY_TODAY,
                         game_types=("R",), inclusive=False)


@register("prop_table_formatted")
def q_prop_table_formatted(spark, sf):
    return pr.prop_table_formatted(q_prop_table(spark, sf))


@register("matchup_overview")
def q_matchup_overview(spark, sf):
    """The DvP text is shown where no rounding tie can make two engines differ."""
    out = pr.matchup_overview(px.facts(spark, sf), px.roster(spark, sf), _requests(spark, sf), HOCKEY_TODAY)
    return out.withColumn("DvP", F.when(F.col("dvp_exact").isNull() | _steady(F.col("dvp_exact"), 10), F.col("DvP"))).drop("dvp_exact")


@register("daily_slate")
def q_daily_slate(spark, sf):
    return vw.daily_slate(px.schedule(spark, sf))


@register("matchup_options")
def q_matchup_options(spark, sf):
    return vw.matchup_options(px.schedule(spark, sf))


@register("player_header")
def q_player_header(spark, sf):
    """Every listed player of every matchup."""
    return vw.player_header(_targets(spark, sf), px.roster(spark, sf), px.facts(spark, sf))


@register("kpi_rates")
def q_kpi_rates(spark, sf):
    """Every (player, season, opponent, prop) that a request asks, under all 105 filter combinations."""
    return vw.view_kpis(px.facts(spark, sf), _lines(spark, sf))


# ------------------------------------------------------------ data quality

@register("integrity_checks")
def q_integrity_checks(spark, sf):
    return bx.integrity_checks(_combined(spark, sf))


@register("join_coverage")
def q_join_coverage(spark, sf):
    return bx.join_coverage(_box(spark, sf), _stats(spark, sf))


@register("goal_reconciliation")
def q_goal_reconciliation(spark, sf):
    return qa.goal_reconciliation(px.pbp(spark, sf), _stats(spark, sf))


@register("first_goal_events")
def q_first_goal_events(spark, sf):
    return qa.first_goal_events(px.pbp(spark, sf))
