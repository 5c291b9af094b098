"""Datasets behind the slate, the player view (filtered log, KPIs, charts,
game log) and the player header - for many selections at once.

A selection is (matchup_id, prop_id, player_id, team_abbrev, spec_id) with selected_date,
home, away, stat, threshold, opponent_team and the filters game_filter
(``season`` / ``last_season`` / ``h2h`` / ``L5`` / ``L10`` / ``L20`` /
``L30``), location_filter (``any`` / ``home`` / ``away``) and rest_filter
(``any`` / ``0`` / ``1`` / ``2`` / ``3+``).
Every "first N games" is ``row_number() <= N`` with a literal N, which Spark
plans as a WindowGroupLimit (partial top-N before the shuffle).

The whole filter space at once (``view_logs`` and what builds on it): a view
has no date cutoff, so its game log depends on the player and on one of a few
scopes - a season, an opponent, the whole history, the last N games - and not
on the request.  Every game is offered to its scopes and, there, to the four
points of the location x rest lattice that hold it (any or its own on either
axis).  All logs of all players come from one pass; a view of any season,
opponent and game filter looks its log up.

A log is a union of cells (season, opponent, location, rest filter) of its
player.  Where only the newest games or the sums of a log are wanted, the games
are cut or summed per cell first, and the cells are offered instead of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from puckline.functions.scalar import (HOCKEY_ZONE, matchup_label, season_label,
                                       season_of_date)
from puckline.operators.common import pick_first
from puckline.operators.facts import GOALIE_PROPS
from puckline.operators.props import HITS, TARGET, asked_pairs, hit_columns, stat_value
from puckline.session import materialize

SEL = [*TARGET, "spec_id"]
LAST_GAMES = (5, 10, 20, 30)
CHART_GAMES = 25
LOG_GAMES = 50
REST_CAP_LABEL = "3+"
GAME_FILTERS = ("season", "last_season", "h2h", *(f"L{n}" for n in LAST_GAMES))
LOCATIONS = ("any", "home", "away")
RESTS = ("any", "0", "1", "2", REST_CAP_LABEL)
#: The lattice of location and rest filters, in display order.
COMBINATIONS = [(loc, rest) for loc in LOCATIONS for rest in RESTS]
#: A log: one player's games in a scope (kind, value) under a location and a rest filter.
SCOPE = ["log_kind", "log_value"]
LOG = ["player_id", *SCOPE, "location_filter", "rest_filter"]


def _newest_first() -> list[Column]:
    return [F.col("date").desc(), F.col("game_id").desc()]


def top_n_games(facts: DataFrame, n: int, part: Sequence[str] = ("player_id",)) -> DataFrame:
    """The ``n`` most recent games per partition (ties on date by game id)."""
    w = Window.partitionBy(*part).orderBy(*_newest_first())
    return facts.withColumn("game_rank", F.row_number().over(w)).filter(F.col("game_rank") <= n)


# ----------------------------------------------------------------- slate

def daily_slate(schedule: DataFrame) -> DataFrame:
    """Per game: local start time (New York, ``hh:mm AM``), ``A @ H``, venue."""
    ts = F.try_to_timestamp(F.col("start_time"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    local = F.from_utc_timestamp(ts, HOCKEY_ZONE)
    return schedule.select(
        "date", "game_id", F.date_format(local, "hh:mm a").alias("time_est"),
        F.col("home_abbrev").alias("home"), F.col("away_abbrev").alias("away"),
        F.coalesce(F.col("venue"), F.lit("Unknown")).alias("venue"),
        matchup_label("away_abbrev", "home_abbrev").alias("matchup"), "start_time")


def matchup_options(schedule: DataFrame) -> DataFrame:
    """Distinct ``A @ H`` per date, ordered by the first game id showing it."""
    m = schedule.select("date", "game_id", matchup_label("away_abbrev", "home_abbrev").alias("matchup"))
    return (m.groupBy("date", "matchup").agg(F.min("game_id").alias("first_game_id"))
            .orderBy("date", "first_game_id"))


# ----------------------------------------------------------------- player view

def player_log_filtered(facts: DataFrame, selections: DataFrame) -> DataFrame:
    """Each selection's game log: game filter first (season, last season, H2H
    or the last N games), then the location and rest-day filters.

    Every game filter is an equi-join: a fact row is offered once under its
    season, once under its opponent and once for selections without an
    opponent, and a player's most recent games once more with their rank.
    """
    def look_up(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    most = max(LAST_GAMES)
    dated = facts.withColumns({"game_rank": F.lit(0), "at": F.explode(F.array(
        look_up("season", F.col("season")), look_up("h2h", F.col("opponent")), look_up("all", F.lit(""))))})
    recent = top_n_games(facts, most).withColumn("at", look_up("recent", F.lit("")))
    games = dated.unionByName(recent).withColumnsRenamed({"player_id": "_player"})
    gf, cur = F.col("game_filter"), season_of_date("selected_date")
    asked = selections.withColumns({
        "first_n": F.when(gf.startswith("L"), F.substring(gf, 2, 9).try_cast("int")).otherwise(0),
        "want": F.when(gf == "season", look_up("season", cur))
                 .when(gf == "last_season", look_up("season", cur - 10001))
                 .when((gf == "h2h") & F.col("opponent_team").isNull(), look_up("all", F.lit("")))
                 .when(gf == "h2h", look_up("h2h", F.col("opponent_team")))
                 .when(gf.isin(*[f"L{n}" for n in LAST_GAMES]), look_up("recent", F.lit("")))})
    log = asked.join(games, (F.col("player_id") == F.col("_player")) & (F.col("want.kind") == F.col("at.kind"))
                     & (F.col("want.value") == F.col("at.value")) & (F.col("game_rank") <= F.col("first_n")))
    loc, rest = F.col("location_filter"), F.col("rest_filter")
    keep = ((loc == "any") | (F.col("location") == loc)) & (
        (rest == "any")
        | ((rest == REST_CAP_LABEL) & (F.col("days_rest") >= 3))
        | ((rest != REST_CAP_LABEL) & (F.col("days_rest") == rest.try_cast("int"))))
    return (log.filter(keep).withColumn("value", stat_value(F.col("stat")))
            .drop("_player", "want", "at", "game_rank", "first_n"))


def _first_n(log: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy(*SEL).orderBy(*_newest_first())
    return log.withColumn("log_rank", F.row_number().over(w)).filter(F.col("log_rank") <= n)


def _rate(hit: Column, cond: Column, name: str) -> list[Column]:
    games = F.count_if(cond).cast("bigint")
    hits = F.count_if(cond & hit).cast("bigint")
    return [F.when(games > 0, hits.cast("double") / games.cast("double") * 100.0)
            .otherwise(F.lit(0.0)).alias(f"{name}_pct"), games.alias(f"{name}_games")]


def kpi_rates(log: DataFrame, selections: DataFrame) -> DataFrame:
    """Season, H2H, last 5 and last 10 hit rates on the filtered log; an empty
    set reads 0 % over 0 games.  Texts use half-even rounding."""
    hit = F.col("value") >= F.col("threshold")
    cur = season_of_date("selected_date")
    whole = log.groupBy(*SEL).agg(
        *_rate(hit, F.col("season") == cur, "season"),
        *_rate(hit, F.col("opponent_team").isNotNull() & (F.col("opponent") == F.col("opponent_team")), "h2h"))
    recent = _first_n(log, 10).groupBy(*SEL).agg(
        *_rate(hit, F.col("log_rank") <= 5, "l5"), *_rate(hit, F.col("log_rank") <= 10, "l10"))
    out = selections.select(*SEL).join(whole, SEL, "left").join(recent, SEL, "left")
    cols = [*SEL]
    for k in ("season", "h2h", "l5", "l10"):
        p = F.coalesce(F.col(f"{k}_pct"), F.lit(0.0))
        g = F.coalesce(F.col(f"{k}_games"), F.lit(0)).cast("bigint")
        text = F.concat(F.bround(p, 0).cast("int").cast("string"), F.lit("%"))
        if k == "h2h":
            text = F.when(g > 0, text).otherwise(F.lit("n/a"))
        cols += [p.alias(f"{k}_pct"), g.alias(f"{k}_games"), text.alias(f"{k}_text")]
    return out.select(*cols)


def chart_series(log: DataFrame) -> DataFrame:
    """Last 25 games (oldest first in the chart): label, value, hit flag,
    line and the y-axis maximum (max value + 1)."""
    last = _first_n(log, CHART_GAMES)
    w = Window.partitionBy(*SEL)
    return last.select(
        *SEL, "game_id", "date", "log_rank",
        F.concat(F.date_format("date", "MM/dd"), F.lit(" vs "), F.col("opponent")).alias("label"),
        "value", (F.col("value") >= F.col("threshold")).alias("hit"), "threshold",
        (F.max("value").over(w) + 1).alias("y_max"))


def chart_summary(log: DataFrame) -> DataFrame:
    """Means of four secondary stats over the chart's 25 games; goalie stats have no summary."""
    last = _first_n(log.filter(~F.col("stat").isin(*GOALIE_PROPS)), CHART_GAMES)
    return last.groupBy(*SEL).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in ("shot_attempts", "missed_shots", "toi_minutes", "shifts")])


def game_log(log: DataFrame) -> DataFrame:
    """The 50 most recent rows of each filtered log."""
    return _first_n(log, LOG_GAMES)


# ----------------------------------------------------------------- the whole filter space

def _scope(kind: Column | str, value: Column | str) -> Column:
    kind, value = (F.lit(x) if isinstance(x, str) else x for x in (kind, value))
    return F.struct(kind.alias("log_kind"), value.cast("string").alias("log_value"))


def scope_of(game_filter: Column, season: Column, opponent: Column) -> Column:
    """The scope that a view's game filter looks up; head-to-head without an opponent is the whole history."""
    return (F.when(game_filter == "season", _scope("season", season))
            .when(game_filter == "last_season", _scope("season", season - 10001))
            .when((game_filter == "h2h") & opponent.isNull(), _scope("all", ""))
            .when(game_filter == "h2h", _scope("h2h", opponent))
            .otherwise(_scope(game_filter, "")))


def view_logs(facts: DataFrame, part: Sequence[str] = ("player_id",)) -> DataFrame:
    """Every game under every log that holds it: the columns of ``facts`` and
    log_kind, log_value, location_filter, rest_filter.

    A game has three scopes (its season, its opponent, all), a player's 30 most
    recent games up to four more, and each scope at most four lattice points."""
    return _dated(facts).unionByName(_recent(facts, part))


def newest_logs(facts: DataFrame, n: int, part: Sequence[str] = ("player_id",)) -> DataFrame:
    """``view_logs`` of the games that can be among the ``n`` newest of a log:
    only the newest of each cell are offered to scopes and lattice points."""
    return view_logs(_newest_of_cells(facts, n, part), part)


def _newest_of_cells(games: DataFrame, n: int, part: Sequence[str]) -> DataFrame:
    """The newest games of each cell of a player: ``n``, and those that can be a player's last games."""
    cut = top_n_games(games.withColumn("_rest", _rest()), max(n, *LAST_GAMES), [*part, *CELL])
    return cut.drop("game_rank", "_rest")


#: Games of a player that lie in the same logs, apart from those of the last N games.
CELL = ["season", "opponent", "location", "_rest"]


def _rest() -> Column:
    """The rest filter (besides any) that holds a game."""
    return (F.when(F.col("days_rest") >= 3, F.lit(REST_CAP_LABEL))
            .when(F.col("days_rest").isin(0, 1, 2), F.col("days_rest").cast("string")))


def _dated(games: DataFrame, rest: Column | None = None) -> DataFrame:
    """Games (or cells) under the logs of their season, their opponent and all."""
    return _at_lattice(games, [_scope("season", F.col("season")), _scope("h2h", F.col("opponent")), _scope("all", "")], rest)


def _recent(games: DataFrame, part: Sequence[str]) -> DataFrame:
    """The most recent games under the logs of the last 5, 10, 20 and 30 that hold them."""
    return _at_lattice(top_n_games(games, max(LAST_GAMES), part),
                       [_scope(F.when(F.col("game_rank") <= n, F.lit(f"L{n}")), "") for n in LAST_GAMES]).drop("game_rank")


def _at_lattice(games: DataFrame, scopes: Sequence[Column], rest: Column | None = None) -> DataFrame:
    """Games at their scopes (those with a kind) and, there, at the lattice points that hold them.

    One generator writes all of a game's rows, so that its columns are copied once per row of the logs."""
    own = F.when(F.col("location").isin("home", "away"), F.col("location"))
    held = games.withColumns({"_own": own, "_held": _rest() if rest is None else rest,
                              **{f"_at{i}": at for i, at in enumerate(scopes)}})
    points = F.array(*[
        F.struct(F.col(f"_at{i}.log_kind"), F.col(f"_at{i}.log_value"), loc.alias("location_filter"), point.alias("rest_filter"))
        for i in range(len(scopes)) for loc in (F.lit("any"), F.col("_own")) for point in (F.lit("any"), F.col("_held"))])
    return (held.select(*games.columns, F.inline(points))
            .filter(F.col("log_kind").isNotNull() & F.col("location_filter").isNotNull() & F.col("rest_filter").isNotNull()))


def ranked_logs(logs: DataFrame, n: int | None = None, key: Sequence[str] = LOG) -> DataFrame:
    """``log_rank`` from the newest game of each log, the first ``n`` only if given."""
    ranked = logs.withColumn("log_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*_newest_first())))
    return ranked if n is None else ranked.filter(F.col("log_rank") <= n)


def log_summaries(logs: DataFrame) -> DataFrame:
    """Means of four secondary stats over the 25 newest games of each log."""
    return ranked_logs(logs, CHART_GAMES).groupBy(*LOG).agg(F.count(F.lit(1)).alias("games"), *[
        F.avg(c).alias(f"avg_{c}") for c in ("shot_attempts", "missed_shots", "toi_minutes", "shifts")])


def log_charts(logs: DataFrame, lines: DataFrame) -> DataFrame:
    """One chart per log and (player_id, stat, threshold) of ``lines``: its 25
    newest games from the oldest on (``points``: label and hit flag), how many
    hit, their mean value and the y-axis maximum."""
    last = ranked_logs(logs, CHART_GAMES).join(lines.select("player_id", "stat", "threshold").distinct(), "player_id")
    value = stat_value(F.col("stat"))
    label = F.concat(F.date_format("date", "MM/dd"), F.lit(" vs "), F.col("opponent"))
    point = F.struct((-F.col("log_rank")).alias("o"), F.concat(label, F.when(value >= F.col("threshold"), F.lit(" +")).otherwise(F.lit(" -"))).alias("p"))
    return last.groupBy(*LOG, "stat", "threshold").agg(
        F.count(F.lit(1)).alias("games"), F.count_if(value >= F.col("threshold")).alias("hits"), F.avg(value).alias("avg_value"),
        (F.max(value) + 1).alias("y_max"),
        F.array_join(F.transform(F.sort_array(F.collect_list(point)), lambda x: x["p"]), "|").alias("points"))


def _lattice(counts: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Rows per lattice point -> one row with (games, hits) of all ``COMBINATIONS``, null where there is no game."""
    point = F.concat_ws("/", "location_filter", "rest_filter")
    vector = F.struct(F.col("g"), F.array(*HITS).alias("h"))
    points = F.array(*[F.lit(f"{loc}/{rest}") for loc, rest in COMBINATIONS])
    held = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(point, vector))).alias("_held"))
    return held.select(*by, F.transform(points, lambda p: F.try_element_at(F.col("_held"), p)).alias(name))


def view_kpis(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """KPI texts of every (player_id, season, opponent_team, stat, threshold) of
    ``targets`` under every game filter: one row per game filter, and in each of
    season_rates, h2h_rates, l5_rates and l10_rates the fifteen texts of ``COMBINATIONS``, as
    ``67% (3g)``, joined by ``|``.  Empty sets read as in ``kpi_rates``.

    Hits of twelve lines travel side by side (see ``props``); games are summed per
    cell before they are offered to logs, and counts are kept per log, season and
    opponent, sets bounded by the calendar's seasons and the teams."""
    asked = targets.select("player_id", F.col("req_season").alias("season"), F.col("h2h_opponent").alias("opponent_team"),
                           "player_type", "stat", "threshold").distinct()
    pairs = asked_pairs(asked)
    placed = asked.withColumn("goalie", F.col("player_type") == "Goalie").join(pairs.drop("stat_at"), ["goalie", "stat", "threshold"])
    slots = pairs.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("place", "stat_at", "threshold"))).alias("lines"))
    keys = placed.select("player_id", "slot").distinct().join(slots, "slot")
    games = facts.join(F.broadcast(keys), "player_id").select(
        "player_id", "slot", "game_id", "date", "season", "opponent", "location", "days_rest", *hit_columns())
    part = ["player_id", "slot"]
    log, total = [*LOG, "slot"], [F.sum(c).cast("int").alias(c) for c in ("g", *HITS)]
    sums = [F.count(F.lit(1)).alias("g"), *[F.sum(h).alias(h) for h in HITS]]
    newest = materialize(_newest_of_cells(games, max(LAST_GAMES), part))
    few = _recent(newest, part).groupBy(*log, "season", "opponent").agg(*sums)
    cells = games.withColumn("_rest", _rest()).groupBy(*part, *CELL).agg(*sums)
    counts = few.unionByName(_dated(cells, F.col("_rest")).select(few.columns))
    scope = ["player_id", "slot", *SCOPE]
    of_season = _lattice(counts.groupBy(*log, "season").agg(*total), [*scope, "season"], "_season")
    of_opponent = _lattice(counts.groupBy(*log, "opponent").agg(*total), [*scope, "opponent"], "_h2h").withColumnRenamed("opponent", "opponent_team")
    ten = ranked_logs(view_logs(newest, part), 10, log)
    last = [_lattice(ten.filter(F.col("log_rank") <= n).groupBy(*log).agg(F.count(F.lit(1)).cast("int").alias("g"), *total[1:]), scope, f"_l{n}")
            for n in (5, 10)]
    views = placed.withColumn("game_filter", F.explode(F.array(*[F.lit(g) for g in GAME_FILTERS]))).withColumn(
        "at", scope_of(F.col("game_filter"), F.col("season"), F.col("opponent_team"))).select("*", "at.*")
    found = (views.join(of_season, [*scope, "season"], "left").join(of_opponent, [*scope, "opponent_team"], "left")
             .join(last[0], scope, "left").join(last[1], scope, "left"))
    def texts(name: str) -> Column:
        empty = F.lit("n/a" if name == "h2h" else "0% (0g)")

        def one(at: Column) -> Column:
            rate = F.get(at["h"], F.col("place")).cast("double") / at["g"].cast("double") * 100.0
            shown = F.concat(F.bround(rate, 0).cast("int").cast("string"), F.lit("% ("), at["g"].cast("string"), F.lit("g)"))
            return F.when(at.isNotNull(), shown).otherwise(empty)

        return F.array_join(F.coalesce(F.transform(F.col(f"_{name}"), one), F.array_repeat(empty, len(COMBINATIONS))), "|")

    return found.select("player_id", "season", "opponent_team", "stat", "threshold", "game_filter",
                        *[texts(k).alias(f"{k}_rates") for k in ("season", "h2h", "l5", "l10")])


def player_header(selections: DataFrame, roster: DataFrame, facts: DataFrame) -> DataFrame:
    """Name and team from the roster, else the player's latest game; then the
    opponent and ``vs`` / ``@`` from the matchup, and the season labels."""
    people = selections.select("matchup_id", "player_id", "selected_date", "home", "away").distinct()
    r = pick_first(roster.select("player_id", F.col("full_player_name").alias("r_name"),
                                 F.col("team_abbrev").alias("r_team"), "headshot_url"),
                   ["player_id"], ["r_team", "r_name", "headshot_url"])
    latest = pick_first(facts.select("player_id", F.col("player_name").alias("h_name"),
                                     F.col("team").alias("h_team"),
                                     (-F.unix_date("date")).alias("_nd"),
                                     (-F.col("game_id")).alias("_ng")),
                        ["player_id"], ["_nd", "_ng"]).drop("_nd", "_ng")
    h = people.join(r, "player_id", "left").join(latest, "player_id", "left")
    on_roster = F.col("r_team").isNotNull() | F.col("r_name").isNotNull()
    team = F.when(on_roster, F.col("r_team")).otherwise(F.col("h_team"))
    h = h.withColumns({"player_name": F.when(on_roster, F.col("r_name")).otherwise(F.col("h_name")),
                       "team": team})
    cur = season_of_date("selected_date")
    return h.select(
        "matchup_id", "player_id", "player_name", "team", "headshot_url",
        F.when(F.col("team") == F.col("home"), F.col("away"))
         .when(F.col("team") == F.col("away"), F.col("home")).alias("opponent_team"),
        F.when(F.col("team") == F.col("home"), F.lit("vs"))
         .when(F.col("team") == F.col("away"), F.lit("@")).alias("game_location"),
        cur.alias("season_id"), season_label(cur).alias("season_label"),
        season_label(cur - 10001).alias("prev_season_label"))
