"""Threshold hit rates for many prop requests in one distributed plan.

A request is (matchup_id, prop_id, selected_date, home, away, player_type,
stat, threshold); matchup_id and prop_id together are its key.  For every
eligible player of every request the rates are taken over the player's games
dated on or before the request date (before it, if not ``inclusive``):

* season   - games of the request date's season;
* h2h      - games against the other team of the matchup;
* last N   - games on the player's N most recent distinct dates (ties share);
* location - season games split by home / away.

Plan (vectors of lines, no requests x history product): the distinct (stat,
line) pairs that are asked are numbered, and a row of history carries the hits
of ``WIDE`` pairs side by side, so it is read once per ``WIDE`` lines and not
once per line.  It is summed per (player, date) and season, and per opponent
where that is asked for, up to the last date asked of the player.  The look-ups
of all matchups are unioned in as markers without games; running sums give the
counts of all pairs at every marker, and the sums of the last N dates are
differences of two running sums.  Players are listed and counted once per day
and pair of teams; requests meet them last, and each takes its pair's place.  A window partition holds the
dates of one player (and opponent): it is bounded by the calendar, not by the
number of games or requests.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from puckline.functions.scalar import pct, round_half_up_int, season_of_date, split_matchup
from puckline.operators.common import pick_first
from puckline.operators.dvp import dvp_matchup, dvp_metrics
from puckline.operators.facts import GOALIE_PROPS, PROP_STATS, SKATER_PROPS, default_line, roster_dim
from puckline.operators.schedule import filter_game_types
from puckline.session import materialize

LAST_N = (5, 10, 20)
REQUEST = ["matchup_id", "prop_id"]
#: A target: one player (of one team) of one request.
TARGET = [*REQUEST, "player_id", "team_abbrev"]
#: What decides who is listed: the day and both teams, however many matchups share them.
SLATE = ["selected_date", "home", "away"]
TARGET_INFO = ["player_name", "position_code", "player_type", "selected_date", "home", "away", "stat", "threshold", "req_season", "h2h_opponent"]
#: (stat, line) pairs that one row of history carries.
WIDE = len(PROP_STATS)


# ----------------------------------------------------------------- requests

def requests_for_games(games: DataFrame, props: list[tuple[str, str, float]]) -> DataFrame:
    """Every game row (game_id, date, home_abbrev, away_abbrev) x the prop list,
    as request rows.  The prop list is a fixed literal array, inlined per row."""
    items = F.array(*[F.struct(F.lit(i).alias("prop_id"), F.lit(t).alias("player_type"),
                               F.lit(s).alias("stat"), F.lit(float(v)).alias("threshold"))
                      for i, (t, s, v) in enumerate(props)])
    return games.select(
        F.col("game_id").alias("matchup_id"), F.to_date("date").alias("selected_date"),
        F.col("home_abbrev").alias("home"), F.col("away_abbrev").alias("away"), F.inline(items)).select(
        *REQUEST, "selected_date", "home", "away", "player_type", "stat", "threshold")


def requests_for_matchups(selections: DataFrame, props: list[tuple[str, str, float]]) -> DataFrame:
    """Requests from (selection_id, date, matchup ``'AWY @ HOM'``) rows - the
    dashboard's selection - times the prop list."""
    m = selections.select(F.col("selection_id").alias("game_id"), "date",
                          split_matchup("matchup").alias("m"))
    return requests_for_games(m.select("game_id", "date", F.col("m.home").alias("home_abbrev"),
                                       F.col("m.away").alias("away_abbrev")), props)


def default_props() -> list[tuple[str, str, float]]:
    """The whole catalogue: every skater and goalie stat with its default line."""
    return ([("Skater", s, default_line(s, "Skater")) for s in SKATER_PROPS]
            + [("Goalie", s, default_line(s, "Goalie")) for s in GOALIE_PROPS])


# ----------------------------------------------------------------- players

def matchup_players(requests: DataFrame, facts: DataFrame, roster: DataFrame,
                    hockey_today: _dt.date | str) -> DataFrame:
    """Players of every distinct (selected_date, home, away) requested: bounded
    by the calendar and the pairs of teams, not by the number of matchups.

    Dates on or after ``hockey_today``: the roster of both teams, one row per
    (player, team); of a roster history (``valid_from``, ``valid_to``) the stays
    that hold the date.  Earlier dates: players who played that day for
    either team (one row per player; if a player has several games that day
    the lowest game id wins).  A player's first game of a day and team stands
    for all of them before the teams are met.
    """
    today = F.lit(str(hockey_today)).cast("date")
    teams = requests.select(*SLATE).distinct().select(
        *SLATE, F.explode(F.array_distinct(F.array("home", "away"))).alias("team"))
    future = teams.filter(F.col("selected_date") >= today)
    if "valid_from" in roster.columns:
        stays = roster.select("player_id", F.col("full_player_name").alias("player_name"), F.col("team_abbrev").alias("team"),
                              "position_code", F.to_date("valid_from").alias("_from"), F.to_date("valid_to").alias("_to"))
        day = F.col("selected_date")
        held = future.join(stays, "team").filter((F.col("_from") <= day) & (F.col("_to").isNull() | (F.col("_to") > day)))
        future = pick_first(held, [*SLATE, "player_id", "team"], [F.col("_from").desc(), "player_name", "position_code"])
    else:
        listed = roster_dim(roster).select("player_id", "player_name", F.col("team_abbrev").alias("team"), "position_code")
        future = future.join(listed, "team")
    played = facts.select("game_id", F.col("date").alias("selected_date"), "team", "player_id",
                          "player_name", F.col("position").alias("position_code"))
    played = pick_first(played.filter(F.col("selected_date") < today), ["selected_date", "team", "player_id"], ["game_id"])
    past = teams.filter(F.col("selected_date") < today).join(played, ["selected_date", "team"])
    past = pick_first(past, [*SLATE, "player_id"], ["game_id", "team"])
    out = [*SLATE, "player_id", "player_name", F.col("team").alias("team_abbrev"), "position_code"]
    return future.select(*out).unionByName(past.select(*out))


def _with_context(players: DataFrame) -> DataFrame:
    """Listed players with their type, the season of the date and the other team."""
    other = (F.when(F.col("team_abbrev") == F.col("home"), F.col("away"))
             .when(F.col("team_abbrev") == F.col("away"), F.col("home")))
    return players.withColumns({"goalie": F.col("position_code") == "G", "req_season": season_of_date("selected_date"),
                                "h2h_opponent": other})


def targets_for(facts: DataFrame, roster: DataFrame, requests: DataFrame,
                hockey_today: _dt.date | str) -> DataFrame:
    """(request, player) rows: goalies or skaters of the matchup by the
    request's player type."""
    return _meet(facts, roster, _keyed(requests), hockey_today).select(*TARGET, *TARGET_INFO)


def lines_for(facts: DataFrame, roster: DataFrame, requests: DataFrame,
              hockey_today: _dt.date | str) -> DataFrame:
    """The distinct rows of ``targets_for`` without the ids of their requests:
    matchups that share the day and the teams are met once."""
    lines = _keyed(requests).select(*SLATE, "player_type", "stat", "threshold").distinct()
    return _meet(facts, roster, lines, hockey_today).select("player_id", "team_abbrev", *TARGET_INFO)


def _keyed(requests: DataFrame) -> DataFrame:
    """Requests without a matchup list nobody."""
    return requests.filter(F.col("matchup_id").isNotNull())


def _meet(facts: DataFrame, roster: DataFrame, requests: DataFrame, hockey_today: _dt.date | str) -> DataFrame:
    """Requests with their listed players.  The requests are generated rows: Spark
    estimates them by the games they come from and would broadcast them, so
    the join is asked to sort and merge.  Of a day and two teams it holds the
    right side, the players: the requests may be many."""
    players = _with_context(matchup_players(requests, facts, roster, hockey_today))
    asked = requests.withColumn("goalie", F.col("player_type") == "Goalie")
    return asked.hint("merge").join(players, [*SLATE, "goalie"])


def eligible_players(requests: DataFrame, facts: DataFrame, roster: DataFrame,
                     hockey_today: _dt.date | str) -> DataFrame:
    """Players listed for each request (see ``targets_for``)."""
    return targets_for(facts, roster, requests, hockey_today).select(*TARGET, "player_name", "position_code")


# ----------------------------------------------------------------- history

def stat_value(stat: Column) -> Column:
    """The fact column named by ``stat`` as double; a name that is no prop stat is an error."""
    expr = F.when(stat.isNull(), F.lit(None).cast("double"))
    for s in PROP_STATS:
        expr = expr.when(stat == s, F.col(s).cast("double"))
    return expr.otherwise(F.raise_error(F.concat(F.lit("not a prop stat: "), stat)).cast("double"))


def history_asof(facts: DataFrame, targets: DataFrame, inclusive: bool = True) -> DataFrame:
    """How much history each requested (player, date) has: games dated on or
    before it (before it, if not ``inclusive``), and the date of the last one."""
    games = facts.groupBy("player_id", "date").agg(F.count(F.lit(1)).alias("g")).withColumn("_m", F.lit(0))
    marks = targets.select("player_id", F.col("selected_date").alias("date")).distinct().select(
        "*", F.lit(0).cast("bigint").alias("g"), F.lit(1 if inclusive else -1).alias("_m"))
    w = (Window.partitionBy("player_id").orderBy("date", "_m")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.max(F.when(F.col("_m") == 0, F.col("date"))).over(w)
    return (games.unionByName(marks).withColumns({"games": F.sum("g").over(w), "last_date": last})
            .filter(F.col("_m") != 0)
            .select("player_id", F.col("date").alias("selected_date"), "games", "last_date"))


def asked_pairs(requests: DataFrame) -> DataFrame:
    """(goalie, stat, threshold, stat_at, slot, place): the distinct pairs of
    each player type, dealt to slots of ``WIDE``.  A stat that is no prop stat is an error."""
    at = F.array_position(F.array(*[F.lit(s) for s in PROP_STATS]), F.col("stat")) - 1
    pairs = requests.select((F.col("player_type") == "Goalie").alias("goalie"), "stat", "threshold").distinct()
    number = F.row_number().over(Window.partitionBy("goalie").orderBy("stat", "threshold")) - 1
    return pairs.select(
        "*", F.when(at >= 0, at).when(F.col("stat").isNotNull(), F.raise_error(F.concat(F.lit("not a prop stat: "), F.col("stat"))))
        .cast("int").alias("stat_at"), number.alias("_n")).select(
        "*", (F.floor(F.col("_n") / WIDE) * 2 + F.col("goalie").cast("int")).cast("int").alias("slot"),
        (F.col("_n") % WIDE).alias("place")).drop("_n")


HITS = [f"h{j}" for j in range(WIDE)]


def hit_columns(values: str | None = None) -> list[Column]:
    """The hit (0 or 1) of every pair in ``lines`` (of ``asked_pairs``, by place);
    ``values`` names an array of the prop stats, if there is one."""
    stats = F.col(values) if values else F.array(*[F.col(s).cast("double") for s in PROP_STATS])
    out = []
    for j, name in enumerate(HITS):
        line = F.get("lines", F.lit(j))
        out.append(F.coalesce(F.get(stats, line["stat_at"]) >= line["threshold"], F.lit(False)).cast("int").alias(name))
    return out


def hit_history(facts: DataFrame, asked: DataFrame, pairs: DataFrame, inclusive: bool = True) -> DataFrame:
    """Games of the asked players up to their last date asked, once per slot,
    with the hit (0 or 1; a null value is no hit) of every pair of the slot.

    ``asked``: (player_id, slot, date, season, opponent).  A player's set of
    opponents is bounded by the number of teams."""
    slots = pairs.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("place", "stat_at", "threshold"))).alias("lines"))
    # A row per player and slot: sent to the history, which stays where it is.
    keys = asked.groupBy("player_id", "slot").agg(F.max("date").alias("until"), F.collect_set("opponent").alias("wanted"))
    values = F.array(*[F.col(s).cast("double") for s in PROP_STATS]).alias("values")
    games = facts.select("player_id", "date", "season", "opponent", "location", values).join(
        F.broadcast(keys.join(slots, "slot")), "player_id")
    known = F.col("date") <= F.col("until") if inclusive else F.col("date") < F.col("until")
    return games.filter(known).select("player_id", "slot", "date", "season", "opponent", "location",
                                      F.array_contains("wanted", F.col("opponent")).alias("versus"), *hit_columns("values"))


def _daily(history: DataFrame, by: list[str], marks: DataFrame, inclusive: bool) -> DataFrame:
    """Games and hits per ``by`` and markers (games -1 or +1 in ``_m`` from a date's own games)."""
    sums = history.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("g"), *[F.sum(h).cast("int").alias(h) for h in HITS])
    nothing = [F.lit(0).cast("int").alias(c) for c in ("g", *HITS)]
    return sums.withColumn("_m", F.lit(0)).unionByName(
        marks.select(*by, *nothing, F.lit(1 if inclusive else -1).alias("_m")))


def _vector(columns: list[Column], name: str) -> Column:
    return F.array(*[F.coalesce(c, F.lit(0)).cast("int") for c in columns]).alias(name)


def season_counts(history: DataFrame, asked: DataFrame, inclusive: bool = True) -> DataFrame:
    """Per asked (player_id, slot, season, date): games and vectors of hits in
    the season (sg, sh), there at home (gh, hh) and away (ga, ha), and on the
    last N dates (g5, h5, ...)."""
    by = ["player_id", "slot", "season", "location", "date"]
    marks = asked.select("player_id", "slot", "season", F.lit(None).cast("string").alias("location"), "date").distinct()
    both = _daily(history, by, marks, inclusive).repartition("player_id", "slot")
    upto = (Window.unboundedPreceding, Window.currentRow)
    place = F.col("location")
    season = Window.partitionBy("player_id", "slot", "season").orderBy("date", "_m").rowsBetween(*upto)
    ever = Window.partitionBy("player_id", "slot").orderBy("date", "_m")
    # Distinct game dates so far: the axis of the last-N sums.
    last_date = F.max(F.when(F.col("_m") == 0, F.col("date"))).over(ever.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("_first", ((F.col("_m") == 0) & ~F.col("date").eqNullSafe(last_date)).cast("int"))
    both = both.withColumn("_day", F.sum("_first").over(ever.rowsBetween(*upto)))
    cols = []
    for name, kept in (("s", F.lit(True)), ("h", place == "home"), ("a", place == "away")):
        cols += [F.sum(F.when(kept, F.col(c)).otherwise(0)).over(season).alias(f"_{name}_{c}") for c in ("g", *HITS)]
    cols += [F.sum(c).over(ever.rowsBetween(*upto)).alias(f"_e_{c}") for c in ("g", *HITS)]
    for n in LAST_N:
        before = Window.partitionBy("player_id", "slot").orderBy("_day").rangeBetween(Window.unboundedPreceding, -n)
        cols += [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{n}_{c}") for c in ("g", *HITS)]
    counts = both.select("player_id", "slot", "season", "date", "_m", *cols).filter(F.col("_m") != 0)
    out = [F.col("_s_g").alias("sg"), _vector([F.col(f"_s_{h}") for h in HITS], "sh"),
           F.col("_h_g").alias("gh"), _vector([F.col(f"_h_{h}") for h in HITS], "hh"),
           F.col("_a_g").alias("ga"), _vector([F.col(f"_a_{h}") for h in HITS], "ha")]
    for n in LAST_N:
        out += [(F.col("_e_g") - F.col(f"_{n}_g")).alias(f"g{n}"),
                _vector([F.col(f"_e_{h}") - F.col(f"_{n}_{h}") for h in HITS], f"h{n}")]
    return counts.select("player_id", "slot", F.col("season").alias("req_season"), F.col("date").alias("selected_date"), *out)


def versus_counts(history: DataFrame, asked: DataFrame, inclusive: bool = True) -> DataFrame:
    """Per asked (player_id, slot, opponent, date): games and the vector of
    hits against the opponent (go, ho)."""
    by = ["player_id", "slot", "opponent", "date"]
    marks = asked.filter(F.col("opponent").isNotNull()).select(*by).distinct()
    both = _daily(history.filter("versus"), by, marks, inclusive).repartition("player_id", "slot", "opponent")
    w = (Window.partitionBy("player_id", "slot", "opponent").orderBy("date", "_m")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = both.select(*by, "_m", *[F.sum(c).over(w).alias(f"_{c}") for c in ("g", *HITS)]).filter(F.col("_m") != 0)
    return counts.select("player_id", "slot", F.col("opponent").alias("h2h_opponent"), F.col("date").alias("selected_date"),
                         F.col("_g").alias("go"), _vector([F.col(f"_{h}") for h in HITS], "ho"))


def rates(facts: DataFrame, roster: DataFrame, requests: DataFrame, hockey_today: _dt.date | str,
          game_types: Sequence[str] | None = None, inclusive: bool = True) -> DataFrame:
    """Every target (see ``targets_for``) with its counts: season (sg, sh),
    home (gh, hh) and away (ga, ha) in the season, head-to-head (go, ho) and
    the last N dates (g5, h5, ...).

    ``game_types`` (letters; None: all) restricts the games that count, not the
    players listed; with ``inclusive`` false the selected date's own games do
    not count.  A request without a stat or a line has no hits."""
    players = materialize(_with_context(matchup_players(_keyed(requests), facts, roster, hockey_today)))
    pairs = asked_pairs(requests)
    slots = pairs.select("goalie", "slot").distinct()
    listed = players.join(F.broadcast(slots), "goalie")
    asked = listed.select("player_id", "slot", F.col("selected_date").alias("date"), F.col("req_season").alias("season"),
                          F.col("h2h_opponent").alias("opponent")).distinct()
    counted = facts if game_types is None else filter_game_types(facts, game_types)
    history = hit_history(counted, asked, pairs, inclusive)
    # The many vectors of a season last: they are shuffled once, to the requests.
    found = (listed.join(versus_counts(history, asked, inclusive), ["player_id", "slot", "h2h_opponent", "selected_date"], "left")
             .join(season_counts(history, asked, inclusive), ["player_id", "slot", "req_season", "selected_date"], "left"))
    # Requests are shuffled and sorted with the number of their pair; its stat and line are looked up when they have
    # met the players.  Of a day and two teams the players are held, not the requests, which may be many.
    asks = _numbered(_keyed(requests), pairs).hint("merge")
    lines = F.broadcast(pairs.select((F.col("slot") * WIDE + F.col("place")).alias("pair"), "stat", "threshold"))
    met = asks.join(found.select(*[F.col(c).alias(f"_{c}" if c in SLATE else c) for c in found.columns if c != "goalie"]),
                    (F.expr(f"cast(pair div {WIDE} as int)") == F.col("slot"))
                    & (F.col("selected_date") == F.col("_selected_date")) & (F.col("home") == F.col("_home")) & (F.col("away") == F.col("_away")))
    games = ["sg", "gh", "ga", "go", *[f"g{n}" for n in LAST_N]]
    hits = ["sh", "hh", "ha", "ho", *[f"h{n}" for n in LAST_N]]
    return met.join(lines, "pair").select(
        *TARGET, *TARGET_INFO, *[F.col(g).cast("bigint").alias(g) for g in games],
        *[F.get(h, F.col("pair") % WIDE).cast("bigint").alias(h) for h in hits])


def _numbered(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Requests with the number (slot and place) of their pair instead of its stat and line."""
    pair = pairs.select(*[F.col(c).alias(f"_{c}") for c in ("goalie", "stat", "threshold")],
                        (F.col("slot") * WIDE + F.col("place")).alias("pair"))
    return requests.withColumn("goalie", F.col("player_type") == "Goalie").join(
        F.broadcast(pair), (F.col("goalie") == F.col("_goalie")) & F.col("stat").eqNullSafe(F.col("_stat"))
        & F.col("threshold").eqNullSafe(F.col("_threshold"))).select(*REQUEST, "pair", *SLATE, "player_type")


def _games(g: str) -> Column:
    return F.coalesce(F.col(g), F.lit(0)).cast("bigint")


def _rate_cols(prefix: str, g: str, h: str) -> list[Column]:
    games = _games(g)
    return [games.alias(f"{prefix}_games"), F.when(games > 0, F.col(h)).cast("bigint").alias(f"{prefix}_hits"),
            pct(F.col(h), games).alias(f"{prefix}_pct")]


def season_cols() -> list[Column]:
    return _rate_cols("season", "sg", "sh")


def location_cols() -> list[Column]:
    out = []
    for side, g, h in (("away", "ga", "ha"), ("home", "gh", "hh")):
        out += [_games(g).alias(f"{side}_season_games"), pct(F.col(h), _games(g)).alias(f"{side}_season_pct")]
    return out


def last_n_cols() -> list[Column]:
    return [c for n in LAST_N for c in _rate_cols(f"l{n}", f"g{n}", f"h{n}")]


def h2h_cols() -> list[Column]:
    """No H2H games, or no opponent, reads 0 games and 0.0 %."""
    games = F.when(F.col("h2h_opponent").isNotNull(), _games("go")).otherwise(0).cast("bigint")
    return [games.alias("h2h_games"), F.when(games > 0, F.col("ho")).cast("bigint").alias("h2h_hits"),
            F.when(games > 0, pct("ho", games)).otherwise(F.lit(0.0)).alias("h2h_pct")]


def _table_cols() -> list:
    return [*REQUEST, "player_id", "player_name", "team_abbrev", "position_code", "stat", "threshold",
            *season_cols(), *h2h_cols(), *last_n_cols(), *location_cols()]


def prop_table(facts: DataFrame, roster: DataFrame, requests: DataFrame, hockey_today: _dt.date | str,
               game_types: Sequence[str] | None = None, inclusive: bool = True) -> DataFrame:
    """Numeric hit-rate table: one row per (request, eligible player and team); see ``rates``."""
    return rates(facts, roster, requests, hockey_today, game_types, inclusive).select(*_table_cols())


# ----------------------------------------------------------------- display

def _text(p: Column, g: Column, min_games: int, with_games: bool) -> Column:
    shown = F.concat(round_half_up_int(p).cast("string"), F.lit("%"))
    if with_games:
        shown = F.concat(shown, F.lit(" ("), g.cast("string"), F.lit("g)"))
    ok = (g >= min_games) & p.isNotNull() if min_games > 1 else (g > 0) & p.isNotNull()
    return F.when(ok, shown).otherwise(F.lit("n/a"))


def prop_table_formatted(table: DataFrame, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Display form: ``67% (3g)`` texts, ``n/a`` rules (L-N needs N games),
    sortable percent columns and the line.  The column names are fixed values."""
    c = F.col
    cols = [*REQUEST, "player_id", c("player_name").alias("Player"),
            c("team_abbrev").alias("Team"), c("position_code").alias("Pos"),
            c("threshold").alias("Line")]
    spec = [("Season", "season", 1, True), ("H2H", "h2h", 1, True)]
    spec += [(f"L{n}", f"l{n}", n, False) for n in LAST_N]
    for label, p, n, with_g in spec:
        g, v = c(f"{p}_games"), c(f"{p}_pct")
        ok = (g >= n) if n > 1 else (g > 0)
        cols += [_text(v, g, n, with_g).alias(f"{label} (Formatted)"),
                 F.when(ok, v).alias(f"{label} %")]
    for label, side in (("Away", "away"), ("Home", "home")):
        g, v = c(f"{side}_season_games"), c(f"{side}_season_pct")
        ok = v.isNotNull() & (g > 0)
        cols += [_text(v, g, 1, True).alias(f"{label} (Season) (Formatted)"),
                 F.when(ok, v).alias(f"{label} %")]
    return table.select(*cols, *extra)


def matchup_overview(facts: DataFrame, roster: DataFrame, requests: DataFrame,
                     hockey_today: _dt.date | str, defense_key: str = "team") -> DataFrame:
    """Formatted table + the DvP of each player's team and position for the
    request's season (from its date) and stat, sorted by L10 % (nulls last);
    ``dvp_exact`` is the value that the DvP text rounds."""
    scope = requests.select(season_of_date("selected_date").alias("season"), "stat").distinct()
    counted = rates(facts, roster, requests, hockey_today).withColumns(
        {"season": F.col("req_season"), "team": F.col("team_abbrev"), "opponent": F.col("h2h_opponent"), "position": F.col("position_code")})
    rated = dvp_matchup(counted, dvp_metrics(facts, scope, defense_key))
    # Counts are sorted: the percents and texts that follow from them are wider.
    l10 = F.when(_games("g10") >= 10, pct("h10", _games("g10")))
    rated = rated.orderBy(l10.desc_nulls_last(), *REQUEST, "player_id", "team_abbrev").select(
        *_table_cols(), "dvp_formatted", "dvp_rank", "dvp_exact")
    return prop_table_formatted(rated, (F.col("dvp_formatted").alias("DvP"), F.col("dvp_rank").alias("DvP_Rank"), F.col("dvp_exact")))
