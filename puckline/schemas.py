"""Explicit schemas of the stored tables and of the landed JSON documents.

Column and field names, types and order are fixed values: the data contract.

Every operator returns its full schema even when it has no rows, so readers
never depend on which columns happened to be present.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEDULE = _struct(
    ("game_id", _L), ("date", _S), ("season", _L), ("game_type", _L),
    ("away_abbrev", _S), ("away_score", _L), ("home_abbrev", _S), ("home_score", _L),
    ("start_time", _S), ("venue", _S),
)

BOXSCORE = _struct(
    ("game_id", _L), ("player_id", _L), ("player_name", _S), ("team", _S),
    ("opponent", _S), ("location", _S), ("position", _S), ("plus_minus", _I),
    ("toi", _S), ("shifts", _I), ("shots_against", _I), ("saves", _I),
    ("goals_against", _I), ("save_pct", _D), ("decision", _S),
    ("game_winning_goal", _I), ("ot_loss", _I),
)

# The ten columns that can name a player on a play-by-play event.
ROLE_COLUMNS = [
    "scoring_player_id", "assist1_player_id", "assist2_player_id",
    "shooting_player_id", "blocking_player_id", "hitting_player_id",
    "committed_player_id", "winning_player_id", "losing_player_id", "player_id",
]

PBP_RAW = _struct(
    ("game_id", _L), ("event_id", _L), ("event_type", _S), ("situation_code", _S),
    ("event_owner_team_id", _L), ("home_team_id", _L), ("away_team_id", _L),
    *[(c, _L) for c in ROLE_COLUMNS],
    ("duration", _I), ("home_score", _I), ("away_score", _I), ("period_type", _S),
)

ROSTER = _struct(
    ("team_abbrev", _S), ("player_id", _L), ("full_player_name", _S),
    ("position_code", _S), ("headshot_url", _S),
)

# Stat columns produced from play-by-play, in output order (ints, then the ratio).
PBP_INT_STATS = [
    "goals", "assists", "points", "shots", "shot_attempts", "blocked_shots",
    "offensive_blocked_shots", "missed_shots", "hits", "giveaways", "takeaways",
    "pim", "ppg", "ppa", "ppp", "game_winning_goal", "faceoff_wins", "faceoff_losses",
]

# The combined player-game table (38 columns, in output order).
COMPREHENSIVE = _struct(
    ("game_id", _L), ("date", _S), ("player_id", _L), ("player_name", _S), ("team", _S), ("opponent", _S),
    ("location", _S), ("position", _S), ("days_rest", _I), ("toi", _S), ("toi_minutes", _D), ("shifts", _I),
    ("goals", _I), ("assists", _I), ("points", _I), ("plus_minus", _I), ("pim", _I),
    ("shots", _I), ("shot_attempts", _I), ("missed_shots", _I), ("offensive_blocked_shots", _I),
    ("blocked_shots", _I), ("hits", _I), ("giveaways", _I), ("takeaways", _I),
    ("faceoff_wins", _I), ("faceoff_losses", _I), ("faceoff_pct", _D),
    ("ppg", _I), ("ppa", _I), ("ppp", _I), ("game_winning_goal", _I),
    ("shots_against", _I), ("saves", _I), ("goals_against", _I), ("save_pct", _D), ("decision", _S), ("ot_loss", _I),
)
COMPREHENSIVE_COLUMNS = COMPREHENSIVE.names

# Of these, the dashboard facts hold all but five numbers as double (null -> 0) and fill texts.
FACT_NUMERIC = [f.name for f in COMPREHENSIVE.fields if f.dataType in (_I, _D) and f.name not in (
    "days_rest", "faceoff_pct", "game_winning_goal", "save_pct", "ot_loss")]
FACT_STRING = ["player_name", "team", "opponent", "location", "position", "decision"]


def stored(schema: T.StructType) -> T.StructType:
    """A stored table: the season partition comes last and stays a bigint."""
    return T.StructType([*(f for f in schema.fields if f.name != "season"), T.StructField("season", _L, True)])


SCHEDULE_REST = T.StructType([*SCHEDULE.fields, T.StructField("home_days_rest", _I, True),
                              T.StructField("away_days_rest", _I, True)])
#: What a stored schedule row holds besides: when each group of its fields landed (scores stay null until known).
SCHEDULE_GROUPS = {"fixture_at": ("date", "season", "game_type", "away_abbrev", "home_abbrev"),
                   "score_at": ("away_score", "home_score"), "start_at": ("start_time",), "venue_at": ("venue",)}
SCHEDULE_MERGED = T.StructType([*SCHEDULE_REST.fields, *[T.StructField(c, T.TimestampType(), True) for c in SCHEDULE_GROUPS]])
#: Per game with raw rows: which of the two tables hold it.
GAME_LEDGER = _struct(("game_id", _L), ("season", _L), ("has_box", T.BooleanType()), ("has_pbp", T.BooleanType()))
#: Inverted index of player names: grams by size.
NAME_POSTINGS = _struct(("size", _I), ("gram", _S), ("player_id", _L), ("player_name", _S))
#: A player's stay on a team's roster, as far as landed rosters tell; an open stay has no end.
ROSTER_HISTORY = T.StructType([*ROSTER.fields, T.StructField("season", _L, True), T.StructField("valid_from", T.TimestampType(), True),
                               T.StructField("valid_to", T.TimestampType(), True)])
TABLES = {
    "schedule": stored(SCHEDULE_REST), "essential_boxscores": stored(BOXSCORE), "raw_pbp_events": stored(PBP_RAW),
    "comprehensive_boxscores": stored(COMPREHENSIVE),
    "roster": stored(T.StructType([*ROSTER.fields, T.StructField("is_current", T.BooleanType(), True)])),
}

# ---- landed JSON documents (one document per game / date / team) -------------

_name = _struct(("default", _S))

SCHEDULE_DOC = _struct(("games", T.ArrayType(_struct(
    ("id", _L), ("gameDate", _S), ("gameType", _L),
    ("awayTeam", _struct(("abbrev", _S), ("score", _L))),
    ("homeTeam", _struct(("abbrev", _S), ("score", _L))),
    ("startTimeUTC", _S), ("venue", _name),
))))

SCORE_DOC = _struct(("games", T.ArrayType(_struct(
    ("id", _L), ("season", _L), ("gameType", _L), ("gameState", _S),
    ("awayTeam", _struct(("abbrev", _S), ("score", _L))),
    ("homeTeam", _struct(("abbrev", _S), ("score", _L))),
))))

STANDINGS_DOC = _struct(("standings", T.ArrayType(_struct(("teamAbbrev", _name)))))
SEASONS_DOC = _struct(("seasons", T.ArrayType(_struct(("id", _L), ("standingsEnd", _S)))))

_roster_player = _struct(
    ("id", _L), ("firstName", _name), ("lastName", _name),
    ("positionCode", _S), ("headshot", _S),
)
ROSTER_DOC = _struct(
    ("forwards", T.ArrayType(_roster_player)),
    ("defensemen", T.ArrayType(_roster_player)),
    ("goalies", T.ArrayType(_roster_player)),
)

_box_player = _struct(
    ("playerId", _L), ("name", _name), ("position", _S), ("plusMinus", _I),
    ("toi", _S), ("shifts", _I), ("gameWinningGoals", _I), ("shotsAgainst", _I),
    ("saves", _I), ("goalsAgainst", _I), ("savePctg", _D), ("decision", _S),
)
_box_side = _struct(
    ("forwards", T.ArrayType(_box_player)),
    ("defense", T.ArrayType(_box_player)),
    ("goalies", T.ArrayType(_box_player)),
)
BOXSCORE_DOC = _struct(
    ("id", _L),
    ("awayTeam", _struct(("abbrev", _S))),
    ("homeTeam", _struct(("abbrev", _S))),
    ("playerByGameStats", _struct(("awayTeam", _box_side), ("homeTeam", _box_side))),
)

_details = _struct(
    ("eventOwnerTeamId", _L), ("scoringPlayerId", _L), ("assist1PlayerId", _L),
    ("assist2PlayerId", _L), ("shootingPlayerId", _L), ("blockingPlayerId", _L),
    ("hittingPlayerId", _L), ("committedByPlayerId", _L), ("winningPlayerId", _L),
    ("losingPlayerId", _L), ("playerId", _L), ("duration", _I),
    ("homeScore", _I), ("awayScore", _I),
)
PBP_DOC = _struct(
    ("id", _L),
    ("awayTeam", _struct(("id", _L))),
    ("homeTeam", _struct(("id", _L))),
    ("plays", T.ArrayType(_struct(
        ("eventId", _L), ("typeDescKey", _S), ("situationCode", _S),
        ("periodDescriptor", _struct(("periodType", _S))),
        ("details", _details),
    ))),
)
