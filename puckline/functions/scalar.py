"""Column-level helpers (all JVM-side expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical results.
# Position code -> display name; unknown codes pass through unchanged.
POSITION_NAMES = {"C": "Center", "L": "Left Wing", "R": "Right Wing", "D": "Defense", "G": "Goalie"}
# Game-type letters accepted by the schedule filter: R -> 2, P -> 3, unknown -> 2.
GAME_TYPE_CODES = {"R": 2, "P": 3}
# Score-feed states that mean a game is finished.
FINISHED_STATES = ["OFF", "FINAL"]
# Hours after midnight (Eastern) that still count as the previous hockey day.
HOCKEY_DAY_START_HOUR = 5
HOCKEY_ZONE = "America/New_York"
# Default skater count when a situation code cannot be read.
DEFAULT_SKATERS = 5


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def skaters(situation_code, which: str) -> Column:
    """Skater count from a situation code ``[awayG][awaySk][homeSk][homeG]``.

    Codes shorter than four characters and non-digit characters give 5.
    """
    sc = col_(situation_code)
    pos = 2 if which == "away" else 3
    digit = F.substring(sc, pos, 1).try_cast("int")
    return F.coalesce(F.when(F.length(sc) >= 4, digit), F.lit(DEFAULT_SKATERS)).cast("int")


def toi_minutes(toi) -> Column:
    """``m:ss`` (or ``h:m:s``: first two fields) to minutes; unreadable parts count 0."""
    t = col_(toi)
    minutes = F.coalesce(F.split_part(t, F.lit(":"), F.lit(1)).try_cast("int"), F.lit(0))
    seconds = F.coalesce(F.split_part(t, F.lit(":"), F.lit(2)).try_cast("int"), F.lit(0))
    value = minutes.cast("double") + seconds.cast("double") / F.lit(60.0)
    return F.coalesce(F.when(t.contains(":"), value).otherwise(F.lit(0.0)), F.lit(0.0))


def season_of_date(d) -> Column:
    """Season id ``YYYYyyyy``: September starts a new season."""
    d = col_(d)
    y = F.year(d).cast("bigint")
    return F.when(F.month(d) >= 9, y * 10000 + y + 1).otherwise((y - 1) * 10000 + y)


def season_label(season) -> Column:
    """``20232024`` -> ``23/24``."""
    s = col_(season).cast("string")
    return F.concat(F.substring(s, 3, 2), F.lit("/"), F.substring(s, 7, 2))


def hockey_date(ts) -> Column:
    """Hockey day of a UTC timestamp: before 05:00 Eastern belongs to the day before."""
    local = F.from_utc_timestamp(col_(ts), HOCKEY_ZONE)
    return F.to_date(local - F.expr(f"INTERVAL {HOCKEY_DAY_START_HOUR} HOURS"))


def position_display(code) -> Column:
    c = col_(code)
    mapping = F.create_map(*[F.lit(x) for kv in POSITION_NAMES.items() for x in kv])
    return F.coalesce(F.element_at(mapping, c), c)


def pct(hits, games) -> Column:
    """``hits / games * 100`` as double; null when there are no games."""
    g = col_(games)
    return F.when(g > 0, col_(hits).cast("double") / g.cast("double") * F.lit(100.0))


def float_div(num, den) -> Column:
    """IEEE division: x/0 gives +Inf, -Inf or NaN by the sign of x; null propagates."""
    n, d = col_(num).cast("double"), col_(den).cast("double")
    by_zero = (F.when(n > 0, F.lit(float("inf"))).when(n < 0, F.lit(float("-inf")))
               .otherwise(F.lit(float("nan"))))
    return F.when(d == 0, F.when(n.isNotNull(), by_zero)).otherwise(n / d)


def round_half_up_int(x) -> Column:
    """Percent shown as a whole number (half away from zero).

    The largest double below a half is added: a half itself would lift the double below
    0.5 to 1.  ``F.round`` would build a BigDecimal per value."""
    x = col_(x).cast("double")
    return (F.signum(x) * F.floor(F.abs(x) + F.lit(0.49999999999999994))).cast("int")


def matchup_label(away, home) -> Column:
    return F.concat(col_(away), F.lit(" @ "), col_(home))


def split_matchup(matchup) -> Column:
    """``'AWY @ HOM'`` -> struct(away, home); null when the text has no `` @ ``."""
    parts = F.split(col_(matchup), " @ ")
    ok = F.size(parts) == 2
    return F.struct(F.when(ok, parts.getItem(0)).alias("away"),
                    F.when(ok, parts.getItem(1)).alias("home"))
