"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Every statement starts with the proxy views below (the same derivations as
``puckline.sources.proxies``) as CTEs over the pre-registered base tables.
Each query then states the reference semantics directly in SQL - windows,
joins, UNION ALL - independently of how the Spark plan computes them.
"""

from __future__ import annotations

from puckline.schemas import ROLE_COLUMNS

GAMES = """
games AS (
  SELECT game_id, date,
         CASE WHEN CAST(substring(date,6,2) AS INT) >= 9
              THEN CAST(substring(date,1,4) AS BIGINT)*10000 + CAST(substring(date,1,4) AS BIGINT)+1
              ELSE (CAST(substring(date,1,4) AS BIGINT)-1)*10000 + CAST(substring(date,1,4) AS BIGINT) END AS season,
         CAST(game_type AS BIGINT) AS game_type,
         'T'||lpad(CAST(ak AS VARCHAR),2,'0') AS away_abbrev, away_score,
         'T'||lpad(CAST(hk AS VARCHAR),2,'0') AS home_abbrev, home_score,
         date||'T'||lpad(CAST(game_id%24 AS VARCHAR),2,'0')||':30:00Z' AS start_time,
         CASE WHEN game_id%10=0 THEN NULL ELSE 'V'||lpad(CAST(hk AS VARCHAR),2,'0') END AS venue,
         100+hk AS home_team_id, 100+ak AS away_team_id
  FROM (SELECT o_orderkey AS game_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date,
               o_custkey%25 AS hk, (o_custkey%25 + 1 + o_orderkey%24)%25 AS ak,
               CAST(floor(o_totalprice) AS BIGINT)%6 AS home_score,
               CAST(floor(o_totalprice/10) AS BIGINT)%6 AS away_score,
               CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '5-LOW' THEN 1 ELSE 2 END AS game_type
        FROM orders) o
),
schedule AS (
  SELECT game_id, date, season, game_type, away_abbrev, away_score, home_abbrev, home_score,
         start_time, venue FROM games
)"""

BOX = """
box AS (
  SELECT l.l_orderkey AS game_id, l.l_suppkey%40 AS player_id,
         'P'||lpad(CAST(l.l_suppkey%40 AS VARCHAR),2,'0') AS player_name,
         CASE WHEN l.l_suppkey%2=0 THEN g.home_abbrev ELSE g.away_abbrev END AS team,
         CASE WHEN l.l_suppkey%2=0 THEN g.away_abbrev ELSE g.home_abbrev END AS opponent,
         CASE WHEN l.l_suppkey%2=0 THEN 'home' ELSE 'away' END AS location,
         CASE l.l_suppkey%5 WHEN 0 THEN 'C' WHEN 1 THEN 'L' WHEN 2 THEN 'R' WHEN 3 THEN 'D' ELSE 'G' END AS position,
         CAST(l.l_linenumber-4 AS INT) AS plus_minus,
         CASE WHEN l.l_partkey%97=0 THEN NULL WHEN l.l_partkey%89=0 THEN 'bad' WHEN l.l_partkey%83=0 THEN 'x:30'
              ELSE CAST(CAST(l.l_quantity AS INT) + CASE WHEN l.l_suppkey%5=4 THEN 20 ELSE 0 END AS VARCHAR)||':'||lpad(CAST(l.l_partkey%60 AS VARCHAR),2,'0') END AS toi,
         CAST(l.l_linenumber*4 AS INT) AS shifts,
         CASE WHEN l.l_suppkey%5=4 THEN CAST(22+l.l_partkey%15 AS INT) END AS shots_against,
         CASE WHEN l.l_suppkey%5=4 THEN CAST(20+l.l_partkey%15 AS INT) END AS saves,
         CASE WHEN l.l_suppkey%5=4 THEN CAST(l.l_partkey%5 AS INT) END AS goals_against,
         CASE WHEN l.l_suppkey%5=4 THEN CAST(20+l.l_partkey%15 AS DOUBLE)/CAST(22+l.l_partkey%15 AS DOUBLE) END AS save_pct,
         CASE WHEN l.l_suppkey%5=4 THEN CASE l.l_linenumber%3 WHEN 0 THEN 'W' WHEN 1 THEN 'L' ELSE 'O' END END AS decision,
         0 AS game_winning_goal,
         CASE WHEN l.l_suppkey%5=4 AND l.l_linenumber%3=2 THEN 1 ELSE 0 END AS ot_loss,
         CAST(l.l_linenumber AS INT) AS src_line, l.l_partkey AS src_part,
         CAST(l.l_quantity AS INT) AS src_qty, l.l_extendedprice AS src_price
  FROM lineitem l JOIN games g ON l.l_orderkey = g.game_id
),
ebox AS (
  SELECT game_id, player_id, player_name, team, opponent, location, position, plus_minus, toi,
         shifts, shots_against, saves, goals_against, save_pct, decision, game_winning_goal, ot_loss
  FROM box
)"""

PBP = """
pbp AS (
  SELECT game_id, event_id, et AS event_type,
         CASE event_id%9 WHEN 0 THEN '1551' WHEN 1 THEN '1541' WHEN 2 THEN '1451' WHEN 3 THEN '1560' WHEN 4 THEN '0651'
              WHEN 5 THEN '15' WHEN 6 THEN NULL WHEN 7 THEN '1A41' ELSE '1531' END AS situation_code,
         CASE WHEN event_id%29=0 THEN NULL WHEN event_id%2=0 THEN home_team_id ELSE away_team_id END AS event_owner_team_id,
         home_team_id, away_team_id,
         CASE WHEN et='goal' THEN u END AS scoring_player_id,
         CASE WHEN et='goal' AND event_id%3<>0 THEN (u+7)%40 END AS assist1_player_id,
         CASE WHEN et='goal' AND event_id%3=2 THEN (u+13)%40 END AS assist2_player_id,
         CASE WHEN et IN ('shot-on-goal','missed-shot','blocked-shot') THEN u END AS shooting_player_id,
         CASE WHEN et='blocked-shot' THEN (u+3)%40 END AS blocking_player_id,
         CASE WHEN et='hit' THEN u END AS hitting_player_id,
         CASE WHEN et='penalty' AND event_id%11<>0 THEN u END AS committed_player_id,
         CASE WHEN et='faceoff' THEN u END AS winning_player_id,
         CASE WHEN et='faceoff' THEN (u+5)%40 END AS losing_player_id,
         CAST(CASE WHEN et='penalty' THEN CASE WHEN event_id%4=0 THEN 5 ELSE 2 END ELSE 0 END AS INT) AS duration,
         CASE WHEN et IN ('giveaway','takeaway') THEN u END AS player_id,
         CAST(CASE WHEN et='goal' THEN sum(CASE WHEN et='goal' AND event_id%2=0 THEN 1 ELSE 0 END) OVER (PARTITION BY game_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) END AS INT) AS home_score,
         CAST(CASE WHEN et='goal' THEN sum(CASE WHEN et='goal' AND event_id%2=1 THEN 1 ELSE 0 END) OVER (PARTITION BY game_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) END AS INT) AS away_score,
         CASE WHEN event_id%40>=38 THEN 'SO' WHEN event_id%40>=35 THEN 'OT' ELSE 'REG' END AS period_type
  FROM (SELECT e.event_id, CAST(floor(e.event_id/40) AS BIGINT) AS game_id, e.user_id%40 AS u,
               g.home_team_id, g.away_team_id,
               CASE e.event_type WHEN 'purchase' THEN 'goal'
                    WHEN 'view' THEN CASE WHEN e.event_id%2=0 THEN 'shot-on-goal' ELSE 'missed-shot' END
                    WHEN 'click' THEN CASE WHEN e.event_id%2=0 THEN 'hit' ELSE 'takeaway' END
                    WHEN 'error' THEN 'penalty'
                    ELSE CASE e.event_id%3 WHEN 0 THEN 'blocked-shot' WHEN 1 THEN 'faceoff' ELSE 'giveaway' END END AS et
        FROM events e JOIN games g ON g.game_id = CAST(floor(e.event_id/40) AS BIGINT)) x
)"""

FACTS = """
facts AS (
  SELECT b.game_id, CAST(g.date AS DATE) AS date, g.season, g.game_type, b.player_id, b.player_name,
         b.team, b.opponent, b.location, b.position,
         CAST(b.src_qty%8 AS DOUBLE) AS shots, CAST(b.src_line%3 AS DOUBLE) AS goals,
         CAST(b.src_part%3 AS DOUBLE) AS assists, CAST(b.src_line%3 + b.src_part%3 AS DOUBLE) AS points,
         CAST(b.src_qty%8 + b.src_part%5 AS DOUBLE) AS shot_attempts, CAST(b.src_part%5 AS DOUBLE) AS missed_shots,
         CAST(b.src_qty%4 AS DOUBLE) AS blocked_shots, CAST(b.src_part%6 AS DOUBLE) AS hits,
         CAST(b.plus_minus AS DOUBLE) AS plus_minus, CAST(b.shifts AS DOUBLE) AS shifts,
         CAST(b.src_qty AS DOUBLE) AS toi_minutes,
         CASE WHEN b.position='G' THEN CAST(20+b.src_part%15 AS DOUBLE) ELSE 0.0 END AS saves,
         CASE WHEN b.position='G' THEN CAST(22+b.src_part%15 AS DOUBLE) ELSE 0.0 END AS shots_against,
         CASE WHEN b.position='G' THEN CAST(b.src_part%5 AS DOUBLE) ELSE 0.0 END AS goals_against,
         CASE WHEN b.game_id%7=0 THEN 99 ELSE CAST(b.game_id%4 AS INT) END AS days_rest,
         g.home_score, g.away_score, g.home_abbrev, g.away_abbrev
  FROM (SELECT bx.*, row_number() OVER (PARTITION BY game_id, player_id
          ORDER BY src_line, src_part, src_qty, src_price, toi NULLS LAST) AS rn FROM box bx) b
  JOIN games g ON b.game_id = g.game_id
  WHERE b.rn = 1
),
roster AS (
  SELECT 'T'||lpad(CAST(player_id%25 AS VARCHAR),2,'0') AS team_abbrev, player_id,
         'Player '||player_name AS full_player_name, min(position) AS position_code,
         CAST(NULL AS VARCHAR) AS headshot_url
  FROM box WHERE player_id%13 <> 0 GROUP BY player_id, player_name
)"""

PROXY_CTES = "WITH " + ",".join([GAMES, BOX, PBP, FACTS])


def sql(text: str) -> str:
    """Prefix the proxy CTEs; ``text`` is either ``SELECT ...`` or ``, x AS (...) SELECT ...``."""
    text = text.strip()
    sep = "\n" if text.startswith(",") else "\n"
    return PROXY_CTES + sep + text


# ---------------------------------------------------------------- play-by-play

def _skaters_sql(pos: int) -> str:
    return (f"COALESCE(CASE WHEN length(situation_code) >= 4 "
            f"THEN TRY_CAST(substring(situation_code,{pos},1) AS INT) END, 5)")


EV_FLAGS = f"""
, ev AS (SELECT * FROM pbp WHERE period_type <> 'SO')
, ev1 AS (
  SELECT *, {_skaters_sql(2)} AS away_skaters, {_skaters_sql(3)} AS home_skaters,
         max(home_score) OVER (PARTITION BY game_id) AS final_home_score,
         max(away_score) OVER (PARTITION BY game_id) AS final_away_score
  FROM ev)
, ev2 AS (
  SELECT *,
    (event_type='goal' AND ((event_owner_team_id = away_team_id AND away_skaters > home_skaters AND home_skaters < 5)
       OR (NOT (event_owner_team_id = away_team_id) AND home_skaters > away_skaters AND away_skaters < 5))) AS is_ppg_event,
    CASE WHEN final_home_score > final_away_score THEN home_team_id
         WHEN final_away_score > final_home_score THEN away_team_id END AS winning_team_id,
    CASE WHEN final_home_score > final_away_score THEN final_away_score + 1
         WHEN final_away_score > final_home_score THEN final_home_score + 1 END AS gwg_score_threshold
  FROM ev1)
, ev3 AS (
  SELECT *, (event_type='goal' AND event_owner_team_id = winning_team_id AND
             ((winning_team_id = home_team_id AND home_score = gwg_score_threshold) OR
              (winning_team_id = away_team_id AND away_score = gwg_score_threshold))) AS is_gwg_event
  FROM ev2)
"""

_LONG = "\n  UNION ALL ".join(
    f"SELECT game_id, event_id, event_type, duration, is_ppg_event, is_gwg_event, "
    f"'{c}' AS event_role, {c} AS player_id FROM ev3 WHERE {c} IS NOT NULL"
    for c in ROLE_COLUMNS)
LONG = f", lng AS (\n  {_LONG})\n"


def _ci(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS INT)"


PGS_BODY = EV_FLAGS + LONG + f"""
, pgs0 AS (
  SELECT game_id, player_id,
    {_ci("event_type='goal' AND event_role='scoring_player_id'")} AS goals,
    {_ci("event_type='goal' AND event_role IN ('assist1_player_id','assist2_player_id')")} AS assists,
    {_ci("event_type='shot-on-goal' AND event_role='shooting_player_id'")} AS saves_on_shooter,
    {_ci("event_type='missed-shot' AND event_role='shooting_player_id'")} AS missed_shots,
    {_ci("event_type='blocked-shot' AND event_role='blocking_player_id'")} AS blocked_shots,
    {_ci("event_type='blocked-shot' AND event_role='shooting_player_id'")} AS offensive_blocked_shots,
    {_ci("event_type='hit' AND event_role='hitting_player_id'")} AS hits,
    {_ci("event_type='giveaway' AND event_role='player_id'")} AS giveaways,
    {_ci("event_type='takeaway' AND event_role='player_id'")} AS takeaways,
    CAST(COALESCE(sum(duration) FILTER (WHERE event_type='penalty' AND event_role='committed_player_id'),0) AS INT) AS pim,
    {_ci("is_ppg_event AND event_role='scoring_player_id'")} AS ppg,
    {_ci("is_ppg_event AND event_role IN ('assist1_player_id','assist2_player_id')")} AS ppa,
    {_ci("is_gwg_event AND event_role='scoring_player_id'")} AS game_winning_goal,
    {_ci("event_type='faceoff' AND event_role='winning_player_id'")} AS faceoff_wins,
    {_ci("event_type='faceoff' AND event_role='losing_player_id'")} AS faceoff_losses
  FROM lng GROUP BY game_id, player_id)
, pgs AS (
  SELECT game_id, player_id, goals, assists, missed_shots, blocked_shots, offensive_blocked_shots,
         hits, giveaways, takeaways, pim, ppg, ppa, game_winning_goal, faceoff_wins, faceoff_losses,
         goals + assists AS points, ppg + ppa AS ppp, goals + saves_on_shooter AS shots,
         CASE WHEN faceoff_wins + faceoff_losses = 0 THEN 0.0
              ELSE CAST(faceoff_wins AS DOUBLE) / (faceoff_wins + faceoff_losses) END AS faceoff_pct,
         goals + saves_on_shooter + missed_shots + offensive_blocked_shots AS shot_attempts
  FROM pgs0)
"""

ORACLE: dict[str, str] = {}

ORACLE["player_game_stats"] = sql(PGS_BODY + "SELECT * FROM pgs")


# ---------------------------------------------------------------- shared CTEs

def season_sql(d: str) -> str:
    return (f"CASE WHEN month({d}) >= 9 THEN CAST(year({d}) AS BIGINT)*10000 + year({d}) + 1 "
            f"ELSE CAST(year({d}) - 1 AS BIGINT)*10000 + year({d}) END")


TOI_SQL = ("CASE WHEN toi LIKE '%:%' THEN CAST(COALESCE(TRY_CAST(split_part(toi, ':', 1) AS INT), 0) AS DOUBLE)"
           " + CAST(COALESCE(TRY_CAST(split_part(toi, ':', 2) AS INT), 0) AS DOUBLE) / 60.0 ELSE 0.0 END")

DBOX = """
, dbox AS (
  SELECT game_id, player_id, player_name, team, opponent, location, position, plus_minus, toi, shifts,
         shots_against, saves, goals_against, save_pct, decision, game_winning_goal, ot_loss
  FROM (SELECT *, row_number() OVER (PARTITION BY game_id, player_id
                                     ORDER BY src_line, src_part, src_qty, src_price) AS rn FROM box)
  WHERE rn = 1)
"""

REST = """
, tg AS (SELECT season, game_id, CAST(date AS DATE) AS d, home_abbrev AS team FROM schedule
         UNION ALL SELECT season, game_id, CAST(date AS DATE) AS d, away_abbrev AS team FROM schedule)
, tg2 AS (SELECT *, lag(d) OVER (PARTITION BY season, team ORDER BY d, game_id) AS prev FROM tg)
, tg3 AS (SELECT game_id, team,
                 CASE WHEN prev IS NULL THEN NULL ELSE CAST(least(date_diff('day', prev, d) - 1, 3) AS INT) END AS rest
          FROM tg2)
, rest AS (SELECT s.*, h.rest AS home_days_rest, a.rest AS away_days_rest FROM schedule s
           LEFT JOIN tg3 h ON h.game_id = s.game_id AND h.team = s.home_abbrev
           LEFT JOIN tg3 a ON a.game_id = s.game_id AND a.team = s.away_abbrev)
"""

_INT_STATS = ["goals", "assists", "points", "shots", "shot_attempts", "blocked_shots",
              "offensive_blocked_shots", "missed_shots", "hits", "giveaways", "takeaways", "pim",
              "ppg", "ppa", "ppp", "game_winning_goal", "faceoff_wins", "faceoff_losses"]


def comb_sql(name: str, box: str, stats: str | None, sched: str = "rest") -> str:
    """The 38-column combined table over CTE ``box`` and stats CTE (or zeros)."""
    if stats:
        st = ", ".join(f"CAST(COALESCE(p.{c}, 0) AS INT) AS {c}" for c in _INT_STATS)
        st += ", CAST(COALESCE(p.faceoff_pct, 0.0) AS DOUBLE) AS faceoff_pct"
        join = f"LEFT JOIN {stats} p ON p.game_id = b.game_id AND p.player_id = b.player_id"
    else:
        st = ", ".join(f"CAST(0 AS INT) AS {c}" for c in _INT_STATS) + ", 0.0 AS faceoff_pct"
        join = ""
    return f"""
, {name}0 AS (
  SELECT b.*, {st}, r.date AS s_date,
         CASE WHEN b.location = 'home' THEN r.home_days_rest ELSE r.away_days_rest END AS days_rest
  FROM (SELECT game_id, player_id, player_name, team, opponent, location, position, plus_minus, toi,
               shifts, shots_against, saves, goals_against, save_pct, decision, ot_loss FROM {box}) b
  {join}
  LEFT JOIN {sched} r ON r.game_id = b.game_id)
, {name} AS (
  SELECT game_id, s_date AS date, player_id, player_name, team, opponent, location, position, days_rest,
         toi, {TOI_SQL} AS toi_minutes, shifts, goals, assists, points, plus_minus, pim, shots,
         shot_attempts, missed_shots, offensive_blocked_shots, blocked_shots, hits, giveaways,
         takeaways, faceoff_wins, faceoff_losses, faceoff_pct, ppg, ppa, ppp, game_winning_goal,
         shots_against, saves, goals_against, save_pct, decision, ot_loss
  FROM {name}0)
"""


COMB = DBOX + REST + PGS_BODY + comb_sql("comb", "dbox", "pgs")

# The prop catalogue with its default lines.
PROPS = [(0, "Skater", "shots", 1.5), (1, "Skater", "shot_attempts", 0.5), (2, "Skater", "points", 0.5),
         (3, "Skater", "goals", 0.5), (4, "Skater", "assists", 0.5), (5, "Skater", "toi_minutes", 0.5),
         (6, "Skater", "blocked_shots", 1.5), (7, "Skater", "hits", 0.5), (8, "Skater", "plus_minus", 0.5),
         (9, "Goalie", "saves", 24.5), (10, "Goalie", "shots_against", 25.5), (11, "Goalie", "goals_against", 2.5)]
_PROP_VALUES = ", ".join(f"({i}, '{t}', '{s}', {v})" for i, t, s, v in PROPS)
PROP_STATS_SQL = ["shots", "shot_attempts", "points", "goals", "assists", "toi_minutes",
                  "blocked_shots", "hits", "plus_minus", "saves", "shots_against", "goals_against"]


def stat_value_sql(stat: str, prefix: str = "f.") -> str:
    return "CASE " + stat + " " + " ".join(f"WHEN '{s}' THEN {prefix}{s}" for s in PROP_STATS_SQL) + " END"


TODAY = "1997-08-24"
REQ = f"""
, req AS (
  SELECT g.game_id AS matchup_id, CAST(p.i AS INT) AS prop_id, CAST(g.date AS DATE) AS selected_date, g.home_abbrev AS home,
         g.away_abbrev AS away, p.player_type, p.stat, CAST(p.threshold AS DOUBLE) AS threshold
  FROM games g, (VALUES {_PROP_VALUES}) p(i, player_type, stat, threshold))
"""


def targets_sql(today: str = TODAY) -> str:
    return REQ + f"""
, slate AS (SELECT game_id AS matchup_id, CAST(date AS DATE) AS selected_date, home_abbrev AS home, away_abbrev AS away FROM games)
, sides AS (SELECT *, home AS team FROM slate UNION ALL SELECT *, away AS team FROM slate)
, past0 AS (
  SELECT s.matchup_id, f.player_id, f.player_name, f.team AS team_abbrev, f.position AS position_code,
         row_number() OVER (PARTITION BY s.matchup_id, f.player_id ORDER BY f.game_id, f.team) AS rn
  FROM sides s JOIN facts f ON f.date = s.selected_date AND f.team = s.team
  WHERE s.selected_date < DATE '{today}')
, listed AS (
  SELECT matchup_id, player_id, player_name, team_abbrev, position_code FROM past0 WHERE rn = 1
  UNION ALL
  SELECT s.matchup_id, r.player_id, r.full_player_name, r.team_abbrev, r.position_code
  FROM sides s JOIN roster r ON r.team_abbrev = s.team WHERE s.selected_date >= DATE '{today}')
, targets AS (
  SELECT q.matchup_id, q.prop_id, e.player_id, e.team_abbrev, e.player_name, e.position_code,
         q.selected_date, q.home, q.away, q.stat, q.threshold,
         {season_sql('q.selected_date')} AS req_season,
         CASE WHEN e.team_abbrev = q.home THEN q.away WHEN e.team_abbrev = q.away THEN q.home END AS h2h_opponent
  FROM req q JOIN listed e ON e.matchup_id = q.matchup_id
   AND ((q.player_type = 'Goalie' AND e.position_code = 'G') OR (q.player_type <> 'Goalie' AND e.position_code <> 'G')))
"""


TARGET_SQL = "matchup_id, prop_id, player_id, team_abbrev"

# Counts as of a date: running sums per day, looked up with ASOF joins.
RATES = """
, counted AS (SELECT * FROM facts)
, hit AS (SELECT f.player_id, p.prop_id, f.date, f.season, f.opponent, f.location, (%s) >= p.threshold AS hit
          FROM counted f, (SELECT DISTINCT prop_id, stat, threshold FROM req) p)
, sday AS (SELECT player_id, prop_id, season, date, count(*) AS g, count(*) FILTER (WHERE hit) AS h,
             count(*) FILTER (WHERE location = 'home') AS gh, count(*) FILTER (WHERE location = 'home' AND hit) AS hh,
             count(*) FILTER (WHERE location = 'away') AS ga, count(*) FILTER (WHERE location = 'away' AND hit) AS ha
           FROM hit GROUP BY ALL)
, srun AS (SELECT player_id, prop_id, season, date, sum(g) OVER w AS sg, sum(h) OVER w AS sh, sum(gh) OVER w AS gh,
             sum(hh) OVER w AS hhm, sum(ga) OVER w AS ga, sum(ha) OVER w AS ha
           FROM sday WINDOW w AS (PARTITION BY player_id, prop_id, season ORDER BY date))
, oday AS (SELECT player_id, prop_id, opponent, date, count(*) AS g, count(*) FILTER (WHERE hit) AS h FROM hit GROUP BY ALL)
, orun AS (SELECT player_id, prop_id, opponent, date, sum(g) OVER w AS hg, sum(h) OVER w AS hh
           FROM oday WINDOW w AS (PARTITION BY player_id, prop_id, opponent ORDER BY date))
, dday AS (SELECT player_id, prop_id, date, count(*) AS g, count(*) FILTER (WHERE hit) AS h FROM hit GROUP BY ALL)
, drun AS (SELECT player_id, prop_id, date,
             sum(g) OVER (w ROWS 4 PRECEDING) AS g5, sum(h) OVER (w ROWS 4 PRECEDING) AS h5,
             sum(g) OVER (w ROWS 9 PRECEDING) AS g10, sum(h) OVER (w ROWS 9 PRECEDING) AS h10,
             sum(g) OVER (w ROWS 19 PRECEDING) AS g20, sum(h) OVER (w ROWS 19 PRECEDING) AS h20
           FROM dday WINDOW w AS (PARTITION BY player_id, prop_id ORDER BY date))
, ragg AS (
  SELECT t.*, s.sg, s.sh, s.gh, s.hhm, s.ga, s.ha, o.hg, o.hh, d.g5, d.h5, d.g10, d.h10, d.g20, d.h20
  FROM targets t
  ASOF LEFT JOIN srun s ON s.player_id = t.player_id AND s.prop_id = t.prop_id AND s.season = t.req_season
    AND t.selected_date >= s.date
  ASOF LEFT JOIN orun o ON o.player_id = t.player_id AND o.prop_id = t.prop_id AND o.opponent = t.h2h_opponent
    AND t.selected_date >= o.date
  ASOF LEFT JOIN drun d ON d.player_id = t.player_id AND d.prop_id = t.prop_id AND t.selected_date >= d.date)
""" % stat_value_sql("p.stat")


def _rate(prefix: str, g: str, h: str) -> str:
    return (f"CAST(COALESCE(a.{g}, 0) AS BIGINT) AS {prefix}_games, "
            f"CASE WHEN COALESCE(a.{g}, 0) > 0 THEN CAST(a.{h} AS BIGINT) END AS {prefix}_hits, "
            f"CASE WHEN COALESCE(a.{g}, 0) > 0 THEN CAST(a.{h} AS DOUBLE) / CAST(a.{g} AS DOUBLE) * 100.0 END AS {prefix}_pct")


def _loc(side: str, g: str, h: str) -> str:
    return (f"CAST(COALESCE(a.{g}, 0) AS BIGINT) AS {side}_season_games, "
            f"CASE WHEN COALESCE(a.{g}, 0) > 0 THEN CAST(a.{h} AS DOUBLE) / CAST(a.{g} AS DOUBLE) * 100.0 END AS {side}_season_pct")


PT = RATES + f"""
, pt AS (
  SELECT a.matchup_id, a.prop_id, a.player_id, a.player_name, a.team_abbrev, a.position_code, a.stat, a.threshold,
    {_rate('season', 'sg', 'sh')},
    CAST(COALESCE(a.hg, 0) AS BIGINT) AS h2h_games,
    CASE WHEN COALESCE(a.hg, 0) > 0 THEN CAST(a.hh AS BIGINT) END AS h2h_hits,
    COALESCE(CASE WHEN COALESCE(a.hg, 0) > 0 THEN CAST(a.hh AS DOUBLE) / CAST(a.hg AS DOUBLE) * 100.0 END, 0.0) AS h2h_pct,
    {_rate('l5', 'g5', 'h5')}, {_rate('l10', 'g10', 'h10')}, {_rate('l20', 'g20', 'h20')},
    {_loc('away', 'ga', 'ha')}, {_loc('home', 'gh', 'hhm')}
  FROM ragg a)
"""


def _fmt(label: str, p: str, n: int, with_g: bool) -> str:
    ok = f"{p}_games >= {n}" if n > 1 else f"{p}_games > 0"
    txt = f"CAST(CAST(round({p}_pct, 0) AS INT) AS VARCHAR) || '%'"
    if with_g:
        txt += f" || ' (' || CAST({p}_games AS VARCHAR) || 'g)'"
    return (f"CASE WHEN {ok} AND {p}_pct IS NOT NULL THEN {txt} ELSE 'n/a' END AS \"{label} (Formatted)\", "
            f"CASE WHEN {ok} THEN {p}_pct END AS \"{label} %\"")


def _fmt_loc(label: str, side: str) -> str:
    p, g = f"{side}_season_pct", f"{side}_season_games"
    txt = f"CAST(CAST(round({p}, 0) AS INT) AS VARCHAR) || '% (' || CAST({g} AS VARCHAR) || 'g)'"
    return (f"CASE WHEN {p} IS NOT NULL AND {g} > 0 THEN {txt} ELSE 'n/a' END AS \"{label} (Season) (Formatted)\", "
            f"CASE WHEN {p} IS NOT NULL AND {g} > 0 THEN {p} END AS \"{label} %\"")


HISTORY = """
, day AS (SELECT player_id, date, count(*) AS g FROM facts GROUP BY ALL)
, run AS (SELECT player_id, date, CAST(sum(g) OVER (PARTITION BY player_id ORDER BY date) AS BIGINT) AS games FROM day)
, asked AS (SELECT DISTINCT player_id, selected_date FROM targets)
SELECT a.player_id, a.selected_date, COALESCE(r.games, 0) AS games, r.date AS last_date
FROM asked a ASOF LEFT JOIN run r ON r.player_id = a.player_id AND a.selected_date >= r.date"""

PTF = PT + f"""
, ptf AS (
  SELECT matchup_id, prop_id, player_id, player_name AS "Player", team_abbrev AS "Team", position_code AS "Pos",
         threshold AS "Line", {_fmt('Season', 'season', 1, True)}, {_fmt('H2H', 'h2h', 1, True)},
         {_fmt('L5', 'l5', 5, False)}, {_fmt('L10', 'l10', 10, False)}, {_fmt('L20', 'l20', 20, False)},
         {_fmt_loc('Away', 'away')}, {_fmt_loc('Home', 'home')}
  FROM pt)
"""


def fdiv(n: str, d: str) -> str:
    return (f"CASE WHEN {d} = 0 THEN CASE WHEN {n} IS NULL THEN NULL WHEN {n} > 0 THEN CAST('inf' AS DOUBLE) "
            f"WHEN {n} < 0 THEN CAST('-inf' AS DOUBLE) ELSE CAST('nan' AS DOUBLE) END ELSE {n} / {d} END")


FLONG = ", flong AS (" + "\n  UNION ALL ".join(
    f"SELECT season, team, opponent, position, '{s}' AS stat, CAST({s} AS DOUBLE) AS value FROM facts"
    for s in PROP_STATS_SQL) + ")\n"


def dvp_sql(defense: str = "team") -> str:
    return FLONG + f"""
, scoped AS (SELECT l.* FROM flong l JOIN scope s USING (season, stat))
, td AS (SELECT season, stat, {defense} AS team, position, avg(value) AS avg_allowed, count(*) AS games_count
         FROM scoped GROUP BY season, stat, {defense}, position)
, pa AS (SELECT season, stat, position, avg(value) AS league_avg, count(*) AS total_games FROM scoped GROUP BY season, stat, position)
, toff AS (SELECT season, stat, team, position, avg(value) AS team_offensive FROM scoped GROUP BY season, stat, team, position)
, opps AS (SELECT DISTINCT season, stat, team, opponent FROM scoped)
, ss0 AS (SELECT o.season, o.stat, o.team, t.position, avg(t.team_offensive) AS avg_opp
          FROM opps o JOIN toff t ON t.season = o.season AND t.stat = o.stat AND t.team = o.opponent
          GROUP BY o.season, o.stat, o.team, t.position)
, ss AS (SELECT s.season, s.stat, s.team, s.position, {fdiv('s.avg_opp', 'p.league_avg')} AS schedule_strength_factor
         FROM ss0 s LEFT JOIN pa p ON p.season = s.season AND p.stat = s.stat AND p.position = s.position)
, dvp0 AS (SELECT td.*, pa.league_avg, ss.schedule_strength_factor, td.avg_allowed - pa.league_avg AS raw_dvp
           FROM td LEFT JOIN pa ON pa.season = td.season AND pa.stat = td.stat AND pa.position = td.position
           LEFT JOIN ss ON ss.season = td.season AND ss.stat = td.stat AND ss.team = td.team AND ss.position = td.position)
, dvp1 AS (SELECT *, {fdiv('raw_dvp', 'schedule_strength_factor')} AS schedule_adjusted_dvp FROM dvp0)
, dvp AS (SELECT *, CASE WHEN schedule_adjusted_dvp IS NOT NULL THEN CAST(dense_rank() OVER (
            PARTITION BY season, stat, position ORDER BY round(schedule_adjusted_dvp, 9) DESC NULLS LAST) AS INT) END AS dvp_rank
          FROM dvp1)
"""


def dvp_scope(stats: list[str]) -> str:
    values = ", ".join(f"('{s}')" for s in stats)
    return f", scope AS (SELECT DISTINCT season, v.stat FROM facts, (VALUES {values}) v(stat))\n"


def _unless_tie(x: str, scale: int, shown: str) -> str:
    return (f"CASE WHEN isnan({x}) OR isinf({x}) OR (abs({x} * {scale} - floor({x} * {scale}) - 0.5) >= 1e-6 "
            f"AND abs({x}) >= 0.05) THEN {shown} END")


def safe_dvp_text(x: str) -> str:
    """Text where no rounding tie or signed zero is near."""
    text = (f"CASE WHEN isnan({x}) THEN '+NaN' WHEN isinf({x}) AND {x} > 0 THEN '+inf' WHEN isinf({x}) THEN '-inf' "
            f"WHEN {x} > 0 THEN '+' || CAST(round({x}, 1) AS VARCHAR) ELSE CAST(round({x}, 1) AS VARCHAR) END")
    return _unless_tie(x, 10, text)


def safe_dvp(x: str) -> str:
    """Rounded value and text where no rounding tie or signed zero is near."""
    return f"{_unless_tie(x, 100, f'round({x}, 2)')} AS dvp_value, {safe_dvp_text(x)} AS dvp_formatted"


def dvp_out(stats: list[str], defense: str = "team") -> str:
    return sql(dvp_scope(stats) + dvp_sql(defense) + f"""
SELECT season, stat, team, position, dvp_rank, {safe_dvp('schedule_adjusted_dvp')}, round(schedule_adjusted_dvp, 6) AS schedule_adjusted_dvp,
       round(avg_allowed, 6) AS avg_allowed, round(league_avg, 6) AS league_avg,
       round(schedule_strength_factor, 6) AS schedule_strength_factor, games_count FROM dvp""")


#: All logs of the player view: a player's games in a scope under a location and a rest filter.
LOGS = """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY date DESC, game_id DESC) AS rn FROM facts)
, scoped_games AS (
  SELECT *, 'season' AS log_kind, CAST(season AS VARCHAR) AS log_value FROM ranked
  UNION ALL SELECT *, 'h2h', opponent FROM ranked
  UNION ALL SELECT *, 'all', '' FROM ranked
  UNION ALL SELECT r.*, 'L' || n, '' FROM ranked r JOIN (VALUES (5), (10), (20), (30)) t(n) ON rn <= n)
, logs AS (
  SELECT g.*, l.location_filter, r.rest_filter,
         CAST(row_number() OVER (PARTITION BY player_id, log_kind, log_value, location_filter, rest_filter
                                 ORDER BY date DESC, game_id DESC) AS INT) AS log_rank
  FROM scoped_games g
  JOIN (VALUES ('any'), ('home'), ('away')) l(location_filter) ON location_filter = 'any' OR location_filter = g.location
  JOIN (VALUES ('any'), ('0'), ('1'), ('2'), ('3+')) r(rest_filter)
    ON rest_filter = 'any' OR (rest_filter = '3+' AND days_rest >= 3) OR (rest_filter <> '3+' AND days_rest = TRY_CAST(rest_filter AS INT)))
"""
_LOGK = "player_id, log_kind, log_value, location_filter, rest_filter"

#: Counts per log and line, looked up by every view; the fifteen lattice points are numbered in display order.
KPIS = targets_sql() + LOGS + f"""
, asked AS (SELECT DISTINCT player_id, req_season AS season, h2h_opponent AS opponent_team, stat, threshold FROM targets)
, hits AS (SELECT {', '.join('g.' + c for c in _LOGK.split(', '))}, g.season, g.opponent, g.log_rank, p.stat, p.threshold,
             ({stat_value_sql('p.stat', 'g.')}) >= p.threshold AS hit
           FROM logs g JOIN (SELECT DISTINCT player_id, stat, threshold FROM asked) p ON p.player_id = g.player_id)
, cs AS (SELECT {_LOGK}, stat, threshold, season, count(*) AS g, count(*) FILTER (WHERE hit) AS h FROM hits GROUP BY ALL)
, co AS (SELECT {_LOGK}, stat, threshold, opponent, count(*) AS g, count(*) FILTER (WHERE hit) AS h FROM hits GROUP BY ALL)
, cl AS (SELECT {_LOGK}, stat, threshold, count(*) FILTER (WHERE log_rank <= 5) AS g5, count(*) FILTER (WHERE hit AND log_rank <= 5) AS h5,
           count(*) AS g10, count(*) FILTER (WHERE hit) AS h10 FROM hits WHERE log_rank <= 10 GROUP BY ALL)
, views AS (
  SELECT a.*, f.game_filter, l.location_filter, r.rest_filter, l.i * 5 + r.j AS point,
         CASE WHEN game_filter IN ('season', 'last_season') THEN 'season' WHEN game_filter = 'h2h' AND opponent_team IS NULL THEN 'all'
              ELSE game_filter END AS log_kind,
         CASE game_filter WHEN 'season' THEN CAST(a.season AS VARCHAR) WHEN 'last_season' THEN CAST(a.season - 10001 AS VARCHAR)
              WHEN 'h2h' THEN COALESCE(opponent_team, '') ELSE '' END AS log_value
  FROM asked a, (VALUES ('season'), ('last_season'), ('h2h'), ('L5'), ('L10'), ('L20'), ('L30')) f(game_filter),
       (VALUES (0, 'any'), (1, 'home'), (2, 'away')) l(i, location_filter),
       (VALUES (0, 'any'), (1, '0'), (2, '1'), (3, '2'), (4, '3+')) r(j, rest_filter))
, rated AS (
  SELECT v.*, cs.g AS sg, cs.h AS sh, co.g AS og, co.h AS oh, g5, h5, g10, h10
  FROM views v LEFT JOIN cs USING ({_LOGK}, stat, threshold, season)
  LEFT JOIN (SELECT * RENAME (opponent AS opponent_team) FROM co) co USING ({_LOGK}, stat, threshold, opponent_team)
  LEFT JOIN cl USING ({_LOGK}, stat, threshold))
"""


def _kpi_text(g: str, h: str, empty: str) -> str:
    rate = f"CAST(CAST(round_even(CAST({h} AS DOUBLE) / CAST({g} AS DOUBLE) * 100.0, 0) AS INT) AS VARCHAR)"
    return f"string_agg(CASE WHEN COALESCE({g}, 0) > 0 THEN {rate} || '% (' || {g} || 'g)' ELSE '{empty}' END, '|' ORDER BY point)"


ORACLE.update({
    "scan_parquet": sql("SELECT game_id, date, season, game_type, away_abbrev, away_score, home_abbrev, home_score, "
                        "start_time, venue FROM schedule WHERE season = 19961997"),
    "scan_all_seasons": sql("SELECT * FROM facts"),
    "scan_schedule_projected": sql("SELECT game_id, date, season, game_type, home_abbrev, away_abbrev, home_score, "
                                   "away_score, start_time, venue FROM schedule"),
    "roster_dim": sql(", rr AS (SELECT team_abbrev, player_id, full_player_name AS player_name, position_code, "
                      "headshot_url FROM roster) SELECT * FROM rr"),
    "flatten_schedule": sql("SELECT game_id, date, season, game_type, away_abbrev, away_score, home_abbrev, home_score, "
                            "start_time, venue FROM schedule CROSS JOIN (VALUES (1), (2)) t(copy)"),
    "flatten_scores": sql("SELECT game_id, date, season, game_type, away_abbrev, away_score, home_abbrev, home_score, "
                          "CAST(NULL AS VARCHAR) AS start_time, CAST(NULL AS VARCHAR) AS venue FROM schedule "
                          "WHERE (CASE WHEN game_id % 11 = 0 THEN 'FUT' ELSE 'FINAL' END) IN ('OFF', 'FINAL')"),
    "flatten_roster": sql("SELECT team_abbrev, player_id, full_player_name, position_code, headshot_url FROM roster"),
    "flatten_boxscore": sql(DBOX + """
SELECT game_id, player_id, player_name, team, opponent, location, position,
       CASE WHEN position = 'G' THEN 0 ELSE plus_minus END AS plus_minus, COALESCE(toi, '0:00') AS toi,
       CASE WHEN position = 'G' THEN 0 ELSE shifts END AS shifts,
       shots_against, saves, goals_against, save_pct,
       CASE WHEN position = 'G' THEN COALESCE(decision, '') END AS decision,
       0 AS game_winning_goal, CASE WHEN position = 'G' AND decision = 'O' THEN 1 ELSE 0 END AS ot_loss
FROM dbox"""),
    "flatten_pbp": sql("SELECT game_id, event_id, event_type, COALESCE(situation_code, '') AS situation_code, "
                       "event_owner_team_id, home_team_id, away_team_id, " + ", ".join(ROLE_COLUMNS)
                       + ", duration, home_score, away_score, period_type FROM pbp"),
    "active_teams": sql("""
, t AS (SELECT season, home_abbrev AS team FROM games UNION SELECT season, away_abbrev FROM games)
SELECT season, team, season = (SELECT max(season) FROM games) AS is_latest FROM t"""),
    "filter_predicates": sql("SELECT * FROM schedule WHERE (home_score > away_score AND venue <> 'V05') "
                             "OR NOT (game_type = 2)"),
    "semi_filter_games": sql(DBOX + "SELECT * FROM dbox WHERE game_id IN (SELECT game_id FROM pbp)"),
    "filter_game_types": sql("SELECT * FROM schedule WHERE game_type IN (2, 3)"),
    "player_log_filtered": sql(LOGS + f"SELECT {_LOGK}, game_id, date, season, opponent, location, days_rest, {', '.join(PROP_STATS_SQL)} FROM logs"),
    "recent_games": sql("SELECT game_id, date, season, game_type, away_abbrev, away_score, home_abbrev, home_score, "
                        "CAST(NULL AS VARCHAR) AS start_time, CAST(NULL AS VARCHAR) AS venue FROM schedule "
                        "WHERE (CASE WHEN game_id % 11 = 0 THEN 'FUT' ELSE 'FINAL' END) IN ('OFF', 'FINAL') AND date BETWEEN '1997-08-16' AND '1997-08-22'"),
    "player_search": sql(DBOX + "SELECT DISTINCT player_id, player_name FROM dbox WHERE contains(lower(player_name), 'p0')"),
    "join_box_stats": sql(DBOX + PGS_BODY + """
SELECT b.game_id, b.player_id, b.player_name, b.team, b.opponent, b.location, b.position, b.plus_minus, b.toi,
       b.shifts, b.shots_against, b.saves, b.goals_against, b.save_pct, b.decision, b.ot_loss,
       p.goals, p.assists, p.missed_shots, p.blocked_shots, p.offensive_blocked_shots, p.hits, p.giveaways,
       p.takeaways, p.pim, p.ppg, p.ppa, p.game_winning_goal, p.faceoff_wins, p.faceoff_losses, p.points,
       p.ppp, p.shots, p.faceoff_pct, p.shot_attempts
FROM dbox b LEFT JOIN pgs p ON p.game_id = b.game_id AND p.player_id = b.player_id"""),
    "dvp_matchup": sql(targets_sql()
                       + ", scope AS (SELECT DISTINCT req_season AS season, stat FROM targets)\n" + dvp_sql() + f"""
, m AS (
SELECT t.matchup_id, t.prop_id, t.player_id, t.team_abbrev, t.req_season AS season, t.stat, t.h2h_opponent AS opponent,
       t.position_code AS position,
       CASE t.position_code WHEN 'C' THEN 'Center' WHEN 'L' THEN 'Left Wing' WHEN 'R' THEN 'Right Wing'
            WHEN 'D' THEN 'Defense' WHEN 'G' THEN 'Goalie' ELSE t.position_code END AS position_name,
       CASE WHEN o.team IS NOT NULL AND x.team IS NOT NULL THEN o.dvp_rank ELSE 16 END AS dvp_rank,
       CASE WHEN o.team IS NOT NULL AND x.team IS NOT NULL THEN round(x.avg_allowed, 6) END AS opponent_avg,
       CASE WHEN o.team IS NOT NULL AND x.team IS NOT NULL THEN o.schedule_adjusted_dvp END AS exact
FROM targets t
LEFT JOIN dvp o ON o.season = t.req_season AND o.stat = t.stat AND o.team = t.team_abbrev AND o.position = t.position_code
LEFT JOIN dvp x ON x.season = t.req_season AND x.stat = t.stat AND x.team = t.h2h_opponent AND x.position = t.position_code)
SELECT * EXCLUDE (exact), {safe_dvp('exact')} FROM m"""),
    "history_asof": sql(targets_sql() + HISTORY),
    "history_asof_before": sql(targets_sql() + HISTORY.replace("a.selected_date >= ", "a.selected_date > ")),
    "requests_for_matchups": sql(f"""
, m AS (SELECT date, away_abbrev, home_abbrev, min(game_id) AS first_game FROM schedule GROUP BY ALL)
SELECT first_game AS matchup_id, CAST(p.i AS INT) AS prop_id, CAST(date AS DATE) AS selected_date, home_abbrev AS home,
       away_abbrev AS away, p.player_type, p.stat, CAST(p.threshold AS DOUBLE) AS threshold
FROM m, (VALUES {_PROP_VALUES}) p(i, player_type, stat, threshold)"""),
    "first_goal_events": sql(EV_FLAGS + """
, ranked AS (SELECT scoring_player_id, game_id, event_id, event_type, situation_code,
                    CAST(row_number() OVER (PARTITION BY scoring_player_id ORDER BY game_id, event_id) AS INT) AS goal_rank
             FROM ev WHERE event_type = 'goal' AND scoring_player_id IS NOT NULL)
SELECT * FROM ranked WHERE goal_rank <= 10"""),
    "write_roundtrip": sql(REST + "SELECT * FROM rest WHERE season = 19961997"),
    "refresh_archive": sql(COMB + "SELECT c.*, s.season FROM comb c JOIN schedule s ON s.game_id = c.game_id "
                           "WHERE s.season = 19961997"),
    "dvp_team_defense": sql(dvp_scope(PROP_STATS_SQL) + FLONG + """
, scoped AS (SELECT l.* FROM flong l JOIN scope s USING (season, stat))
SELECT season, stat, team, position, round(avg(value), 6) AS avg_allowed, count(*) AS games_count
FROM scoped GROUP BY season, stat, team, position"""),
    "dvp_position_avg": sql(dvp_scope(PROP_STATS_SQL) + FLONG + """
, scoped AS (SELECT l.* FROM flong l JOIN scope s USING (season, stat))
SELECT season, stat, position, round(avg(value), 6) AS league_avg, count(*) AS total_games
FROM scoped GROUP BY season, stat, position"""),
    "rate_season": sql(targets_sql() + PT + "SELECT " + TARGET_SQL + ", season_games, season_hits, season_pct FROM pt"),
    "rate_h2h": sql(targets_sql() + PT + "SELECT " + TARGET_SQL + ", h2h_games, h2h_hits, h2h_pct FROM pt"),
    "rate_last_n": sql(targets_sql() + PT + "SELECT " + TARGET_SQL + ", l5_games, l5_hits, l5_pct, "
                       "l10_games, l10_hits, l10_pct, l20_games, l20_hits, l20_pct FROM pt"),
    "rate_location": sql(targets_sql() + PT + "SELECT " + TARGET_SQL + ", away_season_games, "
                         "away_season_pct, home_season_games, home_season_pct FROM pt"),
    "chart_summary": sql(LOGS + f"""
SELECT {_LOGK}, count(*) AS games, round(avg(shot_attempts), 6) AS avg_shot_attempts, round(avg(missed_shots), 6) AS avg_missed_shots,
       round(avg(toi_minutes), 6) AS avg_toi_minutes, round(avg(shifts), 6) AS avg_shifts
FROM logs WHERE log_rank <= 25 GROUP BY {_LOGK}"""),
    "schedule_days_rest": sql(REST + "SELECT * FROM rest"),
    "pbp_gwg_flag": sql(EV_FLAGS + "SELECT game_id, event_id, scoring_player_id, final_home_score, final_away_score, "
                        "winning_team_id, is_gwg_event FROM ev3 WHERE event_type = 'goal'"),
    "sort_schedule": sql("SELECT * FROM schedule ORDER BY date, game_id"),
    "top_n_games": sql("""
, r AS (SELECT player_id, game_id, date, CAST(row_number() OVER (PARTITION BY player_id ORDER BY date DESC, game_id DESC) AS INT) AS game_rank FROM facts)
SELECT * FROM r WHERE game_rank <= 10"""),
    "chart_series": sql(targets_sql() + LOGS + f"""
, valued AS (
  SELECT g.*, p.stat, p.threshold, CAST({stat_value_sql('p.stat', 'g.')} AS DOUBLE) AS value
  FROM logs g JOIN (SELECT DISTINCT player_id, stat, threshold FROM targets) p ON p.player_id = g.player_id WHERE g.log_rank <= 25)
SELECT {_LOGK}, stat, threshold, count(*) AS games, count(*) FILTER (WHERE value >= threshold) AS hits, round(avg(value), 6) AS avg_value,
       max(value) + 1 AS y_max,
       string_agg(strftime(date, '%m/%d') || ' vs ' || opponent || CASE WHEN value >= threshold THEN ' +' ELSE ' -' END, '|'
                  ORDER BY log_rank DESC) AS points
FROM valued GROUP BY {_LOGK}, stat, threshold"""),
    "game_log": sql(LOGS + f"SELECT {_LOGK}, game_id, date, log_rank, {', '.join(PROP_STATS_SQL)} FROM logs WHERE log_rank <= 50"),
    "sample_games": sql("""
, f AS (SELECT *, row_number() OVER (PARTITION BY home_abbrev ORDER BY date, game_id) AS rn FROM schedule WHERE date < '1999-01-01')
SELECT game_id, date, season, game_type, away_abbrev, away_score, home_abbrev, home_score, start_time, venue
FROM f WHERE rn = 1 ORDER BY date, game_id LIMIT 32"""),
    "dedupe_boxscores": sql("""
, d AS (SELECT *, row_number() OVER (PARTITION BY game_id, player_id ORDER BY src_line, src_part, src_qty, src_price) AS rn FROM box)
SELECT * EXCLUDE (rn) FROM d WHERE rn = 1"""),
    "season_schedule": sql("SELECT * FROM schedule WHERE game_type IN (2, 3)"),
    "union_home_away": sql("""
SELECT game_id, date, season, home_abbrev AS team, away_abbrev AS opponent, 'home' AS location,
       home_score AS goals_for, away_score AS goals_against FROM schedule
UNION ALL
SELECT game_id, date, season, away_abbrev, home_abbrev, 'away', away_score, home_score FROM schedule"""),
    "complete_games": sql(DBOX + "SELECT game_id FROM pbp INTERSECT SELECT game_id FROM dbox"),
    "missing_games": sql(DBOX + """
SELECT s.game_id, s.date, s.game_id IN (SELECT game_id FROM pbp) AS has_pbp,
       s.game_id IN (SELECT game_id FROM dbox) AS has_box
FROM schedule s WHERE s.date < '2001-12-31'
  AND NOT (s.game_id IN (SELECT game_id FROM pbp) AND s.game_id IN (SELECT game_id FROM dbox))"""),
    "pbp_unpivot": sql(EV_FLAGS + ", lng2 AS (" + " UNION ALL ".join(
        f"SELECT game_id, event_id, event_type, '{c}' AS event_role, {c} AS player_id FROM ev WHERE {c} IS NOT NULL"
        for c in ROLE_COLUMNS) + ") SELECT * FROM lng2"),
    "stats_long": sql(", sl AS (" + " UNION ALL ".join(
        f"SELECT game_id, player_id, date, season, team, opponent, location, position, '{s}' AS stat, "
        f"CAST({s} AS DOUBLE) AS value FROM facts" for s in PROP_STATS_SQL) + ") SELECT * FROM sl"),
    "pbp_strength": sql(f"SELECT game_id, event_id, situation_code, {_skaters_sql(2)} AS away_skaters, "
                        f"{_skaters_sql(3)} AS home_skaters FROM pbp"),
    "season_of_date": sql(f"""
, s AS (SELECT game_id, date, season, {season_sql('CAST(date AS DATE)')} AS season_id FROM schedule)
SELECT *, substring(CAST(season_id AS VARCHAR), 3, 2) || '/' || substring(CAST(season_id AS VARCHAR), 7, 2) AS season_label FROM s"""),
    "toi_minutes": sql(f"SELECT game_id, player_id, src_line, toi, {TOI_SQL} AS toi_minutes FROM box"),
    "hockey_date": sql("""
SELECT game_id, start_time,
       CAST(timezone('America/New_York', CAST(strptime(start_time, '%Y-%m-%dT%H:%M:%SZ') AS TIMESTAMP) AT TIME ZONE 'UTC')
            - INTERVAL 5 HOUR AS DATE) AS hockey_date
FROM schedule"""),
    "pbp_ppg_flag": sql(EV_FLAGS + "SELECT game_id, event_id, event_type, away_skaters, home_skaters, is_ppg_event FROM ev3"),
    "combine_boxscores": sql(COMB + "SELECT * FROM comb"),
    "backfill_merge": sql(COMB + "SELECT * FROM comb"),
    "refresh_upsert": sql(COMB + """
, recent AS (SELECT game_id FROM schedule WHERE game_id % 11 <> 0 AND date BETWEEN '1996-08-23' AND '1997-08-22')
SELECT * FROM comb WHERE game_id NOT IN (SELECT game_id FROM recent)
UNION ALL SELECT * REPLACE (shifts + 1 AS shifts) FROM comb WHERE game_id IN (SELECT game_id FROM recent)"""),
    "win_flag": sql("""
SELECT game_id, player_id, location, home_score, away_score,
       CASE WHEN location = 'home' AND home_score > away_score THEN 1
            WHEN location = 'away' AND away_score > home_score THEN 1 ELSE 0 END AS win FROM facts"""),
    "dvp_schedule_strength": sql(dvp_scope(PROP_STATS_SQL) + dvp_sql() + "SELECT season, stat, team, position, "
                                 "round(schedule_strength_factor, 6) AS schedule_strength_factor FROM ss"),
    "dvp_metrics": dvp_out(PROP_STATS_SQL),
    "dvp_metrics_opponent": dvp_out(PROP_STATS_SQL, "opponent"),
    "dvp_metrics_nan": dvp_out(["saves", "shots_against", "goals_against"]),
    "eligible_players": sql(targets_sql() + f"SELECT {TARGET_SQL}, player_name, position_code FROM targets"),
    "eligible_players_roster": sql(targets_sql("1990-01-01")
                                   + f"SELECT {TARGET_SQL}, player_name, position_code FROM targets"),
    "prop_table": sql(targets_sql() + PT + "SELECT * FROM pt"),
    "prop_table_regular_before": sql(targets_sql() + PT.replace("FROM facts)", "FROM facts WHERE game_type = 2)")
                                     .replace("t.selected_date >= ", "t.selected_date > ") + "SELECT * FROM pt"),
    "prop_table_formatted": sql(targets_sql() + PTF + "SELECT * FROM ptf"),
    "matchup_overview": sql(targets_sql() + PTF
                            + ", scope AS (SELECT DISTINCT req_season AS season, stat FROM targets)\n" + dvp_sql() + """
SELECT p.*, CASE WHEN o.team IS NOT NULL AND x.team IS NOT NULL THEN o.dvp_rank ELSE 16 END AS "DvP_Rank",
       CASE WHEN o.team IS NULL OR x.team IS NULL THEN '0.0' ELSE @TEXT@ END AS "DvP"
FROM ptf p JOIN targets t ON t.matchup_id = p.matchup_id AND t.prop_id = p.prop_id AND t.player_id = p.player_id
 AND t.team_abbrev = p."Team"
LEFT JOIN dvp o ON o.season = t.req_season AND o.stat = t.stat AND o.team = t.team_abbrev AND o.position = t.position_code
LEFT JOIN dvp x ON x.season = t.req_season AND x.stat = t.stat AND x.team = t.h2h_opponent AND x.position = t.position_code""".replace("@TEXT@", safe_dvp_text("o.schedule_adjusted_dvp"))),
    "daily_slate": sql("""
SELECT date, game_id,
       strftime(timezone('America/New_York', CAST(strptime(start_time, '%Y-%m-%dT%H:%M:%SZ') AS TIMESTAMP) AT TIME ZONE 'UTC'), '%I:%M %p') AS time_est,
       home_abbrev AS home, away_abbrev AS away, COALESCE(venue, 'Unknown') AS venue,
       away_abbrev || ' @ ' || home_abbrev AS matchup, start_time
FROM schedule"""),
    "matchup_options": sql("SELECT date, away_abbrev || ' @ ' || home_abbrev AS matchup, min(game_id) AS first_game_id "
                           "FROM schedule GROUP BY 1, 2"),
    "player_header": sql(targets_sql() + f"""
, ppl AS (SELECT DISTINCT matchup_id, player_id, selected_date, home, away FROM targets)
, rr AS (SELECT player_id, full_player_name AS r_name, team_abbrev AS r_team, headshot_url,
                row_number() OVER (PARTITION BY player_id ORDER BY team_abbrev, full_player_name) AS rn FROM roster)
, lt AS (SELECT player_id, player_name AS h_name, team AS h_team,
                row_number() OVER (PARTITION BY player_id ORDER BY date DESC, game_id DESC) AS rn FROM facts)
, h AS (SELECT p.*, CASE WHEN r.player_id IS NOT NULL THEN r.r_name ELSE l.h_name END AS player_name,
               CASE WHEN r.player_id IS NOT NULL THEN r.r_team ELSE l.h_team END AS team,
               r.headshot_url, {season_sql('p.selected_date')} AS cur
        FROM ppl p LEFT JOIN rr r ON r.player_id = p.player_id AND r.rn = 1
        LEFT JOIN lt l ON l.player_id = p.player_id AND l.rn = 1)
SELECT matchup_id, player_id, player_name, team, headshot_url,
       CASE WHEN team = home THEN away WHEN team = away THEN home END AS opponent_team,
       CASE WHEN team = home THEN 'vs' WHEN team = away THEN '@' END AS game_location,
       cur AS season_id,
       substring(CAST(cur AS VARCHAR), 3, 2) || '/' || substring(CAST(cur AS VARCHAR), 7, 2) AS season_label,
       substring(CAST(cur - 10001 AS VARCHAR), 3, 2) || '/' || substring(CAST(cur - 10001 AS VARCHAR), 7, 2) AS prev_season_label
FROM h"""),
    "kpi_rates": sql(KPIS + f"""
SELECT player_id, season, opponent_team, stat, threshold, game_filter, {_kpi_text('sg', 'sh', '0% (0g)')} AS season_rates,
       {_kpi_text('og', 'oh', 'n/a')} AS h2h_rates, {_kpi_text('g5', 'h5', '0% (0g)')} AS l5_rates,
       {_kpi_text('g10', 'h10', '0% (0g)')} AS l10_rates
FROM rated GROUP BY player_id, season, opponent_team, stat, threshold, game_filter"""),
    "integrity_checks": sql(COMB + """
SELECT 'skaters_over_35_min' AS "check", CAST(count(*) FILTER (WHERE position <> 'G' AND toi_minutes > 35) AS BIGINT) AS n FROM comb
UNION ALL SELECT 'goalies_over_66_min', CAST(count(*) FILTER (WHERE position = 'G' AND toi_minutes > 66) AS BIGINT) FROM comb
UNION ALL SELECT 'shifts_without_toi', CAST(count(*) FILTER (WHERE shifts > 0 AND toi_minutes = 0) AS BIGINT) FROM comb"""),
    "join_coverage": sql(DBOX + PGS_BODY + """
SELECT CAST(COALESCE(sum(p.goals) FILTER (WHERE b.position <> 'G'), 0) AS BIGINT) AS total_skater_goals,
       CAST(count(*) FILTER (WHERE p.goals IS NULL) AS BIGINT) AS rows_without_stats, CAST(count(*) AS BIGINT) AS "rows"
FROM dbox b LEFT JOIN pgs p ON p.game_id = b.game_id AND p.player_id = b.player_id"""),
    "goal_reconciliation": sql(PGS_BODY + """
, raw AS (SELECT game_id, scoring_player_id AS player_id, count(*) AS raw_goals FROM ev
          WHERE event_type = 'goal' AND scoring_player_id IS NOT NULL GROUP BY 1, 2)
, ag AS (SELECT game_id, player_id, CAST(goals AS BIGINT) AS agg_goals FROM pgs WHERE goals > 0)
SELECT COALESCE(r.game_id, a.game_id) AS game_id, COALESCE(r.player_id, a.player_id) AS player_id,
       CAST(COALESCE(r.raw_goals, 0) AS BIGINT) AS raw_goals, CAST(COALESCE(a.agg_goals, 0) AS BIGINT) AS agg_goals,
       COALESCE(r.raw_goals, 0) = COALESCE(a.agg_goals, 0) AS matches
FROM raw r FULL JOIN ag a ON a.game_id = r.game_id AND a.player_id = r.player_id"""),
})

_BUILD_FACTS = COMB + """
, rn AS (SELECT player_id, min(full_player_name) AS roster_name FROM roster WHERE player_id IS NOT NULL GROUP BY player_id)
, bf AS (
  SELECT c.game_id, c.date, c.player_id, COALESCE(r.roster_name, c.player_name) AS player_name, c.team, c.opponent,
         c.location, c.position, c.days_rest, c.toi, c.toi_minutes, c.shifts, c.goals, c.assists, c.points,
         c.plus_minus, c.pim, c.shots, c.shot_attempts, c.missed_shots, c.offensive_blocked_shots,
         c.blocked_shots, c.hits, c.giveaways, c.takeaways, c.faceoff_wins, c.faceoff_losses, c.faceoff_pct,
         c.ppg, c.ppa, c.ppp, c.game_winning_goal, c.shots_against, c.saves, c.goals_against, c.save_pct,
         c.decision, c.ot_loss
  FROM comb c LEFT JOIN rn r ON r.player_id = c.player_id)
"""
_NUM = ["toi_minutes", "shifts", "goals", "assists", "points", "plus_minus", "pim", "shots", "shot_attempts",
        "missed_shots", "offensive_blocked_shots", "blocked_shots", "hits", "giveaways", "takeaways",
        "faceoff_wins", "faceoff_losses", "ppg", "ppa", "ppp", "shots_against", "saves", "goals_against"]
_STR = ["player_name", "team", "opponent", "location", "position", "decision"]


def _bf_col(c: str) -> str:
    if c in _NUM:
        return f"COALESCE(TRY_CAST(b.{c} AS DOUBLE), 0.0) AS {c}"
    if c in _STR:
        return f"COALESCE(b.{c}, 'Unknown') AS {c}"
    if c == "date":
        return "TRY_CAST(b.date AS DATE) AS date"
    if c == "days_rest":
        return "CAST(COALESCE(b.days_rest, 99) AS INT) AS days_rest"
    return f"b.{c}"


_BF_COLS = ["game_id", "date", "player_id", "player_name", "team", "opponent", "location", "position",
            "days_rest", "toi", "toi_minutes", "shifts", "goals", "assists", "points", "plus_minus", "pim",
            "shots", "shot_attempts", "missed_shots", "offensive_blocked_shots", "blocked_shots", "hits",
            "giveaways", "takeaways", "faceoff_wins", "faceoff_losses", "faceoff_pct", "ppg", "ppa", "ppp",
            "game_winning_goal", "shots_against", "saves", "goals_against", "save_pct", "decision", "ot_loss"]

ORACLE["build_facts"] = sql(_BUILD_FACTS + f"""
, bf2 AS (SELECT {", ".join(_bf_col(c) for c in _BF_COLS)} FROM bf b)
SELECT f.*, CAST(COALESCE(s.season, 0) AS BIGINT) AS season, CAST(COALESCE(s.game_type, 2) AS INT) AS game_type,
       s.home_score, s.away_score, s.home_abbrev, s.away_abbrev,
       CASE WHEN f.location = 'home' AND s.home_score > s.away_score THEN 1
            WHEN f.location = 'away' AND s.away_score > s.home_score THEN 1 ELSE 0 END AS win,
       f.days_rest = 0 AS b2b
FROM bf2 f LEFT JOIN schedule s ON s.game_id = f.game_id
WHERE f.date IS NOT NULL""")
