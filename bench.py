"""Benchmark of the headline queries.

Setup derives the stored tables once from the driver's parquet files
(schedule, deduplicated boxscores, play-by-play, facts, roster, landed score
feed and the combined player-game table) and writes them to a scratch folder
under the session's checkpoint location; that time is reported as
``setup_sec``.  Each headline query then reads the stored tables - as the
pipeline and the dashboard do - and runs end to end with
``write.format("noop")`` (every row computed, nothing collected).  One warm-up
run, then the median of ``BENCH_RUNS`` (default 3) timed runs per query.
Shuffle bytes and shuffle map stages per query come from Spark's event log,
written to a scratch folder.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from puckline import registry as rg  # noqa: E402
from puckline.operators import boxscore as bx  # noqa: E402
from puckline.operators import dvp as dv  # noqa: E402
from puckline.operators import facts as fc  # noqa: E402
from puckline.operators import maintenance as mt  # noqa: E402
from puckline.operators import pbp as pb  # noqa: E402
from puckline.operators import props as pr  # noqa: E402
from puckline.operators import quality as qa  # noqa: E402
from puckline.operators import schedule as sc  # noqa: E402
from puckline.operators import views as vw  # noqa: E402
from puckline.session import get_spark, shared_dir  # noqa: E402
from puckline.sources import landing as ld  # noqa: E402
from puckline.sources import proxies as px  # noqa: E402

DATE = "1997-08-23"
SEASON = ("1996-09-01", "1997-08-31")
MANY_FROM = "1997-08-20"  # prop requests for every game from this date to DATE


class Store:
    """Stored tables derived once from the base tables."""

    def __init__(self, spark, sf):
        self.spark, self.base = spark, shared_dir(spark, "bench-tables")
        t0 = time.perf_counter()
        self._put("schedule", px.schedule(spark, sf))
        self._put("box", rg._box(spark, sf))
        self._put("pbp", px.pbp(spark, sf))
        self._put("facts", px.facts(spark, sf))
        self._put("roster", px.roster(spark, sf))
        self._put("scores", ld.landed_scores(spark, sf))
        self._put("targets", rg._targets(spark, sf))
        self._put("comprehensive", bx.combine_boxscores(
            self.box, pb.player_game_stats(self.pbp), sc.with_days_rest(self.schedule)))
        self.setup_sec = time.perf_counter() - t0

    def _put(self, name, df):
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")

    def __getattr__(self, name):
        return self.spark.read.parquet(f"{self.base}/{name}")


def headline(st: Store) -> dict:
    spark = st.spark

    def requests(first, last):
        g = st.schedule.filter(F.col("date").between(first, last))
        return pr.requests_for_games(g, pr.default_props())

    def prop_one():
        one = requests(DATE, DATE).orderBy(*pr.REQUEST).limit(1)
        return pr.prop_table(st.facts, st.roster, one, rg.HOCKEY_TODAY)

    def refresh_upsert():
        recent = sc.recent_games(ld.flatten_scores(st.scores), rg.AS_OF, rg.UPSERT_DAYS)
        ids = recent.select("game_id")
        incoming = bx.combine_boxscores(st.box.join(ids, "game_id", "left_semi"),
                                        pb.player_game_stats(st.pbp.join(ids, "game_id", "left_semi")),
                                        sc.with_days_rest(st.schedule))
        return mt.upsert_games(st.comprehensive, incoming)

    return {
        "player_game_stats": lambda: pb.player_game_stats(st.pbp),
        "schedule_days_rest": lambda: sc.with_days_rest(st.schedule),
        "combine_boxscores": lambda: bx.combine_boxscores(
            st.box, pb.player_game_stats(st.pbp), sc.with_days_rest(st.schedule)),
        "build_facts": lambda: fc.build_facts(st.comprehensive, st.schedule, st.roster),
        "dvp_all_stats_seasons": lambda: dv.dvp_metrics(st.facts, rg.ALL_DVP),
        "prop_table_1": prop_one,
        "prop_table_many": lambda: pr.prop_table(st.facts, st.roster,
                                                 requests(MANY_FROM, DATE), rg.HOCKEY_TODAY),
        "prop_table_season": lambda: pr.prop_table(st.facts, st.roster, requests(*SEASON), rg.HOCKEY_TODAY),
        "matchup_overview": lambda: pr.matchup_overview(
            st.facts, st.roster, requests(DATE, DATE), rg.HOCKEY_TODAY),
        "player_log_filtered": lambda: vw.view_logs(st.facts),
        "kpi_rates": lambda: vw.view_kpis(st.facts, st.targets),
        "refresh_upsert": refresh_upsert,
        "goal_reconciliation": lambda: qa.goal_reconciliation(st.pbp, pb.player_game_stats(st.pbp)),
    }


def run_once(spark, make, group: str) -> float:
    spark.sparkContext.setJobGroup(group, group)
    t0 = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def shuffle_stats(log_dir: str) -> dict:
    """Per job group: shuffle bytes written and shuffle map stages, read from
    the Spark event log (stage and task metrics; no UI or REST endpoint)."""
    stage_group, stage_bytes = {}, {}
    files = [os.path.join(d, n) for d, _, ns in os.walk(log_dir) for n in ns
             if not n.startswith(".") and not n.startswith("appstatus")]
    for path in sorted(files):
        with open(path) as f:
            for line in f:
                e = json.loads(line)
                kind = e.get("Event")
                if kind == "SparkListenerJobStart":
                    g = (e.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in e.get("Stage IDs", []):
                        stage_group[sid] = g
                elif kind == "SparkListenerTaskEnd":
                    w = (e.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    sid = e.get("Stage ID")
                    stage_bytes[sid] = stage_bytes.get(sid, 0) + w.get("Shuffle Bytes Written", 0)
    out: dict = {}
    for sid, b in stage_bytes.items():
        g = stage_group.get(sid)
        if g and b > 0:
            d = out.setdefault(g, {"bytes": 0, "stages": 0})
            d["bytes"] += b
            d["stages"] += 1
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    partitions = max(cpus, 8)
    log_dir = tempfile.mkdtemp(prefix="bench-eventlog-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=partitions,
                      extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                             "spark.eventLog.compress": "false"})
    st = Store(spark, sf)
    queries = headline(st)
    names = sys.argv[1:] or list(queries)
    result = {}
    for name in names:
        run_once(spark, queries[name], f"warm:{name}")
        times = [run_once(spark, queries[name], f"run{i}:{name}") for i in range(runs)]
        result[name] = round(statistics.median(times), 3)
    spark.stop()
    stats = shuffle_stats(log_dir)
    shuffle_bytes, exchanges = {}, {}
    for name in names:
        per_run = [stats.get(f"run{i}:{name}", {"bytes": 0, "stages": 0}) for i in range(runs)]
        shuffle_bytes[name] = int(statistics.median(r["bytes"] for r in per_run))
        exchanges[name] = int(statistics.median(r["stages"] for r in per_run))
    sf_name = os.path.basename(sf)
    print(json.dumps({"metric": "headline_queries_total_median", "value": round(sum(result.values()), 3),
                      "unit": "sec", "queries": result, "setup_sec": round(st.setup_sec, 3),
                      "sf": float(sf_name[2:]) if sf_name.startswith("sf") else sf_name,
                      "cpus": cpus, "shuffle_partitions": partitions, "runs": runs,
                      "shuffle_bytes": shuffle_bytes, "shuffle_map_stages": exchanges}))


if __name__ == "__main__":
    main()
