"""Summarise the physical plans of the headline queries (stored tables).

Prints a Markdown table of plan features per query - shuffle exchanges,
broadcast exchanges, windows, WindowGroupLimit, sort-merge joins, sorts - from
the static plan (AQE off, so the numbers do not depend on runtime sizes), and
the exchange keys.  Checkpointed intermediates (eager jobs) are built while
the plans are assembled.

    python scripts/plan_summary.py [--sf DIR] > PLANS.md
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    a = ap.parse_args()
    import bench
    from puckline.session import get_spark

    spark = get_spark()
    st = bench.Store(spark, a.sf)
    queries = bench.headline(st)
    print(f"# Physical plans of the headline queries ({os.path.basename(a.sf)}, AQE off)\n")
    print("Generated by `scripts/plan_summary.py`. Shuffle = `Exchange hashpartitioning` / "
          "`rangepartitioning`; broadcast sides are chosen by the static size estimate "
          "(with AQE on, by measured size).\n")
    print("| query | shuffles | broadcasts | windows | group limits | sort-merge joins | sorts |")
    print("|---|---|---|---|---|---|---|")
    keys = {}
    for name, make in queries.items():
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = make()._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        shuffles = re.findall(r"Exchange (hashpartitioning|rangepartitioning)\(([^)]*)\)", plan)
        keys[name] = sorted({re.sub(r"#\d+L?", "", k).rsplit(",", 1)[0] for _, k in shuffles})
        print(f"| {name} | {len(shuffles)} | {plan.count('BroadcastExchange')} | "
              f"{plan.count('Window [')} | {plan.count('WindowGroupLimit')} | "
              f"{plan.count('SortMergeJoin')} | {plan.count(' Sort [')} |")
    print("\n## Shuffle keys\n")
    for name, ks in keys.items():
        print(f"* **{name}**: " + "; ".join(f"`{k}`" for k in ks))
    spark.stop()


if __name__ == "__main__":
    main()
