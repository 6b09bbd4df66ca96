"""Tabulate the final (adaptive) physical plan of every registered query.

    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

JOINS = ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")


def summarize(plan: str) -> dict:
    scans = re.findall(r"FileScan parquet [^\n]*", plan)
    # Long filter lists are cut with '...' by the plan printer: stop there too.
    end = r"(?:\], \w+:|\.\.\.,|\]$)"
    part = sorted({m for s in scans for m in re.findall(r"PartitionFilters: \[(.*?)" + end, s) if m})
    pushed = sorted({m for s in scans for m in re.findall(r"PushedFilters: \[(.*?)" + end, s) if m})
    joins = []
    for line in plan.splitlines():
        for j in JOINS:
            if j in line:
                kind = re.search(j + r" \[[^\]]*\], \[[^\]]*\], (\w+)", line)
                joins.append(f"{j}({kind.group(1)})" if kind else j)
    return {
        "exchanges": plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")
        + plan.count("Exchange SinglePartition") + plan.count("Exchange RoundRobin"),
        "broadcasts": plan.count("BroadcastExchange"),
        "joins": ", ".join(sorted(set(joins))) or "—",
        "topk": "yes" if "TakeOrderedAndProject" in plan else "",
        "partition_filters": "; ".join(p[:60] for p in part) or "—",
        "pushed": "; ".join(p[:70] for p in pushed) or "—",
        "scans": len(scans),
    }


def read(plan) -> list[tuple[str, int]]:
    """Table and rows of each file scan that has run, after what was skipped."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return read(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return read(plan.plan())
    own = []
    if "FileSourceScan" in kind:
        folder = re.search(r"/(\w+)/commit=", plan.relation().location().rootPaths().mkString(" ") + " ")
        own = [(folder.group(1) if folder else "other", plan.metrics().apply("numOutputRows").value())]
    return own + [x for i in range(plan.children().size()) for x in read(plan.children().apply(i))]


def main() -> None:
    from trade_insights.catalog import QUERIES
    from trade_insights.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    print(f"# Final physical plans of the registered queries ({os.path.basename(sf_dir)}, local[8], AQE on)\n")
    print("Generated by `tools/plan_report.py` after running each query once (adaptive plans are final). "
          "`exchanges` counts shuffles, `broadcasts` counts broadcast exchanges chosen by size; "
          "filters are the ones reaching the Parquet scan. `rows` are those that the scans hand on, after row groups "
          "and pages were skipped, by table of the store.\n")
    print("| query | rows | scans | exchanges | broadcasts | joins | top-k | partition filters | pushed filters |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        if name == "incremental_ingest":
            continue
        df = fn(spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        s = summarize(plan.toString())
        rows = ", ".join(f"{table} {n:,}" for table, n in read(plan)) or "—"
        print(f"| `{name}` | {rows} | {s['scans']} | {s['exchanges']} | {s['broadcasts']} | {s['joins']} | {s['topk']} "
              f"| {s['partition_filters'].replace('|', '/')} | {s['pushed'].replace('|', '/')} |")


if __name__ == "__main__":
    main()
