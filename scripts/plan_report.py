"""Write PLANS.md: physical-plan facts per registered query (after AQE).

usage: python scripts/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from outagekit.plans import catalog  # noqa: E402
from outagekit.session import get_spark  # noqa: E402


def facts(plan: str) -> dict:
    return {
        "hash/range exchanges": len(re.findall(r"(?<!Broadcast)Exchange (hashpartitioning|rangepartitioning)", plan)),
        "single-partition": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "joins": ", ".join(sorted(set(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|"
                                                 r"BroadcastNestedLoopJoin)", plan)))) or "-",
        "windows": plan.count("Window ["),
        "group limit": "yes" if "WindowGroupLimit" in plan else "-",
        "scans": len(re.findall(r"FileScan parquet", plan)),
        "reused": plan.count("ReusedExchange"),
        "python": ("mapInArrow" if re.search("MapInArrow", plan) else
                   "yes" if re.search("EvalPython|InPandas", plan) else "-"),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark()
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    rows = []
    sc = spark.sparkContext
    for name, fn in catalog.QUERIES.items():
        sc.setJobGroup(f"plan {name}", "jobs before the query's own")
        df = fn(spark, sf)
        early = len(sc.statusTracker().getJobIdsForGroup(f"plan {name}"))
        sc.setJobGroup(f"run {name}", "the query")
        qe = df._jdf.queryExecution()
        qe.toRdd().count()  # run this plan itself so AQE settles its final plan
        plan = qe.executedPlan().toString().split("== Initial Plan ==")[0]
        rows.append((name, {"plan-time jobs": early, **facts(plan)}))
    keys = list(rows[0][1])
    out = ["# Physical plans", "",
           f"Generated by `scripts/plan_report.py` on `{sf}` (local, AQE on, final adaptive plans).",
           "Counts are over the whole plan, fixture views included; reused exchanges are not counted.",
           "Python appears only as the walk over islands of two or more rows in overlap resolution.", "",
           "| query | " + " | ".join(keys) + " |", "|---|" + "---|" * len(keys)]
    for name, f in rows:
        out.append(f"| `{name}` | " + " | ".join(str(f[k]) for k in keys) + " |")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out) + "\n")


if __name__ == "__main__":
    main()
