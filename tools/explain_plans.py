"""Summarize the physical plans of registered queries over a materialized
warehouse: exchanges by kind, broadcasts, scans with pushed filters.

usage: python tools/explain_plans.py [sf_dir] [name ...]
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from finlake import registry  # noqa: E402
from finlake.schemas import WAREHOUSE  # noqa: E402
from finlake.session import get_spark, scratch_dir  # noqa: E402
from finlake.sources.staging import read_star, write_star  # noqa: E402
from finlake.sources.testdata import plant_defects, star_from_testdata  # noqa: E402


def summarize(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    ex = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)", plan)
    return {"hash": ex.count("hashpartitioning"), "range": ex.count("rangepartitioning"),
            "single": ex.count("SinglePartition"), "broadcast": plan.count("BroadcastExchange"),
            "smj": plan.count("SortMergeJoin"), "bhj": plan.count("BroadcastHashJoin"),
            "scans": plan.count("FileScan parquet"),
            "pushed": sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))}


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or sorted(registry.PLANS)
    spark = get_spark()
    root = scratch_dir(spark, "explain")
    write_star(star_from_testdata(spark, sf), f"{root}/clean")
    clean = read_star(spark, f"{root}/clean")
    write_star(plant_defects(clean), f"{root}/defects")
    dirty = read_star(spark, f"{root}/defects", [*WAREHOUSE, "dim_date_loaded"])
    print("| query | scans | hash | range | single | broadcast | BHJ | SMJ | pushed filters |")
    print("|---|---|---|---|---|---|---|---|---|")
    for n in names:
        fn, source = registry.PLANS[n]
        if source == "raw":
            continue
        s = summarize(fn(dirty if source == "defects" else clean))
        pushed = "; ".join(p[:60] for p in s["pushed"] if "IsNotNull" not in p or "EqualTo" in p or "LessThan" in p)
        print(f"| {n} | {s['scans']} | {s['hash']} | {s['range']} | {s['single']} | {s['broadcast']} | "
              f"{s['bhj']} | {s['smj']} | {pushed} |")


if __name__ == "__main__":
    main()
