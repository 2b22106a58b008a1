"""Benchmark: build the warehouse from the driver's tables once, then time the
headline queries over it, every load query, and the flagship straight from
the raw tables.  The build counts in the total.

Prints one JSON line, with the JVM's and Python's peak memory.  Env: BENCH_SF_DIR
(default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 5),
BENCH_LOAD_RUNS (default 2).
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from finlake import registry  # noqa: E402
from finlake.session import drop_scratch, get_spark, scratch_dir  # noqa: E402
from finlake.sources.staging import read_star, write_star  # noqa: E402
from finlake.sources.testdata import plant_defects, star_from_testdata  # noqa: E402

HEADLINE = ["rev_monthly_ytd_mom", "rev_mrr_pareto", "prf_clv_plan", "dq_scorecard", "prf_scorecard",
            "rev_kpis", "rev_annual_yoy", "rev_by_industry", "chn_cohort_retention", "chn_at_risk_top50",
            "prf_clv_top20", "dq_revenue_outliers", "prf_monthly_variance", "check_constraints"]
LOADS = [n for n in registry.PLANS if n.startswith("load_") or n == "table_inventory"]


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, runs: int) -> float:
    fn()  # warm-up
    ts = []
    for _ in range(runs):
        t0 = time.perf_counter()
        fn()
        ts.append(time.perf_counter() - t0)
    return statistics.median(ts)


def pareto_plain_window(star):
    """The baseline of ``rev_mrr_pareto``: NTILE over one partition."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    c = star["dim_customers"].where("is_active = 1").select("customer_id", "mrr_inr")
    order = Window.orderBy(F.col("mrr_inr").desc(), "customer_id")
    c = c.withColumn("quintile", F.ntile(5).over(order)).withColumn("total", F.sum("mrr_inr").over(Window.partitionBy()))
    return c.groupBy("quintile").agg(F.count(F.lit(1)), F.sum("mrr_inr"), F.avg(F.col("mrr_inr") / F.col("total")))


def peak_mb(pid) -> float:
    with open(f"/proc/{pid}/status") as f:
        return next(int(x.split()[1]) / 1024 for x in f if x.startswith("VmHWM"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = get_spark()
    scratch = scratch_dir(spark, "bench")
    out: dict[str, float] = {}

    # ETL: raw tables -> star schema (Parquet, facts partitioned by year); the
    # planted-defect copy for the data-quality suite derives from it
    t0 = time.perf_counter()
    write_star(star_from_testdata(spark, sf_dir, checkpoint_lines=True), f"{scratch}/clean")
    out["build_warehouse"] = time.perf_counter() - t0
    clean = read_star(spark, f"{scratch}/clean")
    write_star(plant_defects(clean), f"{scratch}/defects")
    dirty = read_star(spark, f"{scratch}/defects", [*clean, "dim_date_loaded"])
    for name in HEADLINE:
        fn, source = registry.PLANS[name]
        star = dirty if source == "defects" else clean
        out[name] = timed(lambda: run_noop(fn(star)), runs)
    out["rev_mrr_pareto_plain_window"] = timed(lambda: run_noop(pareto_plain_window(clean)), runs)
    loads = int(os.environ.get("BENCH_LOAD_RUNS", "2"))
    for name in LOADS:
        fn, source = registry.PLANS[name]
        out[name] = timed(lambda: run_noop(fn(spark, sf_dir) if source == "raw" else fn(clean)), loads)
    raw = registry.make_query("rev_monthly_ytd_mom")
    out["rev_monthly_ytd_mom_from_raw"] = timed(lambda: run_noop(raw(spark, sf_dir)), runs)
    memory = {"jvm_peak_mb": round(peak_mb(spark.sparkContext._gateway.proc.pid)), "python_peak_mb": round(peak_mb("self"))}
    drop_scratch(spark)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "build_headline_and_loads_total", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in out.items()},
                      **memory,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(os.environ.get("BENCH_CPUS", "8")), "runs": runs,
                      "spark": spark.version,
                      "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))}))


if __name__ == "__main__":
    main()
