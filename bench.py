"""Headline timings: prints ONE JSON line.

Runs the headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1)
with local[$BENCH_CPUS]. Each query is fully executed through the `noop`
sink (whole plan, no collect). `cold` holds each query's first run, `queries`
its best later run (the headline value adds these up); `fixtures` the stored
inputs that are built once, each by itself. `run_snapshot_end_to_end` is the
whole batch job with the previous manifest: classify once, dedup, manifests,
diagnostics, decisions, dedup pointer, sentinel.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from unhold import fixtures as fx  # noqa: E402
from unhold.plans.catalog import REGISTRY, manifest_evidence, stored_previous_manifest  # noqa: E402
from unhold.plans.runs import fixture_config, run_snapshot  # noqa: E402
from unhold.session import build_session  # noqa: E402

# Each headline query runs once cold and then RUNS times warm.
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
JOB_FIXTURES = ["job_events", "jobs", "run_records", "record_jobs", "report_rows"]

HEADLINE = [
    "classify_versions", "eligible_delete", "eligible_overwrite", "eligible_either",
    "eligible_delete_dedup", "withheld_rows", "eligible_counts", "decide", "run_summary",
    "job_event_routing", "run_outcome", "verify_release", "expiry_projection", "withheld_remedy",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="unhold-bench-")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.checkpoint.dir": f"{scratch}/ckpt",
                                 "spark.local.dir": f"{scratch}/local"})
    times, cold, fixtures = {}, {}, {}

    def timed(fn) -> float:
        t = time.perf_counter()
        fn()
        return round(time.perf_counter() - t, 3)

    # the stored tables that queries start from, each written once
    fixtures["inventory"] = timed(lambda: fx.inventory_table(spark, sf_dir))
    inv = fx.inventory_table(spark, sf_dir)
    for mode in ("delete", "either"):
        fixtures[f"previous_manifest_{mode}"] = timed(lambda: stored_previous_manifest(inv, mode, sf_dir))  # noqa: B023
    fixtures["manifest_evidence"] = timed(lambda: manifest_evidence(inv, sf_dir))
    for name in JOB_FIXTURES:
        fixtures[name] = timed(lambda: fx.stored(spark, sf_dir, name, getattr(fx, name)))  # noqa: B023
    for name in HEADLINE:
        one = lambda: run(REGISTRY[name][0](spark, sf_dir))  # noqa: B023, E731
        cold[name] = timed(one)
        times[name] = min(timed(one) for _ in range(RUNS))
    previous = stored_previous_manifest(inv, "delete", sf_dir)
    times["run_snapshot_end_to_end"] = timed(
        lambda: run_snapshot(spark, inv, fixture_config(inv), f"{scratch}/run", previous_manifest=previous))
    rows = inv.count()
    total = round(sum(v for k, v in times.items() if k in HEADLINE), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "cold": cold, "cold_total": round(sum(cold.values()), 3), "fixtures": fixtures,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "inventory_rows": rows, "cpus": int(cpus), "runs_per_query": RUNS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
