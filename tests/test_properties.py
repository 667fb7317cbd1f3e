"""Randomised checks against small brute-force statements of the rules."""

import random

from pyspark.sql import functions as F

from test_ladder import SCHEMA
from unhold.operators.completion import run_outcome
from unhold.operators.decide import decide


def ladder(r):
    """The decision ladder, one rung per line (test statement of the rules)."""
    run, mode, tc, qid, h, vc, listed, key, exists, err, ro, thr = r[0], r[3], *r[4:]
    if not qid or not h or tc is None or tc < 0:
        return "withheld", "missing_or_invalid_count_metadata"
    if vc is None:
        return "withheld", "count_query_verification_failed"
    if tc != vc:
        return "withheld", "count_mismatch"
    if vc == 0:
        return "skipped", None
    if not ro and vc > thr:
        return "withheld", "safety_threshold_exceeded"
    if not listed:
        return "withheld", "positive_count_without_manifest"
    if not key or not key.startswith(f"manifests/combined/{run}/{mode}/") or ".." in key:
        return "withheld", "invalid_manifest_key"
    if not exists:
        return "withheld", "manifest_not_found"
    if err == "event_hold_unsupported":
        return "withheld", "event_hold_unsupported_by_runtime"
    if err is not None:
        return "withheld", "create_job_failed"
    return ("suspended", None) if ro else ("created", None)


def test_ladder_random(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        run, mode = f"r{i:03x}", rnd.choice(["COMPLIANCE", "GOVERNANCE"])
        tc = rnd.choice([None, -1, 0, 3, 10, 11, 500])
        vc = rnd.choice([tc, tc, tc, None, 4]) if tc is not None else rnd.choice([None, 3])
        key = rnd.choice([f"manifests/combined/{run}/{mode}/m.csv", None, "manifests/combined/x/y/m.csv",
                          f"manifests/combined/{run}/{mode}/../m.csv"])
        rows.append((run, "b", "2024-02-01-00-00", mode, tc, rnd.choice(["q", "", None]), rnd.choice(["h", None, "h"]),
                     vc, rnd.random() < 0.9, key, rnd.random() < 0.9,
                     rnd.choice([None, None, None, "event_hold_unsupported", "boom"]), rnd.random() < 0.3,
                     rnd.choice([10, 1000])))
    got = {r.run_id: (r.outcome, r.reason) for r in decide(spark.createDataFrame(rows, SCHEMA)).collect()}
    for r in rows:
        assert got[r[0]] == ladder(r), r


def test_run_outcome_random(spark):
    rnd = random.Random(11)
    acc, recs, want = [], [], {}
    for i in range(200):
        run = f"r{i}"
        expected = rnd.choice([1, 2])
        recs.append((run, "b", expected))
        jobs = [(run, f"j{i}-{k}", rnd.choice(["Complete", "Failed", "Cancelled"]), rnd.randint(0, 3000), rnd.randint(0, 5))
                for k in range(rnd.choice([1, 2]))]
        acc += jobs
        done = [j for j in jobs if j[2] == "Complete"]
        rel, fail = sum(j[3] for j in done), sum(j[4] for j in done)
        inc = sum(1 for j in jobs if j[2] != "Complete")
        parts = []
        if rel + fail:
            parts.append(f"{rel:,} of {rel + fail:,} version{'s' if rel + fail != 1 else ''} released, {fail:,} failed"
                         if fail else f"{rel:,} version{'s' if rel != 1 else ''} released")
        if inc:
            parts.append(f"{inc} job{'s' if inc != 1 else ''} did not complete")
        want[run] = (len(jobs) >= expected, ", ".join(parts) or "finished, nothing released")
    a = spark.createDataFrame(acc, "run_id string, job_id string, job_status string, succeeded bigint, failed bigint")
    r = spark.createDataFrame(recs, "run_id string, bucket string, jobs_expected bigint")
    for row in run_outcome(a, r).collect():
        complete, text = want[row.run_id]
        assert row.complete == complete
        assert row.outcome == (text if complete else None)
