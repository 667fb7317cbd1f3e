"""The decision ladder, one input row per rung (FIXTURES 6)."""

import pytest
from pyspark.sql import functions as F

from unhold.operators.decide import DECISION_INPUT_COLS, decide, run_summary, validate_config

GOOD = "manifests/combined/r1/{m}/manifest.csv"


def row(run, mode, tc=5, qid="q", h="h", vc=5, listed=True, key=None, exists=True, err=None, ro=False, thr=10):
    return (run, "bkt", "2024-02-01-00-00", mode, tc, qid, h, vc, listed,
            key if key is not None else f"manifests/combined/{run}/{mode}/manifest.csv", exists, err, ro, thr)


CASES = [
    ("missing_meta", row("r01", "COMPLIANCE", qid=None), "withheld", "missing_or_invalid_count_metadata"),
    ("negative", row("r02", "COMPLIANCE", tc=-1), "withheld", "missing_or_invalid_count_metadata"),
    ("unverifiable", row("r03", "COMPLIANCE", vc=None), "withheld", "count_query_verification_failed"),
    ("mismatch", row("r04", "COMPLIANCE", tc=5, vc=6), "withheld", "count_mismatch"),
    ("zero", row("r05", "COMPLIANCE", tc=0, vc=0), "skipped", None),
    ("over_threshold", row("r06", "COMPLIANCE", tc=11, vc=11), "withheld", "safety_threshold_exceeded"),
    ("equal_threshold", row("r07", "COMPLIANCE", tc=10, vc=10), "created", None),
    ("report_only_over", row("r08", "COMPLIANCE", tc=11, vc=11, ro=True), "suspended", None),
    ("no_manifest", row("r09", "COMPLIANCE", listed=False), "withheld", "positive_count_without_manifest"),
    ("bad_key_prefix", row("r10", "COMPLIANCE", key="manifests/combined/other/COMPLIANCE/m.csv"), "withheld", "invalid_manifest_key"),
    ("dotdot", row("r11", "COMPLIANCE", key="manifests/combined/r11/COMPLIANCE/../x"), "withheld", "invalid_manifest_key"),
    ("not_found", row("r12", "COMPLIANCE", exists=False), "withheld", "manifest_not_found"),
    ("unsupported", row("r13", "COMPLIANCE", err="event_hold_unsupported"), "withheld", "event_hold_unsupported_by_runtime"),
    ("create_failed", row("r14", "COMPLIANCE", err="AccessDenied"), "withheld", "create_job_failed"),
    ("report_only", row("r15", "COMPLIANCE", ro=True), "suspended", None),
    ("created", row("r16", "COMPLIANCE"), "created", None),
]

SCHEMA = ("run_id string, bucket string, dt string, mode string, trigger_count bigint, count_query_id string, "
          "count_hash string, verified_count bigint, manifest_listed boolean, manifest_key string, "
          "manifest_exists boolean, submit_error string, report_only boolean, safety_threshold bigint")


def test_every_rung(spark):
    df = spark.createDataFrame([c[1] for c in CASES], SCHEMA)
    got = {r.run_id: (r.outcome, r.reason) for r in decide(df).collect()}
    for name, r, outcome, reason in CASES:
        assert got[r[0]] == (outcome, reason), name


def test_verified_count_recorded_from_rung_four(spark):
    df = spark.createDataFrame([CASES[3][1], CASES[5][1]], SCHEMA)
    got = {r.reason: r.verified_count for r in decide(df).collect()}
    assert got["count_mismatch"] is None
    assert got["safety_threshold_exceeded"] == 11


def test_config_guard(spark):
    bad = spark.createDataFrame([("b", False, 0)], "bucket string, report_only boolean, safety_threshold bigint")
    with pytest.raises(ValueError):
        validate_config(bad)
    ok = spark.createDataFrame([("b", True, 0), ("c", False, 5)], "bucket string, report_only boolean, safety_threshold bigint")
    validate_config(ok)


def test_summary_text(spark):
    rows = [row("r1", "COMPLIANCE", ro=True, tc=1500, vc=1500), row("r1", "GOVERNANCE", tc=0, vc=0, ro=True),
            row("r2", "COMPLIANCE", tc=20, vc=20), row("r2", "GOVERNANCE", tc=3, vc=4)]
    s = {r.run_id: r for r in run_summary(decide(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert s["r1"].headline == "1 job pending, 1,500 versions [Report-Only]"
    assert "COMPLIANCE: found 1500 eligible versions" in s["r1"].summary
    assert "GOVERNANCE: no eligible versions this run." in s["r1"].summary
    assert s["r2"].headline == "2 jobs withheld, 20 versions"
    assert s["r2"].modes_withheld == "COMPLIANCE=safety_threshold_exceeded,GOVERNANCE=count_mismatch"
    assert "eligibility count mismatch (query 4 vs manifest 3)" in s["r2"].summary
