"""Headline examples documented by the original (dispatch and completion)."""

from pyspark.sql import functions as F

from test_ladder import SCHEMA, row
from unhold.operators.completion import completion_recap, run_outcome
from unhold.operators.decide import decide, run_summary


def headlines(spark, rows):
    return {r.run_id: r.headline for r in run_summary(decide(spark.createDataFrame(rows, SCHEMA))).collect()}


def test_dispatch_headlines(spark):
    rows = [
        row("a1", "COMPLIANCE", tc=1000, vc=1000, ro=True), row("a1", "GOVERNANCE", tc=241, vc=241, ro=True),
        row("a2", "COMPLIANCE", tc=1234, vc=1234, thr=1000), row("a2", "GOVERNANCE", tc=0, vc=0),
        row("a3", "COMPLIANCE", tc=6, vc=6, ro=True), row("a3", "GOVERNANCE", tc=4, vc=4, ro=True, exists=False),
        row("a4", "COMPLIANCE", tc=0, vc=0), row("a4", "GOVERNANCE", tc=0, vc=0),
        row("a5", "COMPLIANCE", tc=5, vc=7), row("a5", "GOVERNANCE", tc=0, vc=0),
    ]
    h = headlines(spark, rows)
    assert h["a1"] == "2 jobs pending, 1,241 versions [Report-Only]"
    assert h["a2"] == "1 job withheld, 1,234 versions"
    assert h["a3"] == "1 job pending, 1 withheld, 10 versions [Report-Only]"
    assert h["a4"] == "nothing eligible"
    assert h["a5"] == "1 job withheld"  # withheld before its count was verified: no number


def test_completion_headlines(spark):
    acc = spark.createDataFrame([
        ("r1", "j1", "Complete", 1234, 0),
        ("r2", "j2", "Complete", 1230, 4),
        ("r3", "j3", "Complete", 1, 0), ("r3", "j4", "Failed", 0, 0),
    ], "run_id string, job_id string, job_status string, succeeded bigint, failed bigint")
    recs = spark.createDataFrame([("r1", "b", 1), ("r2", "b", 1), ("r3", "b", 2)],
                                 "run_id string, bucket string, jobs_expected bigint")
    out = {r.run_id: r.outcome for r in run_outcome(acc, recs).collect()}
    assert out == {"r1": "1,234 versions released",
                   "r2": "1,230 of 1,234 versions released, 4 failed",
                   "r3": "1 version released, 1 job did not complete"}
    partial = run_outcome(acc.where(F.col("job_id") != "j4"), recs).where("run_id = 'r3'").first()
    assert partial.complete is False and partial.outcome is None


def test_completion_recap_with_every_line(spark):
    acc = spark.createDataFrame([
        ("r1", "j1", "Complete", 3, 0, 3, None), ("r2", "j2", "Complete", 1, 2, 3, None),
        ("r3", "j3", "Cancelled", 0, 0, 0, None), ("r4", "j4", "Complete", 1, 0, 1, None),
    ], "run_id string, job_id string, job_status string, succeeded bigint, failed bigint, total bigint, failure_reason string")
    recs = spark.createDataFrame([(f"r{i}", "b", "2024-02-01T00-00Z", 2 if i == 4 else 1) for i in (1, 2, 3, 4)],
                                 "run_id string, bucket string, dt string, jobs_expected bigint")
    jobs = spark.createDataFrame([(f"r{i}", f"j{i}", "COMPLIANCE") for i in (1, 2, 3, 4)], "run_id string, job_id string, mode string")
    dec = decide(spark.createDataFrame([
        row("r1", "COMPLIANCE"), row("r1", "GOVERNANCE", tc=0, vc=0),
        row("r2", "GOVERNANCE", err="AccessDenied"), row("r3", "GOVERNANCE", err="event_hold_unsupported"),
    ], SCHEMA))
    out = {r.run_id: r.recap for r in completion_recap(acc, recs, jobs, dec).collect()}
    head = "Run {} against b (inventory 2024-02-01T00-00Z) -- active mode, all jobs finished. "
    assert out == {
        "r1": head.format("r1") + "COMPLIANCE: released 3 of 3 event holds (job j1). GOVERNANCE: no eligible versions this run.",
        "r2": head.format("r2") + "COMPLIANCE: released 1 of 3 event holds, 2 failed -- see reports/r2/COMPLIANCE/ for details (job j2). "
              "GOVERNANCE: WITHHELD -- job creation failed (AccessDenied).",
        "r3": head.format("r3") + "COMPLIANCE: job j3 ended Cancelled -- see job details. GOVERNANCE: WITHHELD -- the job service does not "
              "accept the event hold parameter, so no job was created; these versions stay eligible."}
