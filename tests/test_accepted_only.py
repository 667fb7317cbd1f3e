"""Completion asks the routing for accepted events alone: the same rows, and
less that is shuffled."""

import datetime as dt

from conftest import SF
from test_plans import static_shuffles
from unhold import fixtures as fx
from unhold.operators import completion as J
from unhold.plans.catalog import REGISTRY

T = dt.datetime(2024, 1, 1)


def odd_tables(spark):
    jobs = [("j1", "Complete", "unhold", "a1"), ("j1", "Complete", "unhold", "a1"),  # twice the same row
            ("j2", "Failed", "unhold", "a1"), ("j3", "Active", "unhold", "a1"), ("j4", "Complete", "other", "a1"),
            ("j5", "Complete", None, "a1"), ("j6", "Complete", "unhold", None), ("j7", "Complete", "unhold", ""),
            ("j8", "Complete", "unhold", "not-hex"), ("j9", "Complete", "unhold", "b2"), ("j10", "Complete", "unhold", "a1"),
            ("j11", None, "unhold", "a1"), (None, "Complete", "unhold", "a1"), ("j12", "Cancelled", "unhold", "c3")]
    events = [(j, s, T) for j in [f"j{i}" for i in range(14)] + [None] for s in ("Complete", "Cancelled", "Active", None)]
    records = [("a1",), ("a1",), ("c3",), ("not-hex",), (None,), ("",)]  # a record twice
    listed = [("a1", f"j{i}") for i in range(1, 12) if i != 10] + [("a1", "j2"), ("a1", None), (None, "j12"), ("c3", "j12"), ("not-hex", "j8"), ("", "j7")]
    return (spark.createDataFrame([(*e[:2], e[2], "b") for e in events], "job_id string, event_status string, event_time timestamp_ntz, bucket string"),
            spark.createDataFrame([(a, b, 1, 0, 1, None, c, d) for a, b, c, d in jobs],
                                  "job_id string, status string, succeeded bigint, failed bigint, total bigint, failure_reason string, tag_created_by string, tag_run_id string"),
            spark.createDataFrame(records, "run_id string"), spark.createDataFrame(listed, "run_id string, job_id string"))


def test_accepted_only_gives_the_accepted_rows(spark):
    ev, jobs, records, listed = odd_tables(spark)
    every = J.route_events(ev, jobs, records, listed, "unhold")
    some = J.route_events(ev, jobs, records, listed, "unhold", accepted_only=True)
    assert some.columns == every.columns
    want = sorted(map(str, every.where("route = 'accepted'").collect()))
    assert sorted(map(str, some.collect())) == want
    # j1: 2 events, the job twice, the record twice; j2: 2 events, record and listing twice; j12: 2 events
    assert len(want) == 2 * 2 * 2 + 2 * 2 * 2 + 2
    assert sorted(map(str, J.first_terminal(some).select("run_id", "job_id", "event_status", "route").collect())) == \
        sorted(map(str, J.first_terminal(every).select("run_id", "job_id", "event_status", "route").collect()))


def test_recap_lists_a_job_as_often_as_its_record(spark):
    acc = spark.createDataFrame([("a1", "j1", "Complete", 1, 0, 1, None), ("a1", "j2", "Complete", 1, 0, 1, None)],
                                "run_id string, job_id string, job_status string, succeeded bigint, failed bigint, total bigint, failure_reason string")
    recs = spark.createDataFrame([("a1", "b", "d", 1)], "run_id string, bucket string, dt string, jobs_expected bigint")
    listed = spark.createDataFrame([("a1", "j1", "GOVERNANCE"), ("a1", "j1", "GOVERNANCE"), ("a1", "j3", "COMPLIANCE"), ("a1", None, "COMPLIANCE")],
                                   "run_id string, job_id string, mode string")
    row = J.completion_recap(acc, recs, listed).first()
    assert row.jobs_terminal == 2 and row.recap.count("(job j1)") == 2 and "j2" not in row.recap and "j3" not in row.recap


def test_recap_deals_accepted_rows_out_once(spark):
    # events and jobs by the job; then their rows, two readings of the records and two of the listings by the run
    assert static_shuffles(spark, REGISTRY["completion_recap"][0](spark, SF)) == 7
    assert static_shuffles(spark, REGISTRY["run_outcome"][0](spark, SF)) <= 6


def test_job_totals_meet_by_number(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fx.jobs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = plan[plan.index("SortMergeJoin"):]
    assert "job-" not in below and "orderkey" in below  # texts are made of the numbers above the shuffles
