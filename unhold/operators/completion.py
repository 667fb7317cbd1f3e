"""Job events to run outcomes (T-3 to T-9, A6, A8, W4) as DataFrame functions.

The same functions serve the batch twin (checked against SQL) and the
Structured Streaming job in ``unhold.streaming.completion``. Routing keeps the
original order: terminal event, authoritative job status, creator tag, run
tag, run record, job listed in the record, first terminal event per job.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as X
from ..functions.text import fmt, is_valid_run_id, plural_s, thousands
from ..schemas import TERMINAL_STATUSES


def report_totals(report: DataFrame) -> DataFrame:
    """Per-job task totals from the per-version completion report."""
    return report.groupBy("job_id").agg(
        F.count_if(F.col("task_status") == "Succeeded").alias("succeeded"),
        F.count_if(F.col("task_status").isin("PermanentFailure", "TemporaryFailure")).alias("failed"),
        F.count(F.lit(1)).alias("total"))


def parse_job_events(lines: DataFrame, col: str = "value") -> DataFrame:
    """Nested job status events (JSON text) as flat rows: job_id, event_status,
    event_time. A line that is no such event keeps its row with NULLs, which
    routing reports as ``non_terminal_event``."""
    e = F.from_json(F.col(col), X.JOB_EVENT)
    details = e["detail"]["serviceEventDetails"]
    return lines.select(details["jobId"].alias("job_id"), details["status"].alias("event_status"), e["time"].alias("event_time"))


def active_records(active_jobs: DataFrame) -> DataFrame:
    """The run records of completion (run_id, bucket, jobs_expected) from the
    active-jobs table (run_id, bucket, mode, job_id)."""
    return active_jobs.groupBy("run_id", "bucket").agg(F.count_distinct("job_id").alias("jobs_expected"))


def terminal_events(events: DataFrame) -> DataFrame:
    """T-3: events whose status is terminal."""
    return events.where(F.col("job_id").isNotNull() & F.col("event_status").isin(TERMINAL_STATUSES))


def _passes(steps: list[tuple[Column, str]]) -> Column:
    return reduce(and_, [~F.coalesce(cond, F.lit(False)) for cond, _ in steps])


def _by_run(rows: DataFrame, record_jobs: DataFrame) -> DataFrame:
    """Rows of accepted events (run_id, job_id, ...) with what the run's record
    says of their job: the join on (run_id, job_id), once for each listing.

    Only the run is a join key, the job a condition (``between`` itself): with the
    job as a key, rows that lie by run would be dealt out by (run, job) and for the
    next step by run again. A record lists a job per lock mode and accepted rows have
    a record's run id, so few rows meet in a run."""
    listed = record_jobs.withColumnRenamed("job_id", "_listed")
    return rows.join(listed, "run_id").where(F.col("job_id").between(F.col("_listed"), F.col("_listed"))).drop("_listed")


def route_events(events: DataFrame, jobs: DataFrame, records: DataFrame, record_jobs: DataFrame,
                 our_tag: str, accepted_only: bool = False) -> DataFrame:
    """T-4 + T-5: each event with the authoritative job state and a route.

    ``jobs`` (job_id, status, succeeded, failed, total, failure_reason,
    tag_created_by, tag_run_id), ``records`` (run_id, ...) and
    ``record_jobs`` (run_id, job_id) are static tables joined on equi keys.

    ``accepted_only`` gives the accepted rows alone, for callers that drop the
    others: events and jobs that a step turns away are left out before they are
    shuffled, and what is left meets by the run alone (``_by_run``).
    """
    of_event = [(F.col("job_id").isNull() | ~F.coalesce(F.col("event_status").isin(TERMINAL_STATUSES), F.lit(False)), "non_terminal_event")]
    of_job = [(F.col("job_status").isNull(), "job_not_found"),
              (~F.col("job_status").isin(TERMINAL_STATUSES), "job_not_terminal"),
              (F.coalesce(F.col("tag_created_by") != F.lit(our_tag), F.lit(True)), "not_this_solution"),
              (F.col("run_id").isNull() | (F.col("run_id") == ""), "missing_run_id_tag"),
              (~is_valid_run_id("run_id"), "invalid_run_id_tag")]
    of_record = [(F.col("_has_record").isNull(), "no_active_jobs_record"), (F.col("_in_record").isNull(), "job_not_in_record")]
    j = jobs.select("job_id", F.col("status").alias("job_status"), "succeeded", "failed", "total",
                    "failure_reason", "tag_created_by", F.col("tag_run_id").alias("run_id"))
    if accepted_only:
        e = events.where(_passes(of_event)).join(j.where(_passes(of_job)), "job_id")
        e = e.join(records.select("run_id"), "run_id")
        return _by_run(e, record_jobs.select("run_id", "job_id")).withColumn("route", F.lit("accepted"))
    e = events.join(j, "job_id", "left")
    e = e.join(records.select("run_id", F.lit(True).alias("_has_record")), "run_id", "left")
    e = e.join(record_jobs.select("run_id", "job_id", F.lit(True).alias("_in_record")), ["run_id", "job_id"], "left")
    route = F  # the first step that holds
    for cond, name in [*of_event, *of_job, *of_record]:
        route = route.when(cond, name)
    return e.withColumn("route", route.otherwise("accepted")).drop("_has_record", "_in_record")


def status_disagreement(routed: DataFrame) -> DataFrame:
    """T-4 side output: terminal events whose status differs from the job's."""
    return (routed.where(F.col("event_status").isin(TERMINAL_STATUSES) & F.col("job_status").isNotNull()
                         & (F.col("event_status") != F.col("job_status")))
            .select("job_id", "event_time", "event_status", "job_status"))


def first_terminal(routed: DataFrame) -> DataFrame:
    """T-6 batch twin: the first accepted event per (run, job) wins; repeats
    are routed ``duplicate_event``. Of events at one time, the status that comes
    first by name wins. Groups are one job's repeats (small)."""
    w = Window.partitionBy("run_id", "job_id").orderBy("event_time", "event_status")
    acc = routed.where(F.col("route") == "accepted").withColumn("_rn", F.row_number().over(w))
    return acc.withColumn("route", F.when(F.col("_rn") == 1, F.lit("accepted")).otherwise(F.lit("duplicate_event"))) \
        .drop("_rn")


def _completion_outcome(released: Column, failed: Column, incomplete: Column) -> Column:
    total = released + failed
    vers = F.when(total > 0, F.when(
        failed > 0, fmt(X.TEXT_RELEASED_WITH_FAILURES, thousands(released), thousands(total), plural_s(total),
                        thousands(failed)))
        .otherwise(fmt(X.TEXT_RELEASED, thousands(released), plural_s(released))))
    inc = F.when(incomplete > 0, fmt(X.TEXT_JOBS_NOT_COMPLETE, incomplete, plural_s(incomplete)))
    parts = F.concat_ws(", ", vers, inc)
    return F.when(F.length(parts) > 0, parts).otherwise(F.lit(X.TEXT_NOTHING_RELEASED))


def run_outcome(accepted: DataFrame, records: DataFrame) -> DataFrame:
    """A6 + T-7: per run with a record, totals over its first-terminal jobs.
    Only ``Complete`` jobs contribute versions; ``complete`` is true once every
    expected job is terminal, and only then is the outcome text set."""
    g = accepted.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("jobs_terminal"),
        F.sum(F.when(F.col("job_status") == "Complete", F.col("succeeded")).otherwise(0)).cast("bigint").alias("released"),
        F.sum(F.when(F.col("job_status") == "Complete", F.col("failed")).otherwise(0)).cast("bigint").alias("failed"),
        F.count_if(F.col("job_status").isin("Cancelled", "Failed")).alias("jobs_not_complete"))
    r = records.select("run_id", "bucket", "jobs_expected").join(g, "run_id")
    complete = F.col("jobs_terminal") >= F.col("jobs_expected")
    return r.select(
        "run_id", "bucket", "jobs_expected", "jobs_terminal", "released", "failed",
        (F.col("released") + F.col("failed")).alias("total"), "jobs_not_complete",
        complete.alias("complete"),
        F.when(complete, _completion_outcome(F.col("released"), F.col("failed"), F.col("jobs_not_complete")))
         .alias("outcome"))


def completion_recap(accepted: DataFrame, records: DataFrame, record_jobs: DataFrame,
                     decisions: DataFrame | None = None) -> DataFrame:
    """O2 at completion: the recap of every run whose jobs are all terminal.

    ``accepted`` are first-terminal jobs, ``records`` (run_id, bucket, dt,
    jobs_expected), ``record_jobs`` (run_id, job_id, mode). With ``decisions``
    its modes that made no active job follow: suspended, skipped, withheld.
    A group holds one run's jobs and decisions, a few rows."""
    from .decide import mode_line
    done, failed, total = F.col("succeeded"), F.col("failed"), F.col("total")
    line = (F.when((F.col("job_status") == "Complete") & (failed == 0),
                   fmt(X.TEXT_RECAP_RELEASED, "mode", done, total, plural_s(total), "job_id"))
            .when(F.col("job_status") == "Complete",
                  fmt(X.TEXT_RECAP_FAILURES, "mode", done, total, failed, "run_id", "mode", "job_id"))
            .otherwise(fmt(X.TEXT_RECAP_ENDED, "mode", "job_id", "job_status",
                           F.coalesce("failure_reason", F.lit(X.TEXT_RECAP_NO_REASON)))))
    lines = (accepted.select("run_id", "job_id", "job_status", "succeeded", "failed", "total", "failure_reason")
             .transform(_by_run, record_jobs.select("run_id", "job_id", "mode"))
             .select("run_id", F.lit(0).alias("_ord"), "mode", "job_id", line.alias("line")))
    if decisions is not None:
        order = F.when(F.col("outcome") == "suspended", 1).when(F.col("outcome") == "skipped", 2).otherwise(3)
        lines = lines.unionByName(decisions.where(F.col("outcome") != "created").select(
            "run_id", order.alias("_ord"), "mode", F.col("job_id"), mode_line().alias("line")))
    g = lines.groupBy("run_id").agg(
        F.count_if(F.col("_ord") == 0).alias("jobs_terminal"),
        F.array_sort(F.collect_list(F.struct("_ord", "mode", "job_id", "line"))).alias("_lines"))
    text = F.concat_ws(" ", fmt(X.TEXT_RECAP_HEADER, "run_id", "bucket", "dt"), F.transform("_lines", lambda s: s["line"]))
    return (records.select("run_id", "bucket", "dt", "jobs_expected").join(g, "run_id")
            .where((F.col("jobs_terminal") > 0) & (F.col("jobs_terminal") >= F.col("jobs_expected")))
            .select("run_id", "bucket", "dt", "jobs_terminal", text.alias("recap")))


def missing_record_alarm(routed: DataFrame, period: str = "5 minutes") -> DataFrame:
    """T-8: per period, the number of events without a run record; only
    periods with a breach produce a row (an empty period is not breaching)."""
    m = routed.where(F.col("route") == "no_active_jobs_record")
    return (m.groupBy(F.window("event_time", period).alias("w"))
            .agg(F.count(F.lit(1)).alias("missing_record_events"))
            .select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"),
                    "missing_record_events"))


def backlog_samples(jobs_df: DataFrame, events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Failed-run backlog samples: a failed job's first event adds depth 1 at
    its time and a 0 sample a day later (after redrive)."""
    f = (events.join(jobs_df.where(F.col("status") == "Failed").select("job_id"), "job_id", "left_semi")
         .groupBy("bucket", "job_id").agg(F.min("event_time").alias("t")))
    keys = keys or []
    return (f.select("bucket", *keys, F.col("t").alias("sample_time"), F.lit(1).alias("depth"))
            .unionByName(f.select("bucket", *keys, (F.col("t") + F.expr("INTERVAL 1 DAY")).alias("sample_time"),
                                  F.lit(0).alias("depth"))))


def backlog_periods(samples: DataFrame, period: str = "5 minutes") -> DataFrame:
    """Tumbling max depth per period and bucket, for periods with samples."""
    return (samples.groupBy("bucket", F.window("sample_time", period).alias("w")).agg(F.max("depth").alias("max_depth"))
            .select("bucket", F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "max_depth"))


def backlog_alarm(samples: DataFrame, period: str = "5 minutes") -> DataFrame:
    """T-9 + W4: the state changes of each bucket's alarm: ALARM at the first of
    consecutive periods whose max depth is above 0, OK at the period after the
    last of them. A period without samples is not breaching, so an alarm ends
    there as well, with a depth of 0.

    Islands: a breaching period begins one where the bucket's breaching period
    before it does not end at its start, and ends one likewise. The lag and lead
    run per bucket over its breaching periods, not over rows."""
    p = backlog_periods(samples, period)
    w = Window.partitionBy("bucket").orderBy("period_start")
    hot = p.where("max_depth > 0").withColumns({"_before": F.lag("period_end").over(w), "_after": F.lead("period_start").over(w)})
    begins = hot.where(~F.col("_before").eqNullSafe(F.col("period_start"))).select(
        "bucket", "period_start", "max_depth", F.lit("ALARM").alias("state"), F.lit("OK").alias("previous_state"))
    ends = hot.where(~F.col("_after").eqNullSafe(F.col("period_end"))).select(
        "bucket", F.col("period_end").alias("period_start"), F.lit(0).cast(p.schema["max_depth"].dataType).alias("max_depth"),
        F.lit("OK").alias("state"), F.lit("ALARM").alias("previous_state"))
    return begins.unionByName(ends)
