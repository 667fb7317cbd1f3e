"""Per (run, lock mode) decisions and run summaries.

The ladder is one ordered ``when`` chain over a DataFrame of (run x 2 modes),
so a table of many runs and buckets is decided in one pass. Steps that call an
external service (the count re-query, job creation) become input columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as X
from ..functions.text import fmt, identity_token, plural_s, thousands

# Inputs per (run_id, mode):
#   bucket, dt, trigger_count, count_query_id, count_hash, verified_count
#   (NULL = re-count unavailable), manifest_listed, manifest_key,
#   manifest_exists, submit_error ('event_hold_unsupported' or other text),
#   report_only, safety_threshold.
DECISION_INPUT_COLS = [
    "run_id", "bucket", "dt", "mode", "trigger_count", "count_query_id", "count_hash",
    "verified_count", "manifest_listed", "manifest_key", "manifest_exists", "submit_error",
    "report_only", "safety_threshold",
]


def validate_config(config: DataFrame) -> None:
    """An active (not report-only) configuration with threshold 0 would
    withhold every positive count forever; reject it before deciding."""
    bad = config.where(~F.coalesce(F.col("report_only"), F.lit(False))
                       & (F.coalesce(F.col("safety_threshold"), F.lit(-1)) <= 0)).limit(5).collect()
    if bad:
        raise ValueError(f"active configuration needs safety_threshold > 0: {[r.asDict() for r in bad]}")


def count_reconciliation(expected: DataFrame, manifests: DataFrame) -> DataFrame:
    """Expected counts (run_id, mode, trigger_count) against a re-count of
    the manifest rows (run_id, mode, ...), full outer, so a mode present on
    only one side shows up with a NULL on the other."""
    recount = manifests.groupBy("run_id", "mode").agg(F.count(F.lit(1)).alias("verified_count"))
    return (expected.join(recount, ["run_id", "mode"], "full_outer")
            .withColumn("count_matches", F.coalesce(F.col("trigger_count") == F.col("verified_count"), F.lit(False))))


def _outcome_reason() -> tuple[Column, Column]:
    tc, vc = F.col("trigger_count"), F.col("verified_count")
    key = F.col("manifest_key")
    prefix = F.concat(F.lit("manifests/combined/"), F.col("run_id"), F.lit("/"), F.col("mode"), F.lit("/"))
    active = ~F.coalesce(F.col("report_only"), F.lit(False))
    steps = [
        # fail closed: without a configuration, or active without a threshold, nothing is released
        (F.col("report_only").isNull() | (active & F.col("safety_threshold").isNull()), "withheld", "missing_configuration"),
        (F.col("count_query_id").isNull() | (F.col("count_query_id") == "")
         | F.col("count_hash").isNull() | (F.col("count_hash") == "") | tc.isNull() | (tc < 0),
         "withheld", "missing_or_invalid_count_metadata"),
        (vc.isNull(), "withheld", "count_query_verification_failed"),
        (tc != vc, "withheld", "count_mismatch"),
        (vc == 0, "skipped", None),
        (active & (vc > F.col("safety_threshold")), "withheld", "safety_threshold_exceeded"),
        (~F.coalesce(F.col("manifest_listed"), F.lit(False)), "withheld", "positive_count_without_manifest"),
        (key.isNull() | ~key.startswith(prefix) | key.contains(".."), "withheld", "invalid_manifest_key"),
        (~F.coalesce(F.col("manifest_exists"), F.lit(False)), "withheld", "manifest_not_found"),
        (F.col("submit_error") == "event_hold_unsupported", "withheld", "event_hold_unsupported_by_runtime"),
        (F.col("submit_error").isNotNull(), "withheld", "create_job_failed"),
        (~active, "suspended", None),
    ]
    outcome, reason = None, None
    for cond, o, r in steps:
        outcome = F.when(cond, F.lit(o)) if outcome is None else outcome.when(cond, F.lit(o))
        reason = F.when(cond, F.lit(r)) if reason is None else reason.when(cond, F.lit(r))
    return outcome.otherwise(F.lit("created")), reason.otherwise(F.lit(None).cast("string"))


def decide(inputs: DataFrame) -> DataFrame:
    """One decision row per (run_id, mode), in ladder order. The verified
    count is recorded from rung 4 on (not for modes withheld by rungs 1-3);
    ``decision_token`` is the idempotency key of the decision."""
    outcome, reason = _outcome_reason()
    d = inputs.select(*DECISION_INPUT_COLS, outcome.alias("outcome"), reason.alias("reason"))
    recorded = ~F.col("reason").isin("missing_configuration", "missing_or_invalid_count_metadata",
                                     "count_query_verification_failed", "count_mismatch")
    token = identity_token("bucket", "run_id", "dt", "mode")
    return d.select(
        "run_id", "bucket", "dt", "mode", "outcome", "reason",
        F.when(F.col("reason").isNull() | recorded, F.col("verified_count")).alias("verified_count"),
        F.col("verified_count").alias("query_count"),
        "trigger_count", "safety_threshold", "report_only", "manifest_key", "submit_error",
        token.alias("decision_token"),
        F.when(F.col("outcome").isin("created", "suspended"),
               F.concat(F.lit("job-"), F.substring(token, 1, 12))).alias("job_id"),
    )


def mode_line() -> Column:
    """O2: the sentence of one (run, mode) decision."""
    m, n = F.col("mode"), F.coalesce(F.col("verified_count"), F.lit(0))
    reason = F.col("reason")
    none = F.lit("None")
    return (
        F.when(F.col("outcome") == "created", fmt(X.TEXT_MODE_CREATED, m, n, plural_s(n), "job_id"))
        .when(F.col("outcome") == "suspended", fmt(X.TEXT_MODE_SUSPENDED, m, n, plural_s(n), "job_id"))
        .when(F.col("outcome") == "skipped", fmt(X.TEXT_MODE_SKIPPED, m))
        .when(reason == "safety_threshold_exceeded",
              fmt(X.TEXT_MODE_OVER_THRESHOLD, m, "verified_count", "safety_threshold"))
        .when(reason == "count_mismatch",
              fmt(X.TEXT_MODE_COUNT_MISMATCH, m, F.coalesce(F.col("query_count").cast("string"), none),
                  F.coalesce(F.col("trigger_count").cast("string"), none)))
        .when(reason == "event_hold_unsupported_by_runtime", fmt(X.TEXT_MODE_UNSUPPORTED, m))
        .when(reason == "create_job_failed", fmt(X.TEXT_MODE_CREATE_FAILED, m, "submit_error"))
        .otherwise(fmt(X.TEXT_MODE_WITHHELD, m, F.coalesce(reason, F.lit("unknown"))))
    )


def run_summary(decisions: DataFrame) -> DataFrame:
    """D3 + A7 + O2: one row per run. Groups hold at most the two lock modes
    of a run, so the per-run arrays are bounded."""
    order = (F.when(F.col("outcome") == "created", 0).when(F.col("outcome") == "suspended", 1)
             .when(F.col("outcome") == "skipped", 2).otherwise(3))
    d = decisions.withColumn("_ord", order).withColumn("_line", mode_line())
    counted = F.col("outcome").isin("suspended", "withheld")
    g = d.groupBy("run_id", "bucket", "dt").agg(
        F.max(F.col("report_only").cast("int")).cast("boolean").alias("report_only"),
        F.count_if(F.col("outcome") == "created").alias("jobs_created"),
        F.count_if(F.col("outcome") == "suspended").alias("jobs_pending"),
        F.count_if(F.col("outcome") == "withheld").alias("jobs_withheld"),
        F.sum(F.when(counted, F.coalesce(F.col("verified_count"), F.lit(0))).otherwise(0)).cast("bigint").alias("versions"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("outcome") == "skipped", F.col("mode")))), ",").alias("modes_skipped"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("outcome") == "withheld",
                                                        F.concat(F.col("mode"), F.lit("="), F.col("reason"))))), ",").alias("modes_withheld"),
        F.array_sort(F.collect_list(F.struct("_ord", "mode", "_line"))).alias("_lines"),
    )
    pend, wh, v = F.col("jobs_pending"), F.col("jobs_withheld"), F.col("versions")
    first = (F.when(pend > 0, fmt(X.TEXT_JOBS_PENDING, pend, plural_s(pend)))
             .when(wh > 0, fmt(X.TEXT_JOBS_WITHHELD_FIRST, wh, plural_s(wh))))
    second = F.when((pend > 0) & (wh > 0), fmt(X.TEXT_JOBS_WITHHELD_MORE, wh))
    vers = F.when(v > 0, fmt(X.TEXT_VERSIONS, thousands(v), plural_s(v)))
    outcome = (F.when((pend > 0) | (wh > 0), F.concat_ws(", ", first, second, vers))
               .when(F.length("modes_skipped") > 0, F.lit(X.TEXT_NOTHING_ELIGIBLE))
               .otherwise(F.lit(X.TEXT_NO_MODES_EVALUATED)))
    header = fmt(X.TEXT_RUN_HEADER, "run_id", "bucket", "dt",
                 F.when(F.col("report_only"), F.lit("report-only")).otherwise(F.lit("active")))
    lines = F.transform("_lines", lambda s: s["_line"])
    text = F.when(F.size(lines) > 0, F.concat_ws(" ", header, F.array_join(lines, " "))) \
        .otherwise(F.concat_ws(" ", header, F.lit(X.TEXT_NO_MODES)))
    return g.select(
        "run_id", "bucket", "dt", "report_only", "jobs_created", "jobs_pending", "jobs_withheld", "versions",
        "modes_skipped", "modes_withheld",
        F.concat(outcome, F.when(F.col("report_only"), F.lit(X.TEXT_REPORT_ONLY_TAG)).otherwise(F.lit(""))).alias("headline"),
        text.alias("summary"),
    )


def active_jobs(decisions: DataFrame) -> DataFrame:
    """The jobs that completion waits for: one row per ``created`` decision.
    A suspended job waits for a review and is not one of them."""
    return decisions.where(F.col("outcome") == "created").select("run_id", "bucket", "mode", "job_id")


def latest_decision(history: DataFrame) -> DataFrame:
    """The latest decision row per (run, mode) by decision time."""
    w = Window.partitionBy("run_id", "mode").orderBy(F.col("decided_at").desc(), F.col("decision_id").desc())
    return history.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
