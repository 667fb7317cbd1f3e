"""Registered queries: name -> (spark builder, DuckDB oracle SQL or None).

Every builder takes (spark, sf_dir), reads the driver's tables there (or
DataFrames Spark derives from them) and returns a DataFrame. Column names are
aliased identically on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import classify as C
from ..operators import eligibility as E
from ..session import scratch_table
from . import oracle as O

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _inv(spark, sf_dir):
    """The inventory every query starts from: a stored, partitioned table
    (written once from ``events``), scanned with pruning and pushdown."""
    return fx.inventory_table(spark, sf_dir)


def previous_manifest(inv: DataFrame, release_mode: str) -> DataFrame:
    """The fixture's dedup table: the same release mode's manifest of the
    previous snapshot (bucket, url-encoded key, version_id, mode)."""
    prev = E.eligible(fx.snapshot(inv, fx.PREV_DT), release_mode)
    return E.manifest_rows(prev).select("bucket", "key", "version_id", "mode")


def _code_hash() -> str:
    """Hash of the code that derives the previous manifest (a stored copy
    made by older code is never reused)."""
    import hashlib
    h = hashlib.sha256()
    for mod in (C, E):
        with open(mod.__file__, "rb") as fh:
            h.update(fh.read())
    with open(__file__, "rb") as fh:
        h.update(fh.read())
    return h.hexdigest()[:12]


def stored_previous_manifest(inv: DataFrame, release_mode: str, sf_dir: str) -> DataFrame:
    """The dedup pointer as it exists in a deployment: a small headerless CSV
    table (written once per input through the pointer layout, then read back
    with the positional reader, S4)."""
    from ..sources.records import read_previous_manifest
    spark = inv.sparkSession
    path = fx.fixture_path(spark, sf_dir, f"previous_manifest|{release_mode}|{fx.SNAPSHOTS}|{_code_hash()}")
    if not fx._committed(spark, path):
        (previous_manifest(inv, release_mode).withColumn("target", F.col("bucket"))
         .select("bucket", "key", "version_id", "target", "mode")
         .write.mode("overwrite").option("header", False).option("compression", "none")
         .partitionBy("target", "mode").csv(path))
    return read_previous_manifest(spark, path)


def eligible_dedup(inv: DataFrame, release_mode: str, sf_dir: str, how: str = "left_anti") -> DataFrame:
    cur = E.eligible(fx.snapshot(inv, fx.CUR_DT), release_mode)
    return E.dedup(cur, stored_previous_manifest(inv, release_mode, sf_dir), how)


CAND_COLS = ["bucket", "dt", "key", "version_id", "object_lock_mode", "last_modified_date"]
CLS_COLS = ["bucket", "dt", "key", "version_id", "object_lock_mode", "last_modified_date",
            "superseder_kinds", "superseder_is_delete_marker", "has_tied_noncurrent_peer",
            "superseder_class", "next_lmd"]
INV_COLS = ["bucket", "dt", "key", "version_id", "is_latest", "is_delete_marker",
            "last_modified_date", "object_lock_mode", "object_lock_event_hold_status"]


# --- scans, predicates, classification -------------------------------------

@register("scan_inventory", O.with_ctes(O.INV, body=f"SELECT {', '.join(INV_COLS)} FROM inv WHERE dt = '{fx.CUR_DT}'"))
def q_scan_inventory(spark, d):
    return fx.snapshot(_inv(spark, d), fx.CUR_DT).select(*INV_COLS)


@register("candidates", O.with_ctes(O.INV, O.CLS, body=f"SELECT {', '.join(CAND_COLS)} FROM cand"))
def q_candidates(spark, d):
    return C.candidates(_inv(spark, d)).select(*CAND_COLS)


@register("prefix_scope", O.with_ctes(O.INV, O.CLS, body=(
    f"SELECT {', '.join(CAND_COLS)} FROM cand WHERE starts_with(key, 'team1/')")))
def q_prefix_scope(spark, d):
    return C.candidates(_inv(spark, d)).where(F.col("key").startswith("team1/")).select(*CAND_COLS)


@register("timestamp_order", O.with_ctes(O.INV, O.CLS, body=(
    "SELECT bucket, dt, key, t AS last_modified_date, t_next AS next_lmd FROM succ")))
def q_timestamp_order(spark, d):
    return C.timestamp_order(_inv(spark, d)).select("bucket", "dt", "key", "last_modified_date", "next_lmd")


@register("timestamp_groups", O.with_ctes(O.INV, O.CLS, body=(
    "SELECT s.bucket, s.dt, s.key, s.t AS last_modified_date, CASE WHEN n.t IS NULL THEN 0 ELSE 1 END AS has_nc "
    "FROM stamps s LEFT JOIN nc_stamps n ON n.bucket = s.bucket AND n.dt = s.dt AND n.key = s.key AND n.t = s.t")))
def q_timestamp_groups(spark, d):
    return C.timestamp_groups(_inv(spark, d)).select("bucket", "dt", "key", "last_modified_date", "has_nc")


@register("possible_superseders", O.with_ctes(O.INV, O.CLS, body=(
    "SELECT bucket, dt, key, version_id, count(*) FILTER (WHERE sdm) AS delete_marker_superseders, "
    "count(*) FILTER (WHERE NOT sdm) AS data_version_superseders, "
    "count(*) FILTER (WHERE peer_nc) AS tied_noncurrent_peers FROM poss GROUP BY bucket, dt, key, version_id")))
def q_possible_superseders(spark, d):
    return C.superseder_counts(_inv(spark, d))


@register("classify_versions", O.with_ctes(O.INV, O.CLS, body=f"SELECT {', '.join(CLS_COLS)} FROM classified"))
def q_classify_versions(spark, d):
    return C.classify_versions(_inv(spark, d)).select(*CLS_COLS)


# --- eligibility ------------------------------------------------------------

ELIG = ", ".join(E.ELIGIBLE_COLS)

for _m in ("delete", "overwrite"):
    register(f"eligible_{_m}", O.with_ctes(O.INV, O.CLS, body=O._elig(_m)))(
        (lambda m: lambda spark, d: E.eligible(_inv(spark, d), m))(_m))
    register(f"eligible_{_m}_dedup", O.with_ctes(O.INV, O.CLS, O.eligible_dedup_ctes(_m), body=f"SELECT {ELIG} FROM deduped"))(
        (lambda m: lambda spark, d: eligible_dedup(_inv(spark, d), m, d))(_m))

register("eligible_either", O.with_ctes(O.INV, O.CLS, O.eligible_dedup_ctes("either"), body=f"SELECT {ELIG} FROM deduped"))(
    lambda spark, d: eligible_dedup(_inv(spark, d), "either", d))


def _suppressed_sql():
    parts = []
    for m in ("delete", "overwrite", "either"):
        parts.append(O.with_ctes(O.INV, O.CLS, O.eligible_dedup_ctes(m),
                                 body=f"SELECT '{m}' AS release_mode, {ELIG} FROM suppressed"))
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


@register("dedup_suppressed", _suppressed_sql())
def q_dedup_suppressed(spark, d):
    inv = _inv(spark, d)
    out = None
    for m in ("delete", "overwrite", "either"):
        part = eligible_dedup(inv, m, d, "left_semi").select(F.lit(m).alias("release_mode"), *E.ELIGIBLE_COLS)
        out = part if out is None else out.unionByName(part)
    return out


WH = "bucket, dt, key, object_lock_mode, version_id, last_modified_date"


@register("withheld_rows", O.with_ctes(O.INV, O.CLS, body=(
    f"SELECT {WH}, CASE WHEN has_tied_noncurrent_peer = 1 THEN 'tied_noncurrent_peer' "
    "ELSE 'ambiguous_successor_classification' END AS reason FROM classified WHERE superseder_kinds > 1")))
def q_withheld_rows(spark, d):
    return E.withheld(_inv(spark, d))


@register("unclassified_rows", O.with_ctes(O.INV, O.CLS, body=(
    f"SELECT {WH} FROM classified WHERE superseder_class = 'unclassified'")))
def q_unclassified_rows(spark, d):
    return E.unclassified(_inv(spark, d))


@register("withheld_count", O.with_ctes(O.INV, O.CLS, body=(
    "SELECT u.bucket, u.dt, coalesce(w.n, 0) AS withheld_count "
    "FROM (SELECT DISTINCT bucket, dt FROM inv) u LEFT JOIN "
    "(SELECT bucket, dt, count(*) AS n FROM classified WHERE superseder_kinds > 1 GROUP BY bucket, dt) w "
    "ON w.bucket = u.bucket AND w.dt = u.dt")))
def q_withheld_count(spark, d):
    return E.withheld_count(_inv(spark, d))


@register("eligible_counts", O.with_ctes(O.INV, O.CLS, f"elig AS ({O._elig('delete')})", body=(
    "SELECT u.bucket, u.dt, m.object_lock_mode, coalesce(c.n, 0) AS eligible_count "
    "FROM (SELECT DISTINCT bucket, dt FROM inv) u "
    "CROSS JOIN (VALUES ('COMPLIANCE'), ('GOVERNANCE')) m(object_lock_mode) "
    "LEFT JOIN (SELECT bucket, dt, object_lock_mode, count(*) AS n FROM elig GROUP BY ALL) c "
    "ON c.bucket = u.bucket AND c.dt = u.dt AND c.object_lock_mode = m.object_lock_mode")))
def q_eligible_counts(spark, d):
    inv = _inv(spark, d)
    return E.eligible_counts(inv, E.eligible(inv, "delete"))


@register("manifest_rows", O.with_ctes(O.INV, O.CLS, O.eligible_dedup_ctes("delete"), body=(
    f"SELECT bucket, {O.enc('key')} AS key, version_id, dt, object_lock_mode AS mode FROM deduped")))
def q_manifest_rows(spark, d):
    return E.manifest_rows(eligible_dedup(_inv(spark, d), "delete", d))


@register("partition_invariant", O.with_ctes(O.INV, O.CLS, body=O.violations_sql("classified")))
def q_partition_invariant(spark, d):
    return E.partition_check(_inv(spark, d))


@register("partition_violations", O.with_ctes(O.INV, O.CLS, """
h AS (SELECT *, substr(md5(version_id), 1, 1) AS c FROM classified),
damaged AS (SELECT * FROM h WHERE c <> '0' AND c <> '2'
            UNION ALL SELECT * FROM h WHERE c = '1'
            UNION ALL SELECT * REPLACE ('elsewhere' AS bucket) FROM h WHERE c = '2')""", body=O.violations_sql("damaged")))
def q_partition_violations(spark, d):
    """U3 over a damaged classification: some rows are gone, some come twice,
    some are of no candidate."""
    inv = _inv(spark, d)
    cls = C.classify_versions(inv)
    c = F.substring(F.md5("version_id"), 1, 1)
    bucket = F.when(c == "2", "elsewhere").otherwise(F.col("bucket"))
    times = F.when(c == "0", 0).when(c == "1", 2).otherwise(1)
    damaged = cls.withColumn("_t", F.explode(F.array_repeat(F.lit(1), times))).drop("_t").withColumn("bucket", bucket)
    return E.partition_check(inv, damaged)


# --- an inventory with gaps: current versions not listed, unknown flags ------

def gaps(inv: DataFrame) -> DataFrame:
    """The inventory as a faulty listing gives it: a quarter of the keys has no
    current version, some rows have an unknown current or marker flag."""
    v, k = F.substring(F.md5("version_id"), 1, 1), F.substring(F.md5("key"), 1, 1)
    return (inv.where(~(F.col("is_latest") & (k < "4")))
            .withColumn("is_latest", F.when(v != "1", F.col("is_latest")))
            .withColumn("is_delete_marker", F.when(v != "0", F.col("is_delete_marker"))))


@register("classify_gaps", O.with_ctes(O.INV, O.GAPS, O.cls_on("gaps", "g"), body=f"SELECT {', '.join(CLS_COLS)} FROM classified_g"))
def q_classify_gaps(spark, d):
    return C.classify_versions(gaps(_inv(spark, d))).select(*CLS_COLS)


@register("unclassified_gaps", O.with_ctes(O.INV, O.GAPS, O.cls_on("gaps", "g"), body=(
    f"SELECT {WH} FROM classified_g WHERE superseder_class = 'unclassified'")))
def q_unclassified_gaps(spark, d):
    return E.unclassified(gaps(_inv(spark, d)))


# --- decisions (D1 to D3, A7, J6) --------------------------------------------

from ..operators import decide as D  # noqa: E402
from ..schemas import TEXT_MODE_CREATE_FAILED, TEXT_MODE_UNSUPPORTED  # noqa: E402
from . import runs as R  # noqa: E402

DEC_COLS = ["run_id", "bucket", "dt", "mode", "outcome", "reason", "verified_count", "query_count",
            "trigger_count", "safety_threshold", "report_only", "manifest_key", "decision_token", "job_id"]


def eligible_once(inv: DataFrame) -> DataFrame:
    """The ``delete`` eligible rows, classified once and stored, as the batch job
    does (``runs.run_snapshot``): manifests, counts and reports read these rows
    and do not each classify the inventory again."""
    return scratch_table(E.eligible(inv, "delete"), "eligible")


def manifest_evidence(inv: DataFrame, sf_dir: str, elig: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The manifests of every run as written by K1, and their manifests-ready
    record, stored once per input and read back. Some are damaged, so that the
    ladder's rungs have real evidence: bucket-0's prev COMPLIANCE manifest is
    truncated, its prev GOVERNANCE one was never made and its cur GOVERNANCE
    one is listed but gone; bucket-2's prev COMPLIANCE record names a foreign
    key and its prev GOVERNANCE re-count failed. ``elig``: the eligible rows, where
    the caller has them stored."""
    spark = inv.sparkSession
    path = fx.fixture_path(spark, sf_dir, f"manifest_evidence|{fx.SNAPSHOTS}|{_code_hash()}")
    if not fx._committed(spark, f"{path}/ready"):
        elig = eligible_once(inv) if elig is None else elig
        rows = E.manifest_rows(elig).join(R.run_ids(inv), ["bucket", "dt"])

        def at(bucket, dt, mode):
            return (F.col("bucket") == bucket) & (F.col("dt") == dt) & (F.col("mode") == mode)

        never, gone = at("bucket-0", fx.PREV_DT, "GOVERNANCE"), at("bucket-0", fx.CUR_DT, "GOVERNANCE")
        cut = at("bucket-0", fx.PREV_DT, "COMPLIANCE") & (F.substring(F.md5("version_id"), 1, 1) < "4")
        K.write_manifest(rows.where(~never & ~gone & ~cut), f"{path}/manifests")
        foreign, failed = at("bucket-2", fx.PREV_DT, "COMPLIANCE"), at("bucket-2", fx.PREV_DT, "GOVERNANCE")
        (rows.where(~never).groupBy("bucket", "dt", "run_id", "mode").agg(F.count(F.lit(1)).alias("n")).select(
            "run_id", "mode",
            F.when(foreign, F.concat(F.lit("manifests/combined/elsewhere/"), F.col("mode"), F.lit("/manifest.csv")))
             .otherwise(R.combined_key()).alias("manifest_key"),
            (~gone).alias("manifest_exists"), (~failed).alias("recounted"))
         .write.mode("overwrite").parquet(f"{path}/ready"))
    return (spark.read.schema("bucket string, key string, version_id string, run_id string, mode string").csv(f"{path}/manifests"),
            spark.read.schema("run_id string, mode string, manifest_key string, manifest_exists boolean, recounted boolean").parquet(f"{path}/ready"))


def _decisions(spark, d, bucket1_threshold: int = 100, submissions=None, elig=None):
    inv = _inv(spark, d)
    elig = eligible_once(inv) if elig is None else elig
    return D.decide(R.decision_inputs(inv, elig, R.fixture_config(inv, bucket1_threshold), *manifest_evidence(inv, d, elig), submissions=submissions))


@register("decide", O.with_ctes(O.INV, O.CLS, O.decision_ctes(), body=f"SELECT {', '.join(DEC_COLS)} FROM decisions"))
def q_decide(spark, d):
    return _decisions(spark, d).select(*DEC_COLS)


@register("run_summary", O.run_summary_sql())
def q_run_summary(spark, d):
    return D.run_summary(_decisions(spark, d))


def submission_answers(inv: DataFrame) -> DataFrame:
    """What the job service answered in the fixture: it lacks the hold parameter
    for bucket-1, refuses the job of bucket-2's cur COMPLIANCE run, takes the rest."""
    runs = R.run_ids(inv)
    refused = (F.col("bucket") == "bucket-2") & (F.col("dt") == fx.CUR_DT) & (F.col("mode") == "COMPLIANCE")
    return (E.with_both_modes(runs).withColumnRenamed("object_lock_mode", "mode").join(runs, ["bucket", "dt"])
            .select("run_id", "mode", F.when(F.col("bucket") == "bucket-1", "event_hold_unsupported").when(refused, "AccessDenied").alias("submit_error")))


@register("submission_errors", O.with_ctes(O.INV, O.CLS, O.decision_ctes(((1, 100000, 0),), submit_error=(
    f"CASE WHEN r.bucket = 'bucket-1' THEN 'event_hold_unsupported' WHEN r.bucket = 'bucket-2' AND r.dt = '{fx.CUR_DT}' "
    "AND m.mode = 'COMPLIANCE' THEN 'AccessDenied' END")), body=f"""
SELECT run_id, mode, outcome, reason, printf(CASE reason
       WHEN 'event_hold_unsupported_by_runtime' THEN '{O.quoted(TEXT_MODE_UNSUPPORTED)}'
       ELSE '{O.quoted(TEXT_MODE_CREATE_FAILED.replace('(%s)', '(AccessDenied)'))}' END, mode) AS line
FROM decisions WHERE outcome = 'withheld' AND reason IN ('event_hold_unsupported_by_runtime', 'create_job_failed')"""))
def q_submission_errors(spark, d):
    """F8 + D1: the two rungs of the job service, from its answers, with the
    sentences of the run summary."""
    dec = _decisions(spark, d, 100000, submission_answers(_inv(spark, d))).withColumn("line", D.mode_line())
    return dec.where(F.col("reason").isin("event_hold_unsupported_by_runtime", "create_job_failed")).select("run_id", "mode", "outcome", "reason", "line")


@register("active_jobs", O.with_ctes(O.INV, O.CLS, O.decision_ctes(), """
jobs_made AS (SELECT run_id, bucket, mode, job_id FROM decisions WHERE outcome = 'created')""", body="""
SELECT j.run_id, j.bucket, j.mode, j.job_id, n.jobs_expected
FROM jobs_made j JOIN (SELECT run_id, count(*) AS jobs_expected FROM jobs_made GROUP BY run_id) n ON n.run_id = j.run_id"""))
def q_active_jobs(spark, d):
    """The active-jobs table that links decisions to completion, written twice
    (a replay adds nothing) and read back with its run records."""
    from ..operators import completion as J
    from ..sources import sinks as K
    path = _scratch(spark, "active_jobs")
    elig = eligible_once(_inv(spark, d))
    for _ in range(2):
        K.append_active_jobs(D.active_jobs(_decisions(spark, d, elig=elig)), path)
    rows = spark.read.parquet(path)
    return rows.join(J.active_records(rows), ["run_id", "bucket"]).select("run_id", "bucket", "mode", "job_id", "jobs_expected")


@register("count_reconciliation", O.with_ctes(O.INV, O.CLS, O.decision_ctes(), body=(
    "SELECT run_id, mode, trigger_count, file_count AS verified_count, trigger_count = file_count AS count_matches FROM inp")))
def q_count_reconciliation(spark, d):
    inv = _inv(spark, d)
    elig = eligible_once(inv)
    runs = R.run_ids(inv)
    expected = (E.eligible_counts(inv, elig).join(runs, ["bucket", "dt"])
                .select("run_id", F.col("object_lock_mode").alias("mode"), F.col("eligible_count").alias("trigger_count")))
    rec = D.count_reconciliation(expected, manifest_evidence(inv, d, elig)[0].select("run_id", "mode"))
    return rec.select("run_id", "mode", "trigger_count",
                      F.coalesce("verified_count", F.lit(0).cast("bigint")).alias("verified_count"),
                      (F.col("trigger_count") == F.coalesce("verified_count", F.lit(0))).alias("count_matches"))


@register("class_histogram", O.with_ctes(O.INV, O.CLS, body=(
    "SELECT bucket, dt, object_lock_mode, superseder_class, count(*) AS versions FROM classified "
    "GROUP BY bucket, dt, object_lock_mode, superseder_class")))
def q_class_histogram(spark, d):
    return (C.classify_versions(_inv(spark, d))
            .groupBy("bucket", "dt", "object_lock_mode", "superseder_class")
            .agg(F.count(F.lit(1)).alias("versions")))


# --- job events and completion (T-3 to T-9, A6, A8, W4) ---------------------

from ..operators import completion as J  # noqa: E402


def _ev(spark, d, name):
    """Stored job/event/report fixtures (written once from orders/lineitem)."""
    return fx.stored(spark, d, name, getattr(fx, name))


def _routed(spark, d, accepted_only: bool = False):
    return J.route_events(_ev(spark, d, "job_events"), _ev(spark, d, "jobs"), _ev(spark, d, "run_records"),
                          _ev(spark, d, "record_jobs"), fx.OUR_TAG, accepted_only)


def nested_events(events: DataFrame) -> DataFrame:
    """Job events as they are delivered: one nested JSON document a line."""
    return events.select(F.to_json(F.struct(
        F.lit("job-service").alias("source"), F.lit("Job status changed").alias("detail-type"),
        F.col("event_time").alias("time"),
        F.struct(F.lit("job-service").alias("eventSource"), F.lit("JobStatusChanged").alias("eventName"),
                 F.struct(F.col("job_id").alias("jobId"), F.col("event_status").alias("status")).alias("serviceEventDetails"))
         .alias("detail"))).alias("value"))


@register("job_event_parsing", O.with_ctes(O.EVENTS, body="SELECT job_id, event_status, event_time FROM evs"))
def q_job_event_parsing(spark, d):
    """F12 round trip: nested events written as JSON text and parsed again."""
    path = _scratch(spark, "job_events")
    nested_events(_ev(spark, d, "job_events")).write.text(path)
    return J.parse_job_events(spark.read.text(path))


@register("terminal_events", O.with_ctes(O.EVENTS, body=(
    "SELECT job_id, event_status, event_time FROM evs WHERE job_id IS NOT NULL "
    "AND event_status IN ('Complete', 'Cancelled', 'Failed')")))
def q_terminal_events(spark, d):
    return J.terminal_events(_ev(spark, d, "job_events")).select("job_id", "event_status", "event_time")


@register("job_event_routing", O.with_ctes(O.EVENTS, body=(
    "SELECT job_id, event_time, event_status, job_status, run_id, route FROM routed")))
def q_job_event_routing(spark, d):
    return _routed(spark, d).select("job_id", "event_time", "event_status", "job_status", "run_id", "route")


@register("status_disagreement", O.with_ctes(O.EVENTS, body=(
    "SELECT job_id, event_time, event_status, job_status FROM routed "
    "WHERE event_status IN ('Complete', 'Cancelled', 'Failed') AND job_status IS NOT NULL "
    "AND event_status <> job_status")))
def q_status_disagreement(spark, d):
    return J.status_disagreement(_routed(spark, d))


@register("first_terminal", O.with_ctes(O.EVENTS, body=(
    "SELECT run_id, job_id, event_time, first_route AS route FROM firsts")))
def q_first_terminal(spark, d):
    return J.first_terminal(_routed(spark, d, accepted_only=True)).select("run_id", "job_id", "event_time", "route")


@register("run_outcome", O.run_outcome_sql())
def q_run_outcome(spark, d):
    acc = J.first_terminal(_routed(spark, d, accepted_only=True)).where(F.col("route") == "accepted")
    return J.run_outcome(acc, _ev(spark, d, "run_records"))


@register("completion_recap", O.with_ctes(O.EVENTS, """
j AS (SELECT f.run_id, rj.mode, f.job_id, CASE
        WHEN f.job_status = 'Complete' AND f.failed = 0 THEN rj.mode || ': released ' || f.succeeded || ' of ' || f.total || ' event hold'
             || CASE WHEN f.total <> 1 THEN 's' ELSE '' END || ' (job ' || f.job_id || ').'
        WHEN f.job_status = 'Complete' THEN rj.mode || ': released ' || f.succeeded || ' of ' || f.total || ' event holds, ' || f.failed
             || ' failed -- see reports/' || f.run_id || '/' || rj.mode || '/ for details (job ' || f.job_id || ').'
        ELSE rj.mode || ': job ' || f.job_id || ' ended ' || f.job_status || ' -- ' || coalesce(f.failure_reason, 'see job details') || '.' END AS line
      FROM firsts f JOIN recjobs rj ON rj.run_id = f.run_id AND rj.job_id = f.job_id WHERE f.first_route = 'accepted'),
n AS (SELECT run_id, count(*) AS jobs_terminal, string_agg(line, ' ' ORDER BY mode, job_id) AS lines FROM j GROUP BY run_id),
o AS (SELECT r.run_id, r.bucket, strftime(r.snapshot_ts, '%Y-%m-%dT%H-%MZ') AS dt, n.jobs_terminal, n.lines
      FROM recs r JOIN n ON n.run_id = r.run_id WHERE n.jobs_terminal >= r.jobs_expected)""", body="""
SELECT run_id, bucket, dt, jobs_terminal,
       'Run ' || run_id || ' against ' || bucket || ' (inventory ' || dt || ') -- active mode, all jobs finished. ' || lines AS recap FROM o"""))
def q_completion_recap(spark, d):
    acc = J.first_terminal(_routed(spark, d, accepted_only=True)).where(F.col("route") == "accepted")
    records = _ev(spark, d, "run_records").withColumn("dt", F.date_format("snapshot_ts", "yyyy-MM-dd'T'HH-mm'Z'"))
    return J.completion_recap(acc, records, _ev(spark, d, "record_jobs"))


@register("report_totals", O.with_ctes(O.EVENTS, body="SELECT job_id, succeeded, failed, total FROM rt"))
def q_report_totals(spark, d):
    return J.report_totals(_ev(spark, d, "report_rows"))


@register("missing_record_alarm", O.with_ctes(O.EVENTS, body=(
    "SELECT time_bucket(INTERVAL '5 minutes', event_time) AS period_start, "
    "time_bucket(INTERVAL '5 minutes', event_time) + INTERVAL '5 minutes' AS period_end, "
    "count(*) AS missing_record_events FROM routed WHERE route = 'no_active_jobs_record' GROUP BY 1, 2")))
def q_missing_record_alarm(spark, d):
    return J.missing_record_alarm(_routed(spark, d))


def _backlog_sql(samples: str) -> str:
    """State changes of the alarm over the SQL ``samples`` (bucket, sample_time,
    depth): states of a full calendar of periods, empty ones OK."""
    return O.with_ctes(O.EVENTS, samples, """
p AS (SELECT bucket, time_bucket(INTERVAL '5 minutes', sample_time) AS period_start, max(depth) AS max_depth
      FROM samples GROUP BY 1, 2),
near AS (SELECT bucket, period_start FROM p UNION SELECT bucket, period_start + INTERVAL '5 minutes' FROM p),
filled AS (SELECT n.bucket, n.period_start, coalesce(p.max_depth, 0) AS max_depth,
                  CASE WHEN coalesce(q.max_depth, 0) > 0 THEN 'ALARM' ELSE 'OK' END AS previous_state
           FROM near n LEFT JOIN p ON p.bucket = n.bucket AND p.period_start = n.period_start
                LEFT JOIN p q ON q.bucket = n.bucket AND q.period_start = n.period_start - INTERVAL '5 minutes'),
st AS (SELECT *, CASE WHEN max_depth > 0 THEN 'ALARM' ELSE 'OK' END AS state FROM filled)""",
                       body="SELECT bucket, period_start, max_depth, state, previous_state FROM st WHERE state <> previous_state")


_FAILED_SQL = """
f AS (SELECT e.bucket, e.job_id, min(e.event_time) AS t FROM evs e
      WHERE e.job_id IN (SELECT job_id FROM jobs WHERE status = 'Failed') GROUP BY e.bucket, e.job_id)"""


@register("backlog_alarm", _backlog_sql(_FAILED_SQL + """,
samples AS (SELECT bucket, t AS sample_time, 1 AS depth FROM f UNION ALL SELECT bucket, t + INTERVAL 1 DAY, 0 FROM f)"""))
def q_backlog_alarm(spark, d):
    return J.backlog_alarm(J.backlog_samples(_ev(spark, d, "jobs"), _ev(spark, d, "job_events")))


@register("backlog_alarm_gaps", _backlog_sql(_FAILED_SQL + """,
samples AS (SELECT bucket, t + CAST(k AS INTEGER) * INTERVAL 1 MINUTE AS sample_time,
                   CASE WHEN k = 9 AND ascii(md5(job_id)) % 2 = 0 THEN 0 ELSE 1 END AS depth
            FROM f, (VALUES (0), (4), (9), (17), (360)) v(k))"""))
def q_backlog_alarm_gaps(spark, d):
    """Samples of a sampler that fails for hours: at 0, 4, 9, 17 and 360 minutes
    after a failure, so that alarms end in periods without any sample."""
    f = J.backlog_samples(_ev(spark, d, "jobs"), _ev(spark, d, "job_events"), keys=["job_id"]).where("depth = 1")
    rows = f.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (0, 4, 9, 17, 360)])))
    cleared = (F.col("k") == 9) & (F.ascii(F.md5("job_id")) % 2 == 0)
    return J.backlog_alarm(rows.select("bucket", (F.col("sample_time") + F.make_dt_interval(mins="k")).alias("sample_time"),
                                       F.when(cleared, 0).otherwise(1).alias("depth")))


# --- verification and projections (V1 to V6, W2) -----------------------------

from ..operators import verify as V  # noqa: E402


@register("verify_release", O.with_ctes(O.INV, O.CLS, O.eligible_dedup_ctes("delete"), body=f"""
SELECT pm.bucket, s.key AS key, pm.version_id, pm.mode, s.dt AS later_dt,
       CASE WHEN s.dt IS NULL THEN 'gone' WHEN s.object_lock_event_hold_status = 'ON' THEN 'still_held'
            WHEN s.object_lock_event_hold_status = 'OFF' THEN 'released' ELSE 'unknown' END AS release_status,
       s.object_lock_retain_until_date
FROM pm LEFT JOIN (SELECT * FROM inv WHERE dt = '{fx.CUR_DT}') s
  ON s.bucket = pm.bucket AND {O.enc('s.key')} = pm.key AND s.version_id = pm.version_id"""))
def q_verify_release(spark, d):
    inv = _inv(spark, d)
    return V.verify_release(stored_previous_manifest(inv, "delete", d), fx.snapshot(inv, fx.CUR_DT))


@register("rolling_retention", O.with_ctes(O.INV, body=f"""
SELECT b.bucket, b.key, b.version_id, b.object_lock_event_hold_status AS hold_before,
       a.object_lock_event_hold_status AS hold_after, b.object_lock_retain_until_date AS retain_before,
       a.object_lock_retain_until_date AS retain_after,
       CASE WHEN b.object_lock_event_hold_status = 'ON' AND a.object_lock_event_hold_status = 'ON' THEN
              CASE WHEN a.object_lock_retain_until_date > b.object_lock_retain_until_date THEN 'rolling' ELSE 'not_advancing' END
            WHEN b.object_lock_event_hold_status = 'ON' AND a.object_lock_event_hold_status = 'OFF' THEN 'released'
            WHEN b.object_lock_event_hold_status = 'OFF' AND a.object_lock_event_hold_status = 'OFF' THEN
              CASE WHEN a.object_lock_retain_until_date = b.object_lock_retain_until_date THEN 'settled' ELSE 'changed_after_release' END
            WHEN b.object_lock_event_hold_status = 'OFF' AND a.object_lock_event_hold_status = 'ON' THEN 'hold_reapplied'
            ELSE 'no_hold' END AS retention_status
FROM (SELECT * FROM inv WHERE dt = '{fx.PREV_DT}') b
JOIN (SELECT * FROM inv WHERE dt = '{fx.CUR_DT}') a ON a.bucket = b.bucket AND a.key = b.key AND a.version_id = b.version_id
WHERE b.object_lock_event_hold_status IS NOT NULL OR a.object_lock_event_hold_status IS NOT NULL"""))
def q_rolling_retention(spark, d):
    inv = _inv(spark, d)
    return V.rolling_retention(fx.snapshot(inv, fx.PREV_DT), fx.snapshot(inv, fx.CUR_DT))


_DTS = [dt for dt, _ in fx.SERIES]

HOLD_HISTORY_SQL = O.with_ctes(O.inv_ctes(fx.SERIES), f"""
seen AS (
  SELECT bucket, key, version_id, dt, coalesce(object_lock_event_hold_status = 'ON', false) AS held, CAST(version_id AS BIGINT) AS v,
         object_lock_event_hold_status AS st, object_lock_retain_until_date AS retain
  FROM inv
  WHERE NOT (CAST(version_id AS BIGINT) % 7 = 3 AND dt = '{_DTS[2]}') AND NOT (CAST(version_id AS BIGINT) % 11 = 5 AND dt = '{_DTS[3]}')),
off AS (SELECT *, held AND ((v % 5 = 0 AND dt >= '{_DTS[1]}') OR (v % 5 = 1 AND dt = '{_DTS[1]}')) AS released FROM seen),
snaps_n AS (SELECT bucket, dt, row_number() OVER (PARTITION BY bucket ORDER BY dt) AS n,
                   count(*) OVER (PARTITION BY bucket) AS newest FROM (SELECT DISTINCT bucket, dt FROM off)),
h AS (
  SELECT bucket, key, version_id, dt, n, newest, CASE WHEN released THEN 'OFF' ELSE coalesce(st, 'none') END AS hold_status,
         CASE WHEN released OR (held AND v % 13 = 6 AND dt = '{_DTS[2]}') THEN TIMESTAMP '{fx.PREV_CUT}' + INTERVAL 1 YEAR ELSE retain END AS retain
  FROM off JOIN snaps_n USING (bucket, dt)),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY bucket, key, version_id, hold_status ORDER BY n) AS run FROM h),
step AS (SELECT *, lag(retain) OVER (PARTITION BY bucket, key, version_id, hold_status, run ORDER BY n) AS was FROM runs),
span AS (
  SELECT bucket, key, version_id, hold_status, min(dt) AS first_dt, max(dt) AS last_dt, count(*) AS snapshots,
         arg_min(struct_pack(r := retain), n).r AS first_retain, arg_max(struct_pack(r := retain), n).r AS last_retain,
         count(*) FILTER (WHERE retain > was) AS advances, count(*) FILTER (WHERE retain < was) AS setbacks,
         max(n) AS last_n, max(newest) AS newest
  FROM step GROUP BY bucket, key, version_id, hold_status, run)""", body="""
SELECT s.bucket, s.key, s.version_id, s.hold_status, s.first_dt, s.last_dt, s.snapshots, s.first_retain, s.last_retain, s.advances, s.setbacks,
       CASE WHEN s.last_n = s.newest THEN NULL WHEN f.hold_status IS NULL THEN 'absent'
            WHEN s.hold_status = 'ON' AND f.hold_status = 'OFF' THEN 'released'
            WHEN s.hold_status = 'OFF' AND f.hold_status = 'ON' THEN 'hold_reapplied' ELSE 'status_changed' END AS ended_by
FROM span s LEFT JOIN h f ON f.bucket = s.bucket AND f.key = s.key AND f.version_id = s.version_id AND f.n = s.last_n + 1""")


def _series(spark, d):
    """The inventory of several deliveries, with holds that change between them."""
    return fx.held_series(fx.inventory_table(spark, d, fx.SERIES))


@register("hold_history", HOLD_HISTORY_SQL)
def q_hold_history(spark, d):
    return V.hold_history(_series(spark, d))


@register("hold_history_merged", HOLD_HISTORY_SQL)
def q_hold_history_merged(spark, d):
    """The same history, kept up one delivery at a time in stored tables."""
    from ..sources.sinks import merge_hold_history, read_hold_history
    inv, root = _series(spark, d), _scratch(spark, "hold-history")
    for dt in _DTS:
        rows = fx.snapshot(inv, dt)
        merge_hold_history(rows, rows.select("bucket", "dt").distinct(), root, dt)
    return read_hold_history(spark, root)


@register("release_effect", O.with_ctes(O.INV, O.CLS, f"elig AS ({O._elig('delete')})", body=f"""
SELECT e.bucket, e.dt, e.key, e.version_id, e.object_lock_mode, c.object_lock_retain_until_date,
       greatest(c.object_lock_retain_until_date, TIMESTAMP '{O.RELEASE_TIME}' + INTERVAL {O.HOLD_DAYS} DAY) AS retain_until_after_release
FROM elig e JOIN classified c ON c.bucket = e.bucket AND c.dt = e.dt AND c.key = e.key AND c.version_id = e.version_id"""))
def q_release_effect(spark, d):
    inv = _inv(spark, d)
    cls = C.classify_versions(inv)
    elig = (cls.where((F.col("superseder_kinds") == 1) & F.col("superseder_is_delete_marker"))
            .where(F.col("object_lock_mode").isin("COMPLIANCE", "GOVERNANCE")))
    return V.release_effect(elig, O.RELEASE_TIME, O.HOLD_DAYS)


BECAME_COLS = ["bucket", "dt", "key", "version_id", "superseder_class", "noncurrent_since_min", "noncurrent_since_max"]


@register("became_noncurrent", O.with_ctes(O.INV, O.CLS, O.BECAME, body=f"SELECT {', '.join(BECAME_COLS)} FROM became"))
def q_became_noncurrent(spark, d):
    return V.became_noncurrent(C.classify_versions(_inv(spark, d))).select(*BECAME_COLS)


@register("expiry_projection", O.with_ctes(O.INV, O.CLS, O.BECAME, body=f"""
SELECT bucket, dt, key, version_id, noncurrent_since_max, object_lock_retain_until_date AS retain_until,
       noncurrent_since_max + INTERVAL {O.NONCURRENT_DAYS} DAY AS lifecycle_at,
       greatest(noncurrent_since_max + INTERVAL {O.NONCURRENT_DAYS} DAY, object_lock_retain_until_date) AS earliest_expiry,
       CASE WHEN noncurrent_since_max IS NULL THEN NULL
            WHEN object_lock_retain_until_date IS NULL
              OR noncurrent_since_max + INTERVAL {O.NONCURRENT_DAYS} DAY >= object_lock_retain_until_date THEN 'lifecycle'
            ELSE 'retention' END AS binding
FROM became"""))
def q_expiry_projection(spark, d):
    return V.expiry_projection(C.classify_versions(_inv(spark, d)), O.NONCURRENT_DAYS)


def _runs_released(spark, d):
    li = fx.table(spark, d, "lineitem").groupBy(
        F.lpad(F.lower(F.hex(F.floor(F.col("l_orderkey") / 2))), 8, "0").alias("run_id")).agg(
        F.max("l_shipdate").alias("released_at"))
    return _ev(spark, d, "run_records").join(li, "run_id")


@register("evidence_age", O.with_ctes(O.EVENTS, body=f"""
SELECT r.run_id, r.snapshot_ts, l.released_at, datediff('day', r.snapshot_ts, l.released_at) AS evidence_age_days,
       datediff('day', r.snapshot_ts, l.released_at) > {O.EVIDENCE_MAX_DAYS} AS stale_evidence
FROM recs r JOIN (SELECT lpad(lower(hex(l_orderkey // 2)), 8, '0') AS run_id, max(l_shipdate) AS released_at
                  FROM lineitem GROUP BY 1) l ON l.run_id = r.run_id"""))
def q_evidence_age(spark, d):
    return V.evidence_age(_runs_released(spark, d), O.EVIDENCE_MAX_DAYS)


def _reported(spark, d):
    jb = _ev(spark, d, "jobs").where(F.col("status").isin("Complete", "Failed")).select("job_id")
    return _ev(spark, d, "report_rows").join(jb, "job_id", "left_semi")


@register("audit_trail", O.with_ctes(O.EVENTS, body="""
SELECT coalesce(m.run_id, r.run_id) AS run_id, coalesce(m.mode, r.mode) AS mode, coalesce(m.bucket, r.bucket) AS bucket,
       coalesce(m.key, r.key) AS key, coalesce(m.version_id, r.version_id) AS version_id, r.task_status,
       CASE WHEN m.key IS NULL THEN 'unexpected_report_row' WHEN r.task_status IS NULL THEN 'not_reported'
            WHEN r.task_status = 'Succeeded' THEN 'released' ELSE 'failed' END AS audit_status,
       coalesce(coalesce(m.run_id, r.run_id) IN (SELECT run_id FROM recs), false) AS decision_present
FROM rep m
FULL OUTER JOIN (SELECT * FROM rep WHERE job_id IN (SELECT job_id FROM jobs WHERE status IN ('Complete', 'Failed'))) r
  ON r.run_id = m.run_id AND r.mode = m.mode AND r.bucket = m.bucket AND r.key = m.key AND r.version_id = m.version_id"""))
def q_audit_trail(spark, d):
    manifest = _ev(spark, d, "report_rows").drop("task_status", "job_id")
    return V.audit_trail(manifest, _reported(spark, d), _ev(spark, d, "run_records"))


@register("audit_trail_decided", O.with_ctes(O.INV, O.CLS, O.decision_ctes(), f"""
h AS (SELECT r.run_id, e.object_lock_mode AS mode, e.bucket, e.dt, {O.enc('e.key')} AS key, e.version_id, substr(md5(e.version_id), 1, 1) AS c
      FROM elig e JOIN runs r ON r.bucket = e.bucket AND r.dt = e.dt),
m AS (SELECT * FROM h WHERE NOT (bucket = 'bucket-0' AND mode = 'GOVERNANCE')
        AND NOT (bucket = 'bucket-0' AND dt = '{fx.PREV_DT}' AND mode = 'COMPLIANCE' AND c < '4')),
r AS (SELECT *, CASE WHEN c < 'd' THEN 'Succeeded' ELSE 'PermanentFailure' END AS task_status FROM h WHERE c <> '5')""", body="""
SELECT coalesce(m.run_id, r.run_id) AS run_id, coalesce(m.mode, r.mode) AS mode, coalesce(m.bucket, r.bucket) AS bucket,
       coalesce(m.key, r.key) AS key, coalesce(m.version_id, r.version_id) AS version_id, r.task_status,
       CASE WHEN m.key IS NULL THEN 'unexpected_report_row' WHEN r.task_status IS NULL THEN 'not_reported'
            WHEN r.task_status = 'Succeeded' THEN 'released' ELSE 'failed' END AS audit_status,
       coalesce(m.run_id, r.run_id) IN (SELECT run_id FROM decisions WHERE outcome = 'created') AS decision_present
FROM m FULL OUTER JOIN r
  ON r.run_id = m.run_id AND r.mode = m.mode AND r.bucket = m.bucket AND r.key = m.key AND r.version_id = m.version_id"""))
def q_audit_trail_decided(spark, d):
    """V6 over the manifests as written (some damaged) and the ladder's own
    decisions; the report covers what was eligible, less some rows that were
    never reported."""
    inv = _inv(spark, d)
    elig = eligible_once(inv)
    c = F.substring(F.md5("version_id"), 1, 1)
    report = (E.manifest_rows(elig).join(R.run_ids(inv), ["bucket", "dt"]).where(c != "5")
              .withColumn("task_status", F.when(c < "d", "Succeeded").otherwise("PermanentFailure")))
    decisions = _decisions(spark, d, elig=elig).where(F.col("outcome") == "created")
    return V.audit_trail(manifest_evidence(inv, d, elig)[0], report, decisions)


# --- reviews (C7 to C9, P5) ---------------------------------------------------

from ..operators import review as RV  # noqa: E402

_NO_NC_DM = "inv_nodm AS (SELECT * FROM inv WHERE is_delete_marker IS DISTINCT FROM true OR is_latest IS DISTINCT FROM false)"


@register("withheld_remedy", O.with_ctes(O.INV, O.CLS, _NO_NC_DM, O.cls_on("inv_nodm", "b"), body="""
SELECT c.bucket, c.dt, c.key, c.version_id, c.object_lock_mode, b.superseder_class AS class_after,
       CASE WHEN b.superseder_class IN ('delete', 'overwrite') THEN 'self_heals' ELSE 'stuck' END AS remedy
FROM classified c LEFT JOIN classified_b b ON b.bucket = c.bucket AND b.dt = c.dt AND b.key = c.key AND b.version_id = c.version_id
WHERE c.superseder_class = 'withheld'"""))
def q_withheld_remedy(spark, d):
    return RV.withheld_remedy(_inv(spark, d))


@register("reclassification_hazard", O.with_ctes(O.INV, O.CLS, _NO_NC_DM, O.cls_on("inv_nodm", "b"), body="""
SELECT c.bucket, c.dt, c.key, c.version_id, c.object_lock_mode, c.superseder_class AS class_before, b.superseder_class AS class_after
FROM classified c JOIN classified_b b ON b.bucket = c.bucket AND b.dt = c.dt AND b.key = c.key AND b.version_id = c.version_id
WHERE c.superseder_class = 'delete' AND b.superseder_class = 'overwrite'"""))
def q_reclassification_hazard(spark, d):
    return RV.reclassification_hazard(_inv(spark, d))


@register("withheld_remedy_gaps", O.with_ctes(O.INV, O.GAPS, O.cls_on("gaps", "g"), O.cls_on("gaps_nodm", "h"), body="""
SELECT c.bucket, c.dt, c.key, c.version_id, c.object_lock_mode, b.superseder_class AS class_after,
       CASE WHEN b.superseder_class IN ('delete', 'overwrite') THEN 'self_heals' ELSE 'stuck' END AS remedy
FROM classified_g c LEFT JOIN classified_h b ON b.bucket = c.bucket AND b.dt = c.dt AND b.key = c.key AND b.version_id = c.version_id
WHERE c.superseder_class = 'withheld'"""))
def q_withheld_remedy_gaps(spark, d):
    return RV.withheld_remedy(gaps(_inv(spark, d)))


@register("reclassification_hazard_gaps", O.with_ctes(O.INV, O.GAPS, O.cls_on("gaps", "g"), O.cls_on("gaps_nodm", "h"), body="""
SELECT c.bucket, c.dt, c.key, c.version_id, c.object_lock_mode, c.superseder_class AS class_before, b.superseder_class AS class_after
FROM classified_g c JOIN classified_h b ON b.bucket = c.bucket AND b.dt = c.dt AND b.key = c.key AND b.version_id = c.version_id
WHERE c.superseder_class = 'delete' AND b.superseder_class = 'overwrite'"""))
def q_reclassification_hazard_gaps(spark, d):
    return RV.reclassification_hazard(gaps(_inv(spark, d)))


@register("write_once_anomalies", O.with_ctes(O.INV, O.CLS, body=(
    "SELECT bucket, dt, key, version_id, object_lock_mode, last_modified_date, next_lmd FROM classified "
    "WHERE superseder_class = 'overwrite' AND (" + " OR ".join(f"starts_with(key, '{p}')" for p in O.WRITE_ONCE_PREFIXES) + ")")))
def q_write_once_anomalies(spark, d):
    return RV.write_once_anomalies(C.classify_versions(_inv(spark, d)), O.WRITE_ONCE_PREFIXES)


_SCOPES = """
scopes AS (SELECT DISTINCT bucket, regexp_extract(key, '^([^/]*/)', 1) AS prefix FROM inv
           WHERE regexp_extract(key, '^([^/]*/)', 1) <> '')"""


@register("prefix_shards", O.with_ctes(O.INV, O.CLS, _SCOPES, body="""
SELECT c.bucket, s.prefix AS shard, count(*) AS candidates
FROM cand c JOIN scopes s ON s.bucket = c.bucket AND starts_with(c.key, s.prefix)
GROUP BY c.bucket, s.prefix"""))
def q_prefix_shards(spark, d):
    inv = _inv(spark, d)
    scopes = RV.top_level_scopes(inv)
    return (RV.prefix_shards(C.candidates(inv), scopes)
            .groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("candidates")))


@register("prefix_overlaps", O.with_ctes(O.INV, _SCOPES, """
nested AS (SELECT bucket, key AS prefix FROM inv UNION SELECT bucket, prefix FROM scopes)""", body="""
SELECT a.bucket, a.prefix, b.prefix AS contained_in
FROM nested a JOIN nested b ON a.bucket = b.bucket AND a.prefix <> b.prefix AND starts_with(a.prefix, b.prefix)"""))
def q_prefix_overlaps(spark, d):
    """P5 overlap check over a scope set that does overlap: the top-level
    folders plus every full key as its own scope (each key lies inside its
    folder's scope)."""
    inv = _inv(spark, d)
    scopes = RV.top_level_scopes(inv).unionByName(inv.select("bucket", F.col("key").alias("prefix"))).distinct()
    return RV.prefix_overlaps(scopes)


# --- artifacts, cost, sampling (J8, A10, O3) ----------------------------------

from ..operators import artifacts as AR  # noqa: E402
from ..schemas import RATE_CARD, RETENTION_RULES  # noqa: E402


SHARD_LIMIT = 40  # versions of a shard of the fixture


@register("shard_plan", O.with_ctes(O.INV, f"""
k AS (SELECT bucket, key, count(*) AS n FROM inv GROUP BY bucket, key)""", body=f"""
SELECT bucket, CASE WHEN versions > {SHARD_LIMIT} THEN low ELSE prefix END AS prefix, single_key OR versions > {SHARD_LIMIT} AS single_key, versions, keys FROM (
  WITH RECURSIVE t AS (
    SELECT 0 AS step, bucket, '' AS prefix, false AS single_key, key, n::BIGINT AS n FROM k
    UNION ALL
    SELECT step + 1, bucket, CASE WHEN length(key) > c THEN left(key, c + 1) ELSE key END, length(key) <= c, key, n FROM (
      SELECT *, coalesce(nullif(list_position(list_transform(range(1, least(length(low), length(high)) + 1), lambda i: low[i] = high[i]), false), 0) - 1,
                         least(length(low), length(high))) AS c FROM (
        SELECT *, sum(n) OVER w AS total, min(key) OVER w AS low, max(key) OVER w AS high FROM t WINDOW w AS (PARTITION BY bucket, prefix, single_key))
      WHERE total > {SHARD_LIMIT} AND low <> high))
  SELECT bucket, prefix, single_key, sum(n)::BIGINT AS versions, count(*) AS keys, min(key) AS low FROM (
    SELECT *, row_number() OVER (PARTITION BY bucket, key ORDER BY step DESC) AS last FROM t) WHERE last = 1
  GROUP BY bucket, prefix, single_key)"""))
def q_shard_plan(spark, d):
    """P5: prefixes that cut every bucket into shards of bounded size."""
    return RV.shard_plan(_inv(spark, d), SHARD_LIMIT)


def _values(rows, cols):
    def lit(v):
        return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else repr(v))
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") AS t({cols})"


@register("artifact_retention", O.with_ctes(O.EVENTS, f"""
rules AS (SELECT * FROM {_values(RETENTION_RULES, 'rule_prefix, expire_days')}),
arts AS (
  SELECT unnest([
    'inventory/' || bucket || '/inv/' || strftime(snapshot_ts, '%Y-%m-%dT%H-%MZ') || '/manifest.json',
    'athena-results/' || run_id || '.csv',
    'manifests/parts/' || run_id || '/_query_complete.json',
    'diagnostics/withheld-candidates/dt=' || strftime(snapshot_ts, '%Y-%m-%dT%H-%MZ') || '/' || run_id || '.csv']) AS path,
    snapshot_ts AS created_at FROM recs
  UNION ALL
  SELECT unnest([
    'manifests/combined/' || j.run_id || '/' || j.mode || '/manifest.csv',
    'reports/' || j.run_id || '/' || j.mode || '/report.csv',
    'manifests/previous/' || j.mode || '/' || j.run_id || '.csv']) AS path, r.snapshot_ts AS created_at
  FROM recjobs j JOIN recs r ON r.run_id = j.run_id),
m AS (SELECT a.path, a.created_at, r.rule_prefix, r.expire_days,
             row_number() OVER (PARTITION BY a.path, a.created_at ORDER BY length(r.rule_prefix) DESC NULLS LAST) AS rn
      FROM arts a LEFT JOIN rules r ON starts_with(a.path, r.rule_prefix))""", body="""
SELECT path, created_at, rule_prefix, expire_days IS NULL AS never_expires,
       CASE WHEN expire_days IS NOT NULL THEN created_at + to_days(expire_days) END AS expires_at
FROM m WHERE rn = 1"""))
def q_artifact_retention(spark, d):
    # `never_expires` instead of a nullable day count: the no-expiry rule is
    # a flag, not a number
    arts = AR.run_artifacts(_ev(spark, d, "run_records"), _ev(spark, d, "record_jobs"))
    return AR.artifact_retention(arts).select(
        "path", "created_at", "rule_prefix", F.col("expire_days").isNull().alias("never_expires"), "expires_at")


@register("cost_estimate", O.with_ctes(O.INV, O.CLS, f"elig AS ({O._elig('delete')})", f"""
rates AS (SELECT * FROM {_values(RATE_CARD, 'line_item, unit, rate_usd')}),
usage AS (
  SELECT u.bucket, u.dt, u.versions_listed, coalesce(e.n, 0) AS versions_released, coalesce(e.jobs, 0) AS jobs
  FROM (SELECT bucket, dt, count(*) AS versions_listed FROM inv GROUP BY bucket, dt) u
  LEFT JOIN (SELECT bucket, dt, count(*) AS n, count(DISTINCT object_lock_mode) AS jobs FROM elig GROUP BY bucket, dt) e
    ON e.bucket = u.bucket AND e.dt = u.dt),
q AS (
  SELECT bucket, dt, 'inventory_listing' AS line_item, versions_listed / 1e6 AS quantity FROM usage UNION ALL
  SELECT bucket, dt, 'query_scan', versions_listed * 80 / 1000000000000 FROM usage UNION ALL
  SELECT bucket, dt, 'batch_job', CAST(jobs AS DOUBLE) FROM usage UNION ALL
  SELECT bucket, dt, 'batch_objects', versions_released / 1e6 FROM usage UNION ALL
  SELECT bucket, dt, 'put_requests', versions_released / 1e3 FROM usage)""", body="""
SELECT q.bucket, q.dt, q.line_item, CAST(floor(q.quantity * r.rate_usd * 1e6 + 0.5) AS BIGINT) AS cost_micro_usd
FROM q JOIN rates r ON r.line_item = q.line_item"""))
def q_cost_estimate(spark, d):
    inv = _inv(spark, d)
    elig = E.eligible(inv, "delete")
    usage = (inv.groupBy("bucket", "dt").agg(F.count(F.lit(1)).alias("versions_listed"))
             .join(elig.groupBy("bucket", "dt").agg(F.count(F.lit(1)).alias("versions_released"),
                                                     F.count_distinct("object_lock_mode").alias("jobs")),
                   ["bucket", "dt"], "left")
             .fillna(0, ["versions_released", "jobs"]))
    return AR.cost_estimate(usage, AR.rate_card(spark))


@register("sample_keys", O.with_ctes(O.INV, body=f"""
SELECT bucket, key FROM (SELECT DISTINCT bucket, key FROM inv WHERE dt = '{fx.CUR_DT}')
ORDER BY md5(bucket || '/' || key || '/42'), bucket, key LIMIT 25"""))
def q_sample_keys(spark, d):
    return AR.sample_keys(fx.snapshot(_inv(spark, d), fx.CUR_DT), 25, seed=42)


@register("sample_keys_pct", O.with_ctes(O.INV, f"""
ks AS (SELECT DISTINCT bucket, key FROM inv WHERE dt = '{fx.CUR_DT}'),
nth AS (SELECT bucket, key, row_number() OVER (ORDER BY md5(bucket || '/' || key || '/42'), bucket, key) AS n, count(*) OVER () AS total FROM ks)""", body="""
SELECT bucket, key FROM nth WHERE n <= floor(total * 12.5 / 100)"""))
def q_sample_keys_pct(spark, d):
    return AR.sample_keys_pct(fx.snapshot(_inv(spark, d), fx.CUR_DT), 12.5, seed=42)


# --- sources and sinks: schema drift, records, round trips

import uuid  # noqa: E402

from ..session import checkpoint_dir  # noqa: E402
from ..sources import records as SR  # noqa: E402
from ..sources import sinks as K  # noqa: E402


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for a round trip."""
    return f"{checkpoint_dir(spark)}/roundtrip/{name}-{uuid.uuid4().hex}"


def delivery_manifests(inv: DataFrame) -> DataFrame:
    """One delivery manifest per (bucket, dt) snapshot, derived from the
    inventory, with drift injected: bucket-2's prev delivery lacks the hold
    column, bucket-1 lacks `size` and carries an undeclared column, bucket-0's
    cur delivery is not Parquet."""
    fields = F.array(*[F.lit(f) for f in O.DELIVERY_FIELDS])
    snaps = inv.select("bucket", "dt").distinct()
    b, dt = F.col("bucket"), F.col("dt")
    chosen = (F.when((b == "bucket-2") & (dt == fx.PREV_DT),
                     F.filter(fields, lambda f: ~f.contains(" object_lock_event_hold_status")))
              .when(b == "bucket-1", F.concat(F.filter(fields, lambda f: ~f.contains(" size;")),
                                              F.array(F.lit(O.EXTRA_FIELD))))
              .otherwise(fields))
    return snaps.select(
        "bucket", "dt",
        F.when((b == "bucket-0") & (dt == fx.CUR_DT), "CSV").otherwise("Parquet").alias("fileFormat"),
        F.concat(F.lit("message s3.inventory { "), F.array_join(chosen, " "), F.lit(" }")).alias("fileSchema"))


@register("schema_drift", O.schema_drift_sql())
def q_schema_drift(spark, d):
    return SR.schema_drift(delivery_manifests(_inv(spark, d)))


def _decision_history(spark, d):
    """Two passes over every run: the scheduled one, and a replay a day later
    after bucket-1's threshold was raised (the documented remedy)."""
    out, elig = None, eligible_once(_inv(spark, d))
    for p, thr, off in ((1, 100, 0), (2, 100000, 1)):
        dec = (_decisions(spark, d, thr, elig=elig)
               .withColumn("pass", F.lit(p))
               .withColumn("decision_id", F.concat(F.col("run_id"), F.lit(f"-{p}")))
               .withColumn("decided_at", F.to_timestamp_ntz(F.regexp_replace("dt", r"^(\d{4}-\d{2}-\d{2})-(\d{2})-(\d{2})$", "$1 $2:$3:00"))
                           + F.make_dt_interval(F.lit(off))))
        out = dec if out is None else out.unionByName(dec)
    return out


@register("latest_decision", O.with_ctes(O.INV, O.CLS, O.decision_ctes(((1, 100, 0), (2, 100000, 1))), body="""
SELECT run_id, mode, decision_id, outcome, reason, decided_at FROM (
  SELECT run_id, mode, run_id || '-' || CAST(pass AS VARCHAR) AS decision_id, outcome, reason,
         strptime(dt, '%Y-%m-%d-%H-%M') + to_days(day_offset) AS decided_at,
         row_number() OVER (PARTITION BY run_id, mode ORDER BY strptime(dt, '%Y-%m-%d-%H-%M') + to_days(day_offset) DESC,
                            run_id || '-' || CAST(pass AS VARCHAR) DESC) AS rn
  FROM decisions) WHERE rn = 1"""))
def q_latest_decision(spark, d):
    return D.latest_decision(_decision_history(spark, d)).select(
        "run_id", "mode", "decision_id", "outcome", "reason", "decided_at")


@register("scan_previous_manifest", O.with_ctes(O.INV, O.CLS, O.eligible_dedup_ctes("delete"),
                                                body="SELECT bucket, key, version_id, mode FROM pm"))
def q_scan_previous_manifest(spark, d):
    """K1 writer + S4 reader round trip: the previous snapshot's manifest is
    written as headerless CSV and read back positionally."""
    path = _scratch(spark, "previous_manifest")
    pm = previous_manifest(_inv(spark, d), "delete")
    K.assert_csv_safe(pm, ["bucket", "key", "version_id"])
    (pm.withColumn("target", F.col("bucket")).write.option("header", False).option("compression", "none")
     .partitionBy("target", "mode").csv(path))
    return SR.read_previous_manifest(spark, path)


_RAW_DT = r"regexp_replace(dt, '^(\d{4}-\d{2}-\d{2})-(\d{2})-(\d{2})$', '\1T\2-\3Z')"


@register("withheld_history", O.with_ctes(O.INV, O.CLS, body=(
    f"SELECT {O.enc('key')} AS key, version_id, object_lock_mode, "
    "strftime(last_modified_date, '%Y-%m-%d %H:%M:%S.%g') AS last_modified_date, "
    "CASE WHEN has_tied_noncurrent_peer = 1 THEN 'tied_noncurrent_peer' ELSE 'ambiguous_successor_classification' END AS reason, "
    f"{_RAW_DT} AS dt, bucket FROM classified WHERE superseder_kinds > 1")))
def q_withheld_history(spark, d):
    """K2 writer + S5 reader round trip over the raw-dt partitions."""
    path = _scratch(spark, "withheld")
    wh = E.withheld(_inv(spark, d)).withColumn(
        "dt_raw", F.regexp_replace("dt", r"^(\d{4}-\d{2}-\d{2})-(\d{2})-(\d{2})$", "$1T$2-$3Z"))
    K.write_withheld(wh, path)
    dts = [fx.PREV_DT, fx.CUR_DT]
    raw = [f"{x[:10]}T{x[11:13]}-{x[14:16]}Z" for x in dts]
    return SR.read_withheld_history(spark, path, raw)


@register("next_previous_manifest", O.with_ctes(O.INV, O.CLS, O.decision_ctes(), """
latest AS (
  SELECT run_id, bucket, dt, mode FROM (
    SELECT *, row_number() OVER (PARTITION BY bucket, mode ORDER BY dt DESC, run_id DESC) AS rn
    FROM decisions WHERE outcome = 'created') WHERE rn = 1)""", body=f"""
SELECT e.bucket, {O.enc('e.key')} AS key, e.version_id, e.object_lock_mode AS mode
FROM elig e JOIN latest l ON l.bucket = e.bucket AND l.dt = e.dt AND l.mode = e.object_lock_mode"""))
def q_next_previous_manifest(spark, d):
    """K4: publish the dedup pointer from decisions and read it back."""
    path = _scratch(spark, "previous")
    inv = _inv(spark, d)
    elig = eligible_once(inv)
    K.publish_previous_manifest(manifest_evidence(inv, d, elig)[0], _decisions(spark, d, elig=elig), path)
    return SR.read_previous_manifest(spark, path)


RUN_ID_SQL = "substr(sha256(bucket || '/' || dt), 1, 16)"


@register("rerun_resolves", O.with_ctes(O.INV, O.CLS, body=(
    f"SELECT bucket, {O.enc('key')} AS key, version_id, object_lock_mode AS mode, {RUN_ID_SQL} AS run_id FROM classified "
    "WHERE superseder_kinds = 1 AND superseder_is_delete_marker AND object_lock_mode IN ('COMPLIANCE', 'GOVERNANCE') "
    f"AND (dt = '{fx.CUR_DT}' OR substr(md5(version_id), 1, 1) < '8')")))
def q_rerun_resolves(spark, d):
    """K1/K5: manifests of three attempts as readers resolve them. The first
    commits every run; the second dies after writing half of the rows; the third
    commits the prev runs again, with the other half."""
    from ..sources import attempts as A
    root, inv = _scratch(spark, "attempts"), _inv(spark, d)
    runs = R.run_ids(inv)
    rows = E.manifest_rows(E.eligible(inv, "delete")).join(runs, ["bucket", "dt"])
    low = F.substring(F.md5("version_id"), 1, 1) < "8"
    prev = F.col("dt") == fx.PREV_DT
    for attempt, part, done in (("first", rows, runs), ("second", rows.where(~low), None), ("third", rows.where(low & prev), runs.where(prev))):
        K.write_manifest(part, A.attempt_path(root, "manifests", attempt))
        if done is not None:
            A.commit(spark, root, attempt, done)
    path = f"{root}/manifests"
    return A.resolved(spark.read.schema(R.MANIFEST_SCHEMA).csv(path), path).select("bucket", "key", "version_id", "mode", "run_id")


@register("dedup_replay", O.with_ctes(O.INV, O.CLS, O.eligible_dedup_ctes("delete"), body=(
    f"SELECT bucket, {O.enc('key')} AS key, version_id, object_lock_mode AS mode FROM deduped")))
def q_dedup_replay(spark, d):
    """J4 by lineage: the prev runs publish the pointer, the cur runs move it on,
    and the cur runs are replayed against it: each is compared with its
    predecessor, never with itself."""
    from ..sources import attempts as A
    root, inv = _scratch(spark, "replay"), _inv(spark, d)
    config = inv.select("bucket").distinct().select("bucket", F.lit("delete").alias("release_mode"), F.lit(False).alias("report_only"), F.lit(1 << 60).alias("safety_threshold"))
    for dt in (fx.PREV_DT, fx.CUR_DT, fx.CUR_DT):
        R.run_snapshot(spark, fx.snapshot(inv, dt), config, root, validate=False, pointer=f"{root}/previous")
    rows = A.resolved(spark.read.schema(R.MANIFEST_SCHEMA).csv(f"{root}/manifests"), f"{root}/manifests")
    cur = R.run_ids(fx.snapshot(inv, fx.CUR_DT)).select("run_id")
    return rows.join(cur, "run_id", "left_semi").select("bucket", "key", "version_id", "mode")


PART_LIMIT = 4096  # small files, so that the fixture's manifests have several


@register("combined_parts", O.with_ctes(O.INV, O.CLS, body=f"""
SELECT run_id, mode, part, count(*) AS row_count, sum(size)::BIGINT AS byte_count, min(line) AS first_line, max(line) AS last_line FROM (
  SELECT run_id, mode, line, size, CAST(floor((sum(size) OVER (PARTITION BY run_id, mode ORDER BY bucket, key, version_id) - size) / {PART_LIMIT}) AS INTEGER) AS part FROM (
    SELECT *, bucket || ',' || key || ',' || version_id AS line, strlen(bucket) + strlen(key) + strlen(version_id) + 3 AS size FROM (
      SELECT bucket, {O.enc('key')} AS key, version_id, object_lock_mode AS mode, {RUN_ID_SQL} AS run_id FROM classified
      WHERE superseder_kinds = 1 AND superseder_is_delete_marker AND object_lock_mode IN ('COMPLIANCE', 'GOVERNANCE'))))
GROUP BY run_id, mode, part"""))
def q_combined_parts(spark, d):
    """K3: the combined manifests, cut into files of a byte size, written and
    read back file by file."""
    path, inv = _scratch(spark, "combined"), _inv(spark, d)
    rows = E.manifest_rows(E.eligible(inv, "delete")).join(R.run_ids(inv), ["bucket", "dt"])
    K.write_combined(rows, path, PART_LIMIT)
    line = F.concat_ws(",", "bucket", "key", "version_id")
    return (spark.read.schema(R.COMBINED_SCHEMA).csv(path).groupBy("run_id", "mode", "part")
            .agg(F.count(F.lit(1)).alias("row_count"), F.sum(K.line_bytes()).cast("bigint").alias("byte_count"),
                 F.min(line).alias("first_line"), F.max(line).alias("last_line")))


def run_record_json(inv: DataFrame) -> DataFrame:
    """Query-complete records as JSON text, one per (bucket, dt) run, derived
    from the eligible counts. bucket-1's records lack the GOVERNANCE count;
    bucket-2's prev record is truncated (corrupt); bucket-0's prev record was
    delivered to another run's folder (``path_run_id``)."""
    elig = E.eligible(inv, "delete")
    counts = E.eligible_counts(inv, elig)
    runs = R.run_ids(inv)
    per_run = (counts.groupBy("bucket", "dt").agg(
        F.map_from_entries(F.collect_list(F.struct("object_lock_mode", "eligible_count"))).alias("rc")))
    rc = F.when(F.col("bucket") == "bucket-1", F.map_filter("rc", lambda k, v: k != "GOVERNANCE")).otherwise(F.col("rc"))
    rec = per_run.join(runs, ["bucket", "dt"]).select(
        "bucket", "dt", "run_id",
        F.to_json(F.struct(
            F.col("run_id"),
            F.regexp_replace("dt", r"^(\d{4}-\d{2}-\d{2})-(\d{2})-(\d{2})$", "$1T$2-$3Z").alias("dt"),
            F.col("bucket").alias("target_bucket"), F.lit("inv").alias("inventory_id"),
            F.array(F.lit("COMPLIANCE"), F.lit("GOVERNANCE")).alias("modes_succeeded"),
            rc.alias("row_counts"))).alias("json"))
    bad = (F.col("bucket") == "bucket-2") & (F.col("dt") == fx.PREV_DT)
    astray = (F.col("bucket") == "bucket-0") & (F.col("dt") == fx.PREV_DT)
    return rec.select(F.when(bad, F.substring("json", 1, 20)).otherwise(F.col("json")).alias("value"),
                      F.when(astray, "elsewhere").otherwise(F.col("run_id")).alias("path_run_id"))


@register("validate_run_records", O.with_ctes(O.INV, body=f"""
SELECT CASE WHEN corrupt THEN NULL ELSE run_id END AS run_id, CASE WHEN corrupt THEN NULL ELSE {_RAW_DT} END AS dt,
       NOT corrupt AND bucket <> 'bucket-1' AND NOT (bucket = 'bucket-0' AND dt = '{fx.PREV_DT}') AS valid,
       CASE WHEN corrupt THEN 'corrupt_record,invalid_run_id,invalid_dt,missing_target_bucket,missing_inventory_id,missing_modes_succeeded,missing_mode_count'
            WHEN bucket = 'bucket-0' AND dt = '{fx.PREV_DT}' THEN 'run_id_mismatch'
            WHEN bucket = 'bucket-1' THEN 'missing_mode_count' ELSE '' END AS problems
FROM (SELECT DISTINCT bucket, dt, substr(sha256(bucket || '/' || dt), 1, 16) AS run_id,
             bucket = 'bucket-2' AND dt = '{fx.PREV_DT}' AS corrupt FROM inv)"""))
def q_validate_run_records(spark, d):
    """S6 round trip: records written as JSON text, read PERMISSIVE with an
    explicit schema, checked rule by rule."""
    path = _scratch(spark, "records")
    run_record_json(_inv(spark, d)).write.partitionBy("path_run_id").text(path)
    v = SR.validate_run_records(SR.read_run_records(spark, path).withColumn(
        "path_run_id", F.regexp_extract(F.col("_metadata.file_path"), "path_run_id=([^/]*)/", 1)).drop("_metadata"))
    return v.select("run_id", "dt", "valid", F.array_join("problems", ",").alias("problems"))


@register("scan_delivery", O.with_ctes(O.INV, body=f"SELECT {', '.join(INV_COLS)} FROM inv"))
def q_scan_delivery(spark, d):
    """S1 round trip: both snapshots written in the delivery layout (flat data
    folders plus a per-dt listing), then read back in one Parquet scan with
    each row's dt restored from its file."""
    from ..sources.inventory import read_inventory, write_delivery
    root = _scratch(spark, "delivery")
    inv = _inv(spark, d)
    for dt in (fx.PREV_DT, fx.CUR_DT):
        write_delivery(fx.snapshot(inv, dt), root, dt)
    return read_inventory(spark, root, [fx.PREV_DT, fx.CUR_DT]).select(*INV_COLS)
