"""Explicit schemas and fixed vocabulary.

Every reader uses an explicit ``StructType``; nothing is inferred. CSV tables
bind by position, so the field order here is load-bearing.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values (must equal the original tool's for identical results) ---
LOCK_MODES = ["COMPLIANCE", "GOVERNANCE"]
RELEASE_MODES = ["delete", "overwrite", "either"]
HOLD_ON = "ON"
REASON_TIED_PEER = "tied_noncurrent_peer"
REASON_AMBIGUOUS = "ambiguous_successor_classification"
TERMINAL_STATUSES = ["Complete", "Cancelled", "Failed"]
REQUIRED_INVENTORY_COLUMNS = [
    "key", "version_id", "is_latest", "is_delete_marker",
    "last_modified_date", "object_lock_mode", "object_lock_event_hold_status",
]
OPTIONAL_INVENTORY_COLUMNS = [
    "bucket", "size", "object_lock_retain_until_date", "object_lock_legal_hold_status",
]
# Delivery dt as it appears in the delivery path (YYYY-MM-DDThh-mmZ), and the
# hex event sequencer / run id (1 to 64 hex digits). `\z` not `\Z`: in Java
# regex `\Z` also accepts a trailing newline.
DT_RAW_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}-[0-9]{2}Z\z"
RUN_ID_PATTERN = r"^[0-9A-Fa-f]{1,64}\z"
# Field declarations inside a Parquet message schema: repetition, type, name
# (the name is group 2).
PARQUET_FIELD_PATTERN = r"\b(?:required|optional|repeated)\s+(\w+)\s+(\w+)"
# Retention of working artifacts by path prefix (days; None = never expires).
RETENTION_RULES = [
    ("inventory/", 14),
    ("manifests/parts/", 14),
    ("athena-results/", 14),
    ("manifests/combined/", 90),
    ("reports/", 90),
    ("diagnostics/withheld-candidates/", 90),
    ("manifests/previous/", None),
]
# Illustrative list prices used by the cost examples (USD).
RATE_CARD = [
    ("inventory_listing", "per million versions listed", 0.0025),
    ("query_scan", "per TB scanned", 5.00),
    ("batch_job", "per job", 0.25),
    ("batch_objects", "per million objects processed", 1.00),
    ("put_requests", "per thousand requests", 0.005),
]
# Text formats of the run summary and the completion outcome (printf style,
# filled with format_string; a "%s" right after a noun is its plural "s").
TEXT_RUN_HEADER = "Run %s against %s (inventory %s), %s mode."
TEXT_NO_MODES = "No modes were evaluated for this run."
TEXT_MODE_CREATED = "%s: released %s event hold%s (job %s)."
TEXT_MODE_SUSPENDED = "%s: found %s eligible version%s, job %s created suspended for review (report-only) -- nothing released."
TEXT_MODE_SKIPPED = "%s: no eligible versions this run."
TEXT_MODE_OVER_THRESHOLD = "%s: WITHHELD -- %s eligible versions exceeds SafetyThreshold (%s); no job created, review and re-run to proceed."
# our own wording of these three: the re-count is of the manifest files, not of a query service
TEXT_MODE_COUNT_MISMATCH = "%s: WITHHELD -- eligibility count mismatch (query %s vs manifest %s); no job created."
TEXT_MODE_CREATE_FAILED = "%s: WITHHELD -- job creation failed (%s)."
TEXT_MODE_UNSUPPORTED = "%s: WITHHELD -- the job service does not accept the event hold parameter, so no job was created; these versions stay eligible."
TEXT_MODE_WITHHELD = "%s: WITHHELD -- %s."
TEXT_JOBS_PENDING = "%s job%s pending"
TEXT_JOBS_WITHHELD_FIRST = "%s job%s withheld"
TEXT_JOBS_WITHHELD_MORE = "%s withheld"
TEXT_VERSIONS = "%s version%s"
TEXT_NOTHING_ELIGIBLE = "nothing eligible"
TEXT_NO_MODES_EVALUATED = "no modes evaluated"
TEXT_REPORT_ONLY_TAG = " [Report-Only]"
TEXT_RELEASED_WITH_FAILURES = "%s of %s version%s released, %s failed"
TEXT_RELEASED = "%s version%s released"
TEXT_JOBS_NOT_COMPLETE = "%s job%s did not complete"
TEXT_NOTHING_RELEASED = "finished, nothing released"
TEXT_RECAP_HEADER = "Run %s against %s (inventory %s) -- active mode, all jobs finished."
TEXT_RECAP_RELEASED = "%s: released %s of %s event hold%s (job %s)."
TEXT_RECAP_FAILURES = "%s: released %s of %s event holds, %s failed -- see reports/%s/%s/ for details (job %s)."
TEXT_RECAP_ENDED = "%s: job %s ended %s -- %s."
TEXT_RECAP_NO_REASON = "see job details"
# ---------------------------------------------------------------------------

INVENTORY = T.StructType([
    T.StructField("bucket", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("version_id", T.StringType()),
    T.StructField("is_latest", T.BooleanType()),
    T.StructField("is_delete_marker", T.BooleanType()),
    T.StructField("size", T.LongType()),
    T.StructField("last_modified_date", T.TimestampNTZType()),
    T.StructField("object_lock_retain_until_date", T.TimestampNTZType()),
    T.StructField("object_lock_mode", T.StringType()),
    T.StructField("object_lock_legal_hold_status", T.StringType()),
    T.StructField("object_lock_event_hold_status", T.StringType()),
])

# Headerless, positional: bucket, url-encoded key, version id.
MANIFEST_CSV = T.StructType([
    T.StructField("bucket", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("version_id", T.StringType()),
])

# Headerless, positional withheld diagnostic rows.
WITHHELD_CSV = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("version_id", T.StringType()),
    T.StructField("object_lock_mode", T.StringType()),
    T.StructField("last_modified_date", T.StringType()),
    T.StructField("reason", T.StringType()),
])

DELIVERY_MANIFEST = T.StructType([
    T.StructField("sourceBucket", T.StringType()),
    T.StructField("destinationBucket", T.StringType()),
    T.StructField("fileFormat", T.StringType()),
    T.StructField("fileSchema", T.StringType()),
    T.StructField("creationTimestamp", T.StringType()),
])

QUERY_COMPLETE = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("dt", T.StringType()),
    T.StructField("target_bucket", T.StringType()),
    T.StructField("inventory_id", T.StringType()),
    T.StructField("modes_succeeded", T.ArrayType(T.StringType())),
    T.StructField("row_counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("withheld_candidate_count", T.LongType()),
    T.StructField("withheld_manifest_written", T.BooleanType()),
    T.StructField("query_execution_ids", T.MapType(T.StringType(), T.StringType())),
    T.StructField("count_query_execution_ids", T.MapType(T.StringType(), T.StringType())),
    T.StructField("count_query_hashes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("withheld_count_hash", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

JOB_EVENT = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("detail-type", T.StringType()),
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("detail", T.StructType([
        T.StructField("eventSource", T.StringType()),
        T.StructField("eventName", T.StringType()),
        T.StructField("serviceEventDetails", T.StructType([
            T.StructField("jobId", T.StringType()),
            T.StructField("status", T.StringType()),
        ])),
    ])),
])
