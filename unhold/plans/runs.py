"""Entry points 1 and 2 as Spark jobs over many buckets and snapshots.

``decision_inputs`` turns one classification into the per (run, mode) rows the
ladder reads; ``run_snapshot`` is the whole batch job: classify once, write the
classified table (a durable lineage cut in the shared folder), then derive
manifests, diagnostics, counts, decisions, the dedup pointer and the sentinel
from it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import identity_token
from ..operators import classify as C
from ..operators import decide as D
from ..operators import eligibility as E
from ..schemas import LOCK_MODES
from ..sources import attempts as A
from ..sources import sinks as K
from ..sources.paths import table_exists
from ..sources.records import read_published


def run_ids(inv: DataFrame) -> DataFrame:
    """One run per (bucket, dt) snapshot; the run id is 16 hex digits of a
    SHA-256 of bucket/dt (deterministic, so a replay gets the same id)."""
    return (inv.select("bucket", "dt").distinct()
            .withColumn("run_id", F.substring(F.sha2(F.concat_ws("/", "bucket", "dt"), 256), 1, 16)))


def fixture_config(inv: DataFrame, bucket1_threshold: int = 100) -> DataFrame:
    """Per-bucket configuration of the fixture: bucket-2 runs report-only,
    bucket-1 has a low threshold, the rest the default of 1,000."""
    b = inv.select("bucket").distinct()
    return b.select(
        "bucket",
        F.lit("delete").alias("release_mode"),
        (F.col("bucket") == "bucket-2").alias("report_only"),
        F.when(F.col("bucket") == "bucket-1", F.lit(bucket1_threshold)).otherwise(F.lit(1000)).cast("bigint").alias("safety_threshold"),
    )


def combined_key():
    return F.concat(F.lit("manifests/combined/"), F.col("run_id"), F.lit("/"), F.col("mode"), F.lit("/manifest.csv"))


def manifests_ready(manifests: DataFrame) -> DataFrame:
    """The manifests-ready record of manifests without a combined form: one row
    per (run, mode) that has rows."""
    return manifests.select("run_id", "mode").distinct().select(
        "run_id", "mode", combined_key().alias("manifest_key"), F.lit(True).alias("manifest_exists"), F.lit(True).alias("recounted"))


def ready_record(combined: DataFrame) -> DataFrame:
    """The manifests-ready record of combined manifests as written (K3): the key
    and the list of parts, in order, with their rows and bytes."""
    parts = combined.groupBy("run_id", "mode", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum(K.line_bytes()).alias("bytes"))
    # a list has one entry for each file of a manifest
    return (parts.groupBy("run_id", "mode").agg(F.array_sort(F.collect_list(F.struct("part", "rows", "bytes"))).alias("parts"))
            .select("mode", combined_key().alias("manifest_key"), "parts", "run_id"))


def ready_evidence(ready: DataFrame, combined: DataFrame) -> DataFrame:
    """Whether each listed manifest is there: every part of its list is found
    with as many rows as the list says."""
    found = combined.groupBy("run_id", "mode", "part").agg(F.count(F.lit(1)).alias("found"))
    listed = ready.select("run_id", "mode", "manifest_key", F.explode("parts").alias("p")).select("run_id", "mode", "manifest_key", F.col("p.part").alias("part"), F.col("p.rows").alias("rows"))
    return (listed.join(found, ["run_id", "mode", "part"], "left").groupBy("run_id", "mode", "manifest_key")
            .agg(F.every(F.coalesce(F.col("found") == F.col("rows"), F.lit(False))).alias("manifest_exists"))
            .withColumn("recounted", F.lit(True)))


def decision_inputs(inv: DataFrame, eligible_rows: DataFrame, config: DataFrame, manifests: DataFrame,
                    ready: DataFrame | None = None, runs: DataFrame | None = None,
                    submissions: DataFrame | None = None) -> DataFrame:
    """Rows for D1: trigger counts from A4, verified counts re-counted from
    the manifests as written (J6), the manifests-ready record, per-bucket
    config. Where a manifest is not listed or gone there is nothing to count
    and its own rung reports it; a listed one whose re-count failed
    (``recounted`` false) has a NULL verified count. ``submissions`` holds what the
    job service answered (run_id, mode, submit_error: NULL where it took the job)."""
    runs = run_ids(inv) if runs is None else runs
    counts = E.eligible_counts(runs, eligible_rows).withColumnRenamed("object_lock_mode", "mode")
    per_run = counts.join(runs, ["bucket", "dt"])
    expected = per_run.select("run_id", "bucket", "dt", "mode", F.col("eligible_count").alias("trigger_count"))
    rec = (D.count_reconciliation(expected, manifests.select("run_id", "mode"))
           .join(manifests_ready(manifests) if ready is None else ready, ["run_id", "mode"], "left"))
    there = F.coalesce("manifest_exists", F.lit(False))  # false too where no row lists it
    if submissions is None:
        rec = rec.withColumn("submit_error", F.lit(None).cast("string"))
    else:
        rec = rec.join(submissions.select("run_id", "mode", "submit_error"), ["run_id", "mode"], "left")
    return (rec.join(config, "bucket", "left").select(
        "run_id", "bucket", "dt", "mode", "trigger_count",
        F.concat(F.lit("q-"), F.col("run_id"), F.lit("-"), F.col("mode")).alias("count_query_id"),
        identity_token("run_id", "mode", F.lit("count")).alias("count_hash"),
        F.when(~there, F.col("trigger_count")).when(F.col("recounted"), F.coalesce("verified_count", F.lit(0).cast("bigint")))
         .alias("verified_count"),
        F.col("manifest_exists").isNotNull().alias("manifest_listed"),
        "manifest_key",
        there.alias("manifest_exists"),
        "submit_error",
        "report_only", "safety_threshold",
    ))


def query_complete_records(runs: DataFrame, counts: DataFrame, withheld_counts: DataFrame) -> DataFrame:
    """One query-complete record per run: counts per lock mode (a real 0
    included), the withheld count, and the count evidence the ladder checks.
    Per-run maps hold the two lock modes only."""
    per_run = (counts.groupBy("bucket", "dt").agg(
        F.map_from_entries(F.collect_list(F.struct("object_lock_mode", "eligible_count"))).alias("row_counts")))
    ids = F.transform(F.map_keys("row_counts"), lambda m: F.struct(m, F.concat(F.lit("q-"), F.col("run_id"), F.lit("-"), m)))
    hashes = F.transform(F.map_keys("row_counts"),
                         lambda m: F.struct(m, F.sha2(F.concat_ws("/", F.col("run_id"), m, F.lit("count")), 256)))
    return (per_run.join(runs, ["bucket", "dt"]).join(withheld_counts, ["bucket", "dt"], "left")
            .select("run_id",
                    F.regexp_replace("dt", r"^(\d{4}-\d{2}-\d{2})-(\d{2})-(\d{2})$", "$1T$2-$3Z").alias("dt"),
                    F.col("bucket").alias("target_bucket"), F.lit("inv").alias("inventory_id"),
                    F.array_sort(F.map_keys("row_counts")).alias("modes_succeeded"), "row_counts",
                    F.coalesce("withheld_count", F.lit(0).cast("bigint")).alias("withheld_candidate_count"),
                    (F.coalesce("withheld_count", F.lit(0)) > 0).alias("withheld_manifest_written"),
                    F.map_from_entries(ids).alias("count_query_execution_ids"),
                    F.map_from_entries(hashes).alias("count_query_hashes")))


def lineage_manifest(spark: SparkSession, pointer: str, runs: DataFrame) -> DataFrame | None:
    """The dedup rows of each run: the manifest of the published run of the same
    (bucket, mode) with the latest snapshot before the run's own. A run is so
    never compared with its own manifest, nor with a later one, when it is
    replayed after the pointer went on. Rows carry the run's ``dt``."""
    if not table_exists(spark, f"{pointer}_log"):
        return None
    log = spark.read.parquet(f"{pointer}_log").select("bucket", "mode", F.col("dt").alias("_dt"), F.col("run_id").alias("_of"))
    before = (runs.select("bucket", "dt").join(log, "bucket").where(F.col("_dt") < F.col("dt"))
              .groupBy("bucket", "dt", "mode").agg(F.max_by("_of", F.struct("_dt", "_of")).alias("run_id")))
    return read_published(spark, pointer).join(before, ["bucket", "mode", "run_id"]).select("bucket", "key", "version_id", "mode", "dt")


MANIFEST_SCHEMA = "bucket string, key string, version_id string, run_id string, mode string"
COMBINED_SCHEMA = "bucket string, key string, version_id string, run_id string, mode string, part int"

#: Each output's sub-folder of a run.
FOLDERS = {"classified": "bucket={bucket}/dt={dt}", "eligible": "bucket={bucket}/dt={dt}", "manifests": "run_id={run_id}", "combined": "run_id={run_id}",
           "ready": "run_id={run_id}", "withheld": "target={bucket}/dt={raw}"}


def run_snapshot(spark: SparkSession, inv: DataFrame, config: DataFrame, out_root: str,
                 previous_manifest: DataFrame | None = None, validate: bool = True,
                 decide_inline: bool = True, pointer: str | None = None, part_bytes: int = K.PART_BYTES,
                 submissions: DataFrame | None = None) -> dict:
    """The batch job of one cadence over every bucket/snapshot in ``inv``.

    Writes under ``out_root``, each in a folder of this attempt: classified/
    (Parquet, the lineage cut), eligible/, manifests/ (CSV per run/mode),
    combined/ (the sorted manifest cut into files of ``part_bytes``), ready/
    (which manifests are finished, with their parts), withheld/ (CSV per bucket
    and raw dt); then the commit row, by which readers find them. After that:
    records/, decisions/, active_jobs/ (what completion waits for), previous/
    (dedup pointer, created modes only), runs/ (sentinel, last). A job that dies
    leaves what was committed before; its replay is a new attempt.

    ``previous_manifest`` holds versions not to be released again; ``pointer``
    names a published dedup pointer, of which each run takes its predecessor.
    ``submissions``: the job service's answers, see ``decision_inputs``.
    """
    D.validate_config(config)
    if validate:
        C.assert_unique_versions(inv)
    attempt = uuid.uuid4().hex

    def at(name: str) -> str:
        return A.attempt_path(out_root, name, attempt)

    # one row per (bucket, snapshot) of this cadence; later steps read these, not the inventory
    own = [(r.bucket, r.dt, r.run_id) for r in run_ids(inv).collect()]
    runs = spark.createDataFrame(own, "bucket string, dt string, run_id string")
    A.begin(out_root, attempt, runs)
    classified = C.classify_versions(inv)
    classified.write.partitionBy("bucket", "dt").parquet(at("classified"))
    cls = spark.read.schema(classified.schema).parquet(at("classified"))
    # each bucket's own release mode, in one filter over the classified table
    # (it holds every candidate, so `either` needs no classification columns).
    # A bucket without a configuration selects nothing here and is withheld as
    # ``missing_configuration`` by the ladder
    release = config.select("bucket", "release_mode")
    rm = F.col("release_mode")
    unanimous = F.col("superseder_kinds") == 1
    selected = ((rm == "either")
                | ((rm == "delete") & unanimous & (F.col("superseder_is_delete_marker") == F.lit(True)))
                | ((rm == "overwrite") & unanimous & (F.col("superseder_is_delete_marker") == F.lit(False))))
    elig = (cls.join(release, "bucket", "left").where(selected & F.col("object_lock_mode").isin(LOCK_MODES))
            .select(*E.ELIGIBLE_COLS))
    if previous_manifest is not None:
        elig = E.dedup(elig, previous_manifest)
    lineage = lineage_manifest(spark, pointer, runs) if pointer else None
    if lineage is not None:
        elig = E.dedup(elig, lineage)
    # manifests and counts read one stored result, so the dedup joins run once
    elig.write.partitionBy("bucket", "dt").parquet(at("eligible"))
    elig = spark.read.schema(elig.schema).parquet(at("eligible"))
    K.write_manifest(E.manifest_rows(elig).join(runs, ["bucket", "dt"]), at("manifests"))
    written = spark.read.schema(MANIFEST_SCHEMA).csv(at("manifests"))
    K.write_combined(written, at("combined"), part_bytes)
    combined = spark.read.schema(COMBINED_SCHEMA).csv(at("combined"))
    # what the manifest stage finished: the decision stream trusts no manifest that is not listed here
    ready = ready_record(combined)
    ready.write.partitionBy("run_id").parquet(at("ready"))
    wh = E.withheld(inv, cls).withColumn(
        "dt_raw", F.regexp_replace("dt", r"^(\d{4}-\d{2}-\d{2})-(\d{2})-(\d{2})$", "$1T$2-$3Z"))
    K.write_withheld(wh, at("withheld"))
    A.commit(spark, out_root, attempt, runs)

    # the stage's query-complete records (entry point 2 starts from them)
    counts = E.eligible_counts(runs, elig)
    query_complete_records(runs, counts, E.withheld_count(runs, cls)) \
        .write.mode("append").json(f"{out_root}/records")
    if decide_inline:
        evidence = ready_evidence(spark.read.schema(ready.schema).parquet(at("ready")), combined)
        inputs = decision_inputs(inv, elig, config, manifests=written, ready=evidence, runs=runs, submissions=submissions)
        decisions = D.decide(inputs).withColumn("decided_at", F.current_timestamp().cast("timestamp_ntz"))
        K.append_decisions(decisions, f"{out_root}/decisions", attempt)
        dec = spark.read.parquet(f"{out_root}/decisions").where(F.col("attempt") == attempt)
        K.append_active_jobs(D.active_jobs(dec), f"{out_root}/active_jobs")
        K.publish_previous_manifest(written, dec, f"{out_root}/previous")
    K.mark_complete(spark, f"{out_root}/runs", runs)
    A.retire(spark, out_root, runs, FOLDERS)
    return {"classified": f"{out_root}/classified", "manifests": f"{out_root}/manifests", "combined": f"{out_root}/combined",
            "decisions": f"{out_root}/decisions", "withheld": f"{out_root}/withheld",
            "records": f"{out_root}/records", "ready": f"{out_root}/ready", "active_jobs": f"{out_root}/active_jobs",
            "previous": f"{out_root}/previous", "runs": f"{out_root}/runs", "commits": f"{out_root}/commits"}
