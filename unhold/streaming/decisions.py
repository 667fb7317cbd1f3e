"""Entry point 2 as a stream (T-2 for run records, D1, J6, K4, K6).

Query-complete records (one JSON document per run, written by the batch job)
arrive as files, at least once. The stream reads them with an explicit schema
(PERMISSIVE, corrupt rows kept), validates them (S6: invalid records go to a
quarantine table, each of them, and never block a corrected successor), and per
micro-batch keeps one valid record of each run, re-counts the run's written
manifests (J6), takes their listing from the manifests-ready record, runs the
ladder and appends only decisions whose token is new: the first claim of a run
holds, however late a record or batch is replayed.
The dedup pointer is published from the new ``created`` decisions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import raw_dt_to_dashed
from ..operators import decide as D
from ..plans.runs import manifests_ready
from ..schemas import LOCK_MODES, QUERY_COMPLETE
from ..sources import sinks as K
from ..sources.attempts import resolved
from ..sources.paths import table_exists
from ..sources.records import validate_run_records

MANIFEST_SCHEMA = "bucket string, key string, version_id string, run_id string, mode string"


def _ready(spark: SparkSession, path: str | None, manifests: DataFrame) -> DataFrame:
    """(run_id, mode, manifest_key) of the finished manifests; without a record
    kept (``path`` None), those that have rows."""
    if path is None:
        return manifests_ready(manifests).select("run_id", "mode", "manifest_key")
    schema = "mode string, manifest_key string, run_id string"
    if not table_exists(spark, path):
        return spark.createDataFrame([], schema)
    return resolved(spark.read.schema(schema).parquet(path), path).select("run_id", "mode", "manifest_key")


def decision_batch(spark: SparkSession, batch: DataFrame, manifests_path: str, config: DataFrame,
                   out_root: str, ready_path: str | None = None, submissions: DataFrame | None = None) -> None:
    checked = validate_run_records(batch)
    K.append_once(checked.where(~F.col("valid")).select("run_id", "dt", F.array_join("problems", ",").alias("problems"), "_corrupt_record"),
                  f"{out_root}/quarantine", ["run_id", "dt", "problems", "_corrupt_record"])
    recs = checked.where(F.col("valid")).dropDuplicates(["run_id"])
    rows = recs.select(
        "run_id", F.col("target_bucket").alias("bucket"), raw_dt_to_dashed("dt").alias("dt"),
        F.explode(F.array(*[F.lit(m) for m in LOCK_MODES])).alias("mode"),
        "row_counts", "count_query_execution_ids", "count_query_hashes")
    man = (resolved(spark.read.schema(MANIFEST_SCHEMA).csv(manifests_path), manifests_path)
           .join(rows.select("run_id").distinct(), "run_id", "left_semi"))
    recount = man.groupBy("run_id", "mode").agg(F.count(F.lit(1)).alias("recount"))
    ready = _ready(spark, ready_path, man)
    answers = (rows.select("run_id", "mode", F.lit(None).cast("string").alias("submit_error")) if submissions is None
               else submissions.select("run_id", "mode", "submit_error"))
    inputs = (rows.join(answers, ["run_id", "mode"], "left").join(recount, ["run_id", "mode"], "left").join(ready, ["run_id", "mode"], "left")
              .join(config, "bucket", "left").select(
        "run_id", "bucket", "dt", "mode",
        F.col("row_counts")[F.col("mode")].alias("trigger_count"),
        F.col("count_query_execution_ids")[F.col("mode")].alias("count_query_id"),
        F.col("count_query_hashes")[F.col("mode")].alias("count_hash"),
        # a manifest that is not listed, or gone, has nothing to count: its own rung reports it
        F.coalesce(F.when(F.col("manifest_key").isNotNull(), F.col("recount")),
                   F.col("row_counts")[F.col("mode")]).alias("verified_count"),
        F.col("manifest_key").isNotNull().alias("manifest_listed"),
        "manifest_key",
        F.col("recount").isNotNull().alias("manifest_exists"),
        "submit_error",
        "report_only", "safety_threshold"))
    dec = D.decide(inputs).withColumn("decided_at", F.current_timestamp().cast("timestamp_ntz"))
    path = f"{out_root}/decisions"
    if table_exists(spark, path):
        dec = dec.join(spark.read.parquet(path).select("decision_token"), "decision_token", "left_anti")
    K.append_decisions(dec, path, uuid.uuid4().hex)
    # each step takes what the history holds for the batch's runs and its own
    # output does not: whatever a killed attempt left undone, its replay does
    held = spark.read.parquet(path).join(recs.select("run_id").distinct(), "run_id", "left_semi")
    K.append_active_jobs(D.active_jobs(held), f"{out_root}/active_jobs")
    K.publish_previous_manifest(man, held, f"{out_root}/previous")


def start(spark: SparkSession, records_path: str, manifests_path: str, config: DataFrame, out_root: str,
          available_now: bool = True, ready_path: str | None = None, submissions: DataFrame | None = None):
    """``submissions``: the job service's answers (run_id, mode, submit_error), or
    a function that reads them for every batch."""
    src = (spark.readStream.schema(QUERY_COMPLETE).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(records_path))
    trig = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    return (src.writeStream
            .foreachBatch(lambda df, _bid: decision_batch(spark, df, manifests_path, config, out_root, ready_path,
                                                           submissions() if callable(submissions) else submissions))
            .option("checkpointLocation", f"{out_root}/_ckpt/decisions")
            .trigger(**trig).start())
