"""Structured Streaming with availableNow: duplicates, out-of-order events,
restart from checkpoint, one emission per run."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF
from unhold import fixtures as fx
from unhold.operators import completion as J
from unhold.streaming import completion as SC
from unhold.streaming import deliveries as SD
from unhold.sources.inventory import write_delivery
from unhold.plans.oracle import DELIVERY_FIELDS


def _write_events(df, path):
    df.select("job_id", "event_status", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss").alias("event_time"),
              "bucket").write.mode("append").json(path)


def test_completion_stream_matches_batch(spark, tmp):
    ev = fx.job_events(spark, SF)
    jobs, recs, rj = fx.jobs(spark, SF), fx.run_records(spark, SF), fx.record_jobs(spark, SF)
    # two arrivals: later half first (out of order), then everything again (duplicates)
    _write_events(ev.where(F.col("event_time") >= "1998-01-01"), f"{tmp}/events")
    out = f"{tmp}/out"
    for q in SC.start(spark, f"{tmp}/events", jobs, recs, rj, out, fx.OUR_TAG):
        q.awaitTermination()
    first_count = spark.read.parquet(f"{out}/completion_sent").count()
    _write_events(ev, f"{tmp}/events")
    for q in SC.start(spark, f"{tmp}/events", jobs, recs, rj, out, fx.OUR_TAG):  # restart from checkpoint
        q.awaitTermination()
    sent = spark.read.parquet(f"{out}/completion_sent")
    assert sent.count() >= first_count
    assert sent.groupBy("run_id").count().where(F.col("count") > 1).count() == 0  # one emission per run
    routed = J.route_events(ev, jobs, recs, rj, fx.OUR_TAG)
    batch = J.run_outcome(J.first_terminal(routed).where(F.col("route") == "accepted"), recs).where("complete")
    cols = ["run_id", "released", "failed", "jobs_not_complete", "outcome"]
    assert sent.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert batch.select(*cols).exceptAll(sent.select(*cols)).count() == 0
    alarm = spark.read.parquet(f"{out}/missing_record_alarm")
    assert alarm.count() > 0


def test_decisions_to_completion(spark, tmp):
    """Active jobs of a batch run and nested events end in one completion per run."""
    from unhold.plans.catalog import nested_events
    from unhold.plans.runs import run_snapshot
    inv = fx.inventory(spark, SF).where(F.col("bucket") == "bucket-0")
    cfg = spark.createDataFrame([("bucket-0", "delete", False, 1000)],
                                "bucket string, release_mode string, report_only boolean, safety_threshold bigint")
    for _ in range(2):  # a replay adds no job
        paths = run_snapshot(spark, inv, cfg, f"{tmp}/batch")
    active = spark.read.parquet(paths["active_jobs"])
    n = active.count()
    assert n > 0 and active.select("job_id").distinct().count() == n
    jobs = active.select("job_id", F.lit("Complete").alias("status"), F.lit(3).cast("long").alias("succeeded"),
                         F.lit(0).cast("long").alias("failed"), F.lit(3).cast("long").alias("total"),
                         F.lit(None).cast("string").alias("failure_reason"), F.lit(fx.OUR_TAG).alias("tag_created_by"),
                         F.col("run_id").alias("tag_run_id"))
    events = active.select("job_id", F.lit("Complete").alias("event_status"), F.to_timestamp_ntz(F.lit("2024-02-02 00:00:00")).alias("event_time"))
    nested_events(events).unionByName(spark.createDataFrame([("{broken",), ("{}",)], "value string")).write.text(f"{tmp}/events")
    for q in SC.start(spark, f"{tmp}/events", jobs, lambda: J.active_records(active), lambda: active.select("run_id", "job_id"),
                      f"{tmp}/out", fx.OUR_TAG, nested=True):
        q.awaitTermination()
    sent = spark.read.parquet(f"{tmp}/out/completion_sent")
    assert {r.run_id for r in sent.collect()} == {r.run_id for r in active.collect()}
    assert sent.agg(F.sum("released")).first()[0] == 3 * n


def test_delivery_stream_runs_once_per_delivery(spark, tmp):
    inv = fx.inventory(spark, SF).where(F.col("bucket") == "bucket-0")
    data_root, man_root, out = f"{tmp}/data", f"{tmp}/manifests", f"{tmp}/out"
    cfg = spark.createDataFrame([("bucket-0", "delete", False, 1000)],
                                "bucket string, release_mode string, report_only boolean, safety_threshold bigint")
    schema = "message s3.inventory { " + " ".join(DELIVERY_FIELDS) + " }"
    for dt in (fx.PREV_DT, fx.CUR_DT):
        write_delivery(fx.snapshot(inv, dt), f"{data_root}/bucket-0", dt)
        raw = f"{dt[:10]}T{dt[11:13]}-{dt[14:16]}Z"
        d = f"{man_root}/bucket-0/inv/{raw}"
        os.makedirs(d, exist_ok=True)
        with open(f"{d}/manifest.json", "w") as fh:
            json.dump({"fileFormat": "Parquet", "fileSchema": schema}, fh)
    SD.start(spark, man_root, data_root, cfg, out).awaitTermination()
    SD.start(spark, man_root, data_root, cfg, out).awaitTermination()  # restart: nothing new
    runs = spark.read.parquet(f"{out}/runs")
    assert runs.count() == 2
    man = spark.read.schema("bucket string, key string, version_id string, run_id string, mode string") \
        .csv(f"{out}/manifests")
    from unhold.operators.eligibility import eligible
    assert man.count() == eligible(inv, "delete").count()


def test_decision_stream_matches_inline_and_replays_to_nothing(spark, tmp):
    from unhold.plans.runs import fixture_config, run_snapshot
    from unhold.streaming import decisions as SDec
    inv = fx.inventory(spark, SF)
    cfg = fixture_config(inv)
    out = run_snapshot(spark, inv, cfg, f"{tmp}/batch", decide_inline=False)
    dout = f"{tmp}/dec"
    SDec.start(spark, out["records"], out["manifests"], cfg, dout, ready_path=out["ready"]).awaitTermination()
    got = spark.read.parquet(f"{dout}/decisions")
    inline = spark.read.parquet(run_snapshot(spark, inv, cfg, f"{tmp}/inline")["decisions"])
    cols = ["decision_token", "run_id", "mode", "outcome", "verified_count"]
    assert got.count() == 12
    assert got.select(*cols).exceptAll(inline.select(*cols)).count() == 0
    # the batch job replays (records written again): nothing new is decided
    run_snapshot(spark, inv, cfg, f"{tmp}/batch", decide_inline=False)
    SDec.start(spark, out["records"], out["manifests"], cfg, dout, ready_path=out["ready"]).awaitTermination()
    assert spark.read.parquet(f"{dout}/decisions").count() == 12
    from unhold.sources.records import read_previous_manifest
    created = got.where(F.col("outcome") == "created").select("bucket", "mode").distinct().count()
    assert read_previous_manifest(spark, f"{dout}/previous").select("bucket", "mode").distinct().count() == created


def test_decisions_trust_listed_manifests_only(spark, tmp):
    """Of one run's two manifests, one is not listed and the other listed under
    a foreign key; of another run, both are listed but one is gone."""
    from unhold.plans.runs import run_snapshot
    from unhold.schemas import QUERY_COMPLETE
    from unhold.streaming.decisions import decision_batch
    inv = fx.inventory(spark, SF).where(F.col("bucket") == "bucket-0")
    cfg = spark.createDataFrame([("bucket-0", "delete", False, 100000)],
                                "bucket string, release_mode string, report_only boolean, safety_threshold bigint")
    out = run_snapshot(spark, inv, cfg, f"{tmp}/batch", decide_inline=False)
    ready = spark.read.schema("mode string, manifest_key string, run_id string").parquet(out["ready"])
    first, second = sorted({r.run_id for r in ready.collect()})
    damaged = ready.where(~((F.col("run_id") == first) & (F.col("mode") == "GOVERNANCE"))).withColumn(
        "manifest_key", F.when(F.col("run_id") == first, "manifests/combined/elsewhere/manifest.csv").otherwise(F.col("manifest_key")))
    damaged.write.partitionBy("run_id").parquet(f"{tmp}/ready")
    man = spark.read.schema("bucket string, key string, version_id string, run_id string, mode string").csv(out["manifests"])
    (man.where(~((F.col("run_id") == second) & (F.col("mode") == "COMPLIANCE"))).write.partitionBy("run_id", "mode").csv(f"{tmp}/manifests"))
    recs = spark.read.schema(QUERY_COMPLETE).json(out["records"])
    decision_batch(spark, recs, f"{tmp}/manifests", cfg, f"{tmp}/dec", f"{tmp}/ready")
    got = {(r.run_id, r.mode): r.reason or r.outcome for r in spark.read.parquet(f"{tmp}/dec/decisions").collect()}
    assert got == {(first, "GOVERNANCE"): "positive_count_without_manifest", (first, "COMPLIANCE"): "invalid_manifest_key",
                   (second, "COMPLIANCE"): "manifest_not_found", (second, "GOVERNANCE"): "created"}
