"""Re-runs, missing configuration, replays and bad input must fail closed."""

from pyspark.sql import functions as F

from conftest import SF
from test_ladder import SCHEMA, row
from unhold import fixtures as fx
from unhold.operators import review as RV
from unhold.operators.classify import classify_versions
from unhold.operators.decide import decide
from unhold.plans.runs import fixture_config, run_snapshot
from unhold.sources import sinks as K
from unhold.sources.inventory import read_inventory, write_delivery
from unhold.sources.records import read_previous_manifest

MANIFEST = "bucket string, key string, version_id string, run_id string, mode string"


def _inv(spark):
    return fx.inventory(spark, SF).where((F.col("bucket") == "bucket-0") & (F.col("dt") == fx.CUR_DT))


def test_rerun_that_shrinks_leaves_nothing_behind(spark, tmp):
    inv = _inv(spark).persist()
    cfg = spark.createDataFrame([("bucket-0", "delete", False, 100000)],
                                "bucket string, release_mode string, report_only boolean, safety_threshold bigint")
    out = run_snapshot(spark, inv, cfg, f"{tmp}/r")
    assert spark.read.schema(MANIFEST).csv(out["manifests"]).count() > 0
    run_snapshot(spark, inv.withColumn("object_lock_event_hold_status", F.lit("OFF")), cfg, f"{tmp}/r")
    assert spark.read.schema(MANIFEST).csv(out["manifests"]).count() == 0
    history = spark.read.parquet(out["decisions"])
    assert history.count() == 4 and history.select("decision_id").distinct().count() == 4  # both attempts stay
    last = history.orderBy(F.desc("decided_at")).limit(2).collect()
    assert {r.outcome for r in last} == {"skipped"}
    assert spark.read.parquet(out["runs"]).count() == 1  # one sentinel
    inv.unpersist()


def test_missing_configuration_is_withheld(spark, tmp):
    rows = [row("r1", "COMPLIANCE", vc=9_999_999, tc=9_999_999, thr=None), row("r2", "COMPLIANCE", ro=None), row("r3", "COMPLIANCE", ro=True, thr=None)]
    got = {r.run_id: (r.outcome, r.reason) for r in decide(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"r1": ("withheld", "missing_configuration"), "r2": ("withheld", "missing_configuration"), "r3": ("suspended", None)}
    other = spark.createDataFrame([("elsewhere", "delete", False, 10)],
                                  "bucket string, release_mode string, report_only boolean, safety_threshold bigint")
    out = run_snapshot(spark, _inv(spark), other, f"{tmp}/r")
    assert {(r.outcome, r.reason) for r in spark.read.parquet(out["decisions"]).collect()} == {("withheld", "missing_configuration")}


def test_pointer_never_moves_back(spark, tmp):
    man = spark.createDataFrame([("b", "old", "v", "r1", "COMPLIANCE"), ("b", "new", "v", "r2", "COMPLIANCE")], MANIFEST)
    dec = spark.createDataFrame([("r1", "b", "2024-01-01-00-00", "COMPLIANCE", "created"), ("r2", "b", "2024-02-01-00-00", "COMPLIANCE", "created")],
                                "run_id string, bucket string, dt string, mode string, outcome string")
    K.publish_previous_manifest(man, dec, f"{tmp}/p")
    K.publish_previous_manifest(man, dec.where("run_id = 'r1'"), f"{tmp}/p")  # an older run is replayed
    assert [r.key for r in read_previous_manifest(spark, f"{tmp}/p").collect()] == ["new"]


def test_every_corrupt_record_is_quarantined(spark, tmp):
    import os
    from unhold.streaming import decisions as SD
    os.makedirs(f"{tmp}/records")
    for i in range(3):
        with open(f"{tmp}/records/{i}.json", "w") as fh:
            fh.write("{not json %d" % i)
    os.makedirs(f"{tmp}/manifests")
    SD.start(spark, f"{tmp}/records", f"{tmp}/manifests", fixture_config(_inv(spark)), f"{tmp}/out").awaitTermination()
    assert spark.read.parquet(f"{tmp}/out/quarantine").count() == 3


def test_listing_with_escaped_path(spark, tmp):
    inv = _inv(spark)
    write_delivery(inv, f"{tmp}/inv root+1", fx.CUR_DT)
    assert read_inventory(spark, f"{tmp}/inv root+1", [fx.CUR_DT]).count() == inv.count()


def test_null_flags_stay_in_reviews(spark):
    inv = _inv(spark).withColumn("is_latest", F.when(F.crc32("version_id") % 3 == 0, F.lit(None)).otherwise(F.col("is_latest")))
    kept = RV.without_noncurrent_markers(inv)
    gone = inv.where(F.col("is_delete_marker") & (F.col("is_latest") == F.lit(False)))
    assert kept.count() == inv.count() - gone.count()
    withheld = classify_versions(inv).where("superseder_class = 'withheld'").count()
    assert RV.withheld_remedy(inv).count() == withheld


def test_bad_delivery_does_not_stop_the_others(spark, tmp):
    from unhold.plans.oracle import DELIVERY_FIELDS
    from unhold.streaming import deliveries as SD
    inv = _inv(spark)
    write_delivery(inv, f"{tmp}/data/bucket-0", fx.CUR_DT)
    good = '{"fileFormat": "Parquet", "fileSchema": "message s3.inventory { ' + " ".join(DELIVERY_FIELDS) + ' }"}'
    batch = spark.createDataFrame([(good, f"{tmp}/m/bucket-0/inv/2024-02-01T00-00Z/manifest.json"), ('{"fileFormat": "CSV"}', f"{tmp}/m/bucket-1/inv/2024-02-01T00-00Z/manifest.json"),
                                   (good, f"{tmp}/m/bucket-1/inv/yesterday/manifest.json")], "value string, path string")
    SD.delivery_batch(spark, batch, f"{tmp}/data", fixture_config(inv), f"{tmp}/out")
    assert [r.bucket for r in spark.read.parquet(f"{tmp}/out/runs").collect()] == ["bucket-0"]
    assert {r.verdict for r in spark.read.parquet(f"{tmp}/out/delivery_quarantine").collect()} == {"not_parquet", "invalid_dt"}
