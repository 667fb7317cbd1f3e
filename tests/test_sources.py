"""Sources and sinks: delivery layout, partition pruning, positional CSV,
schema drift, manifest round trip, the end-to-end batch job and its replay."""

import pytest
from pyspark.sql import functions as F

from conftest import SF
from unhold import fixtures as fx
from unhold.operators.eligibility import dedup, eligible, manifest_rows
from unhold.plans.runs import fixture_config, run_snapshot
from unhold.schemas import INVENTORY
from unhold.sources import inventory as S
from unhold.sources import records as SR
from unhold.sources import sinks as K


@pytest.fixture(scope="module")
def inv(spark):
    return fx.inventory(spark, SF).cache()


def test_delivery_layout_roundtrip(spark, inv, tmp):
    cur = fx.snapshot(inv, fx.CUR_DT).where(F.col("bucket") == "bucket-0")
    S.write_delivery(cur, f"{tmp}/bucket-0", fx.CUR_DT)
    back = S.read_inventory(spark, f"{tmp}/bucket-0", [fx.CUR_DT])
    cols = [f.name for f in INVENTORY.fields] + ["dt"]
    assert back.select(*cols).exceptAll(cur.select(*cols)).count() == 0
    assert back.count() == cur.count()
    with pytest.raises(Exception):
        S.read_inventory(spark, f"{tmp}/bucket-0", ["2030-01-01-00-00"]).count()


def test_partitioned_table_prunes_and_pushes_down(spark, inv, tmp):
    S.write_inventory_table(inv, f"{tmp}/table")
    df = S.read_inventory_table(spark, f"{tmp}/table", dt=fx.CUR_DT, key_prefix="team1/").select("key", "version_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dt" in plan.split("PartitionFilters")[1][:200]
    assert "StringStartsWith(key,team1/)" in plan
    assert "ReadSchema: struct<key:string,version_id:string>" in plan
    assert df.count() == fx.snapshot(inv, fx.CUR_DT).where(F.col("key").startswith("team1/")).count()


def test_positional_csv_needs_three_columns(spark, inv, tmp):
    pm = manifest_rows(eligible(fx.snapshot(inv, fx.PREV_DT), "delete"))
    (pm.select("bucket", "key", "version_id", F.col("bucket").alias("target"), "mode")
     .write.option("header", False).partitionBy("target", "mode").csv(f"{tmp}/pm"))
    good = SR.read_previous_manifest(spark, f"{tmp}/pm")
    # the manifest read back suppresses every one of its own rows
    elig = eligible(fx.snapshot(inv, fx.PREV_DT), "delete")
    assert dedup(elig, good).count() == 0
    # a two-column schema binds bucket as key: matches nothing, silently
    short = spark.read.schema("key string, version_id string").csv(f"{tmp}/pm")
    assert short.where(F.col("key").startswith("bucket-")).count() == short.count()


def test_schema_check_catches_silent_null(spark, inv, tmp):
    cur = fx.snapshot(inv, fx.CUR_DT).drop("object_lock_event_hold_status", "dt")
    cur.write.parquet(f"{tmp}/drift")
    # Spark, like the original engine, reads a declared-but-absent column as NULL
    back = spark.read.schema(INVENTORY).parquet(f"{tmp}/drift")
    assert back.where(F.col("object_lock_event_hold_status").isNotNull()).count() == 0
    fields = " ".join(f"optional binary {f.name} (STRING);" for f in back.schema.fields
                      if f.name in cur.columns)
    d = spark.createDataFrame([("Parquet", "message s3.inventory { " + fields + " }")], "fileFormat string, fileSchema string")
    checked = SR.schema_drift(d)
    assert checked.first().missing_required == "object_lock_event_hold_status"
    with pytest.raises(RuntimeError):
        SR.require_schema_ok(checked)
    nonparq = spark.createDataFrame([("CSV", "message s3.inventory { " + fields + " }")], "fileFormat string, fileSchema string")
    assert SR.schema_drift(nonparq).first().verdict == "not_parquet"


def test_manifest_writer_refuses_quoting(spark):
    df = spark.createDataFrame([("b", "a,b", "v", "r", "COMPLIANCE")], "bucket string, key string, version_id string, run_id string, mode string")
    with pytest.raises(ValueError):
        K.assert_csv_safe(df, ["bucket", "key", "version_id"])


def test_run_snapshot_end_to_end_and_replay(spark, inv, tmp):
    cfg = fixture_config(inv)
    out = run_snapshot(spark, inv, cfg, f"{tmp}/run")
    man = spark.read.schema("bucket string, key string, version_id string, run_id string, mode string").csv(out["manifests"])
    assert man.count() == eligible(inv, "delete").count()
    dec = spark.read.parquet(out["decisions"])
    assert dec.count() == 12
    assert set(r.outcome for r in dec.collect()) <= {"created", "suspended", "withheld", "skipped"}
    prev = SR.read_previous_manifest(spark, out["previous"])
    created = dec.where(F.col("outcome") == "created").select("bucket", "mode").distinct().count()
    assert prev.select("bucket", "mode").distinct().count() == created
    wh = spark.read.schema("key string, version_id string, object_lock_mode string, last_modified_date string, "
                           "reason string, target string, dt string").csv(out["withheld"])
    assert wh.count() > 0 and wh.where(~F.col("dt").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}-\d{2}Z$")).count() == 0
    # the same decisions on replay: tokens are deterministic
    out2 = run_snapshot(spark, inv, cfg, f"{tmp}/run2")
    d2 = spark.read.parquet(out2["decisions"])
    assert dec.select("decision_token", "outcome").exceptAll(d2.select("decision_token", "outcome")).count() == 0


def test_combine_manifest(spark, inv, tmp):
    rows = manifest_rows(eligible(fx.snapshot(inv, fx.CUR_DT), "delete"))
    rows.select("bucket", "key", "version_id").write.option("header", False).csv(f"{tmp}/parts")
    assert K.combine_manifest(spark, f"{tmp}/parts", f"{tmp}/combined")
    import glob
    files = [f for f in glob.glob(f"{tmp}/combined/*") if not f.split("/")[-1].startswith(("_", "."))]
    lines = [x for f in sorted(files) for x in open(f).read().splitlines()]  # sorted across the parts
    assert len(lines) == rows.count() and lines == sorted(lines, key=lambda l: tuple(l.split(",")))
    rows.limit(0).select("bucket", "key", "version_id").write.option("header", False).csv(f"{tmp}/none")
    assert not K.combine_manifest(spark, f"{tmp}/none", f"{tmp}/combined2")


def test_run_snapshot_replay_is_idempotent(spark, inv, tmp):
    cfg = fixture_config(inv)
    out = run_snapshot(spark, inv, cfg, f"{tmp}/same")
    n1 = spark.read.csv(out["manifests"]).count()
    run_snapshot(spark, inv, cfg, f"{tmp}/same")
    assert spark.read.csv(out["manifests"]).count() == n1


def test_runs_of_two_buckets_in_one_folder_keep_each_other(spark, inv, tmp):
    cfg = fixture_config(inv)
    root = f"{tmp}/shared"
    for b in ("bucket-0", "bucket-1"):
        run_snapshot(spark, inv.where(F.col("bucket") == b), cfg, root)
    cls = spark.read.parquet(f"{root}/classified")
    assert {r.bucket for r in cls.select("bucket").distinct().collect()} == {"bucket-0", "bucket-1"}
    wh = SR.read_withheld_history(spark, f"{root}/withheld", ["2024-01-16T00-00Z", "2024-02-01T00-00Z"])
    assert {r.bucket for r in wh.select("bucket").distinct().collect()} == {"bucket-0", "bucket-1"}
    assert spark.read.parquet(f"{root}/runs").count() == 4
