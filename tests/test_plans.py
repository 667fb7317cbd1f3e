"""Plan shape: what should reach the scan, and what must not appear."""

from pyspark.sql import functions as F

from conftest import SF
from unhold import fixtures as fx
from unhold.operators.classify import classify_versions
from unhold.operators.eligibility import eligible
from unhold.operators.review import reclassification_hazard, withheld_remedy


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_classification_has_no_nested_loop_or_cartesian_on_inventory(spark, tmp):
    fx.inventory(spark, SF).write.partitionBy("dt").parquet(f"{tmp}/inv")
    inv = spark.read.parquet(f"{tmp}/inv")
    p = plan(classify_versions(inv))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    # the inventory is scanned with pruned columns only (never `size`, `legal hold`)
    assert "object_lock_legal_hold_status" not in p.split("ReadSchema")[1]


def test_candidate_filter_reaches_the_scan(spark, tmp):
    fx.inventory(spark, SF).write.partitionBy("dt").parquet(f"{tmp}/inv2")
    inv = spark.read.parquet(f"{tmp}/inv2").where(F.col("dt") == fx.CUR_DT)
    p = plan(eligible(inv, "either"))
    assert "PushedFilters: [IsNotNull(is_latest), IsNotNull(is_delete_marker)" in p or \
        ("EqualTo(object_lock_event_hold_status,ON)" in p)
    assert "PartitionFilters: [isnotnull(dt" in p


def static_shuffles(spark, df):
    """Exchanges of the plan as it would be on large inputs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString().count("- Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reviews_classify_once(spark, tmp):
    fx.inventory(spark, SF).write.partitionBy("dt").parquet(f"{tmp}/inv3")
    inv = spark.read.parquet(f"{tmp}/inv3")
    one = static_shuffles(spark, classify_versions(inv))
    assert 0 < one <= 7
    assert static_shuffles(spark, withheld_remedy(inv)) <= one
    assert static_shuffles(spark, reclassification_hazard(inv)) <= one
