"""Golden counts of FIXTURES.md section 3 at sf0.001."""

from pyspark.sql import functions as F

from conftest import SF
from unhold import fixtures as fx
from unhold.operators.classify import candidates, classify_versions
from unhold.operators.eligibility import eligible, partition_check, unclassified, withheld
from unhold.plans.catalog import eligible_dedup


def by_mode(df):
    return {r.object_lock_mode: r["count"] for r in df.groupBy("object_lock_mode").count().collect()}


def test_golden_counts(spark):
    inv = fx.inventory(spark, SF).cache()
    cur = fx.snapshot(inv, fx.CUR_DT)
    assert cur.count() == 1000 and fx.snapshot(inv, fx.PREV_DT).count() == 520
    assert cur.select("bucket", "key").distinct().count() == 15
    assert candidates(cur).count() == 601
    assert candidates(fx.snapshot(inv, fx.PREV_DT)).count() == 302
    cls = classify_versions(inv).where(F.col("dt") == fx.CUR_DT).cache()
    assert by_mode(eligible(cur, "delete", classified=cls)) == {"COMPLIANCE": 58, "GOVERNANCE": 41}
    assert by_mode(eligible(cur, "overwrite", classified=cls)) == {"COMPLIANCE": 238, "GOVERNANCE": 231}
    w = withheld(cur, cls)
    assert by_mode(w) == {"COMPLIANCE": 13, "GOVERNANCE": 20}
    assert {r.reason: r["count"] for r in w.groupBy("reason").count().collect()} == {
        "tied_noncurrent_peer": 23, "ambiguous_successor_classification": 10}
    assert unclassified(cur, cls).count() == 0
    assert by_mode(eligible_dedup(inv, "delete", SF)) == {"COMPLIANCE": 22, "GOVERNANCE": 15}
    assert by_mode(eligible_dedup(inv, "overwrite", SF)) == {"COMPLIANCE": 120, "GOVERNANCE": 121}
    assert by_mode(eligible_dedup(inv, "either", SF)) == {"COMPLIANCE": 149, "GOVERNANCE": 150}
    assert partition_check(inv).count() == 0


def test_run_golden(spark):
    recs = fx.run_records(spark, SF)
    assert recs.count() == 735
    jb = fx.job_rows(spark, SF)
    term = jb.where(F.col("status").isin("Complete", "Failed", "Cancelled")).groupBy("run_id").count()
    both = recs.join(term, "run_id").where(F.col("count") == F.col("jobs_expected"))
    assert both.count() == 328
