"""A key holding most of the rows must not land in one window task: the
segmented lead spreads its groups over (key, segment) partitions, and the
result stays equal to the literal joined form."""

import datetime as dt

from pyspark.sql import functions as F

from helpers import inventory_df
from unhold.operators.classify import classify_versions, classify_versions_joined, timestamp_groups
from pyspark.sql import Window


def hot_inventory():
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    # hot key: 60 days x 20 versions (every 3rd a delete marker); 20 cold keys
    for d in range(60):
        for i in range(20):
            n = d * 20 + i
            dm = n % 3 == 0
            rows.append(("b", "hot", f"h{n}", False, dm, 1, t0 + dt.timedelta(days=d, minutes=i // 2), None,
                         None if dm else "GOVERNANCE", None, None if dm else "ON", "2024-03-01-00-00"))
    rows.append(("b", "hot", "h-last", True, False, 1, t0 + dt.timedelta(days=61), None, "GOVERNANCE", None, "ON",
                 "2024-03-01-00-00"))
    for k in range(20):
        for i in range(3):
            rows.append(("b", f"cold{k}", f"c{k}-{i}", i == 2, False, 1, t0 + dt.timedelta(hours=i), None,
                         "COMPLIANCE", None, "ON", "2024-03-01-00-00"))
    return rows


def test_hot_key_spreads_over_window_partitions(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        inv = inventory_df(spark, hot_inventory())
        g = timestamp_groups(inv).withColumn(
            "_n", F.lead("last_modified_date").over(Window.partitionBy("bucket", "dt", "key", "seg").orderBy("last_modified_date")))
        parts = g.where(F.col("key") == "hot").select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts > 1
        a = classify_versions(inv).select("version_id", "superseder_class", "next_lmd")
        b = classify_versions_joined(inv).select("version_id", "superseder_class", "next_lmd")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
