"""T-1 + T-2: react to each new delivery manifest with the batch job.

A file-source stream watches ``manifest.json`` files under the delivery root
(path layout ``<root>/<bucket>/<inventory_id>/<dt_raw>/manifest.json``). Each
micro-batch checks the delivered dt and schemas (S3), puts deliveries that fail
into a quarantine table and goes on with the rest, skips deliveries whose run was
already completed (the ``runs`` sentinel table: the first claim wins, so a
duplicate notification or a replayed batch is a no-op), and runs the batch job
for the rest. The file source's checkpoint remembers processed files across
restarts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_valid_raw_dt, path_part, raw_dt_to_dashed
from ..plans.runs import run_snapshot
from ..schemas import DELIVERY_MANIFEST
from ..sources.inventory import read_inventory
from ..sources.paths import table_exists
from ..sources.records import schema_drift
from ..sources.sinks import append_once


def _parsed(batch: DataFrame) -> DataFrame:
    j = F.from_json("value", DELIVERY_MANIFEST)
    path = F.col("path")
    return batch.select(
        path, j["fileFormat"].alias("fileFormat"), j["fileSchema"].alias("fileSchema"),
        path_part(path, -4).alias("bucket"), path_part(path, -2).alias("dt_raw"))


def delivery_batch(spark: SparkSession, batch: DataFrame, data_root: str, config: DataFrame, out_root: str) -> None:
    d = _parsed(batch)
    checked = schema_drift(d).withColumn("verdict", F.when(~F.coalesce(is_valid_raw_dt("dt_raw"), F.lit(False)), "invalid_dt").otherwise(F.col("verdict")))
    bad = checked.where(F.col("verdict") != "ok").select("path", "bucket", "dt_raw", "verdict", "missing_required")
    append_once(bad, f"{out_root}/delivery_quarantine", ["path", "verdict"])  # also when the batch is replayed
    todo = checked.where(F.col("verdict") == "ok").select("bucket", raw_dt_to_dashed("dt_raw").alias("dt")).distinct()
    runs_path = f"{out_root}/runs"
    if table_exists(spark, runs_path):
        todo = todo.join(spark.read.parquet(runs_path).select("bucket", "dt"), ["bucket", "dt"], "left_anti")
    # one row per delivery (small metadata); all deliveries of the batch are
    # then classified and decided together in one run_snapshot job
    snaps = [(r.bucket, r.dt) for r in todo.collect()]
    if not snaps:
        return
    frames = []
    for bucket in sorted({b for b, _ in snaps}):
        dts = sorted(dt for b, dt in snaps if b == bucket)
        frames.append(read_inventory(spark, f"{data_root}/{bucket}", dts, bucket=bucket)
                      .withColumn("bucket", F.lit(bucket)))
    inv = reduce(DataFrame.unionByName, frames)
    # versions whose release is in flight are not put into a manifest again
    run_snapshot(spark, inv, config, out_root, pointer=f"{out_root}/previous")


def start(spark: SparkSession, manifest_root: str, data_root: str, config: DataFrame, out_root: str,
          available_now: bool = True):
    src = (spark.readStream.format("text").option("wholetext", True)
           .option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json")
           .load(manifest_root)
           .select("value", F.col("_metadata.file_path").alias("path")))
    trig = {"availableNow": True} if available_now else {"processingTime": "5 minutes"}
    return (src.writeStream
            .foreachBatch(lambda df, _bid: delivery_batch(spark, df, data_root, config, out_root))
            .option("checkpointLocation", f"{out_root}/_ckpt/deliveries")
            .trigger(**trig).start())
