"""K1 to K6: manifest and diagnostic writers, dedup pointer, sentinel, history.

Manifests are headerless, uncompressed CSV with url-encoded keys, so no value
ever needs CSV quoting; ``write_manifest`` checks that before writing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import table_exists

# Timestamp text of the withheld diagnostic (explicit: engines differ).
WITHHELD_TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"


def _csv(df: DataFrame):
    return (df.write.option("header", False).option("compression", "none")
            .option("quoteAll", False))


def assert_csv_safe(df: DataFrame, cols: list[str]) -> None:
    """T4: values with a comma, quote, backslash or line break would be
    quoted by the CSV writer and break positional readers downstream."""
    bad = df.where(F.exists(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in cols]),
                            lambda v: v.rlike('[,"\\\\\\r\\n]'))).limit(1).count()
    if bad:
        raise ValueError(f"manifest values need CSV quoting in {cols}; keys must be url-encoded")


def write_manifest(rows: DataFrame, path: str, run_id_col: str = "run_id") -> None:
    """K1: bucket, key (url-encoded), version_id per (run_id, mode) folder.

    ``rows`` has bucket, key, version_id, mode and ``run_id_col``. Sorted by
    (bucket, key, version_id) within files for a byte-stable manifest (O1)."""
    assert_csv_safe(rows, ["bucket", "key", "version_id"])
    out = (rows.select("bucket", "key", "version_id", F.col(run_id_col).alias("run_id"), "mode")
           .repartition("run_id", "mode", "key", "version_id")
           .sortWithinPartitions("bucket", "key", "version_id"))
    # dynamic overwrite: a replayed run replaces exactly its own folders
    _csv(out).mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("run_id", "mode").csv(path)


def write_withheld(rows: DataFrame, path: str) -> None:
    """K2: withheld diagnostic rows; timestamp written with an explicit format
    and the partition dt in its raw delivery spelling. Folders are
    ``target=<bucket>/dt=<raw dt>/``, so one bucket's run never replaces
    another's diagnostic of the same dt."""
    out = rows.select(
        F.url_encode("key").alias("key"), "version_id", "object_lock_mode",
        F.date_format("last_modified_date", WITHHELD_TS_FORMAT).alias("last_modified_date"),
        "reason", F.col("bucket").alias("target"), F.col("dt_raw").alias("dt"))
    _csv(out).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target", "dt").csv(path)


def combine_manifest(spark: SparkSession, parts_path: str, out_path: str) -> bool:
    """K3: the manifest as one folder of part files, sorted across the files,
    at any size; read in file order it is the one sorted object. Returns False,
    with no output, when there are no rows. Spark's readers skip ``_`` names."""
    from ..schemas import MANIFEST_CSV
    df = spark.read.schema(MANIFEST_CSV).csv(parts_path)
    if df.limit(1).count() == 0:
        return False
    order = ["bucket", "key", "version_id"]
    _csv(df.repartitionByRange(*order).sortWithinPartitions(*order)).mode("overwrite").csv(out_path)
    return True


PART_BYTES = 256 << 20  # a combined manifest is cut into files of about this size


def line_bytes():
    """Bytes of a manifest row as written: three values, two commas, a line end."""
    return F.octet_length("bucket") + F.octet_length("key") + F.octet_length("version_id") + F.lit(3)


def manifest_parts(rows: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """K3: ``rows`` (bucket, key, version_id, run_id, mode) with ``part``: the
    file of the sorted manifest that a row belongs to. A file begins where the
    bytes before it reach another multiple of ``part_bytes``.

    The running sum is distributed: rows are range-partitioned in manifest order,
    summed within each range, and ranges are offset by the sums before them."""
    from pyspark.sql import Window

    from ..session import scratch_table
    keys = ["run_id", "mode", "bucket", "key", "version_id"]
    # stored, so that the ranges are the same for the sums and for the rows
    dealt = scratch_table(rows.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
                          .withColumns({"_at": F.monotonically_increasing_id(), "_bytes": line_bytes().cast("bigint")}), "manifest-order")
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    past = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("run_id", "mode", "_range").agg(F.sum("_bytes").alias("_sum"))  # one row a range and manifest
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(past("run_id", "mode").orderBy("_range")), F.lit(0))).drop("_sum")
    begin = F.coalesce(F.sum("_bytes").over(past("run_id", "mode", "_range").orderBy("_at")), F.lit(0)) + F.col("_offset")
    return dealt.join(sums, ["run_id", "mode", "_range"]).select(*keys, F.floor(begin / part_bytes).cast("int").alias("part"))


def write_combined(rows: DataFrame, path: str, part_bytes: int = PART_BYTES) -> None:
    """K3: the combined manifest of every (run_id, mode): one sorted file a part,
    in ``run_id=/mode=/part=`` folders; read in part order they are the one
    sorted object. A (run, mode) without rows has no manifest."""
    order = ["bucket", "key", "version_id"]
    out = manifest_parts(rows, part_bytes).select(*order, "run_id", "mode", "part").repartition("run_id", "mode", "part").sortWithinPartitions(*order)
    _csv(out).partitionBy("run_id", "mode", "part").csv(path)


def publish_previous_manifest(manifest_rows: DataFrame, decisions: DataFrame, path: str) -> None:
    """K4: move a (bucket, mode) dedup pointer where a decision is ``created``,
    to that bucket's latest created run; other pointers stay. Rows lie in
    ``target=<bucket>/mode=<mode>/run_id=<run>/`` (the CSV itself keeps its
    positional bucket column); the row in the log beside it is what moves the
    pointer, so nothing is removed before, and what was published earlier stays
    for the runs that follow it."""
    from pyspark.sql import Window
    spark = decisions.sparkSession
    created = decisions.where(F.col("outcome") == "created").select("run_id", "bucket", "dt", "mode")
    w = Window.partitionBy("bucket", "mode").orderBy(F.col("dt").desc(), F.col("run_id").desc())
    latest = created.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    # the pointer never moves back: an older run than the published one is passed over, and a published one is done
    log = f"{path}_log"
    if table_exists(spark, log):
        at = spark.read.parquet(log).groupBy("bucket", "mode").agg(F.max(F.struct("dt", "run_id")).alias("_at"))
        latest = (latest.join(at, ["bucket", "mode"], "left")
                  .where(F.col("_at").isNull() | (F.struct("dt", "run_id") > F.col("_at"))).drop("_at"))
    todo = [tuple(r) for r in latest.select("run_id", "bucket", "dt", "mode").collect()]  # one row a bucket and mode that moves
    if not todo and table_exists(spark, log):
        return
    latest = spark.createDataFrame(todo, "run_id string, bucket string, dt string, mode string")
    rows = manifest_rows.join(latest.select("run_id", "bucket", "mode"), ["run_id", "bucket", "mode"], "left_semi")
    _csv(rows.select("bucket", "key", "version_id", F.col("bucket").alias("target"), "mode", "run_id")
         .repartition("target", "mode", "key", "version_id")) \
        .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target", "mode", "run_id").csv(path)
    latest.select("bucket", "mode", "dt", "run_id").coalesce(1).write.mode("append").parquet(log)


def mark_complete(spark: SparkSession, runs_path: str, run_rows: DataFrame) -> None:
    """K5: append the run's sentinel row only after its outputs were written.
    Consumers read outputs joined to ``runs``; a failed stage raises before
    this point, so a failure never looks like an empty result."""
    if table_exists(spark, runs_path):  # one sentinel per run, also on a replay
        run_rows = run_rows.join(spark.read.parquet(runs_path).select("run_id"), "run_id", "left_anti")
    run_rows.withColumn("completed_at", F.current_timestamp().cast("timestamp_ntz")) \
        .write.mode("append").parquet(runs_path)


def append_active_jobs(active: DataFrame, path: str) -> None:
    """Jobs that completion waits for, each once however often its decision is
    replayed (a job id follows from its decision's token)."""
    if table_exists(active.sparkSession, path):
        active = active.join(active.sparkSession.read.parquet(path).select("job_id"), "job_id", "left_anti")
    active.write.mode("append").parquet(path)


def append_once(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose ``keys`` the table does not hold yet (NULL-safe)."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates(keys)
    if table_exists(spark, path):
        held = spark.read.parquet(path).select(*[F.col(k).alias(f"_{k}") for k in keys])
        rows = rows.join(held, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
    rows.write.mode("append").parquet(path)


def append_decisions(decisions: DataFrame, path: str, attempt: str) -> None:
    """K6: append-only decision history. Every decision has its own
    ``decision_id`` (of its token and the attempt that made it); a replay adds
    rows and never replaces older ones."""
    (decisions.withColumn("attempt", F.lit(attempt))
     .withColumn("decision_id", F.sha2(F.concat_ws("/", "decision_token", "attempt"), 256))
     .write.mode("append").parquet(path))


def merge_hold_history(delivery: DataFrame, delivered: DataFrame, path: str, step: str) -> bool:
    """Adds one delivery to the stored hold history (``verify.merge_delivery``).

    ``lasting/step=<step>`` holds the spans that last up to a step, ``ended/step=``
    those that ended in it, and a row of ``steps`` commits both, so a step that
    died is written again and readers never see half of one. Steps ascend as
    text (the snapshot's dt): one that is already committed does nothing and
    returns False, an older one that is not raises."""
    from ..operators.verify import merge_delivery
    spark = delivery.sparkSession
    steps = f"{path}/steps"
    newest, lasting = None, None
    if table_exists(spark, steps):
        done = spark.read.parquet(steps)
        newest = done.agg(F.max("step")).first()[0]
        if done.where(F.col("step") == step).limit(1).count():
            return False
        if step < newest:
            raise ValueError(f"step {step} is older than the history's newest, {newest}")
        lasting = spark.read.parquet(f"{path}/lasting/step={newest}")
    lasts, ended = merge_delivery(lasting, delivery, delivered)
    lasts.write.mode("overwrite").parquet(f"{path}/lasting/step={step}")
    ended.write.mode("overwrite").parquet(f"{path}/ended/step={step}")
    spark.createDataFrame([(step,)], "step string").coalesce(1).write.mode("append").parquet(steps)
    return True


def read_hold_history(spark: SparkSession, path: str) -> DataFrame:
    """All spans of the committed steps; ``ended_by`` is NULL while one lasts."""
    steps = spark.read.parquet(f"{path}/steps")
    newest = steps.agg(F.max("step")).first()[0]
    lasting = spark.read.parquet(f"{path}/lasting/step={newest}")
    text = lasting.withColumn("ended_by", F.lit(None).cast("string"))
    ended = spark.read.schema(text.withColumn("step", F.lit("")).schema).parquet(f"{path}/ended")
    return ended.join(steps, "step", "left_semi").drop("step").unionByName(text)
