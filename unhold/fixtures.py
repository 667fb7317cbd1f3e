"""Inputs derived from the driver's read-only tables (FIXTURES.md).

Nothing here writes data: each fixture is a DataFrame over the given tables,
so its size grows with them. The inventory is built from ``events``; runs,
jobs, job events and completion reports from ``orders`` and ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import url_encode_key

# Two snapshots of the same synthetic bucket set: `prev` holds the events
# before its cut, `cur` all of them. (dt, cut) pairs.
PREV_DT, PREV_CUT = "2024-01-16-00-00", "2024-01-16 00:00:00"
CUR_DT, CUR_CUT = "2024-02-01-00-00", "2024-02-01 00:00:00"
SNAPSHOTS = [(PREV_DT, PREV_CUT), (CUR_DT, CUR_CUT)]
# A longer series for the hold history; it starts and ends with the two above.
SERIES = [(PREV_DT, PREV_CUT), ("2024-01-21-00-00", "2024-01-21 00:00:00"),
          ("2024-01-26-00-00", "2024-01-26 00:00:00"), (CUR_DT, CUR_CUT)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshot_spec(spark: SparkSession, snapshots=SNAPSHOTS) -> DataFrame:
    """One row per snapshot: its dt and cut time. Size = len(snapshots); a
    local relation, so the planner sees its exact size."""
    values = ", ".join(f"('{dt}', TIMESTAMP_NTZ '{cut}')" for dt, cut in snapshots)
    return spark.sql(f"SELECT * FROM VALUES {values} AS s(dt, cut)")


def inventory(spark: SparkSession, sf_dir: str, snapshots=SNAPSHOTS) -> DataFrame:
    """Version-level inventory rows for every snapshot in ``snapshots``.

    One scan of ``events``; each event is exploded into the snapshots whose
    cut follows it (their number is a parameter). `is_latest` comes from a per-key
    max over a partial (hash) aggregation joined back, not a window, so a key
    holding a third of all rows does not land in one task. The join takes each
    event once, with every snapshot's maximum of its key; rows multiply after it.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    # latest = greatest (ts, event_id); packed into one decimal(38,0) so the
    # per-key maximum is a hash aggregate (micros * 10^20 + event_id + 2^63:
    # the offset id stays below 10^20, so it never crosses timestamps)
    order = (F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(38,0)")
             * F.lit(str(10 ** 20)).cast("decimal(38,0)")
             + (F.col("event_id").cast("decimal(38,0)") + F.lit(str(2 ** 63)).cast("decimal(38,0)")))
    cuts = [F.lit(cut).cast("timestamp_ntz") for _, cut in snapshots]
    latest = ev.groupBy("user_id").agg(*[F.max(F.when(F.col("ts") < cut, order)).alias(f"_latest{i}") for i, cut in enumerate(cuts)])
    # each event belongs to every snapshot cut after it: a per-row explode over
    # the (few) snapshots, no join
    specs = F.array(*[F.struct(F.lit(dt).alias("dt"), cut.alias("cut"), F.col(f"_latest{i}").alias("latest"))
                      for i, ((dt, _), cut) in enumerate(zip(snapshots, cuts, strict=True))])
    rows = (ev.join(latest, "user_id").withColumn("_s", F.explode(F.filter(specs, lambda s: F.col("ts") < s["cut"])))
            .select("event_id", "ts", "user_id", "event_type", "value", "_s.dt", "_s.cut",
                    order.alias("_order"), F.col("_s.latest").alias("_latest")))
    is_error = F.col("event_type") == "error"
    hold = (F.when(is_error, F.lit(None).cast("string"))
            .when(F.col("event_type") == "view", F.lit("OFF"))
            .otherwise(F.lit("ON")))
    lmd = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return rows.select(
        F.concat(F.lit("bucket-"), (F.col("user_id") % 3).cast("string")).alias("bucket"),
        F.concat(F.lit("team"), (F.col("user_id") % 4).cast("string"), F.lit("/user "),
                 F.col("user_id").cast("string"), F.lit("/profile~v*.json")).alias("key"),
        F.col("event_id").cast("string").alias("version_id"),
        (F.col("_order") == F.col("_latest")).alias("is_latest"),
        is_error.alias("is_delete_marker"),
        F.floor(F.col("value") * 100).cast("bigint").alias("size"),
        lmd.alias("last_modified_date"),
        F.when(hold == "ON", F.col("cut") + F.expr("INTERVAL 1 YEAR"))
         .when(hold == "OFF", lmd + F.expr("INTERVAL 1 YEAR"))
         .alias("object_lock_retain_until_date"),
        F.when(is_error, F.lit(None).cast("string"))
         .when(F.col("event_id") % 2 == 0, F.lit("GOVERNANCE"))
         .otherwise(F.lit("COMPLIANCE")).alias("object_lock_mode"),
        F.when(~is_error, F.lit("OFF")).alias("object_lock_legal_hold_status"),
        hold.alias("object_lock_event_hold_status"),
        F.col("dt"),
    )


def _committed(spark: SparkSession, path: str) -> bool:
    """True when a Spark write to ``path`` committed (its _SUCCESS marker)."""
    try:
        spark.read.text(f"{path}/_SUCCESS").count()
        return True
    except Exception:  # noqa: BLE001 - AnalysisException: path not found
        return False


def fixture_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder for a stored fixture in the shared checkpoint folder, keyed by
    the input tables (path, size, time), the fixture's name/parameters and the
    fixture code."""
    import hashlib
    import os

    from .session import checkpoint_dir
    stamp = []
    for t in ("events", "orders", "lineitem"):
        src = f"{sf_dir}/{t}.parquet"
        if os.path.exists(src):
            st = os.stat(src)
            stamp.append(f"{st.st_size}-{int(st.st_mtime)}")
    # the fixture code itself is part of the key: a changed definition is
    # never served from an older stored copy
    with open(__file__, "rb") as fh:
        code = hashlib.sha256(fh.read()).hexdigest()[:12]
    digest = hashlib.sha256(f"{os.path.abspath(sf_dir)}|{stamp}|{name}|{code}".encode()).hexdigest()[:16]
    label = name.split("|")[0]
    return f"{checkpoint_dir(spark)}/fixtures/{label}-{digest}"


def inventory_table(spark: SparkSession, sf_dir: str, snapshots=SNAPSHOTS) -> DataFrame:
    """The inventory fixture as a stored table, like a real deployment's.

    Built once per input (keyed by the events file and the snapshot spec) as a
    Parquet table partitioned by (bucket, dt) in the shared checkpoint folder,
    then read back with partition pruning and filter pushdown. A write that
    did not commit is redone.
    """
    from .sources.inventory import read_inventory_table, write_inventory_table
    path = fixture_path(spark, sf_dir, f"inventory|{snapshots}")
    if not _committed(spark, path):
        write_inventory_table(inventory(spark, sf_dir, snapshots), path)
    return read_inventory_table(spark, path)


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived fixture table written once to the shared checkpoint folder
    (keyed by the inputs) and read back; ``build(spark, sf_dir)`` makes it."""
    path = fixture_path(spark, sf_dir, name)
    if not _committed(spark, path):
        build(spark, sf_dir).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def held_series(inv: DataFrame) -> DataFrame:
    """The inventory of ``SERIES`` as holds change from snapshot to snapshot, by
    version id: released at the second one (one in 5) or for that one only (one in
    5), not listed in the third (one in 7) or the fourth (one in 11), and the
    retain-until date set back in the third (one in 13)."""
    v = F.col("version_id").cast("bigint")
    dts = [dt for dt, _ in SERIES]
    dt, retain = F.col("dt"), F.col("object_lock_retain_until_date")
    held = F.col("object_lock_event_hold_status") == "ON"
    off = held & (((v % 5 == 0) & (dt >= dts[1])) | ((v % 5 == 1) & (dt == dts[1])))
    back = held & (v % 13 == 6) & (dt == dts[2])
    at_release = F.lit(PREV_CUT).cast("timestamp_ntz") + F.expr("INTERVAL 1 YEAR")
    hidden = ((v % 7 == 3) & (dt == dts[2])) | ((v % 11 == 5) & (dt == dts[3]))
    return (inv.where(~hidden).withColumn("_off", off).withColumn("_back", back)
            .withColumn("object_lock_retain_until_date", F.when(F.col("_off") | F.col("_back"), at_release).otherwise(retain))
            .withColumn("object_lock_event_hold_status", F.when(F.col("_off"), "OFF").otherwise(F.col("object_lock_event_hold_status")))
            .drop("_off", "_back"))


def snapshot(inv: DataFrame, dt: str) -> DataFrame:
    """Select one snapshot (partition pruning on a partitioned table)."""
    return inv.where(F.col("dt") == F.lit(dt))


# --- Runs, jobs, events and reports over orders / lineitem (FIXTURES.md 5) ---

def _run_id(col):
    return F.lpad(F.lower(F.hex(F.floor(col / 2))), 8, "0")


def _mode(col):
    return F.when(col % 2 == 0, "GOVERNANCE").otherwise("COMPLIANCE")


def _job_id(col):
    return F.concat(F.lit("job-"), col.cast("string"))


def _status(col):
    return F.when(col == "F", "Complete").when(col == "O", "Failed").otherwise("Active")


def _task_status(col):
    return F.when(col == "R", "PermanentFailure").otherwise("Succeeded")


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per order: run = order pair, mode by parity, status by o_orderstatus."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return o.select(
        _run_id(F.col("o_orderkey")).alias("run_id"),
        _mode(F.col("o_orderkey")).alias("mode"),
        _job_id(F.col("o_orderkey")).alias("job_id"),
        _status(F.col("o_orderstatus")).alias("status"),
        F.col("o_orderkey"),
        F.col("o_orderdate").alias("event_time"),
    )


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion report: one row per lineitem of the job's order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return li.select(
        _run_id(F.col("l_orderkey")).alias("run_id"),
        _mode(F.col("l_orderkey")).alias("mode"),
        _job_id(F.col("l_orderkey")).alias("job_id"),
        F.concat(F.lit("bucket-"), (F.floor(F.col("l_orderkey") / 2) % 3).cast("string")).alias("bucket"),
        url_encode_key(F.concat(F.lit("order "), F.col("l_orderkey").cast("string"),
                                F.lit("/line~"), F.col("l_linenumber").cast("string"))).alias("key"),
        F.col("l_linenumber").cast("string").alias("version_id"),
        _task_status(F.col("l_returnflag")).alias("task_status"),
    )


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records (the active-jobs record): every run except those with
    ``run % 50 = 0``; the record lists the run's jobs."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    runs = (o.groupBy(F.floor(F.col("o_orderkey") / 2).alias("run_num"))
            .agg(F.count(F.lit(1)).alias("jobs_expected"),
                 F.min("o_orderdate").alias("snapshot_ts")))
    return (runs.where(F.col("run_num") % 50 != 0)
            .select(F.lpad(F.lower(F.hex("run_num")), 8, "0").alias("run_id"),
                    F.concat(F.lit("bucket-"), (F.col("run_num") % 3).cast("string")).alias("bucket"),
                    "jobs_expected", "snapshot_ts"))


def record_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, job_id, mode) listed by each run record. Orders meet the records
    by their number and the run it gives; job id and mode are spelled after."""
    rec = run_records(spark, sf_dir).select("run_id")
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    o = o.join(rec, _run_id(o["o_orderkey"]) == rec["run_id"], "left_semi")
    return o.select(_run_id(F.col("o_orderkey")).alias("run_id"), _job_id(F.col("o_orderkey")).alias("job_id"), _mode(F.col("o_orderkey")).alias("mode"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authoritative job state: status by o_orderstatus, task totals from the
    completion report (A8), the creator tag (foreign for every 11th order) and
    the run tag (not hex for every 13th). Jobs and report rows are counted and
    meet by the order's number, which shuffles smaller than the texts made of it."""
    from .operators.completion import report_totals
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), _task_status(F.col("l_returnflag")).alias("task_status"))
    totals = report_totals(li).withColumnRenamed("job_id", "o_orderkey")
    j = o.join(totals, "o_orderkey", "left").withColumns({
        "job_id": _job_id(F.col("o_orderkey")), "run_id": _run_id(F.col("o_orderkey")), "status": _status(F.col("o_orderstatus"))})
    return (j.select(
        "job_id", "status",
        F.coalesce("succeeded", F.lit(0).cast("bigint")).alias("succeeded"),
        F.coalesce("failed", F.lit(0).cast("bigint")).alias("failed"),
        F.coalesce("total", F.lit(0).cast("bigint")).alias("total"),
        F.when(F.col("status") != "Complete", F.col("status")).alias("failure_reason"),
        F.when(F.col("o_orderkey") % 11 == 0, "someone-else").otherwise(OUR_TAG).alias("tag_created_by"),
        F.when(F.col("o_orderkey") % 13 == 0, F.lit("not-a-hex-id")).otherwise(F.col("run_id")).alias("tag_run_id"),
        F.concat(F.lit("bucket-"), (F.floor(F.col("o_orderkey") / 2) % 3).cast("string")).alias("bucket"),
    ))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job status events, at least once: one per order at its order date, a
    repeat one minute later for every 7th order; every 17th event claims
    'Complete' whatever the job's real status (a stale event)."""
    j = job_rows(spark, sf_dir)
    base = j.select(
        "job_id",
        F.when(F.col("o_orderkey") % 17 == 0, F.lit("Complete")).otherwise(F.col("status")).alias("event_status"),
        "event_time",
        F.concat(F.lit("bucket-"), (F.floor(F.col("o_orderkey") / 2) % 3).cast("string")).alias("bucket"),
        F.col("o_orderkey"),
    )
    dup = base.where(F.col("o_orderkey") % 7 == 0).withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 1 MINUTE"))
    return base.unionByName(dup).drop("o_orderkey")


OUR_TAG = "unhold"
