"""T-2, T-6, T-7, T-8 as Structured Streaming jobs over job status events.

Events arrive at least once and out of order. The stream routes each event
against the jobs, run records and record jobs as they are at that batch (pass
functions that read them, and a job that ends later is seen), then:

* ``missing_record_alarm`` (T-8): per micro-batch, the events without a run
  record, and their count by 5-minute period, in folders per batch that a replay
  writes again. ``alarm_periods`` adds the batches up, however late an event
  comes; ``alarms.missing_record_windows`` is the event-time form.
* ``completion`` (T-6 + T-7): ``foreachBatch`` keeps the first terminal event
  per (run, job) in a table (anti join: first wins across restarts and
  replays), recomputes the outcome of the runs touched by the batch, and
  appends a run to ``completion_sent`` exactly once, when all its jobs are
  terminal. A replayed batch finds its rows already present and writes
  nothing new, so the sink is idempotent without relying on batch ids alone.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import completion as J
from ..sources.paths import table_exists as _exists

EVENT_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("event_status", T.StringType()),
    T.StructField("event_time", T.TimestampType()),  # watermarks need TIMESTAMP (session zone is UTC)
    T.StructField("bucket", T.StringType()),
])


#: Run records, and so the jobs that events may refer to, expire after so many days.
RECORD_DAYS = 90


def _near(spark: SparkSession, path: str, days: tuple) -> DataFrame:
    """Rows of a sink table in the day folders that rows of ``days`` can meet:
    first events and completions of one run lie within a record's life."""
    low, high = (d + timedelta(days=k) for d, k in zip(days, (-RECORD_DAYS, RECORD_DAYS)))
    return spark.read.parquet(path).where(F.col("day").between(F.lit(low), F.lit(high)))


def completion_batch(spark: SparkSession, batch: DataFrame, records: DataFrame, out_root: str) -> None:
    """One micro-batch of routed events: first-terminal table, outcomes,
    one-time completion emission. Both tables lie in folders by the event's day;
    a batch reads the folders within a record's life of its own events."""
    firsts_path, sent_path = f"{out_root}/first_terminal", f"{out_root}/completion_sent"
    acc = J.first_terminal(batch).where(F.col("route") == "accepted").drop("route").withColumn("day", F.to_date("event_time"))
    days = acc.agg(F.min("day"), F.max("day")).first()
    if days[0] is None:
        return
    if _exists(spark, firsts_path):
        acc = acc.join(_near(spark, firsts_path, days).select("run_id", "job_id"), ["run_id", "job_id"], "left_anti")
    acc.write.mode("append").partitionBy("day").parquet(firsts_path)
    if not _exists(spark, firsts_path):
        return
    touched = batch.where(F.col("route") == "accepted").select("run_id").distinct()
    firsts = _near(spark, firsts_path, days).join(touched, "run_id", "left_semi")
    done = J.run_outcome(firsts, records).where(F.col("complete"))
    done = done.join(firsts.groupBy("run_id").agg(F.max("day").alias("day")), "run_id")
    if _exists(spark, sent_path):
        done = done.join(_near(spark, sent_path, days).select("run_id"), "run_id", "left_anti")
    done.withColumn("sent_at", F.current_timestamp().cast("timestamp_ntz")).write.mode("append").partitionBy("day").parquet(sent_path)


def start(spark: SparkSession, events_path: str, jobs: DataFrame, records: DataFrame, record_jobs: DataFrame,
          out_root: str, our_tag: str, available_now: bool = True, nested: bool = False):
    """Start both streaming queries; returns them (call ``awaitTermination``).
    ``nested``: the files hold one nested job event a line, as delivered."""
    if nested:
        events = J.parse_job_events(spark.readStream.text(events_path))
    else:
        events = spark.readStream.schema(EVENT_SCHEMA).json(events_path)
    now = lambda t: t() if callable(t) else t  # noqa: E731 - read again for every batch
    trig = {"availableNow": True} if available_now else {"processingTime": "1 minute"}

    def route(batch: DataFrame) -> DataFrame:
        return J.route_events(batch, now(jobs), now(records), now(record_jobs), our_tag)

    def alarm_batch(batch: DataFrame, batch_id: int) -> None:
        routed = route(batch)
        (routed.where(F.col("route") == "no_active_jobs_record").select("job_id", "event_status", F.col("event_time").cast("timestamp").alias("event_time"), F.lit(batch_id).alias("batch"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out_root}/missing_record_events"))
        (J.missing_record_alarm(routed).withColumn("batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out_root}/missing_record_alarm"))

    def outcome_batch(batch: DataFrame, _batch_id: int) -> None:
        routed = route(batch).persist()  # read for the first events and for the runs touched
        try:
            completion_batch(spark, routed, now(records), out_root)
        finally:
            routed.unpersist()

    alarm = (events.writeStream.foreachBatch(alarm_batch)
             .option("checkpointLocation", f"{out_root}/_ckpt/alarm").trigger(**trig).start())
    # No watermark on either path: first-wins is enforced exactly by the sink's
    # anti join, so an event arriving any time later is still folded in.
    comp = (events.writeStream
            .foreachBatch(outcome_batch)
            .option("checkpointLocation", f"{out_root}/_ckpt/completion")
            .trigger(**trig).start())
    return alarm, comp


def alarm_periods(spark: SparkSession, out_root: str) -> DataFrame:
    """T-8: events without a run record per period, over all batches so far."""
    return (spark.read.parquet(f"{out_root}/missing_record_alarm").groupBy("period_start", "period_end")
            .agg(F.sum("missing_record_events").alias("missing_record_events")))
