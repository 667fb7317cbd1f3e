"""T-8 and T-9 as event-time streams.

* ``backlog_alarms`` (T-9): keyed state holds each bucket's unfinished periods
  and its last breaching one. An alarm ends
  when the period after it is finished, by a sample of 0 or, without any sample,
  by the event-time timeout.
* ``missing_record_windows`` (T-8): events without a run record are counted in
  event-time windows behind a watermark. ``missing_record_totals`` adds what the
  windows no longer took: every event is in the events' table, so the difference
  to the finished windows is the side output of late ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALARM_SCHEMA = "bucket string, period_start timestamp, max_depth int, state string, previous_state string"
_SECOND = 1_000_000


def _alarm_changes(period: int):
    """State changes of one bucket. The state holds the end of its last breaching
    period (0 while the alarm is off) and the periods behind which the watermark
    still is, at most those within the lateness: starts and depths. Times are
    microseconds."""
    length = period * _SECOND

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, starts, depths = state.get if state.exists else (0, [], [])
        deepest = dict(zip(starts, depths))
        mark = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for frame in frames:
                times = frame["sample_time"].astype("datetime64[us]").astype("int64")
                for start, depth in (times // length * length).to_frame("s").assign(d=frame["depth"]).groupby("s")["d"].max().items():
                    if start + length > mark:  # a later sample does not reopen a finished period
                        deepest[start] = max(deepest.get(start, 0), depth)
        out = []
        for start in sorted(deepest):
            if last and start > last and last + length <= mark:  # the period after the last breaching one had no sample
                out.append((key[0], last, 0, "OK", "ALARM"))
                last = 0
            if start + length > mark:
                break
            depth = int(deepest.pop(start))
            if depth > 0:
                if not last:
                    out.append((key[0], start, depth, "ALARM", "OK"))
                last = start + length
            elif last:
                out.append((key[0], start, 0, "OK", "ALARM"))
                last = 0
        if last and last + length <= mark:
            out.append((key[0], last, 0, "OK", "ALARM"))
            last = 0
        if last or deepest:
            state.update((last, [int(k) for k in sorted(deepest)], [int(deepest[k]) for k in sorted(deepest)]))
            due = min([*deepest, *([last] if last else [])]) + length
            state.setTimeoutTimestamp(max(due, mark + 1000) // 1000)
        elif state.exists:
            state.remove()
        frame = pd.DataFrame(out, columns=["bucket", "period_start", "max_depth", "state", "previous_state"])
        frame["period_start"] = pd.to_datetime(frame["period_start"], unit="us")
        yield frame.astype({"max_depth": "int32"})
    return run


def backlog_alarms(samples: DataFrame, period_seconds: int = 300, lateness: str = "10 minutes") -> DataFrame:
    """T-9: alarm changes of streamed samples (bucket, sample_time, depth). The
    twin of ``completion.backlog_alarm``; a period is finished once the watermark,
    ``lateness`` behind the newest sample, has passed it."""
    return (samples.withWatermark("sample_time", lateness).groupBy("bucket")
            .applyInPandasWithState(_alarm_changes(period_seconds), ALARM_SCHEMA, "last long, starts array<long>, depths array<int>",
                                    "append", GroupStateTimeout.EventTimeTimeout))


def missing_record_windows(spark: SparkSession, out_root: str, lateness: str = "1 hour", period: str = "5 minutes", available_now: bool = True):
    """T-8: windows over the events that the routing stream found without a run
    record, as a stream of that table's new files; finished windows only."""
    events = (spark.readStream.schema("job_id string, event_status string, event_time timestamp, batch long").parquet(f"{out_root}/missing_record_events")
              .withWatermark("event_time", lateness))
    counted = (events.groupBy(F.window("event_time", period).alias("w")).agg(F.count(F.lit(1)).alias("missing_record_events"))
               .select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "missing_record_events"))
    trig = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    return (counted.writeStream.outputMode("append").format("parquet").option("path", f"{out_root}/missing_record_windows")
            .option("checkpointLocation", f"{out_root}/_ckpt/missing_record_windows").trigger(**trig).start())


def missing_record_totals(spark: SparkSession, out_root: str, period: str = "5 minutes") -> DataFrame:
    """T-8: per period all events without a run record, how many the finished
    windows had, and how many came late, after their window was finished. Periods
    that are still open have no window yet and no late events."""
    seen = (spark.read.parquet(f"{out_root}/missing_record_events").groupBy(F.window("event_time", period).alias("w"))
            .agg(F.count(F.lit(1)).alias("missing_record_events")).select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "missing_record_events"))
    done = spark.read.schema("period_start timestamp, period_end timestamp, missing_record_events long").parquet(f"{out_root}/missing_record_windows")
    newest = done.agg(F.max("period_end").alias("newest"))
    finished = F.coalesce(F.col("period_end") <= F.col("newest"), F.lit(False))
    return (seen.join(done.select("period_start", F.col("missing_record_events").alias("in_window")), "period_start", "left").join(F.broadcast(newest))  # one row
            .select("period_start", "period_end", "missing_record_events", "in_window",
                    F.when(finished, F.col("missing_record_events") - F.coalesce("in_window", F.lit(0))).otherwise(0).alias("late_events")))
