"""Event-time alarms, pruned sink tables, the shard planner, job service answers."""

import datetime as dt
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F
from unhold import fixtures as fx
from unhold.operators import completion as J
from unhold.operators import review as RV
from unhold.streaming import alarms as SA
from unhold.streaming import completion as SC

T0 = dt.datetime(2024, 1, 1)
SAMPLES = "bucket string, sample_time timestamp, depth int"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def changes(df):
    return sorted(tuple(r) for r in df.select("bucket", "period_start", "max_depth", "state", "previous_state").collect())


def test_an_alarm_ends_in_an_empty_period(spark):
    df = spark.createDataFrame([("b", at(0), 1), ("b", at(360), 1)], SAMPLES)
    assert changes(J.backlog_alarm(df)) == [("b", at(0), 1, "ALARM", "OK"), ("b", at(5), 0, "OK", "ALARM"), ("b", at(360), 1, "ALARM", "OK"), ("b", at(365), 0, "OK", "ALARM")]


def brute_alarm(rows):
    deep = {}
    for b, t, d in rows:
        k = (b, int((t - T0).total_seconds() // 300))
        deep[k] = max(deep.get(k, 0), d)
    out = []
    for b in {b for b, _, _ in rows}:
        was = False
        top = max(k for x, k in deep if x == b) + 1
        for k in range(top + 1):
            now = deep.get((b, k), 0) > 0
            if now != was:
                out.append((b, at(5 * k), deep.get((b, k), 0), "ALARM" if now else "OK", "OK" if now else "ALARM"))
            was = now
    return sorted(out)


def test_alarm_against_a_calendar_of_periods(spark):
    rnd = random.Random(4)
    rows = [(f"b{rnd.randrange(4)}", at(rnd.randrange(600)), rnd.choice([0, 0, 1, 3])) for _ in range(200)]
    assert changes(J.backlog_alarm(spark.createDataFrame(rows, SAMPLES))) == brute_alarm(rows)


def test_alarm_stream_equals_the_batch_twin(spark, tmp):
    """Samples in order of time over several files, one a batch; a last one far
    ahead moves the watermark past all periods."""
    rnd = random.Random(9)
    rows = sorted(((f"b{rnd.randrange(3)}", at(rnd.randrange(300)), rnd.choice([0, 1, 2])) for _ in range(60)), key=lambda r: r[1])
    parts = [rows[i::1][k:k + 12] for i in (0,) for k in range(0, 60, 12)] + [[("end", at(3000), 0)], [("end", at(3001), 0)]]
    for part in parts:
        spark.createDataFrame(part, SAMPLES).coalesce(1).write.mode("append").json(f"{tmp}/samples")
    src = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", 1).json(f"{tmp}/samples")
    (SA.backlog_alarms(src).writeStream.outputMode("append").format("parquet").option("path", f"{tmp}/changes")
     .option("checkpointLocation", f"{tmp}/ckpt").trigger(availableNow=True).start().awaitTermination())
    assert changes(spark.read.parquet(f"{tmp}/changes")) == brute_alarm(rows)


def test_missing_record_windows_with_a_late_event(spark, tmp):
    """An event two hours late is dropped by the windows and still counted."""
    def add(batch, minutes):
        rows = [(f"j{m}", "Complete", at(m)) for m in minutes]
        spark.createDataFrame(rows, "job_id string, event_status string, event_time timestamp").coalesce(1).write.mode("overwrite").parquet(f"{tmp}/missing_record_events/batch={batch}")
        SA.missing_record_windows(spark, tmp).awaitTermination()

    batches = [[0, 1, 7], [8, 130, 131], [3, 260], [400]]
    for k, minutes in enumerate(batches):
        add(k, minutes)
    got = {r.period_start: (r.missing_record_events, r.in_window, r.late_events) for r in SA.missing_record_totals(spark, tmp).collect()}
    everything = spark.createDataFrame([("no_active_jobs_record", at(m)) for b in batches for m in b], "route string, event_time timestamp")
    twin = {r.period_start: r.missing_record_events for r in J.missing_record_alarm(everything).collect()}
    assert {k: v[0] for k, v in got.items()} == twin
    assert got[at(0)] == (3, 2, 1)  # minute 3 came when the watermark was past minute 5
    assert got[at(5)] == (2, 2, 0)
    assert got[at(400)] == (1, None, 0)


def test_first_terminal_of_one_time_is_defined(spark):
    rows = [("r", "j", T0, s, "accepted") for s in ("Failed", "Complete", "Cancelled")]
    df = spark.createDataFrame(rows, "run_id string, job_id string, event_time timestamp, event_status string, route string")
    for part in (1, 3):
        assert [r.event_status for r in J.first_terminal(df.repartition(part)).where("route = 'accepted'").collect()] == ["Cancelled"]


def test_a_batch_reads_only_folders_within_a_records_life(spark, tmp):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=30 * k) for k in range(12)]
    spark.createDataFrame([(f"r{k}", "j", d) for k, d in enumerate(days)], "run_id string, job_id string, day date").write.partitionBy("day").parquet(f"{tmp}/t")
    near = SC._near(spark, f"{tmp}/t", (days[6], days[6]))
    assert sorted(r.run_id for r in near.collect()) == [f"r{k}" for k in range(3, 10)]
    assert "PartitionFilters: [isnotnull(day" in near._jdf.queryExecution().toString()


@pytest.mark.parametrize("limit", [1, 7, 60])
def test_shard_plan_is_a_disjoint_cover(spark, limit):
    rnd = random.Random(limit)
    names = ["a", "ab", "abc", "é", "éa", "日本/1", "日本/2", "", "logs/2024/01/x", "logs/2024/01/xy"] + [f"logs/2024/{m:02d}/{i}" for m in range(1, 4) for i in range(20)]
    rows = [("b0", k) for k in names for _ in range(rnd.choice([1, 1, 2, 9]))] + [("b0", "hot")] * 200 + [("b1", "only")]
    plan = RV.shard_plan(spark.createDataFrame(rows, "bucket string, key string"), limit).collect()
    for b, k in set(rows):
        hits = [p for p in plan if p.bucket == b and (k == p.prefix if p.single_key else k.startswith(p.prefix))]
        assert len([p for p in hits if p.single_key] or hits) == 1, (k, hits)
        # a prefix shard may not take in keys that another shard names
        assert len(hits) == 1, (k, hits)
    assert all(p.versions <= limit or p["keys"] == 1 for p in plan)
    assert sum(p.versions for p in plan) == len(rows) and sum(p["keys"] for p in plan) == len(set(rows))


def test_shard_plan_of_no_keys(spark):
    assert RV.shard_plan(spark.createDataFrame([], "bucket string, key string"), 5).count() == 0


def test_job_service_answers_reach_the_ladder(spark, tmp):
    from unhold.plans.runs import run_snapshot
    inv = fx.inventory(spark, SF).where((F.col("bucket") == "bucket-0") & (F.col("dt") == fx.CUR_DT))
    cfg = spark.createDataFrame([("bucket-0", "delete", False, 100000)], "bucket string, release_mode string, report_only boolean, safety_threshold bigint")
    from unhold.plans.runs import run_ids
    run = run_ids(inv).first().run_id
    answers = spark.createDataFrame([(run, "COMPLIANCE", "AccessDenied"), (run, "GOVERNANCE", "event_hold_unsupported")], "run_id string, mode string, submit_error string")
    out = run_snapshot(spark, inv, cfg, f"{tmp}/r", validate=False, submissions=answers)
    assert {(r.mode, r.reason) for r in spark.read.parquet(out["decisions"]).collect()} == {("COMPLIANCE", "create_job_failed"), ("GOVERNANCE", "event_hold_unsupported_by_runtime")}
    assert spark.read.parquet(out["active_jobs"]).count() == 0
