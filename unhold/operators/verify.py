"""Release verification and projections across snapshots.

All are joins between a small side (a manifest, eligible rows) and a
snapshot, keyed on (bucket, key, version_id), or per-candidate expressions
over the classification. Durations are parameters: the original never
collects the hold duration or the lifecycle rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import url_decode_key
from .classify import KEY, LMD

VERSION = ["bucket", "key", "version_id"]
#: columns of a span of the hold history, without how it ended
HISTORY = [*VERSION, "hold_status", "first_dt", "last_dt", "snapshots", "first_retain", "last_retain", "advances", "setbacks"]


def _days(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} DAYS")


def verify_release(manifest: DataFrame, later: DataFrame) -> DataFrame:
    """V1: each manifest row (bucket, url-encoded key, version_id, mode)
    against a later snapshot: ``released`` (hold now OFF), ``still_held``
    (ON), ``gone`` (version absent).

    The snapshot meets the manifest in an inner join on (bucket, key, version),
    whose strategy the planner picks by measured bytes, and the versions no
    longer listed come from an anti join between the two small sides. The manifest
    key is decoded once, so the snapshot is joined on its raw key without
    re-encoding every row."""
    m = manifest.select("bucket", url_decode_key("key").alias("key"), "version_id", "mode")
    s = later.select("bucket", "key", "version_id", "object_lock_event_hold_status",
                     "object_lock_retain_until_date", F.col("dt").alias("later_dt"))
    found = s.join(m, ["bucket", "key", "version_id"])
    st = F.col("object_lock_event_hold_status")
    found = found.select(
        "bucket", "key", "version_id", "mode", "later_dt",
        F.when(st == "ON", "still_held").when(st == "OFF", "released").otherwise("unknown").alias("release_status"),
        "object_lock_retain_until_date")
    gone = (m.join(found.select("bucket", "key", "version_id"), ["bucket", "key", "version_id"], "left_anti")
            .select("bucket", "key", "version_id", "mode", F.lit(None).cast("string").alias("later_dt"),
                    F.lit("gone").alias("release_status"),
                    F.lit(None).cast("timestamp_ntz").alias("object_lock_retain_until_date")))
    return found.unionByName(gone)


def rolling_retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """V2: per version in both snapshots, whether the retain-until date
    behaves: it rolls forward while the hold is ON and stays fixed once the
    hold is released."""
    b = before.select("bucket", "key", "version_id",
                      F.col("object_lock_event_hold_status").alias("hold_before"),
                      F.col("object_lock_retain_until_date").alias("retain_before"))
    a = after.select("bucket", "key", "version_id",
                     F.col("object_lock_event_hold_status").alias("hold_after"),
                     F.col("object_lock_retain_until_date").alias("retain_after"))
    j = b.join(a, ["bucket", "key", "version_id"])
    hb, ha, rb, ra = F.col("hold_before"), F.col("hold_after"), F.col("retain_before"), F.col("retain_after")
    status = (F.when((hb == "ON") & (ha == "ON"), F.when(ra > rb, "rolling").otherwise("not_advancing"))
              .when((hb == "ON") & (ha == "OFF"), "released")
              .when((hb == "OFF") & (ha == "OFF"), F.when(ra == rb, "settled").otherwise("changed_after_release"))
              .when((hb == "OFF") & (ha == "ON"), "hold_reapplied")
              .otherwise("no_hold"))
    return j.where(hb.isNotNull() | ha.isNotNull()).select(
        "bucket", "key", "version_id", "hold_before", "hold_after", "retain_before", "retain_after",
        status.alias("retention_status"))


def _ended(status: Column, following: Column, adjacent: Column) -> Column:
    """How a span of one hold status ended, from the version's next span."""
    return (F.when(following.isNull() | ~adjacent, "absent")
            .when((status == "ON") & (following == "OFF"), "released")
            .when((status == "OFF") & (following == "ON"), "hold_reapplied")
            .otherwise("status_changed"))


def _held(rows: DataFrame) -> DataFrame:
    """The history's columns of inventory rows; a NULL status is ``none``."""
    return rows.select(*VERSION, "dt", F.coalesce("object_lock_event_hold_status", F.lit("none")).alias("hold_status"),
                       F.col("object_lock_retain_until_date").alias("retain"))


def hold_history(inv: DataFrame) -> DataFrame:
    """V2, W2 over any number of snapshots: the spans of consecutive snapshots of
    its bucket in which a version kept one hold status.

    Per span: first and last snapshot, their number, the retain-until dates at
    both ends, in how many steps the date moved on (``advances``) or back
    (``setbacks``), and how the span ended: ``released``, ``hold_reapplied``,
    ``status_changed``, ``absent`` (the next snapshot does not list the version),
    or NULL while it lasts to the bucket's newest snapshot. A step to or from a
    NULL date is neither an advance nor a setback. A window holds one version's
    snapshots, so no hot key makes a large one. Version ids are unique in a
    snapshot (``classify.assert_unique_versions``)."""
    numbered = inv.select("bucket", "dt").distinct()  # one row per delivery
    by_bucket = Window.partitionBy("bucket").orderBy("dt")
    numbered = numbered.select("bucket", "dt", F.row_number().over(by_bucket).alias("n"),
                               F.lead("dt").over(by_bucket).isNull().alias("newest"))
    w = Window.partitionBy(*VERSION).orderBy("n")
    before = F.lag(F.struct("n", "hold_status", "retain")).over(w)
    rows = _held(inv).join(numbered, ["bucket", "dt"]).withColumn("_p", before)
    p = F.col("_p")
    starts = p.isNull() | (p["n"] + 1 != F.col("n")) | (p["hold_status"] != F.col("hold_status"))
    rows = (rows.withColumn("_moved", F.when(~starts, F.col("retain") > p["retain"]))
            .withColumn("_back", F.when(~starts, F.col("retain") < p["retain"]))
            .withColumn("_span", F.sum(starts.cast("int")).over(w)))
    spans = rows.groupBy(*VERSION, "_span").agg(
        F.min("hold_status").alias("hold_status"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"),
        F.count(F.lit(1)).alias("snapshots"), F.min_by("retain", "n").alias("first_retain"), F.max_by("retain", "n").alias("last_retain"),
        F.count_if("_moved").alias("advances"), F.count_if("_back").alias("setbacks"),
        F.min("n").alias("_first"), F.max("n").alias("_last"), F.bool_or("newest").alias("_lasts"))
    nxt = F.lead(F.struct(F.col("hold_status"), F.col("_first"))).over(Window.partitionBy(*VERSION).orderBy("_span"))
    spans = spans.withColumn("_next", nxt)
    ended = _ended(F.col("hold_status"), F.col("_next.hold_status"), F.col("_next._first") == F.col("_last") + 1)
    return spans.select(*HISTORY, F.when(~F.col("_lasts"), ended).alias("ended_by"))


def merge_delivery(lasting: DataFrame | None, delivery: DataFrame, delivered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step of ``hold_history``: (spans that last, spans that ended now).

    ``lasting`` are the spans that lasted up to now (None: no history yet),
    ``delivery`` the rows of at most one newer snapshot a bucket, and ``delivered`` their
    (bucket, dt), one row per delivery, which also tells of a snapshot without
    rows. A version is met once on each side of one full outer join, so the work
    is that of the delivery and the lasting spans, however long the history is.
    Spans of buckets without a delivery go on unchanged; ended spans are never
    read again."""
    rows = _held(delivery)
    fresh = rows.select(*VERSION, "hold_status", F.col("dt").alias("first_dt"), F.col("dt").alias("last_dt"), F.lit(1).cast("bigint").alias("snapshots"),
                        F.col("retain").alias("first_retain"), F.col("retain").alias("last_retain"),
                        F.lit(0).cast("bigint").alias("advances"), F.lit(0).cast("bigint").alias("setbacks"))
    if lasting is None:
        return fresh, fresh.where(F.lit(False)).withColumn("ended_by", F.lit(None).cast("string"))
    have = lasting.join(delivered.select("bucket", F.col("dt").alias("_dt")), "bucket", "left")
    idle = have.where(F.col("_dt").isNull()).select(*HISTORY)
    old = have.where(F.col("_dt").isNotNull()).select(*VERSION, F.struct(*HISTORY[len(VERSION):]).alias("_o"))
    new = fresh.select(*VERSION, F.struct(*HISTORY[len(VERSION):]).alias("_n"))
    met = old.join(new, VERSION, "full_outer")
    o, n = F.col("_o"), F.col("_n")
    on = F.coalesce(o["hold_status"] == n["hold_status"], F.lit(False))
    step = [F.when(on, o[c]).otherwise(n[c]).alias(c) for c in ("hold_status", "first_dt")] + [n["last_dt"].alias("last_dt")]
    step += [F.when(on, o["snapshots"] + 1).otherwise(F.lit(1)).alias("snapshots"),
             F.when(on, o["first_retain"]).otherwise(n["first_retain"]).alias("first_retain"), n["last_retain"].alias("last_retain")]
    for name, moved in (("advances", n["last_retain"] > o["last_retain"]), ("setbacks", n["last_retain"] < o["last_retain"])):
        step.append(F.when(on, o[name] + F.coalesce(moved, F.lit(False)).cast("bigint")).otherwise(F.lit(0)).alias(name))
    lasts = met.where(n.isNotNull()).select(*VERSION, *step).unionByName(idle)
    over = met.where(o.isNotNull() & ~on).select(
        *VERSION, "_o.*", _ended(o["hold_status"], n["hold_status"], n.isNotNull()).alias("ended_by"))
    return lasts, over


def release_effect(eligible_rows: DataFrame, release_time: str, hold_days: int) -> DataFrame:
    """V3: retain-until after release = MAX(existing, release time + the
    configured hold duration); NULL existing dates are ignored."""
    new = F.greatest(F.col("object_lock_retain_until_date"),
                     F.to_timestamp_ntz(F.lit(release_time)) + _days(hold_days))
    return eligible_rows.select(*KEY, "version_id", "object_lock_mode", "object_lock_retain_until_date",
                                new.alias("retain_until_after_release"))


def became_noncurrent(classified: DataFrame) -> DataFrame:
    """When the candidate became noncurrent, as an interval. Without
    ties it is the next timestamp exactly; a tied peer makes it own-timestamp
    possible, and a tied *noncurrent* peer (or no peer) keeps the next
    timestamp possible. NULL when unclassified."""
    own, nxt = F.col(LMD), F.col("next_lmd")
    peer, nc_peer = F.col("has_tied_peer"), F.col("has_tied_noncurrent")
    unc = F.col("superseder_class") == "unclassified"
    lo = F.when(unc, None).when(peer, own).otherwise(nxt)
    hi = F.when(unc, None).when(nxt.isNotNull() & (~peer | nc_peer), nxt).otherwise(own)
    return classified.select(*KEY, "version_id", "object_lock_mode", LMD, "next_lmd", "superseder_class",
                             "object_lock_retain_until_date",
                             lo.alias("noncurrent_since_min"), hi.alias("noncurrent_since_max"))


def expiry_projection(classified: DataFrame, noncurrent_days: int) -> DataFrame:
    """V4: earliest expiry = MAX(became-noncurrent + NoncurrentDays,
    retain-until), using the latest possible became-noncurrent time, and
    which bound binds."""
    b = became_noncurrent(classified)
    lifecycle = F.col("noncurrent_since_max") + _days(noncurrent_days)
    ret = F.col("object_lock_retain_until_date")
    exp = F.greatest(lifecycle, ret)
    binding = (F.when(lifecycle.isNull(), None).when(ret.isNull() | (lifecycle >= ret), "lifecycle")
               .otherwise("retention"))
    return b.select(*KEY, "version_id", "noncurrent_since_max", ret.alias("retain_until"),
                    lifecycle.alias("lifecycle_at"), exp.alias("earliest_expiry"), binding.alias("binding"))


def evidence_age(runs: DataFrame, max_days: int) -> DataFrame:
    """V5: release time minus snapshot time per run, flagged above a bound."""
    age = F.datediff(F.col("released_at"), F.col("snapshot_ts")).cast("bigint")
    return runs.select("run_id", "snapshot_ts", "released_at", age.alias("evidence_age_days"),
                       (age > max_days).alias("stale_evidence"))


def audit_trail(manifest: DataFrame, report: DataFrame, decisions: DataFrame) -> DataFrame:
    """V6: every manifest row with its report row, rows missing on either
    side kept (full outer), plus whether the run has a decision record (a run
    with a decision per lock mode counts once)."""
    k = ["run_id", "mode", "bucket", "key", "version_id"]
    m = manifest.select(*k, F.lit(True).alias("_in_manifest"))
    r = report.select(*k, "task_status")
    j = m.join(r, k, "full_outer")
    j = j.join(decisions.select("run_id").distinct().withColumn("_decided", F.lit(True)), "run_id", "left")
    status = (F.when(F.col("_in_manifest").isNull(), "unexpected_report_row")
              .when(F.col("task_status").isNull(), "not_reported")
              .when(F.col("task_status") == "Succeeded", "released")
              .otherwise("failed"))
    return j.select(*k, "task_status", status.alias("audit_status"),
                    F.coalesce(F.col("_decided"), F.lit(False)).alias("decision_present"))
