"""Eligible, withheld and unclassified versions; dedup; counts.

``eligible(inv, 'either')`` never classifies: it is a filter plus the dedup
anti join, and its plan has no Window. ``delete`` / ``overwrite`` select the
unanimous candidates of C1. The withheld set comes from the same
classification with the inverted condition, so the two cannot drift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import url_encode_key
from ..schemas import LOCK_MODES, RELEASE_MODES
from .classify import KEY, LMD, candidates, classify_versions, withheld_reason


ELIGIBLE_COLS = [*KEY, "object_lock_mode", "version_id", LMD]


def _check_mode(release_mode: str) -> None:
    if release_mode not in RELEASE_MODES:
        raise ValueError(f"release_mode must be one of {RELEASE_MODES}, got {release_mode!r}")


def eligible(inv: DataFrame, release_mode: str, previous_manifest: DataFrame | None = None,
             classified: DataFrame | None = None) -> DataFrame:
    """Versions whose hold may be released under ``release_mode``,
    both lock modes at once (``object_lock_mode`` is a column), minus the
    previous manifest of the same lock mode when given."""
    _check_mode(release_mode)
    if release_mode == "either":
        rows = candidates(inv).select(*ELIGIBLE_COLS)
    else:
        cls = classified if classified is not None else classify_versions(inv)
        want_dm = release_mode == "delete"
        rows = (cls.where((F.col("superseder_kinds") == 1)
                          & (F.col("superseder_is_delete_marker") == F.lit(want_dm)))
                .select(*ELIGIBLE_COLS))
    rows = rows.where(F.col("object_lock_mode").isin(LOCK_MODES))  # P3
    if previous_manifest is not None:
        rows = dedup(rows, previous_manifest)
    return rows


def dedup(rows: DataFrame, previous_manifest: DataFrame, how: str = "left_anti") -> DataFrame:
    """J4 (``left_anti``) / J5 (``left_semi``): compare with the previous
    manifest of the same lock mode on (bucket, url-encoded key, version id).

    ``previous_manifest`` has columns bucket, key (url-encoded), version_id,
    mode. Where it also has ``dt``, each snapshot is compared with the rows of
    its own dt only. NULL version ids never match, as in the original left join +
    IS NULL. No broadcast hint: the planner and AQE choose by measured bytes.
    """
    pm = previous_manifest.select(
        F.col("bucket").alias("_pm_bucket"), F.col("key").alias("_pm_key"),
        F.col("version_id").alias("_pm_version_id"), F.col("mode").alias("_pm_mode"),
        *([F.col("dt").alias("_pm_dt")] if "dt" in previous_manifest.columns else []))
    cond = [rows.bucket == pm._pm_bucket,
            rows.object_lock_mode == pm._pm_mode,
            url_encode_key(rows.key) == pm._pm_key,
            rows.version_id == pm._pm_version_id]
    if "_pm_dt" in pm.columns:
        cond.append(rows.dt == pm._pm_dt)
    return rows.join(pm, cond, how)


def withheld(inv: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """Candidates with more than one kind of possible superseder, with the
    reason. No dedup anti join, deliberately (the two sets are disjoint)."""
    cls = classified if classified is not None else classify_versions(inv)
    return (cls.where(F.col("superseder_kinds") > 1)
            .select(*KEY, "object_lock_mode", "version_id", LMD, withheld_reason().alias("reason")))


def unclassified(inv: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """Candidates with no possible superseder: neither eligible nor withheld."""
    cls = classified if classified is not None else classify_versions(inv)
    return (cls.where(F.col("superseder_class") == "unclassified")
            .select(*KEY, "object_lock_mode", "version_id", LMD))


def manifest_rows(eligible_rows: DataFrame) -> DataFrame:
    """K1 rows: bucket, url-encoded key, version id, plus the partition
    columns dt and mode. The key is url-encoded so no CSV quoting is needed."""
    return eligible_rows.select(
        "bucket", url_encode_key("key").alias("key"), "version_id",
        "dt", F.col("object_lock_mode").alias("mode"))


def with_both_modes(df: DataFrame) -> DataFrame:
    """(bucket, dt) rows widened to the fixed two lock modes (no join)."""
    return df.select("bucket", "dt", F.explode(F.array(*[F.lit(m) for m in LOCK_MODES])).alias("object_lock_mode"))


def eligible_counts(inv: DataFrame, eligible_rows: DataFrame) -> DataFrame:
    """A4: eligible count per (bucket, dt, lock mode), a real 0 included.

    The (bucket, dt) universe comes from the inventory (a partial
    aggregation); the two modes are a literal array, so no join fans out.
    """
    universe = with_both_modes(inv.select("bucket", "dt").distinct())
    counts = eligible_rows.groupBy("bucket", "dt", "object_lock_mode").agg(
        F.count(F.lit(1)).alias("eligible_count"))
    return (universe.join(counts, ["bucket", "dt", "object_lock_mode"], "left")
            .select("bucket", "dt", "object_lock_mode",
                    F.coalesce(F.col("eligible_count"), F.lit(0).cast("bigint")).alias("eligible_count")))


def withheld_count(inv: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """A5: withheld count per (bucket, dt), both lock modes together; 0 included."""
    universe = inv.select("bucket", "dt").distinct()
    w = withheld(inv, classified).groupBy("bucket", "dt").agg(F.count(F.lit(1)).alias("withheld_count"))
    return (universe.join(w, ["bucket", "dt"], "left")
            .select("bucket", "dt", F.coalesce(F.col("withheld_count"), F.lit(0).cast("bigint")).alias("withheld_count")))


#: Hash buckets of a snapshot that are compared by their sums.
FINGERPRINT_BUCKETS = 256


def _fingerprints(rows: DataFrame, times: Column) -> DataFrame:
    """Order-free sums over the multiset of (key, version_id), each row ``times``
    times, per (bucket, dt, hash bucket): rows, and sums of two halves of a hash
    (of 32 bits, so that they do not overflow)."""
    h = F.xxhash64(*KEY, "version_id")
    slot = F.pmod(F.hash(*KEY, "version_id"), F.lit(FINGERPRINT_BUCKETS))
    return (rows.select("bucket", "dt", slot.alias("slot"), h.alias("h"), times.cast("bigint").alias("t")).groupBy("bucket", "dt", "slot")
            .agg(F.sum("t").alias("n"), F.sum(F.col("t") * F.col("h").bitwiseAND(0xFFFFFFFF)).alias("low"),
                 F.sum(F.col("t") * F.shiftrightunsigned("h", 32)).alias("high")))


def partition_check(inv: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """Eligible (delete or overwrite), withheld and unclassified are
    pairwise disjoint and their union is the candidate set.

    Returns the violations: rows of the candidate set missing from the union,
    and rows of the union not in the candidate set or counted twice. Empty means
    the invariant holds.

    Both sides are reconciled by multiset fingerprints first, in one pass over the
    candidates and one over the classification; rows are compared (``exceptAll``
    both ways) only in the hash buckets whose sums differ.
    """
    from ..session import scratch_table
    cls = classified if classified is not None else classify_versions(inv)
    in_modes = F.col("object_lock_mode").isin(LOCK_MODES)
    cand = candidates(inv).where(in_modes).select(*KEY, "version_id")
    # how many of the parts a classified row is in
    one, dm = F.col("superseder_kinds") == 1, F.col("superseder_is_delete_marker")
    parts = [one & (dm == F.lit(True)), one & (dm == F.lit(False)), F.col("superseder_kinds") > 1, F.col("superseder_class") == "unclassified"]
    times = sum((F.coalesce(p, F.lit(False)).cast("int") for p in parts), F.lit(0))
    in_parts = cls.where(in_modes).select(*KEY, "version_id", times.alias("_times"))
    sums = (_fingerprints(cand, F.lit(1)).withColumn("side", F.lit(1)).unionByName(_fingerprints(in_parts, F.col("_times")).withColumn("side", F.lit(-1))))
    differ = scratch_table(sums.groupBy("bucket", "dt", "slot").agg(*[F.sum(F.col(c) * F.col("side")).alias(c) for c in ("n", "low", "high")])
                           .where("n <> 0 OR low <> 0 OR high <> 0").select("bucket", "dt", "slot"), "differing-buckets")
    if differ.limit(1).count() == 0:
        return cand.limit(0).withColumn("violation", F.lit(None).cast("string"))

    def inside(rows: DataFrame) -> DataFrame:
        return rows.withColumn("slot", F.pmod(F.hash(*KEY, "version_id"), F.lit(FINGERPRINT_BUCKETS))).join(differ, ["bucket", "dt", "slot"], "left_semi").drop("slot")

    union = inside(in_parts).withColumn("_t", F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select(*KEY, "version_id")
    cand = inside(cand).select(*KEY, "version_id")
    missing = cand.exceptAll(union).withColumn("violation", F.lit("missing"))
    extra = union.exceptAll(cand).withColumn("violation", F.lit("extra_or_overlap"))
    return missing.unionByName(extra)
