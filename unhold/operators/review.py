"""Reviews a user runs before choosing a release mode.

Each reads one classification pass or joins rows to a small scope table; none
collects rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import KEY, classify_before_and_after


def without_noncurrent_markers(inv: DataFrame) -> DataFrame:
    """The snapshot as it will look once noncurrent delete markers expire."""
    return inv.where(~(F.col("is_delete_marker").eqNullSafe(True) & F.col("is_latest").eqNullSafe(False)))


def _both(inv: DataFrame, classified: DataFrame | None, now: str) -> DataFrame:
    """Candidates of class ``now`` with their class once noncurrent delete
    markers expire. With a stored classification, only the keys it gives that
    class are read (classification is per key)."""
    if classified is not None:
        keys = classified.where(F.col("superseder_class") == now).select(*KEY).distinct()
        inv = inv.join(keys, KEY, "left_semi")
    return classify_before_and_after(inv).where(F.col("superseder_class") == now)


def withheld_remedy(inv: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """For each withheld candidate, ``self_heals`` when the snapshot without
    its noncurrent delete markers gives a unanimous class, else ``stuck``. Pass
    the stored classification (``run_snapshot`` writes it) to read only the
    affected keys."""
    return _both(inv, classified, "withheld").select(
        *KEY, "version_id", "object_lock_mode", "class_after",
        F.when(F.col("class_after").isin("delete", "overwrite"), "self_heals").otherwise("stuck").alias("remedy"))


def write_once_anomalies(classified: DataFrame, prefixes: list[str]) -> DataFrame:
    """Overwrite-superseded versions under prefixes expected to be
    written once."""
    cond = None
    for p in prefixes:
        c = F.col("key").startswith(p)
        cond = c if cond is None else cond | c
    return (classified.where((F.col("superseder_class") == "overwrite") & cond)
            .select(*KEY, "version_id", "object_lock_mode", "last_modified_date", "next_lmd"))


def reclassification_hazard(inv: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """Candidates delete-superseded now that become overwrite-superseded
    once noncurrent delete markers expire first."""
    return (_both(inv, classified, "delete").where(F.col("class_after") == "overwrite")
            .select(*KEY, "version_id", "object_lock_mode", F.col("superseder_class").alias("class_before"),
                    "class_after"))


def top_level_scopes(inv: DataFrame) -> DataFrame:
    """Scopes derived from the data: one (bucket, prefix) per top-level folder."""
    return (inv.select("bucket", F.regexp_extract("key", r"^([^/]*/)", 1).alias("prefix"))
            .where(F.col("prefix") != "").distinct())


def _lengths(scopes: DataFrame) -> list[int]:
    """The distinct prefix lengths of a scope set: at most the key length limit."""
    return sorted(r.n for r in scopes.select(F.length("prefix").alias("n")).distinct().collect())


def prefix_overlaps(scopes: DataFrame) -> DataFrame:
    """P5 check: scopes of the same bucket where one prefix contains another.
    Each scope is cut at the shorter lengths that scopes have and equi-joined
    with the scope set: never all pairs of scopes, nor every length of a key."""
    own = scopes.select("bucket", "prefix").distinct()
    shorter = F.filter(F.array(*[F.lit(n) for n in _lengths(scopes)]).cast("array<int>"), lambda n: n < F.length("prefix"))
    cand = (own.select("bucket", "prefix", F.explode(shorter).alias("_n"))
            .select("bucket", "prefix", F.substring("prefix", F.lit(1), F.col("_n")).alias("contained_in")))
    return cand.join(own.select("bucket", F.col("prefix").alias("contained_in")), ["bucket", "contained_in"]) \
        .select("bucket", "prefix", "contained_in")


def prefix_shards(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """P5: rows assigned to their (bucket, prefix) shard by an equi join.

    The distinct prefix lengths (at most the key length limit, a few values in
    practice) are gathered; each row's key is cut at those lengths and joined
    on (bucket, prefix). With non-overlapping scopes a row matches at most one
    shard."""
    lengths = _lengths(scopes)
    if not lengths:
        return rows.withColumn("shard", F.lit(None).cast("string")).limit(0)
    s = scopes.select(F.col("bucket").alias("_sb"), F.col("prefix").alias("shard"))
    cut = rows.withColumn("_p", F.explode(F.array_distinct(F.array(*[F.substring("key", 1, n) for n in lengths]))))
    return (cut.join(s, (cut.bucket == s._sb) & (cut._p == s.shard))
            .where(F.length("key") >= F.length("shard")).drop("_sb", "_p"))


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    first = F.array_position(same, F.lit(False))
    return F.when(n == 0, 0).when(first == 0, n).otherwise(first - 1).cast("int")


def shard_plan(inv: DataFrame, limit: int) -> DataFrame:
    """P5: shards of each bucket's keys by prefix, none with more than ``limit``
    versions unless it is a single key: (bucket, prefix, single_key, versions,
    keys). A shard is all keys that start with its prefix, or the one key that
    equals it; the shards are disjoint and cover all keys.

    The key tree is descended from the whole bucket: a prefix above the limit is
    split at the first character in which its keys differ (the common prefix of
    its least and greatest key), the others are done. Versions are counted per key
    once, so a hot key is one row; each step reads the keys of heavy prefixes."""
    from ..session import scratch_table
    at = ["bucket", "prefix", "single_key"]
    keys = scratch_table(inv.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("n"))
                         .withColumns({"prefix": F.lit(""), "single_key": F.lit(False)}), "shard-keys")
    done = None
    while True:
        groups = scratch_table(keys.groupBy(*at).agg(F.sum("n").alias("versions"), F.count(F.lit(1)).alias("keys"), F.min("key").alias("_low"), F.max("key").alias("_high")), "shard-counts")
        heavy = (F.col("versions") > limit) & (F.col("keys") > 1)
        # one key is named by itself, so that its shard is that key and nothing else
        alone = (F.col("versions") > limit) & (F.col("keys") == 1)
        fine = groups.where(~heavy).select("bucket", F.when(alone, F.col("_low")).otherwise(F.col("prefix")).alias("prefix"),
                                           (F.col("single_key") | alone).alias("single_key"), "versions", "keys")
        done = fine if done is None else done.unionByName(fine)
        split = groups.where(heavy).select(*at, _common(F.col("_low"), F.col("_high")).alias("_common"))
        if split.limit(1).count() == 0:
            return done
        whole = F.length("key") <= F.col("_common")
        keys = scratch_table(keys.join(split, at).select(
            "bucket", "key", "n", F.when(whole, F.col("key")).otherwise(F.substring("key", F.lit(1), F.col("_common") + 1)).alias("prefix"), whole.alias("single_key")), "shard-keys")
