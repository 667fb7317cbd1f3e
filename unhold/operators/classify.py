"""C1 classify_versions: why was each held noncurrent version superseded?

A candidate is a noncurrent data version whose event hold is ON. Its
*possible superseders* are every other row at its (key, timestamp) plus the
possibly-first rows of the key's next timestamp (that group's noncurrent rows,
or all of it when it has none). Unanimous delete markers: ``delete``;
unanimous data versions: ``overwrite``; both: ``withheld``; none:
``unclassified``. Every key below is (bucket, dt, key): one job covers all
buckets and snapshots.

Plan (one-pass form):
  1. group rows by (bucket, dt, key, seg, lmd) with counts. Partial
     aggregation runs map-side, so a hot (key, timestamp) collapses before the
     shuffle.
  2. next-group values by a *segmented* lead: lead within (key, seg) where seg
     is a time bucket of the timestamp, then the last group of each segment
     takes the first group of the key's next non-empty segment (a lead over
     one row per segment). A key holding a third of all rows therefore spreads
     over its segments instead of landing in one window task.
  3. one equi join of candidates back to their group.
The literal joined form (self joins + UNION ALL) is kept as
``classify_versions_joined``: the independent, brute-force formulation the
tests compare against on small fixtures (it pairs candidates with their tied
peers, so it is never used on whole tables).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import HOLD_ON, REASON_AMBIGUOUS, REASON_TIED_PEER

KEY = ["bucket", "dt", "key"]
LMD = "last_modified_date"
# Default segment width for the segmented lead: one day of timestamps.
SEGMENT_SECONDS = 86_400


def candidate_predicate() -> Column:
    """Noncurrent, not a delete marker, event hold ON. Three-valued: a NULL
    in any of the three never selects (no coalescing)."""
    return ((F.col("is_latest") == F.lit(False))
            & (F.col("is_delete_marker") == F.lit(False))
            & (F.col("object_lock_event_hold_status") == F.lit(HOLD_ON)))


def candidates(inv: DataFrame) -> DataFrame:
    return inv.where(candidate_predicate())


def _segment(seconds: int) -> Column:
    """Time bucket of the timestamp. Non-nullable (coalesced), so the planner
    infers no extra filter on it and both uses of the group aggregate stay
    identical: their shuffle is computed once and reused."""
    seg = F.floor(F.unix_micros(F.col(LMD).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")
    return F.coalesce(seg, F.lit(-1).cast("bigint"))


def _first_rows(has_nc: Column, nc: tuple[Column, ...], every: tuple[Column, ...]) -> list[Column]:
    """Counts (delete markers, data versions, all) of a group's possibly-first
    rows: its noncurrent rows if any, otherwise every row (the current version
    alone)."""
    return [F.when(has_nc, a).otherwise(b).alias(n)
            for a, b, n in zip(nc, every, ("first_dm", "first_data", "first_all"))]


def timestamp_groups(inv: DataFrame, segment_seconds: int = SEGMENT_SECONDS, expired: bool = False) -> DataFrame:
    """A1 + A2: one row per (bucket, dt, key, timestamp) with the counts the
    classification needs. Rows with a NULL timestamp are no one's superseder.

    With ``expired``, also ``rest``: the same counts of the group once its
    noncurrent delete markers are gone, NULL when nothing else is in it."""
    nc = F.col("is_latest") == F.lit(False)
    dm = F.col("is_delete_marker") == F.lit(True)
    data = F.col("is_delete_marker") == F.lit(False)
    g = (inv.where(F.col(LMD).isNotNull())
         .select(*KEY, LMD, "is_latest", "is_delete_marker",
                 _segment(segment_seconds).alias("seg"))
         .groupBy(*KEY, "seg", LMD)
         .agg(F.count(F.lit(1)).alias("g_all"),
              F.count_if(dm).alias("g_dm"),
              F.count_if(data).alias("g_data"),
              F.count_if(nc).alias("g_nc"),
              F.count_if(nc & dm).alias("nc_dm"),
              F.count_if(nc & data).alias("nc_data")))
    c = F.col
    has_nc = c("g_nc") > 0
    more = []
    if expired:
        r_all, r_dm, r_nc = c("g_all") - c("nc_dm"), c("g_dm") - c("nc_dm"), c("g_nc") - c("nc_dm")
        more = [F.when(r_all > 0, F.struct(
            c(LMD).alias("lmd"), r_all.alias("g_all"), r_dm.alias("g_dm"), c("g_data").alias("g_data"),
            *_first_rows(r_nc > 0, (F.lit(0).cast("bigint"), c("nc_data"), r_nc), (r_dm, c("g_data"), r_all)))).alias("rest")]
    return g.select(
        *KEY, "seg", LMD, "g_all", "g_dm", "g_data", "g_nc",
        (F.when(has_nc, 1).otherwise(0)).alias("has_nc"),
        *_first_rows(has_nc, (c("nc_dm"), c("nc_data"), c("g_nc")), (c("g_dm"), c("g_data"), c("g_all"))),
        *more)


def timestamp_order(inv: DataFrame, segment_seconds: int = SEGMENT_SECONDS, expired: bool = False) -> DataFrame:
    """Each group with the next greater timestamp of its key and that
    group's possibly-first counts (NULL next for the key's last group).

    With ``expired``, also ``rest`` (see ``timestamp_groups``) and ``rest_next``:
    the possibly-first counts of the next group that is not empty then."""
    g0 = timestamp_groups(inv, segment_seconds, expired)
    nxt = F.struct(F.col(LMD).alias("lmd"), "first_dm", "first_data", "first_all")
    # both branches start from the same aggregate, so its shuffle is reused
    g = g0.withColumn("_n", F.lead(nxt).over(Window.partitionBy(*KEY, "seg").orderBy(LMD)))
    # first group of every segment, then the next non-empty segment's first
    # group: one row per segment
    # (min / min_by on fixed-width columns keep this a hash aggregate; the
    # timestamp is unique within a segment, so min_by is deterministic)
    firsts = [F.struct(
        F.min(LMD).alias("lmd"),
        F.min_by("first_dm", LMD).alias("first_dm"),
        F.min_by("first_data", LMD).alias("first_data"),
        F.min_by("first_all", LMD).alias("first_all")).alias("_f")]
    w_seg = Window.partitionBy(*KEY).orderBy("seg")
    nexts = [F.lead("_f").over(w_seg).alias("_sn")]
    more = []
    if expired:
        # the same two steps over the groups that are not empty: a lead that
        # passes over NULLs
        keys = ", ".join(KEY)
        g = g.withColumn("_rn", F.expr(f"lead(rest) IGNORE NULLS OVER (PARTITION BY {keys}, seg ORDER BY {LMD})"))
        at = F.col("rest.lmd")
        firsts.append(F.struct(F.min(at).alias("lmd"), *[
            F.min_by(F.col(f"rest.{n}"), at).alias(n) for n in ("first_dm", "first_data", "first_all")]).alias("_rf"))
        nexts.append(F.expr(f"lead(CASE WHEN _rf.lmd IS NOT NULL THEN _rf END) IGNORE NULLS "
                            f"OVER (PARTITION BY {keys} ORDER BY seg)").alias("_rsn"))
        r, rs = F.col("_rn"), F.col("_rsn")
        more = ["rest", F.struct(*[F.when(r.isNotNull(), r[n]).otherwise(rs[n]).alias(n)
                                   for n in ("lmd", "first_dm", "first_data", "first_all")]).alias("rest_next")]
    seg_next = g0.groupBy(*KEY, "seg").agg(*firsts).select(*KEY, "seg", *nexts)
    g = g.join(seg_next, KEY + ["seg"], "left")
    n = F.coalesce(F.col("_n"), F.col("_sn"))
    return g.select(
        *KEY, "seg", LMD, "g_all", "g_dm", "g_data", "g_nc", "has_nc",
        "first_dm", "first_data", "first_all",
        n["lmd"].alias("next_lmd"),
        F.coalesce(n["first_dm"], F.lit(0)).alias("n_dm"),
        F.coalesce(n["first_data"], F.lit(0)).alias("n_data"),
        F.coalesce(n["first_all"], F.lit(0)).alias("n_all"),
        *more)


def _kinds(g_all: Column, g_dm: Column, g_data: Column, n_all: Column, n_dm: Column, n_data: Column):
    """(some possible superseder, delete markers, data versions, kinds) of a
    candidate: the peers at its timestamp minus itself, plus the next group's
    possibly-first rows."""
    a, b = g_dm + n_dm, (g_data - 1) + n_data
    matched = g_all.isNotNull() & ((g_all - 1) + n_all > 0)
    kinds = (F.when(a > 0, 1).otherwise(0) + F.when(b > 0, 1).otherwise(0)).cast("bigint")
    return matched, a, b, kinds


def _class(matched: Column, b: Column, kinds: Column) -> Column:
    return (F.when(~matched | (kinds == 0), F.lit("unclassified"))
            .when(kinds > 1, F.lit("withheld"))
            .when(b > 0, F.lit("overwrite"))
            .otherwise(F.lit("delete")))


def classify_versions(inv: DataFrame, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """C1 (one-pass form). One row per candidate with:
    superseder_kinds (bigint), superseder_is_delete_marker (boolean),
    has_tied_noncurrent_peer (int), superseder_class, next_lmd and tie flags.

    Requires version ids to be non-null and unique per (bucket, dt, key); see
    ``assert_unique_versions``.
    """
    cand = (candidates(inv)
            .select(*KEY, "version_id", "object_lock_mode", LMD,
                    "object_lock_retain_until_date", _segment(segment_seconds).alias("seg")))
    ts = timestamp_order(inv, segment_seconds)
    j = cand.join(ts, KEY + ["seg", LMD], "left")
    matched, a, b, kinds = _kinds(*[F.col(n) for n in ("g_all", "g_dm", "g_data", "n_all", "n_dm", "n_data")])
    tied_nc = F.col("g_nc") - 1 > 0
    return j.select(
        *KEY, "version_id", "object_lock_mode", LMD, "object_lock_retain_until_date",
        F.when(matched, kinds).otherwise(F.lit(0).cast("bigint")).alias("superseder_kinds"),
        F.when(matched & (b > 0), F.lit(False)).when(matched & (a > 0), F.lit(True))
         .alias("superseder_is_delete_marker"),
        F.when(matched, F.when(tied_nc, 1).otherwise(0)).alias("has_tied_noncurrent_peer"),
        _class(matched, b, kinds).alias("superseder_class"),
        F.col("next_lmd"),
        F.coalesce(F.col("g_all") - 1 > 0, F.lit(False)).alias("has_tied_peer"),
        F.coalesce(tied_nc, F.lit(False)).alias("has_tied_noncurrent"),
    )


def classify_before_and_after(inv: DataFrame, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """Each candidate's class now and once every noncurrent delete marker has
    expired, in one pass over the same groups: the markers only take from the
    group counts, and groups left empty are passed over by the second lead."""
    cand = candidates(inv).select(*KEY, "version_id", "object_lock_mode", LMD, _segment(segment_seconds).alias("seg"))
    j = cand.join(timestamp_order(inv, segment_seconds, expired=True), KEY + ["seg", LMD], "left")
    now = _kinds(*[F.col(n) for n in ("g_all", "g_dm", "g_data", "n_all", "n_dm", "n_data")])
    r, n = F.col("rest"), F.col("rest_next")
    after = _kinds(r["g_all"], r["g_dm"], r["g_data"],
                   *[F.coalesce(n[k], F.lit(0)) for k in ("first_all", "first_dm", "first_data")])
    return j.select(*KEY, "version_id", "object_lock_mode",
                    _class(now[0], now[2], now[3]).alias("superseder_class"),
                    _class(after[0], after[2], after[3]).alias("class_after"))


def superseder_counts(inv: DataFrame, segment_seconds: int = SEGMENT_SECONDS) -> DataFrame:
    """J1 + J2 + U1, aggregated: per candidate with at least one possible
    superseder, how many are delete markers, how many data versions, and how
    many are tied noncurrent peers. Computed from the group counts, so no
    candidate x peer pairs are ever formed (a hot timestamp group stays
    linear)."""
    cand = (candidates(inv)
            .select(*KEY, "version_id", LMD, _segment(segment_seconds).alias("seg")))
    j = cand.join(timestamp_order(inv, segment_seconds), KEY + ["seg", LMD])
    n_poss = (F.col("g_all") - 1) + F.col("n_all")
    return j.where(n_poss > 0).select(
        *KEY, "version_id",
        (F.col("g_dm") + F.col("n_dm")).alias("delete_marker_superseders"),
        (F.col("g_data") - 1 + F.col("n_data")).alias("data_version_superseders"),
        (F.col("g_nc") - 1).alias("tied_noncurrent_peers"))


def withheld_reason() -> Column:
    """F8: reason text of a withheld candidate."""
    return (F.when(F.col("has_tied_noncurrent_peer") == 1, F.lit(REASON_TIED_PEER))
            .otherwise(F.lit(REASON_AMBIGUOUS)))


def assert_unique_versions(inv: DataFrame) -> None:
    """Raise when a version id is NULL or repeated within (bucket, dt, key).

    The one-pass form counts the candidate out of its own group; with a NULL
    or duplicated id the literal form would drop different peers. One
    aggregation over four narrow columns; only offending rows (at most 5)
    reach the driver.
    """
    bad = (inv.groupBy(*KEY, "version_id").agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("version_id").isNull() | (F.col("n") > 1))
           .limit(5).collect())
    if bad:
        raise ValueError(
            "version ids must be non-null and unique per (bucket, dt, key); "
            f"offending groups: {[r.asDict() for r in bad]}")


def _stamps(inv: DataFrame):
    """Brute-force helpers of the test oracle: each (key, timestamp) with the
    smallest later timestamp of its key (a self join on the key with an
    inequality: quadratic per key), and the timestamps holding a noncurrent
    row."""
    st = inv.where(F.col(LMD).isNotNull()).select(*KEY, F.col(LMD).alias("t")).distinct()
    a, b = st.alias("a"), st.alias("b")
    succ = (a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY] + [F.col("b.t") > F.col("a.t")], "left")
            .groupBy(*[F.col(f"a.{k}") for k in KEY], F.col("a.t")).agg(F.min("b.t").alias("t_next")))
    nc = inv.where(F.col("is_latest") == F.lit(False)).select(*KEY, F.col(LMD).alias("t")).distinct()
    return succ, nc


def possible_superseders(inv: DataFrame) -> DataFrame:
    """J1 + J2 + U1 (literal, pairwise form): one row per (candidate, possible
    superseder) with the superseder's delete-marker flag and whether it is a
    tied noncurrent peer. Bag semantics (UNION ALL). It pairs candidates with
    their tied peers, so it is only the brute-force oracle of the tests, run on
    small fixtures; ``superseder_counts`` is the scalable form."""
    succ, nc = _stamps(inv)
    c = candidates(inv).select(*KEY, "version_id", F.col(LMD).alias("t"))
    others = inv.select(*KEY, F.col("version_id").alias("v2"), F.col(LMD).alias("t"),
                        F.col("is_latest").alias("l2"), F.col("is_delete_marker").alias("sdm"))
    peers = (c.join(others, KEY + ["t"]).where(F.col("v2") != F.col("version_id"))
             .select(*KEY, "version_id", "sdm",
                     F.coalesce(F.col("l2") == F.lit(False), F.lit(False)).alias("peer_nc")))
    # rows of the next timestamp that may come first: noncurrent ones, or all
    # of them when that timestamp holds no noncurrent row
    first_rows = (others.join(nc.withColumn("_has_nc", F.lit(True)), KEY + ["t"], "left")
                  .where((F.col("l2") == F.lit(False)) | F.col("_has_nc").isNull())
                  .select(*KEY, F.col("t").alias("t_next"), "sdm"))
    nxt = (c.join(succ, KEY + ["t"]).join(first_rows, KEY + ["t_next"])
           .select(*KEY, "version_id", "sdm", F.lit(False).alias("peer_nc")))
    return peers.unionByName(nxt)


def classify_versions_joined(inv: DataFrame) -> DataFrame:
    """C1, literal joined form (J1, J2, U1, A1 to A3): the brute-force oracle
    the tests compare the one-pass form with, on small fixtures only."""
    succ, _ = _stamps(inv)
    verdict = possible_superseders(inv).groupBy(*KEY, "version_id").agg(
        F.count_distinct("sdm").alias("k"),
        F.when(F.bool_or(~F.col("sdm")), F.lit(False)).when(F.bool_or("sdm"), F.lit(True)).alias("superseder_is_delete_marker"),
        F.max(F.col("peer_nc").cast("int")).alias("has_tied_noncurrent_peer"))
    out = (candidates(inv).join(verdict, KEY + ["version_id"], "left")
           .join(succ.withColumnRenamed("t", LMD), KEY + [LMD], "left"))
    k = F.coalesce(F.col("k"), F.lit(0).cast("bigint"))
    return out.select(
        *KEY, "version_id", "object_lock_mode", LMD, "object_lock_retain_until_date",
        k.alias("superseder_kinds"), "superseder_is_delete_marker", "has_tied_noncurrent_peer",
        F.when(k == 0, "unclassified").when(k > 1, "withheld")
         .when(F.col("superseder_is_delete_marker"), "delete").otherwise("overwrite")
         .alias("superseder_class"),
        F.col("t_next").alias("next_lmd"),
    )
