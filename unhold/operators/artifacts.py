"""Artifact retention, cost projection, reproducible sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RATE_CARD, RETENTION_RULES

# Bytes per object version of a Parquet listing (midpoint of 40 to 120).
BYTES_PER_VERSION = 80
TB = 1_000_000_000_000


def retention_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RETENTION_RULES, "prefix string, expire_days int")


def rate_card(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATE_CARD, "line_item string, unit string, rate_usd double")


def artifact_retention(artifacts: DataFrame, rules=RETENTION_RULES) -> DataFrame:
    """Each artifact (path, created_at) with the rule of its longest
    matching prefix and its expiry (NULL = kept until replaced).

    The rule list is fixed and short, so it is a literal array: matching and
    longest-prefix choice are per-row expressions (no join, no shuffle)."""
    arr = F.array(*[F.struct(F.lit(len(p)).alias("n"), F.lit(p).alias("rule_prefix"),
                             F.lit(d).cast("int").alias("expire_days")) for p, d in rules])
    best = F.array_max(F.filter(arr, lambda r: F.col("path").startswith(r["rule_prefix"])))
    return artifacts.select(
        "path", "created_at", best["rule_prefix"].alias("rule_prefix"), best["expire_days"].alias("expire_days"),
        F.when(best["expire_days"].isNotNull(),
               F.col("created_at") + F.make_dt_interval(best["expire_days"])).alias("expires_at"))


def run_artifacts(records: DataFrame, record_jobs: DataFrame) -> DataFrame:
    """Working artifacts a run leaves behind, as (path, created_at)."""
    r = records.select("run_id", "bucket", "snapshot_ts")
    per_run = r.select(
        F.explode(F.array(
            F.concat(F.lit("inventory/"), F.col("bucket"), F.lit("/inv/"), F.date_format("snapshot_ts", "yyyy-MM-dd'T'HH-mm'Z'"), F.lit("/manifest.json")),
            F.concat(F.lit("athena-results/"), F.col("run_id"), F.lit(".csv")),
            F.concat(F.lit("manifests/parts/"), F.col("run_id"), F.lit("/_query_complete.json")),
            F.concat(F.lit("diagnostics/withheld-candidates/dt="), F.date_format("snapshot_ts", "yyyy-MM-dd'T'HH-mm'Z'"), F.lit("/"), F.col("run_id"), F.lit(".csv")),
        )).alias("path"), F.col("snapshot_ts").alias("created_at"))
    per_job = record_jobs.join(r, "run_id").select(
        F.explode(F.array(
            F.concat(F.lit("manifests/combined/"), F.col("run_id"), F.lit("/"), F.col("mode"), F.lit("/manifest.csv")),
            F.concat(F.lit("reports/"), F.col("run_id"), F.lit("/"), F.col("mode"), F.lit("/report.csv")),
            F.concat(F.lit("manifests/previous/"), F.col("mode"), F.lit("/"), F.col("run_id"), F.lit(".csv")),
        )).alias("path"), F.col("snapshot_ts").alias("created_at"))
    # runs of one bucket and date share their inventory artifact: one object
    return per_run.unionByName(per_job).distinct()


def cost_estimate(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """A10: per (bucket, dt) and line item, quantity x rate in micro-dollars
    (integer, so totals add exactly). ``usage`` has bucket, dt, versions_listed,
    versions_released, jobs."""
    q = usage.select("bucket", "dt", F.explode(F.array(
        F.struct(F.lit("inventory_listing").alias("line_item"), (F.col("versions_listed") / 1e6).alias("quantity")),
        F.struct(F.lit("query_scan").alias("line_item"), (F.col("versions_listed") * BYTES_PER_VERSION / TB).alias("quantity")),
        F.struct(F.lit("batch_job").alias("line_item"), F.col("jobs").cast("double").alias("quantity")),
        F.struct(F.lit("batch_objects").alias("line_item"), (F.col("versions_released") / 1e6).alias("quantity")),
        F.struct(F.lit("put_requests").alias("line_item"), (F.col("versions_released") / 1e3).alias("quantity")),
    )).alias("u")).select("bucket", "dt", "u.line_item", "u.quantity")
    r = rates
    j = q.join(r, "line_item")
    return j.select("bucket", "dt", "line_item",
                    F.floor(F.col("quantity") * F.col("rate_usd") * 1e6 + 0.5).cast("bigint").alias("cost_micro_usd"))


def sample_keys(keys: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """O3: exactly ``n`` distinct keys (all when fewer), chosen by a seeded
    hash order so the sample is reproducible. The limit is the feature; Spark
    keeps a top-n per partition and merges them (no global sort)."""
    k = keys.select("bucket", "key").distinct()
    return (k.withColumn("_h", F.md5(F.concat_ws("/", "bucket", "key", F.lit(str(seed)))))
            .orderBy("_h", "bucket", "key").limit(n).drop("_h"))


def sample_keys_pct(keys: DataFrame, pct: float, seed: int = 42) -> DataFrame:
    """O3 percentage form: floor(distinct keys * pct / 100) keys in the same order."""
    total = keys.select("bucket", "key").distinct().count()
    return sample_keys(keys, int(total * pct // 100), seed)
