"""Delivery schema check, CSV tables, validated JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import table_exists
from ..functions.text import is_valid_raw_dt, is_valid_run_id
from ..schemas import (DELIVERY_MANIFEST, LOCK_MODES, MANIFEST_CSV, OPTIONAL_INVENTORY_COLUMNS,
                       PARQUET_FIELD_PATTERN, QUERY_COMPLETE, REQUIRED_INVENTORY_COLUMNS,
                       WITHHELD_CSV)


def _arr(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def schema_drift(deliveries: DataFrame) -> DataFrame:
    """S3 + U2: per delivery, the delivered column names parsed from the
    Parquet message schema and the missing-required, missing-optional and
    undeclared sets (sorted, comma-joined), plus ``ok``: Parquet, parseable,
    nothing required missing."""
    delivered = F.array_distinct(F.regexp_extract_all(F.coalesce("fileSchema", F.lit("")),
                                                      F.lit(PARQUET_FIELD_PATTERN), 2))
    req, opt = _arr(REQUIRED_INVENTORY_COLUMNS), _arr(OPTIONAL_INVENTORY_COLUMNS)
    d = deliveries.withColumn("_cols", delivered)
    missing_req = F.array_sort(F.array_except(req, F.col("_cols")))
    missing_opt = F.array_sort(F.array_except(opt, F.col("_cols")))
    undeclared = F.array_sort(F.array_except(F.col("_cols"), F.array_union(req, opt)))
    parsed = F.size("_cols") > 0
    is_parquet = F.coalesce(F.col("fileFormat") == "Parquet", F.lit(False))
    return d.select(
        *[c for c in deliveries.columns if c not in ("fileSchema",)],
        F.array_join(F.array_sort("_cols"), ",").alias("delivered_columns"),
        F.array_join(missing_req, ",").alias("missing_required"),
        F.array_join(missing_opt, ",").alias("missing_optional"),
        F.array_join(undeclared, ",").alias("undeclared_columns"),
        (is_parquet & parsed & (F.size(missing_req) == 0)).alias("ok"),
        F.when(~is_parquet, "not_parquet").when(~parsed, "unparseable_schema")
         .when(F.size(missing_req) > 0, "missing_required_columns").otherwise("ok").alias("verdict"),
    )


def require_schema_ok(checked: DataFrame) -> None:
    """Batch gate: raise if any delivery fails the schema check."""
    bad = checked.where(~F.col("ok")).limit(5).collect()
    if bad:
        raise RuntimeError(f"inventory deliveries failed the schema check: {[r.asDict() for r in bad]}")


def read_delivery_manifests(spark: SparkSession, root: str) -> DataFrame:
    """manifest.json files under ``root`` (one JSON document per file), with
    the dt taken from the file path."""
    df = (spark.read.schema(DELIVERY_MANIFEST).option("multiLine", True)
          .option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(root))
    path = F.col("_metadata.file_path")
    return df.select("*", path.alias("manifest_path"),
                     F.element_at(F.split(path, "/"), -2).alias("dt_raw"))


_POINTER = T.StructType(MANIFEST_CSV.fields + [T.StructField("target", T.StringType()), T.StructField("mode", T.StringType())])


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """All manifests ever published to a pointer, with their ``run_id``."""
    schema = T.StructType(_POINTER.fields + [T.StructField("run_id", T.StringType())])
    return (spark.read.schema(schema).option("header", False).csv(path)
            .where(F.col("mode").isin(LOCK_MODES)).drop("target"))


def read_previous_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Headerless positional CSV (bucket, key, version_id) under
    ``mode=<MODE>/`` folders. The three-field schema is load-bearing: a
    shorter one would bind bucket as key and silently match nothing. Where a
    pointer was published (its log lies beside it), the run that it names for
    each (bucket, mode) counts."""
    if not table_exists(spark, f"{path}_log"):
        return (spark.read.schema(_POINTER).option("header", False).csv(path)
                .where(F.col("mode").isin(LOCK_MODES)).drop("target"))
    at = spark.read.parquet(f"{path}_log").groupBy("bucket", "mode").agg(F.max_by("run_id", F.struct("dt", "run_id")).alias("run_id"))
    return read_published(spark, path).join(at, ["bucket", "mode", "run_id"], "left_semi").select("bucket", "key", "version_id", "mode")


def read_withheld_history(spark: SparkSession, path: str, dts: list[str]) -> DataFrame:
    """Withheld diagnostic history; a dt predicate is mandatory. The
    bucket comes from the ``target=`` folder."""
    if not dts:
        raise ValueError("withheld history needs at least one dt")
    schema = T.StructType(WITHHELD_CSV.fields + [T.StructField("target", T.StringType()),
                                                 T.StructField("dt", T.StringType())])
    return (spark.read.schema(schema).option("header", False).csv(path)
            .where(F.col("dt").isin(dts)).withColumnRenamed("target", "bucket"))


def validate_run_records(records: DataFrame) -> DataFrame:
    """Rule columns over query-complete records read PERMISSIVE; adds
    ``problems`` (array of rule names) and ``valid``. Where the records carry
    ``path_run_id`` (the run of the folder that delivered them), a record that
    names another run is a ``run_id_mismatch``."""
    rc = F.col("row_counts")
    rules = [
        ("corrupt_record", F.col("_corrupt_record").isNotNull()),
        ("invalid_run_id", ~is_valid_run_id("run_id")),
        ("invalid_dt", ~is_valid_raw_dt("dt")),
        ("missing_target_bucket", F.col("target_bucket").isNull() | (F.col("target_bucket") == "")),
        ("missing_inventory_id", F.col("inventory_id").isNull()),
        ("missing_modes_succeeded", F.col("modes_succeeded").isNull()),
        ("disallowed_mode", F.coalesce(F.exists("modes_succeeded", lambda m: m.isNull() | ~m.isin(LOCK_MODES)), F.lit(False))),
        ("missing_mode_count", F.coalesce(~F.forall(_arr(LOCK_MODES), lambda m: F.map_contains_key(rc, m)), F.lit(True))),
        ("negative_count", F.coalesce(F.exists(F.map_values(rc), lambda v: v.isNull() | (v < 0)), F.lit(False))),
        ("unknown_mode", F.coalesce(F.exists(F.map_keys(rc), lambda k: ~k.isin(LOCK_MODES)), F.lit(False))),
    ]
    if "path_run_id" in records.columns:
        rules.append(("run_id_mismatch", F.coalesce(F.col("run_id") != F.col("path_run_id"), F.lit(False))))
    problems = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]), lambda x: x.isNotNull())
    return records.withColumn("problems", problems).withColumn("valid", F.size("problems") == 0)


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(QUERY_COMPLETE).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
