"""Snapshot-scoped inventory scans.

Two layouts are supported:
* a delivery layout, where Parquet data files sit in one flat shared folder and
  a per-delivery ``hive/dt=<dt>/symlink.txt`` lists the files of that
  snapshot (S1);
* a table partitioned by ``bucket`` and ``dt`` (S2), where a dt predicate is
  pruned to the matching folders by the Parquet source itself.
Both read with the explicit inventory schema; Parquet binds by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import INVENTORY


def _unescaped(uri: Column) -> Column:
    """The path that a file URI of the scan stands for (a plus is itself)."""
    return F.url_decode(F.regexp_replace(uri, r"\+", "%2B"))


def symlink_paths(spark: SparkSession, root: str, dts: list[str]) -> DataFrame:
    """(path, dt) for every data file listed by the deliveries ``dts``."""
    # the folder holds the delivery's symlink.txt; reading the folder also
    # accepts a listing written as part files by Spark's own text writer
    frames = [spark.read.text(f"{root}/hive/dt={dt}")
              .select(F.trim("value").alias("path"), F.lit(dt).alias("dt"))
              for dt in dts]
    return reduce(DataFrame.unionByName, frames).where(F.col("path") != "")


def read_inventory(spark: SparkSession, root: str, dts: list[str], bucket: str | None = None) -> DataFrame:
    """The snapshots ``dts`` of a delivery layout, in one Parquet scan.

    The listed paths are gathered (file metadata, one row per file), the data
    files are scanned once, and each row gets its dt from a join of
    ``_metadata.file_path`` to the listing. A missing listing raises
    (path not found): never a silent empty snapshot.
    """
    listing = symlink_paths(spark, root, dts)
    paths = [r.path for r in listing.select("path").distinct().collect()]
    if not paths:
        raise FileNotFoundError(f"deliveries {dts} under {root} list no data files")
    data = (spark.read.schema(INVENTORY).parquet(*paths)
            .withColumn("_file", F.col("_metadata.file_path")))
    # _metadata.file_path is an escaped URI (file:/...); compare unescaped paths
    lst = listing.select(F.col("path").alias("_listed"), "dt")
    lst = lst.withColumn("_norm", F.regexp_replace("_listed", "^[a-zA-Z0-9]+:(//)?", "/"))
    lst = lst.withColumn("_norm", F.regexp_replace("_norm", "^/+", "/"))
    data = data.withColumn("_norm", F.regexp_replace(F.regexp_replace(_unescaped(F.col("_file")), "^[a-zA-Z0-9]+:(//)?", "/"), "^/+", "/"))
    # a scanned file that matches no listing is an error, never dropped rows
    unlisted = F.raise_error(F.concat(F.lit("no listing has the file "), F.col("_file"))).cast("string")
    out = data.join(lst, "_norm", "left").withColumn("dt", F.coalesce(F.col("dt"), unlisted)).drop("_norm", "_file", "_listed")
    if bucket is not None:
        out = out.withColumn("bucket", F.coalesce(F.col("bucket"), F.lit(bucket)))
    return out


def write_delivery(inv: DataFrame, root: str, dt: str) -> str:
    """Write one snapshot in the delivery layout (data files plus the listing)
    and return the data folder. Used by tests and the local bench."""
    data_dir = f"{root}/data/{dt}"
    inv.drop("dt").write.mode("overwrite").parquet(data_dir)
    spark = inv.sparkSession
    files = (spark.read.parquet(data_dir).select(_unescaped(F.col("_metadata.file_path")).alias("p")).distinct())
    files.coalesce(1).write.mode("overwrite").text(f"{root}/hive/dt={dt}")
    return data_dir


def write_inventory_table(inv: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned Parquet table (bucket, dt). Range-partitioned on
    (bucket, dt, key) so every writer task owns a contiguous key range (few
    files per folder, sorted, so row-group statistics prune key-prefix scans)
    while one large bucket still spreads over many tasks."""
    n = int(inv.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (inv.repartitionByRange(n, "bucket", "dt", "key", "last_modified_date", "version_id")  # a hot key spreads over tasks
     .sortWithinPartitions("bucket", "dt", "key", "last_modified_date")
     .write.mode(mode).partitionBy("bucket", "dt").parquet(path))


def read_inventory_table(spark: SparkSession, path: str, dt: str | None = None,
                         buckets: list[str] | None = None, key_prefix: str | None = None) -> DataFrame:
    """S2 + P4: partition pruning on dt/bucket, prefix pushdown on key."""
    schema = T.StructType(INVENTORY.fields[1:] + [T.StructField("bucket", T.StringType()),
                                                  T.StructField("dt", T.StringType())])
    df = spark.read.schema(schema).parquet(path)
    if dt is not None:
        df = df.where(F.col("dt") == F.lit(dt))
    if buckets is not None:
        df = df.where(F.col("bucket").isin(buckets))
    if key_prefix is not None:
        df = df.where(F.col("key").startswith(key_prefix))
    return df
