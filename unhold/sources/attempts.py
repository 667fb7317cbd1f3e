"""Versioned outputs: attempt folders and one commit row.

A job writes every output under ``<root>/<name>/attempt=<id>/`` and deletes
nothing. The attempt counts once its rows in ``<root>/commits`` are there: one
file, written in one job, for all runs of the attempt. Readers resolve a run to
the attempt of its latest commit, so a job that dies at any write leaves the
earlier outputs as they were. Only after a commit are the folders removed that no
commit names any more, those of dead attempts among them.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import clear_folders, table_exists


def attempt_path(root: str, name: str, attempt: str) -> str:
    return f"{root}/{name}/attempt={attempt}"


def begin(root: str, attempt: str, runs: DataFrame) -> None:
    """Note which runs an attempt is about to write."""
    runs.select("run_id", "bucket", "dt").withColumn("attempt", F.lit(attempt)).coalesce(1).write.mode("append").parquet(f"{root}/begun")


def commit(spark: SparkSession, root: str, attempt: str, runs: DataFrame) -> None:
    """The commit rows of an attempt, after all of its outputs were written."""
    rows = runs.select("run_id", "bucket", "dt")
    if table_exists(spark, f"{root}/commits"):
        last = spark.read.parquet(f"{root}/commits").groupBy("run_id").agg(F.max("seq").alias("_last"))
        rows = rows.join(last, "run_id", "left")
    else:
        rows = rows.withColumn("_last", F.lit(None).cast("bigint"))
    (rows.select("run_id", "bucket", "dt", F.lit(attempt).alias("attempt"), (F.coalesce("_last", F.lit(0)) + 1).alias("seq"),
                 F.current_timestamp().cast("timestamp_ntz").alias("committed_at"))
     .coalesce(1).write.mode("append").parquet(f"{root}/commits"))


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """(run_id, attempt) of each run's latest commit; None where nothing was
    committed in this layout."""
    if not table_exists(spark, f"{root}/commits"):
        return None
    return spark.read.parquet(f"{root}/commits").groupBy("run_id").agg(F.max_by("attempt", "seq").alias("attempt"))


def resolved(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` read from ``path`` (``<root>/<name>``), only those of the attempt
    that counts for their run. A folder without attempts is read as it is."""
    if "attempt" not in rows.columns:
        return rows
    at = current(rows.sparkSession, posixpath.dirname(path.rstrip("/")))
    return rows.drop("attempt") if at is None else rows.join(at, ["run_id", "attempt"], "left_semi").drop("attempt")


def retire(spark: SparkSession, root: str, runs: DataFrame, folders: dict[str, str]) -> None:
    """Remove what earlier attempts wrote for ``runs``. ``folders``: output name
    to its sub-folder of a run, with {run_id}, {bucket}, {dt} and {raw}."""
    old = spark.read.parquet(f"{root}/begun").join(runs.select("run_id"), "run_id", "left_semi").join(current(spark, root), ["run_id", "attempt"], "left_anti")
    for r in old.distinct().collect():  # earlier attempts of this job's own runs
        raw = f"{r.dt[:10]}T{r.dt[11:]}Z"
        for name, sub in folders.items():
            clear_folders(spark, attempt_path(root, name, r.attempt), [sub.format(run_id=r.run_id, bucket=r.bucket, dt=r.dt, raw=raw)])
