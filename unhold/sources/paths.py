"""Whether a stored table is there: only "no such path" counts as absent; a
storage error is raised, never read as an empty table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

_ABSENT = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).limit(0).collect()
        return True
    except AnalysisException as e:
        if e.getCondition() in _ABSENT:
            return False
        raise


def csv_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("value string").csv(path).limit(0).collect()
        return True
    except AnalysisException as e:
        if e.getCondition() in _ABSENT:
            return False
        raise


def clear_folders(spark: SparkSession, path: str, folders: list[str]) -> None:
    """Remove partition folders of ``path`` before they are written again: a
    dynamic overwrite leaves a partition that got no rows as it was."""
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        fs = at.getFileSystem(conf)
        if fs.exists(at):
            fs.delete(at, True)
