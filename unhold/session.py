"""Spark session defaults and the shared checkpoint folder.

On a cluster the session arrives configured (``spark.checkpoint.dir`` names a
shared folder); we only fill in settings that are unset, so tests and the
local bench get sane values without overriding a real deployment.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on. Time zone matters: the inventory columns
# are TIMESTAMP_NTZ and `date_trunc` round-trips through the session zone.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "false",
}


def build_session(master: str | None = None, app: str = "unhold",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Local/test session builder. The UI stays off: no server is started."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": str(shuffle_partitions or 8),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **_DEFAULTS,
    }
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL defaults that are still unset on ``spark``."""
    for k, v in _DEFAULTS.items():
        if k == "spark.sql.session.timeZone":
            # Always UTC: the fixtures and all timestamp text assume it.
            spark.conf.set(k, v)
        elif spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, as named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session; only when it is unset
    (tests, the local bench) a fresh scratch folder is created and recorded,
    so a cluster run never falls back to a machine-local folder silently.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.sparkContext.getCheckpointDir()
        except Exception:  # noqa: BLE001 - no classic SparkContext (e.g. Connect)
            d = None
    if not d:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: a machine-local "
                               "scratch folder is not visible to the executors of a cluster")
        d = tempfile.mkdtemp(prefix="unhold-ckpt-", dir=os.environ.get("UNHOLD_SCRATCH", "/tmp"))
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001 - Connect sessions have no SparkContext
        pass
    return d


def scratch_table(df, name: str):
    """``df`` written once as Parquet under the shared checkpoint folder and read
    back: a result that every later use, and every retry, reads the same."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
