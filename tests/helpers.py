"""Small builders for hand-written inventories (test input only)."""

from __future__ import annotations

import datetime as dt

from unhold.schemas import INVENTORY
from pyspark.sql import functions as F
from pyspark.sql import types as T

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def chain(key: str, spec: list[tuple], bucket: str = "b", snap: str = "2024-02-01-00-00"):
    """spec items: (version_id, minute, is_delete_marker, is_latest, hold)."""
    rows = []
    for vid, minute, dm, latest, hold in spec:
        rows.append((bucket, key, vid, latest, dm, 1, T0 + dt.timedelta(minutes=minute),
                     None, None if dm else "GOVERNANCE", None if dm else "OFF",
                     None if dm else hold, snap))
    return rows


def inventory_df(spark, rows):
    schema = T.StructType(INVENTORY.fields + [T.StructField("dt", T.StringType())])
    return spark.createDataFrame(rows, schema)


def classes(df):
    return {r.version_id: r.superseder_class for r in df.select("version_id", "superseder_class").collect()}


def reasons(df):
    return {r.version_id: r.reason for r in df.select("version_id", "reason").collect()}


def rows_of(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def col_eq(a, b):
    return F.col(a) == F.col(b)
