"""Hold history: spans over any number of snapshots, in one pass and one
delivery at a time."""

import datetime as dt

import pytest

from conftest import SF
from helpers import T0
from unhold import fixtures as fx
from unhold.functions.text import path_part
from unhold.operators import verify as V
from unhold.plans import catalog
from unhold.schemas import INVENTORY
from unhold.sources.sinks import merge_hold_history, read_hold_history
from pyspark.sql import functions as F
from pyspark.sql import types as T

DTS = [f"2024-0{m}-01-00-00" for m in range(1, 6)]
SCHEMA = T.StructType(INVENTORY.fields + [T.StructField("dt", T.StringType())])
COLS = [*V.HISTORY, "ended_by"]


def row(version, at, hold, retain_days, bucket="b"):
    retain = None if retain_days is None else T0 + dt.timedelta(days=retain_days)
    return (bucket, "k", version, False, False, 1, T0, retain, "GOVERNANCE", "OFF", hold, DTS[at])


def spans(df, version):
    rows = df.where(F.col("version_id") == version).orderBy("first_dt").collect()
    return [(r.hold_status, DTS.index(r.first_dt), DTS.index(r.last_dt), r.snapshots, r.advances, r.setbacks, r.ended_by) for r in rows]


@pytest.fixture()
def rows(spark):
    data = []
    data += [row("rolls", i, "ON", 10 + i) for i in range(5)]
    data += [row("released", i, "ON", 10) for i in range(2)] + [row("released", i, "OFF", 10) for i in range(2, 5)]
    data += [row("again", 0, "ON", 10), row("again", 1, "OFF", 10), row("again", 2, "ON", 9), row("again", 3, "ON", 8), row("again", 4, "ON", None)]
    data += [row("gap", 0, "ON", 1), row("gap", 2, "ON", 2), row("gap", 3, "ON", 3)]
    data += [row("marker", 3, None, None), row("marker", 4, "ON", None)]
    data += [row("other", i, "ON", i, bucket="c") for i in (1, 3)]  # the other bucket is delivered twice
    return spark.createDataFrame(data, SCHEMA)


def merged(spark, rows, path):
    for at in DTS:
        part = rows.where(F.col("dt") == at)
        assert merge_hold_history(part, part.select("bucket", "dt").distinct(), path, at)
    return read_hold_history(spark, path)


def test_spans(spark, rows, tmp):
    for out in (V.hold_history(rows), merged(spark, rows, f"{tmp}/h")):
        assert spans(out, "rolls") == [("ON", 0, 4, 5, 4, 0, None)]
        assert spans(out, "released") == [("ON", 0, 1, 2, 0, 0, "released"), ("OFF", 2, 4, 3, 0, 0, None)]
        assert spans(out, "again") == [("ON", 0, 0, 1, 0, 0, "released"), ("OFF", 1, 1, 1, 0, 0, "hold_reapplied"), ("ON", 2, 4, 3, 0, 1, None)]
        assert spans(out, "gap") == [("ON", 0, 0, 1, 0, 0, "absent"), ("ON", 2, 3, 2, 1, 0, "absent")]
        assert spans(out, "marker") == [("none", 3, 3, 1, 0, 0, "status_changed"), ("ON", 4, 4, 1, 0, 0, None)]
        # a snapshot of one bucket says nothing about another's
        assert spans(out, "other") == [("ON", 1, 3, 2, 1, 0, None)]


def test_a_delivery_without_rows_ends_what_lasted(spark, rows, tmp):
    first = rows.where(F.col("dt") == DTS[0])
    merge_hold_history(first, first.select("bucket", "dt").distinct(), tmp, DTS[0])
    none = rows.where(F.lit(False))
    merge_hold_history(none, spark.createDataFrame([("b", DTS[1])], "bucket string, dt string"), tmp, DTS[1])
    out = read_hold_history(spark, tmp).collect()
    assert len(out) == 4 and {r.ended_by for r in out} == {"absent"}
    assert V.hold_history(none).count() == 0


def test_a_killed_step_is_written_again_and_a_committed_one_is_not(spark, rows, tmp):
    whole = sorted(map(tuple, merged(spark, rows, f"{tmp}/whole").select(*COLS).collect()), key=str)
    path = f"{tmp}/killed"
    for at in DTS:
        part = rows.where(F.col("dt") == at)
        delivered = part.select("bucket", "dt").distinct()
        # died after the first write: another state of this step lies there, uncommitted
        part.select(*V.VERSION).write.parquet(f"{path}/lasting/step={at}")
        assert merge_hold_history(part, delivered, path, at)
        before = read_hold_history(spark, path).count()
        assert not merge_hold_history(part, delivered, path, at)
        assert read_hold_history(spark, path).count() == before
    assert sorted(map(tuple, read_hold_history(spark, path).select(*COLS).collect()), key=str) == whole
    with pytest.raises(ValueError, match="older"):
        merge_hold_history(rows, rows.select("bucket", "dt"), path, "2024-04-15-00-00")


def test_one_pass_equals_merging_on_the_fixture(spark):
    one = catalog.REGISTRY["hold_history"][0](spark, SF)
    kept = catalog.REGISTRY["hold_history_merged"][0](spark, SF)
    one, kept = (sorted(map(tuple, d.select(*COLS).collect()), key=str) for d in (one, kept))
    assert one == kept and {r[-1] for r in one} == {None, "absent", "released", "hold_reapplied"}
    assert any(r[COLS.index("setbacks")] for r in one)


def test_a_merge_shuffles_the_delivery_and_the_lasting_spans_only(spark, rows):
    lasting, _ = V.merge_delivery(None, rows.where(F.col("dt") == DTS[0]), None)
    lasts, over = V.merge_delivery(lasting, rows.where(F.col("dt") == DTS[1]), rows.select("bucket", "dt").distinct())
    for df in (lasts, over):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_path_parts_from_both_ends(spark):
    got = spark.range(1).select(*[path_part(F.lit("a/b/c"), i) for i in (0, 2, -1, -3, 3, -4)]).first()
    assert tuple(got) == ("a", "c", "c", "a", None, None)
    assert fx.SERIES[0] == fx.SNAPSHOTS[0] and fx.SERIES[-1] == fx.SNAPSHOTS[-1]
