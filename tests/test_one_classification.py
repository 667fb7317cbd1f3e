"""What the ladder's queries shuffle: one classification each, and an inventory
whose join takes each event once."""

import datetime as dt

import pytest

from test_plans import static_shuffles
from unhold import fixtures as fx
from unhold.operators import eligibility as E
from unhold.plans.catalog import REGISTRY


def write_events(spark, path, rows):
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double") \
        .write.parquet(f"{path}/events.parquet")


def at(day, second=0):
    return dt.datetime(2024, 1, day, 0, 0, second)


@pytest.mark.parametrize("name", ["audit_trail_decided", "next_previous_manifest", "latest_decision"])
def test_the_inventory_is_classified_once(spark, tmp, monkeypatch, name):
    # per user: a held version, then a delete marker, then a current version
    write_events(spark, tmp, [(3 * u + i, at(1 + i, u), u, t, 1.0) for u in range(12) for i, t in enumerate(("buy", "error", "buy"))])
    calls, classify = [], E.classify_versions
    monkeypatch.setattr(E, "classify_versions", lambda *a: calls.append(a) or classify(*a))
    assert REGISTRY[name][0](spark, tmp).count() > 0  # makes the evidence too
    assert len(calls) == 1


def test_inventory_marks_the_latest_of_odd_rows(spark, tmp):
    # user 1: null id, null time, twice the same row, a row after the last cut; no user: no key
    write_events(spark, tmp, [(1, at(2), 1, "buy", 1.0), (None, at(20), 1, "buy", 1.0), (2, None, 1, "buy", 1.0),
                              (3, at(18), 1, "view", 1.0), (3, at(18), 1, "view", 1.0), (4, dt.datetime(2024, 3, 1), 1, "buy", 1.0),
                              (5, at(3), None, "buy", 1.0), (None, at(4), 2, "buy", 1.0), (6, at(20), 3, "error", 1.0)])
    inv = fx.inventory(spark, tmp)
    got = sorted(((r.dt[5:10], r.key[11:12], r.version_id, r.is_latest) for r in inv.collect()), key=str)
    assert got == sorted([
        ("01-16", "1", "1", True), ("01-16", "2", None, None),
        ("02-01", "1", "1", False), ("02-01", "1", None, None), ("02-01", "1", "3", True), ("02-01", "1", "3", True),
        ("02-01", "2", None, None), ("02-01", "3", "6", True)], key=str)


def test_inventory_join_takes_each_event_once(spark, tmp):
    write_events(spark, tmp, [(1, at(2), 1, "buy", 1.0)])
    inv = fx.inventory(spark, tmp)
    assert static_shuffles(spark, inv) == 2  # the keys' maxima, the events
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = inv._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.index("Generate explode") < plan.index("Exchange")  # a row multiplies above the shuffles
