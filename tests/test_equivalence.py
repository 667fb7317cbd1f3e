"""Seeded random keys with dense timestamp ties: one-pass == joined form,
for several segment widths (the segmented lead must not change results)."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from helpers import inventory_df
from unhold.operators.classify import classify_before_and_after, classify_versions, classify_versions_joined
from unhold.operators.review import without_noncurrent_markers

COLS = ["bucket", "dt", "key", "version_id", "superseder_kinds", "superseder_is_delete_marker",
        "has_tied_noncurrent_peer", "superseder_class", "next_lmd"]


def random_inventory(seed: int, n_keys: int = 300):
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    vid = 0
    for k in range(n_keys):
        n = rnd.randint(1, 12)
        # few distinct timestamps -> dense ties; spread over days -> many segments
        stamps = sorted(t0 + dt.timedelta(hours=rnd.choice([0, 1, 2, 30, 31, 80, 200])) for _ in range(n))
        latest = n - 1 if rnd.random() < 0.9 else None
        for i, ts in enumerate(stamps):
            dm = rnd.random() < 0.3
            hold = None if dm else rnd.choice(["ON", "ON", "OFF"])
            rows.append((f"b{k % 3}", f"key {k}", f"v{vid}", i == latest, dm, 1, ts, None,
                         None if dm else rnd.choice(["GOVERNANCE", "COMPLIANCE"]), None, hold,
                         rnd.choice(["2024-02-01-00-00", "2024-01-16-00-00"])))
            vid += 1
    return rows


@pytest.mark.parametrize("seed,segment", [(1, 86_400), (2, 3_600), (3, 7 * 86_400)])
def test_one_pass_equals_joined(spark, seed, segment):
    inv = inventory_df(spark, random_inventory(seed)).cache()
    a = classify_versions(inv, segment_seconds=segment).select(*COLS)
    b = classify_versions_joined(inv).select(*COLS)
    assert a.count() > 100
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0


@pytest.mark.parametrize("seed,segment", [(4, 86_400), (5, 3_600), (6, 7 * 86_400)])
def test_class_after_equals_a_second_classification(spark, seed, segment):
    inv = inventory_df(spark, random_inventory(seed)).cache()
    k = ["bucket", "dt", "key", "version_id"]
    both = classify_before_and_after(inv, segment_seconds=segment).select(*k, "superseder_class", "class_after")
    now = classify_versions_joined(inv).select(*k, "superseder_class")
    after = classify_versions_joined(without_noncurrent_markers(inv)).select(*k, F.col("superseder_class").alias("class_after"))
    want = now.join(after, k)
    assert want.where("superseder_class != class_after").count() > 20
    assert both.exceptAll(want).count() == 0 and want.exceptAll(both).count() == 0
