"""Hand-written topologies (FIXTURES.md section 4), both classifier forms."""

import pytest

from helpers import chain, classes, inventory_df, reasons
from unhold.operators.classify import assert_unique_versions, classify_versions, classify_versions_joined
from unhold.operators.eligibility import eligible, unclassified, withheld
from unhold.operators.review import withheld_remedy

D, V = True, False  # delete marker / data version

CASES = [
    # id, spec (vid, minute, dm, latest, hold), expected class per candidate
    ("1_v1_v2_D", [("v1", 0, V, False, "ON"), ("v2", 1, V, False, "ON"), ("d", 2, D, True, None)],
     {"v1": "overwrite", "v2": "delete"}),
    ("2_v1_D_v2", [("v1", 0, V, False, "ON"), ("d", 1, D, False, None), ("v2", 2, V, True, "ON")],
     {"v1": "delete"}),
    ("3_tie_current", [("v1", 0, V, False, "ON"), ("v2", 0, V, True, "ON")], {"v1": "overwrite"}),
    ("4_tie_current_marker", [("v1", 0, V, False, "ON"), ("d", 0, D, True, None)], {"v1": "delete"}),
    ("5_two_held_tied", [("v1", 0, V, False, "ON"), ("v2", 0, V, False, "ON"), ("v3", 1, V, True, "ON")],
     {"v1": "overwrite", "v2": "overwrite"}),
    ("6_tie_noncurrent_marker", [("v1", 0, V, False, "ON"), ("d", 0, D, False, None), ("v2", 1, V, True, "ON")],
     {"v1": "withheld"}),
    ("7_tie_then_marker", [("v1", 0, V, False, "ON"), ("v2", 0, V, False, "ON"), ("d", 1, D, True, None)],
     {"v1": "withheld", "v2": "withheld"}),
    ("8_next_group_mixed", [("v1", 0, V, False, "ON"), ("v2", 1, V, False, "ON"), ("d", 1, D, False, None),
                            ("v3", 2, V, True, "ON")],
     {"v1": "withheld", "v2": "withheld"}),
    ("9_next_group_current_marker", [("v1", 0, V, False, "ON"), ("v2", 1, V, False, "ON"), ("d", 1, D, True, None)],
     {"v1": "overwrite", "v2": "delete"}),
    ("10_lonely", [("v1", 0, V, False, "ON")], {"v1": "unclassified"}),
    ("11_hold_off", [("v1", 0, V, False, "OFF"), ("v2", 1, V, True, "ON")], {}),
]


@pytest.mark.parametrize("name,spec,expected", CASES, ids=[c[0] for c in CASES])
def test_topology(spark, name, spec, expected):
    inv = inventory_df(spark, chain("k", spec))
    assert classes(classify_versions(inv)) == expected
    assert classes(classify_versions_joined(inv)) == expected


def test_withheld_reasons_and_remedies(spark):
    rows = (chain("k6", CASES[5][1]) + chain("k7", CASES[6][1]) + chain("k8", CASES[7][1]))
    inv = inventory_df(spark, rows)
    r = {(x.key, x.version_id): x.reason for x in withheld(inv).collect()}
    assert r == {("k6", "v1"): "tied_noncurrent_peer", ("k7", "v1"): "tied_noncurrent_peer",
                 ("k7", "v2"): "tied_noncurrent_peer", ("k8", "v1"): "ambiguous_successor_classification",
                 ("k8", "v2"): "tied_noncurrent_peer"}
    rem = {(x.key, x.version_id): x.remedy for x in withheld_remedy(inv).collect()}
    assert rem[("k6", "v1")] == "self_heals"
    assert rem[("k7", "v1")] == "stuck" and rem[("k7", "v2")] == "stuck"


def test_either_selects_every_candidate(spark):
    rows = []
    for i, (_, spec, _) in enumerate(CASES[:10]):
        rows += chain(f"k{i}", spec)
    inv = inventory_df(spark, rows)
    n_cand = sum(1 for _, spec, _ in CASES[:10] for s in spec if not s[3] and not s[2] and s[4] == "ON")
    assert eligible(inv, "either").count() == n_cand
    # unclassified rows are neither eligible nor withheld
    unc = {r.key for r in unclassified(inv).collect()}
    assert unc == {"k9"}
    elig = {(r.key, r.version_id) for r in eligible(inv, "delete").union(eligible(inv, "overwrite")).collect()}
    assert all(k != "k9" for k, _ in elig)


def test_either_plan_has_no_window(spark):
    inv = inventory_df(spark, chain("k", CASES[0][1]))
    plan = eligible(inv, "either")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_null_or_duplicate_version_ids_raise(spark):
    dup = chain("k", [("v1", 0, V, False, "ON"), ("v1", 1, V, True, "ON")])
    with pytest.raises(ValueError):
        assert_unique_versions(inventory_df(spark, dup))
    nul = chain("k", [(None, 0, V, False, "ON"), ("v2", 1, V, True, "ON")])
    with pytest.raises(ValueError):
        assert_unique_versions(inventory_df(spark, nul))


def test_three_valued_logic(spark):
    # NULL is_latest / hold never select a candidate
    rows = chain("k", [("v1", 0, V, None, "ON"), ("v2", 1, V, False, None), ("v3", 2, V, True, "ON")])
    inv = inventory_df(spark, rows)
    assert classify_versions(inv).count() == 0


def test_remedy_with_stored_classification_restricts_keys(spark, tmp):
    from unhold.operators.review import reclassification_hazard
    rows = (chain("k6", CASES[5][1]) + chain("k7", CASES[6][1]) + chain("k1", CASES[0][1]))
    inv = inventory_df(spark, rows)
    classify_versions(inv).write.parquet(f"{tmp}/cls")
    stored = spark.read.parquet(f"{tmp}/cls")
    a = {(r.key, r.version_id, r.remedy) for r in withheld_remedy(inv, stored).collect()}
    b = {(r.key, r.version_id, r.remedy) for r in withheld_remedy(inv).collect()}
    assert a == b and len(a) == 3
    assert reclassification_hazard(inv, stored).count() == reclassification_hazard(inv).count()
