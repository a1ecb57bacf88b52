"""Forensic and error reports on rows written out by hand; rows as JSON."""

import pytest

from ledgerloom.plans import reports
from ledgerloom.sources import ledger as src

KNOWN = [
    ("a", "gym", "gym", 0.9), ("b", "gym", "gym", 0.9), ("c", "gym", "none", 0.4), ("d", "none", "none", 0.7), ("e", "none", "music", 0.6), ("f", "cloud", "music", 0.5), ("g", "music", "music", 0.8),
]
WIDE = "client_id string, family string, client_total_count long, amount0_count long, amount0_last_age double, amount0_gap_cv double, amount0_gap_median double, amount0_amount_median double, amount0_refund_count long, broad0_count long, broad0_last_age double, broad0_gap_median double, broad0_amount_median double, broad0_refund_count long"
FEATURES = [
    ("a", "gym", 10, 5, 12.0, 0.1, 30.0, 9.99, 2, 7, 12.0, 29.0, 10.0, 0), ("b", "gym", 50, 3, 95.0, 0.5, 31.0, 8.0, None, None, None, None, None, None),
    ("c", "gym", 200, None, None, None, None, None, None, 2, 5.0, 14.0, 3.0, 0), ("d", "none", 60, None, None, None, None, None, None, None, None, None, None, None),
    ("d", "gym", 60, 4, 1.0, 0.0, 7.0, 1.0, 0, None, None, None, None, None), ("e", "none", 60, None, None, None, None, None, None, None, None, None, None, None),
    ("f", "cloud", 60, 2, 3.0, 0.0, 7.0, 1.0, 0, None, None, None, None, None), ("g", "music", 60, 2, 3.0, 0.0, 7.0, 1.0, 0, 2, 4.0, 14.0, 5.5, 1),
]


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame(KNOWN, "client_id string, truth string, prediction string, confidence double")


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(FEATURES, WIDE)


def test_cohorts_and_kinds(known, wide):
    got = {r["cohort"]: (r["n"], r["errors"]) for r in reports.error_cohorts(reports.with_own_evidence(known, wide)).collect()}
    assert got == {
        "all": (7, 3), "low_history": (1, 0), "high_activity": (1, 1), "true_none": (2, 1), "true_family": (5, 2), "family_without_candidate": (3, 2),
        "family_regular": (1, 0), "family_irregular": (1, 0), "family_recent": (1, 0), "family_stale": (1, 0),
    }
    assert reports.error_kinds(known).first().asDict() == {"errors": 3, "missed": 1, "invented": 1, "wrong_family": 1}
    empty = reports.error_cohorts(reports.with_own_evidence(known.limit(0), wide)).collect()
    assert len(empty) == 10 and {(r["n"], r["errors"], r["accuracy"]) for r in empty} == {(0, 0, None)}


def test_explanations(known, wide):
    got = {r["label"]: r for r in reports.explanations(known, wide).collect()}
    # ties of confidence go to the smaller id
    assert {k: (r["client_id"], r["evidence"], r["count"]) for k, r in got.items()} == {"gym": ("a", "amount0", 5), "none": ("d", None, None), "music": ("g", "broad0", 2)}
    assert got["gym"]["note"] == "5 payments, every 30.0 days, the last 12.0 days ago, 9.99 each; refunds matched to it: 2"
    assert got["none"]["note"] == "families with a repeated amount: 1"
    bare = reports.explanations(known.where("client_id = 'b'"), wide.where("client_id = 'b'").withColumn("amount0_count", wide["amount0_count"] - 1)).first()
    assert bare["evidence"] is None and bare["note"] == "no repeated payment of this family"
    assert reports.explanations(known.limit(0), wide).count() == 0


def test_cluster_report_takes_medians_over_ranges(spark):
    rows = [(k % 2 == 0, float(k % 7), k) for k in range(41)]
    x = spark.createDataFrame(rows, "matches_target boolean, gap_median double, count long")
    got = {(r["matches_target"], r["statistic"]): (r["n"], r["median"]) for r in reports.cluster_report(x, ["gap_median", "count"]).collect()}
    assert got == {(True, "gap_median"): (21, 3.0), (True, "count"): (21, 20.0), (False, "gap_median"): (20, 3.0), (False, "count"): (20, 20.0)}
    assert [(r["days"], r["n"]) for r in reports.interval_counts(spark.createDataFrame([(0.5,), (1.5,), (2.5,), (1.9,)], "gap_median double")).collect()] == [(2, 3), (0, 1)]


def test_rows_as_json_and_back(spark):
    x = spark.createDataFrame([(1, 'say "hi"\n{}', 0.1, None), (2, None, None, 7), (3, "", -0.0, 2**60), (3, "", -0.0, 2**60)], "id long, text string, part double, big long")
    back = src.from_json_rows(src.to_json_rows(x, "id"), "id", x.schema)
    assert back.schema.names == x.schema.names and sorted(map(repr, back.collect())) == sorted(map(repr, x.collect()))
    assert src.from_json_rows(src.to_json_rows(x.limit(0), "id"), "id", x.schema).count() == 0
    broken = spark.createDataFrame([(1, "{no json")], "id long, json string")
    with pytest.raises(Exception, match="(?i)malformed"):
        src.from_json_rows(broken, "id", x.schema).collect()
