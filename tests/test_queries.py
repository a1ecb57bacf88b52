"""Every query against its SQL on the small tables."""

import pytest

from ledgerloom.oracles import ORACLE_SQL
from ledgerloom.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_fold_and_masking_properties(spark, sf_dir):
    folds = QUERIES["fold_assignment"](spark, sf_dir).toPandas()
    assert (folds.groupby("quality").n.max() - folds.groupby("quality").n.min() <= 1).all()
    masked = {r["type"]: r for r in QUERIES["masked_view"](spark, sf_dir).collect()}
    assert masked["topup"]["masked"] == 0 and 0 < masked["card_payment"]["masked"] < 0.4 * masked["card_payment"]["n"]
    for r in QUERIES["bootstrap_ci"](spark, sf_dir).collect():
        assert -1 < r["low"] < r["high"] < 1
    scores = QUERIES["gbt_ranker"](spark, sf_dir)
    assert scores.where("score IS NULL").count() == 0
