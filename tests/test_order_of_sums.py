"""Means of clients add their amounts in the order of events, whatever the order and the partitions of the rows."""

from pyspark.sql import functions as F

from ledgerloom.operators import clients

AMOUNTS = [0.1, 0.2, 0.3, None, 1e16, -1e16, 0.7]


def test_client_mean_depends_on_no_order_of_rows(spark):
    rows = [("a", k, -1.0 - k, v, "card_payment", "out", "chf") for k, v in enumerate(AMOUNTS)] + [("b", 9, -1.0, None, "card_payment", "out", "chf")]
    x = spark.createDataFrame(rows[::-1], "client_id string, tx_id long, t double, amount double, type string, direction string, currency string")
    total = 0.0
    for v in AMOUNTS:
        total += v or 0.0
    for shown in (x, x.orderBy("tx_id"), x.repartition(5), x.orderBy(F.col("amount").desc())):
        got = {r["client_id"]: (r["total_count"], r["amount_mean"]) for r in clients.client_globals(shown, [30]).collect()}
        assert got == {"a": (7, total / 6), "b": (1, None)}
