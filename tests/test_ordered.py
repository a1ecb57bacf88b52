"""Numbers, running sums, quantiles, as-of and band joins against plain versions."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit, clients, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most rows, ties, nulls and a null group."""
    random.seed(8)
    rows = [(k, "big" if k % 10 else random.choice(["a", "b", None]), float(random.choice([1, 2, 2, 2, random.randint(0, 500), random.random()])) if k % 17 else None) for k in range(6000)]
    return spark.createDataFrame(rows, "id long, g string, v double").repartition(5).cache()


@pytest.mark.parametrize("by", [(), ("g",)])
def test_numbers_over_ranges(skewed, by):
    order = [F.md5(F.col("id").cast("string")), "id"]
    made = ordered.numbered(skewed, order, by, rows=300)
    assert ordered.ranged(skewed, order, by, 300).groupBy("_part").count().agg(F.max("count")).first()[0] < 900
    from pyspark.sql import Window

    plain = skewed.withColumn("_n", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)))
    assert sorted(map(repr, made.select("id", "_n").collect())) == sorted(map(repr, plain.select("id", "_n").collect()))
    assert ordered.numbered(skewed.where("false"), order, by).count() == 0


def test_running_sums_over_ranges(skewed):
    made = ordered.running(skewed, ["id"], ("g",), {"s": F.col("id") % 7, "n": F.lit(1).cast("long")}, rows=250)
    want, got = {}, {}
    for r in sorted(skewed.collect(), key=lambda r: r["id"]):
        s, n = want.setdefault(r["g"], [0, 0])
        got[r["id"]] = (s, n)
        want[r["g"]] = [s + r["id"] % 7, n + 1]
    assert {r["id"]: (r["s"], r["n"]) for r in made.collect()} == got


@pytest.mark.parametrize("rows", [50, 1_000_000])
def test_exact_percentiles(skewed, rows):
    p = [0.0, 0.005, 0.25, 0.5, 0.77, 0.995, 1.0]
    literal = F.array(*map(F.lit, p))
    for by in ((), ("g",)):
        want = {tuple(r[c] for c in by): r["q"] for r in skewed.groupBy(*by).agg(F.percentile("v", literal).alias("q")).collect()}
        assert {tuple(r[c] for c in by): r["q"] for r in ordered.percentiles(skewed, "v", p, by, rows).collect()} == want


def test_percentiles_of_nothing(spark, skewed):
    assert ordered.percentiles(skewed.where("false"), "v", [0.5], ("g",)).count() == 0
    nulls = spark.createDataFrame([("a", None), ("a", None), ("b", 3.0)], "g string, v double")
    assert {r["g"]: r["q"] for r in ordered.percentiles(nulls, "v", [0.5], ("g",)).collect()} == {"a": None, "b": [3.0]}
    same = spark.range(5000).select(F.lit("x").alias("g"), F.lit(7.0).alias("v"))
    assert ordered.percentiles(same, "v", [0.1, 0.9], ("g",), rows=10).first()["q"] == [7.0, 7.0]


def test_no_task_sorts_a_group(skewed):
    """The last selection sees a small part of the rows."""
    wanted = skewed.groupBy("g").agg(F.count("v").alias("n")).select("g", (F.col("n") / 2).cast("long").alias("rank"))
    found = {r["g"]: r["value"] for r in ordered.order_statistics(skewed.select("g", F.col("v").alias("value")), wanted, rows=40).collect()}
    for g, v in found.items():
        values = sorted(r["v"] for r in skewed.collect() if r["g"] == g and r["v"] is not None)
        assert v == values[len(values) // 2]


def test_a_frequent_value_does_not_hide_the_others(spark):
    values = spark.range(20_000).select(F.lit("x").alias("g"), F.when(F.col("id") < 600, F.col("id").cast("double")).otherwise(1000.0).alias("value"))
    wanted = spark.createDataFrame([("x", 0), ("x", 577), ("x", 600), ("x", 19_999)], "g string, rank long")
    got = {r["rank"]: r["value"] for r in ordered.order_statistics(values, wanted, rows=10).collect()}
    assert got == {0: 0.0, 577: 577.0, 600: 1000.0, 19_999: 1000.0}


def test_permutation_and_folds_by_ranges(spark):
    labels = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("y"))
    few, many = (sorted(map(repr, audit.stratified_folds(labels, "y", "k", rows=n).collect())) for n in (100, 10**6))
    assert few == many
    a, b = (sorted(map(repr, audit.permuted(labels, "k", "y", 5, rows=n).collect())) for n in (100, 10**6))
    assert a == b


def ledger_of(spark, rows):
    start = dt.datetime(2026, 1, 1)
    made = [(c, k, "card_payment" if kind == "c" else "refund", "chf" if k % 3 else "eur", a, float(k % 5), start - dt.timedelta(days=age), -age) for k, (c, kind, a, age) in enumerate(rows)]
    return spark.createDataFrame(made, "client_id string, tx_id long, type string, currency string, amount double, fee double, timestamp timestamp, t double")


def test_nearest_card_and_bands_against_all_pairs(spark):
    random.seed(6)
    rows = [(random.choice("ABC"), random.choice("cccr"), round(math.exp(random.uniform(1, 3)), 2), float(random.randint(0, 60))) for _ in range(600)]
    ledger = ledger_of(spark, rows)
    slots = [(c, f"f{k}", "p", round(math.exp(random.uniform(1, 3)), 2), random.choice([float(random.randint(0, 70)), random.uniform(0, 60)])) for c in "ABCD" for k in range(12)]
    frame = spark.createDataFrame(slots, "client_id string, family string, prefix string, amount_median double, last_age double")
    cards = [(r["client_id"], -r["t"], r["timestamp"], r["tx_id"], r["currency"], r["fee"], r["amount"], r["type"]) for r in ledger.collect()]
    near = {(r["client_id"], r["family"]): (r["currency"], r["last_fee"]) for r in clients.nearest_card(ledger, frame).collect()}
    want = {}
    for c, f, _, _, age in slots:
        mine = [(abs(a - age), ts, tx, cur, fee) for cl, a, ts, tx, cur, fee, _, kind in cards if cl == c and kind == "card_payment"]
        if mine:
            want[c, f] = min(mine)[3:]
    assert near == want
    got = {(r["client_id"], r["family"]): (r["refund_count"], r["fee_mean"]) for r in clients.payment_context(ledger, frame, tolerance=0.1).collect()}
    for c, f, _, m, _ in slots:
        hits = [x for x in cards if (c, f) in want and x[0] == c and x[4] == want[c, f][0] and abs(math.log(x[6] / m)) < 0.1]
        assert ((c, f) in got) == bool(hits)
        if hits:
            fees = [x[5] for x in hits if x[7] == "card_payment"]
            assert got[c, f][0] == sum(x[7] == "refund" for x in hits)
            assert (got[c, f][1] is None) == (not fees) and (not fees or abs(got[c, f][1] - np.mean(fees)) < 1e-9)


def test_joins_are_linear_in_one_clients_payments(spark):
    """100,000 payments and 2,000 streams of one client: all pairs would be 200 million."""
    n = 100_000
    ledger = spark.range(n).selectExpr(
        "'A' AS client_id", "id AS tx_id", "'card_payment' AS type", "'chf' AS currency", "exp(id % 1000 / 200.0) AS amount", "0.0D AS fee",
        "timestamp_seconds(1767225600 - id * 60) AS timestamp", "-id / 1440.0D AS t",
    )
    slots = spark.range(2000).selectExpr("'A' AS client_id", "concat('f', id) AS family", "'p' AS prefix", "exp(id / 400.0) AS amount_median", "id / 30.0D AS last_age")
    assert clients.nearest_card(ledger, slots).count() == 2000
    hits = clients.payment_context(ledger, slots, tolerance=0.001)
    assert hits.count() == 1000  # every second stream has payments of its amount
