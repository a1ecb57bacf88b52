"""Queries on a ledger with amounts of zero, some of them the first of a stream or all of it, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numeric
from ledgerloom.operators import clients, streams
from ledgerloom.oracles import ORACLE_SQL
from ledgerloom.plans import features
from ledgerloom.queries import QUERIES
from ledgerloom.sources import ledger as src

NAMES = [
    "amount_change",
    "explanations",
    "error_cohorts",
    "feature_matrix",
    "matrix_activity",
    "matrix_amount1",
    "matrix_amount0",
    "matrix_broad0",
    "matrix_broad1",
    "matrix_competition",
    "matrix_context",
    "matrix_globals",
    "matrix_ranks",
    "matrix_templates",
    "ranking_competition",
    "ranking_matrix",
    "ablation_columns",
    "amount_components",
    "amount_pairs",
    "cadence_audit",
    "cadence_error",
    "calibration_bins",
    "clock_selection",
    "edge_values",
    "error_kinds",
    "family_ranks",
    "flagship_minimum_next",
    "forensic_clusters",
    "forensic_intervals",
    "forensic_report",
]


@pytest.fixture(scope="module")
def zeros(spark, sf_dir, tmp_path_factory):
    """Every seventh payment is zero, and all payments of some clients."""
    folder = str(tmp_path_factory.mktemp("zeros"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("value", F.when((F.col("event_id") % 7 == 0) | (F.col("user_id") % 9 == 0), 0.0).otherwise(F.col("value"))).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.fixture(scope="module")
def shared(zeros, tmp_path_factory):
    """The two matrices are built once for all queries that show parts of them."""

    def once(build, path):
        made = []

        def run(ledger, *rest):
            if not made:
                build(ledger, *rest).write.parquet(path)
                made.append(path)
            return ledger.sparkSession.read.parquet(path)

        return run

    folder = tmp_path_factory.mktemp("matrices")
    with pytest.MonkeyPatch.context() as m:
        for name in ("build_features", "ranking_features"):
            m.setattr(features, name, once(getattr(features, name), f"{folder}/{name}"))
        yield


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(name, spark, zeros, shared):
    def plain(rows):
        return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)

    x = QUERIES[name](spark, zeros)
    if name not in ORACLE_SQL:  # the matrix as a whole: its parts have SQL
        assert x.count() == 8 * x.select("client_id").distinct().count() > 0
        return
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{zeros}/events.parquet/*.parquet'")
    sql, names = ORACLE_SQL[name], ", ".join(f'"{c}"' for c in sorted(x.columns))
    assert plain(map(tuple, x.select(*[f"`{c}`" for c in sorted(x.columns)]).collect())) == plain(con.execute(f"SELECT {names} FROM ({sql})").fetchall())


def test_zero_amounts_are_near_nothing(spark):
    rows = [("a", "chf", k, v) for k, v in enumerate([0.0, 0.0, 0.0, 0.01, 0.01, 0.01, 9.0])]
    x = spark.createDataFrame(rows, "client_id string, currency string, tx_id long, amount double")
    assert sorted((r["tx_id"], r["comp"]) for r in streams.amount_components(x).collect()) == [(3, 3), (4, 3), (5, 3)]


def test_arithmetic_of_zeros(spark):
    x = spark.createDataFrame([(2.0, 0.0), (0.0, 0.0), (-2.0, 0.0), (1.0, 4.0), (None, 0.0), (1.0, None)], "a double, b double")
    got = [str(r[0]) for r in x.select(numeric.divided(F.col("a"), F.col("b"))).collect()]
    assert got == ["inf", "nan", "-inf", "0.25", "None", "None"]
    assert [str(r[0]) for r in x.select(numeric.log(F.col("a") / 2)).collect()][:3] == ["0.0", "-inf", "nan"]
    assert x.limit(1).select(numeric.price_support(F.col("a"), F.lit(0.0), F.lit(0.0))).first()[0] == 0.0


def test_payments_of_one_moment_have_no_cadence(spark):
    rows = [("a", k, 5.0, "gym membership") for k in range(4)]
    x = spark.createDataFrame(rows, "client_id string, tx_id long, amount double, description string").withColumns(
        {"timestamp": F.when(F.col("tx_id") < 3, "2025-01-01").otherwise("2025-12-30").cast("timestamp"), "currency": F.lit("chf"), "type": F.lit("card_payment"), "direction": F.lit("out"), "mcc": F.lit("7997"), "fee": F.lit(0.0)}
    )
    assert [tuple(r) for r in clients.weak_labels(src.enrich(x), -30, 30, min_gap=0).collect()] == [("a", "none")]
