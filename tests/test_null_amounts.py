"""Queries on a ledger that lacks every seventh amount, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.oracles import ORACLE_SQL
from ledgerloom.plans import features
from ledgerloom.queries import QUERIES

NAMES = [
    "amount_components",
    "error_cohorts",
    "matrix_activity",
    "matrix_amount1",
    "matrix_amount0",
    "matrix_competition",
    "matrix_context",
    "matrix_ranks",
    "matrix_templates",
    "ablation_columns",
    "amount_pairs",
    "error_kinds",
    "flagship_minimum_next",
    "forensic_intervals",
    "forensic_report",
]


@pytest.fixture(scope="module")
def nulls(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("nulls"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value"))).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """The matrix is built once for all queries that show parts of it."""
    made, path, build = [], str(tmp_path_factory.mktemp("matrix") / "m"), features.build_features

    def run(ledger, *rest):
        if not made:
            build(ledger, *rest).write.parquet(path)
            made.append(path)
        return ledger.sparkSession.read.parquet(path)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(features, "build_features", run)
        yield


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(name, spark, nulls, shared):
    def plain(rows):
        return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)

    x = QUERIES[name](spark, nulls)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{nulls}/events.parquet/*.parquet'")
    names = ", ".join(f'"{c}"' for c in sorted(x.columns))
    assert plain(map(tuple, x.select(*[f"`{c}`" for c in sorted(x.columns)]).collect())) == plain(con.execute(f"SELECT {names} FROM ({ORACLE_SQL[name]})").fetchall())
