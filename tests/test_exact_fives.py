"""Payments at whole 128ths of a day: times and gaps are doubles that end in a five behind the sixth place.

Queries return doubles as they are: what Spark rounds up itself, another reader rounds to the even place.
"""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.oracles import ORACLE_SQL
from ledgerloom.queries import QUERIES

NAMES = [
    "ranking_matrix",
    "cadence_audit",
    "cadence_error",
    "clock_selection",
    "edge_values",
    "family_ranks",
    "forensic_clusters",
    "ranking_competition",
]


@pytest.fixture(scope="module")
def fives(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("fives"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    events.withColumn("ts", F.timestamp_seconds(seconds - seconds % 675).cast("timestamp_ntz")).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(name, spark, fives):
    def plain(rows):
        return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)

    x = QUERIES[name](spark, fives)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{fives}/events.parquet/*.parquet'")
    columns = sorted(c for c in x.columns if "linear" not in c)  # a fitted line's last places depend on how its sums are taken
    names = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, x.select(*[f"`{c}`" for c in columns]).collect())) == plain(con.execute(f"SELECT {names} FROM ({ORACLE_SQL[name]})").fetchall())
