"""Doubles just below a five behind the sixth place: Spark's rounding takes them up, the SQL's values do not."""

from datetime import datetime

import duckdb
import pytest

from ledgerloom.oracles import ORACLE_SQL
from ledgerloom.queries import QUERIES
from ledgerloom.sources.ledger import VOCABULARY


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three gym payments whose median deviation is 16.65 of 32, in binary a little less than 0.5203125."""
    folder = str(tmp_path_factory.mktemp("ties"))
    k = (VOCABULARY.split("|").index("gym membership") - 3) % 30
    rows = [(i, datetime(2024, 1, 3 + 7 * i), 1, "view", v, f'{{"k": {k}}}') for i, v in enumerate((15.35, 32.0, 48.65))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


def test_matrix_statistics_are_not_rounded_up(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT broad0_amount_mad FROM ({ORACLE_SQL['matrix_broad0']}) WHERE family = 'gym'").fetchone()[0]
    got = QUERIES["matrix_broad0"](spark, folder).where("family = 'gym'").first()["broad0_amount_mad"]
    assert round(want, 6) == 0.520312
    assert round(got, 6) == round(want, 6)
