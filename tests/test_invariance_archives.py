"""Hash trees over tables, and archives as a source."""

import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import invariance
from ledgerloom.sources import archives
from ledgerloom.sources.ledger import ContractError


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).selectExpr("concat('c', id) AS k", "id % 7 AS a", "CASE WHEN id % 5 > 0 THEN id / 3.0D END AS b", "cast(id % 3 AS string) AS c").cache()


def test_equal_tables_touch_digests_only(rows):
    other = rows.repartition(9, "c").select("c", "b", "k", "a")
    trees = invariance.hash_tree(rows, ["k"]), invariance.hash_tree(other, ["k"])
    assert invariance.changed_buckets(*trees) == (None, [1])
    unread = rows.withColumn("a", F.raise_error(F.lit("read")).cast("long"))
    assert invariance.changes(unread, other, ["k"], trees).count() == 0


def test_changes_are_named_and_little_is_compared(rows):
    hit = F.col("k").isin("c5", "c77")
    other = rows.withColumn("a", F.when(hit, F.col("a") + 1).otherwise(F.col("a"))).withColumn("b", F.when(F.col("k") == "c77", None).otherwise(F.col("b"))).where("k <> 'c9'")
    other = other.union(rows.where("k = 'c1'").withColumn("k", F.lit("new")))
    trees = invariance.hash_tree(rows, ["k"]), invariance.hash_tree(other, ["k"])
    found, seen = invariance.changed_buckets(*trees)
    assert found.count() <= 4 and max(seen) <= 64
    got = {(r["k"], r["column"]) for r in invariance.changes(rows, other, ["k"], trees).collect()}
    assert got == {("c5", "a"), ("c77", "a"), ("c77", "b"), *(("c9", c) for c in "abc"), *(("new", c) for c in "abc")}


def test_tree_sees_nulls_repeats_and_moved_values(spark):
    make = lambda data: spark.createDataFrame(data, "k string, a string, b string")
    base = make([("x", None, "1"), ("y", "1", None), (None, "2", "2")])
    for other in ([("x", "1", None), ("y", "1", None), (None, "2", "2")], [("x", "null", "1"), ("y", "1", None), (None, "2", "2")]):
        assert {r["k"] for r in invariance.changes(base, make(other), ["k"]).collect()} == {"x"}
    twice = base.union(base)
    assert invariance.changed_buckets(invariance.hash_tree(base, ["k"]), invariance.hash_tree(twice, ["k"]))[0] is not None
    with pytest.raises(ContractError):
        invariance.changes(base, twice, ["k"])
    with pytest.raises(ContractError):
        invariance.changes(base, base.drop("b"), ["k"])
    assert invariance.changes(base.where("false"), base.where("false"), ["k"]).count() == 0


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return str(path)


def test_archive_members_are_read_and_checked(spark, tmp_path):
    a = '{"client_id": "A", "amount": 1.5}\n{"client_id": "B", "amount": 2}\n'
    b = "".join(f'{{"client_id": "C{k}", "amount": {k}}}\r\n' for k in range(5000))
    path = archive(tmp_path / "x.zip", {"data/a.jsonl": a, "data/b.jsonl": b, "readme.txt": "hello\nthere"})
    sha = {"data/a.jsonl": hashlib.sha256(a.encode()).hexdigest(), "data/b.jsonl": hashlib.sha256(b.encode()).hexdigest()}
    made = archives.read_archived_json(spark, [path], "client_id string, amount double", sha)
    assert made.rdd.getNumPartitions() == 2
    assert {(r["member"], r["n"], r["s"]) for r in made.groupBy("member").agg(F.count("*").alias("n"), F.sum("amount").alias("s")).collect()} == {("data/a.jsonl", 2, 3.5), ("data/b.jsonl", 5000, 12497500.0)}
    lines = archives.read_archive(spark, ["file://" + path], suffix=".txt").collect()
    assert [(r["line"], r["value"]) for r in lines] == [(1, "hello"), (2, "there")]
    with pytest.raises(Exception, match="digest"):
        archives.read_archive(spark, [path], sha | {"data/b.jsonl": "0" * 64}).count()
    with pytest.raises(Exception, match="not in the archives"):
        archives.read_archive(spark, [path], {"data/c.jsonl": "0" * 64}).count()
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|malformed"):
        archives.read_archived_json(spark, [archive(tmp_path / "bad.zip", {"a.jsonl": "{no"})], "client_id string").collect()


@pytest.mark.parametrize("name", ["../evil.jsonl", "a/../../b", "/etc/x", "C:\\x", "a\\..\\b"])
def test_names_that_leave_the_folder_are_refused(spark, tmp_path, name):
    path = archive(tmp_path / "y.zip", {"ok.jsonl": "{}", name: "{}"})
    with pytest.raises(Exception, match="outside the folder"):
        archives.read_archive(spark, [path]).count()
