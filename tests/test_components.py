"""Stored components, drift, and the text stage."""

import threading

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import boosting, components, learning
from ledgerloom.plans.textmodel import SublinearTfidf, SublinearTfidfModel


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(200).selectExpr(
        "concat('c', id) AS client_id", "0 AS place", "cast(id % 2 AS double) AS label", "id % 2 + (id * 7919 % 101) / 80.0D AS x", "(id * 104729 % 97) / 97.0D AS noise"
    ).cache()


QUICK = boosting.Boosting("logistic", rounds=2, leaves=3, learning_rate=0.5, min_rows=5, l2=1.0, columns=1.0)


def test_second_run_fits_nothing_and_changes_are_seen(spark, rows, tmp_path):
    fit = lambda s, x, k=QUICK: components.fitted(s, x, ["x", "noise"], "label", ["client_id"], "place", k)
    first, second = (components.Store(spark, str(tmp_path / "store")) for _ in range(2))
    one = fit(first, rows)
    assert len(first.made) == 1 and fit(second, rows.repartition(5, "x").select(*reversed(rows.columns))) == one and second.made == []
    changed = rows.withColumn("x", F.when(F.col("client_id") == "c7", 9.0).otherwise(F.col("x")))
    fit(second, changed)
    fit(second, rows, components.boosting.Boosting(**{**QUICK.__dict__, "seed": 1}))
    assert len(second.made) == 2


def test_concurrent_runs_share_a_component(spark, tmp_path):
    stores = [components.Store(spark, str(tmp_path / "shared")) for _ in range(4)]
    barrier, got = threading.Barrier(4), []

    def make():
        barrier.wait(60)  # all are making it at the same time
        return spark.range(500).repartition(3)

    run = lambda s: got.append(s.table("t", {"a": 1}, make).count())
    threads = [threading.Thread(target=run, args=(s,)) for s in stores]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert got == [500] * 4 and sum(len(s.made) for s in stores) == 1
    left = list((tmp_path / "shared" / "making").iterdir())
    assert [p for p in left if p.is_dir()] == []


def test_drift_report(spark, rows, tmp_path):
    store = components.Store(spark, str(tmp_path / "drift"))
    moved = rows.withColumn("x", F.col("x") + 5)
    auc, important = components.drift_report(store, rows, moved, ["x", "noise"], folds=2)
    assert sorted(r["fold"] for r in auc.collect()) == [0, 1] and all(r["auc"] > 0.99 for r in auc.collect())
    assert important[0][0] == "x" and important[0][1] > 0.95 and important[0][2] == 1 and len(store.made) == 2
    same, _ = components.drift_report(store, rows, rows, ["noise"], folds=2)
    assert all(abs(r["auc"] - 0.5) < 0.2 for r in same.collect())


def test_vectors_of_unseen_documents(spark, tmp_path):
    docs = spark.createDataFrame(
        [("a", "cloud access ; cloud backup"), ("b", "gym membership gym gym"), ("c", "cloud access gym"), ("d", None), ("e", "only once")], "client_id string, document string"
    )
    terms = learning.terms(docs)
    model = SublinearTfidf(minDF=2, vocabSize=4).fit(terms)
    assert set(model.vocabulary) == {"cloud", "gym", "access", "cloud access"} and model.vocabulary[0] == "gym"
    model.write().overwrite().save(str(tmp_path / "tfidf"))
    read = SublinearTfidfModel.load(str(tmp_path / "tfidf"))
    new = learning.terms(spark.createDataFrame([("n", "cloud access access unseen"), ("o", "unseen"), ("p", None)], "client_id string, document string"))
    got = {r["client_id"]: r["features"] for r in read.transform(new).collect()}
    import math

    idf = lambda df: math.log(6 / (1 + df)) + 1
    want = {"cloud": idf(2), "access": (1 + math.log(2)) * idf(2), "cloud access": idf(2)}
    length = math.sqrt(sum(v * v for v in want.values()))
    assert {read.vocabulary[k]: pytest.approx(v) for k, v in zip(got["n"].indices, got["n"].values)} == {k: v / length for k, v in want.items()}
    assert got["o"].numNonzeros() == got["p"].numNonzeros() == 0 and got["o"].size == 4
    assert (read.getInputCol(), read.getOrDefault(read.minDF), read.uid) == ("terms", 2, model.uid)
