"""The staged protocol on a small ledger with cheap features."""

import pytest
from pyspark.sql import functions as F

from ledgerloom import constants
from ledgerloom.operators import families
from ledgerloom.plans import learning
from ledgerloom.plans.protocol import Inputs, Protocol
from ledgerloom.sources import ledger as src
from ledgerloom.sources.ledger import ContractError

FAMILIES = ["cloud", "gym", "insurance"]


def cheap_bank(ledger, windows, profiles, mode):
    """Counts of texts of a family and how long ago the last was."""
    own = None
    for f in FAMILIES:
        hit = ledger.where(F.col("mcc") == constants.MCC[f]).groupBy("client_id").agg(F.count("*").cast("double").alias("n"), F.min(-F.col("t")).alias("age")).withColumn("family", F.lit(f))
        own = hit if own is None else own.unionByName(hit)
    x = families.candidates(ledger.select("client_id").distinct()).select("client_id", "family", F.col("family_index").cast("double").alias("family_index"))
    return x.join(own, ["client_id", "family"], "left")


def ledger_of(spark, first, n):
    """Clients whose payments mostly go to one family."""
    rows = spark.range(first, first + n).select(F.concat(F.lit("C"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("client_id"), "id")
    each = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), ((F.col("id") + F.when(F.col("k") == 5, 1).otherwise(0)) % 3 + 1).cast("int"))
    code = F.create_map(*[F.lit(x) for f in FAMILIES for x in (f, constants.MCC[f])])
    made = each.select(
        "client_id", F.timestamp_seconds(F.lit(1766000000) - F.col("k") * 2_600_000 - F.col("id") * 60).alias("timestamp"), (F.col("id") % 3 + 10.0).alias("amount"), F.lit("chf").alias("currency"),
        F.lit("card_payment").alias("type"), F.lit("out").alias("direction"), F.concat(F.lit("plan "), family).alias("description"), F.element_at(code, family).alias("mcc"), F.lit(0.0).alias("fee"),
    )
    labels = rows.select("client_id", F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("id") % 3 + 1).cast("int")).alias("truth"))
    return src.enrich(made.withColumn("tx_id", F.xxhash64(*src.RAW))), labels


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder, opened = str(tmp_path_factory.mktemp("protocol") / "run"), []
    train, labels = ledger_of(spark, 0, 24)
    holdout, truth = ledger_of(spark, 500, 12)
    test, _ = ledger_of(spark, 700, 6)
    base = learning.replace(learning.catalogue()["no_multiseed"], leaves=3, augment=False)
    recipes = [base, learning.replace(base, name="no_none_detector", none_detector=False)]
    profiles = spark.createDataFrame([("cloud", 1.0, 50.0)], "family string, low double, high double")
    inputs = Inputs(train, labels, profiles, holdout, lambda: (opened.append(1), truth)[1], test)
    make = lambda **more: Protocol(spark, folder, inputs, recipes, 2, (30,), ("original",), {"rounds": 2, "min_rows": 2, "l2": 0.1, "learning_rate": 1.0, "columns": 1.0}, cheap_bank, **more)
    return make, opened, inputs


def test_stages_resume_and_open_the_holdout_once(spark, run, monkeypatch):
    make, opened, inputs = run
    first = make()
    done = first.run("select")
    assert set(done["develop"]) == {"no_multiseed", "no_none_detector"} and done["select"]["recipe"] == "no_none_detector"
    # both recipes share their rankers: 2 folds, and 2 detectors for one of them
    assert sum(m.startswith("models/") for m in first.store.made) == 4
    monkeypatch.setattr(first, "permutation", lambda: {"macro_f1": 0.3})
    with pytest.raises(ContractError, match="permuted"):
        Protocol.freeze(_Told(first, {"permutation": {"macro_f1": 0.3}}))
    second = make()
    monkeypatch.setattr(second, "permutation", lambda: {"macro_f1": 0.1})
    done = second.run()
    assert not any(m.startswith("models/") and m in first.store.made for m in second.store.made) and opened == [1]
    assert done["evaluate"]["accuracy"] >= 0.9 and done["evaluate"]["submission"] == (done["evaluate"]["macro_f1"] >= 0.52)
    assert done["predict"]["test"]["clients"] == 6 and done["verify"] == {"verified": True} and "no_none_detector" in done["report"]["markdown"]
    third = make()
    assert third.run() == done and third.store.made == [] and opened == [1]
    with pytest.raises(ContractError):
        third.evaluate()
    with pytest.raises(ContractError, match="tables differ"):
        Protocol(spark, third.folder, Inputs(inputs.train.where("client_id <> 'C0001'"), inputs.labels, inputs.profiles, inputs.holdout, inputs.holdout_labels), third.recipes)._frozen()


class _Told:
    """A protocol whose receipts are partly told."""

    def __init__(self, real, told):
        self.real, self.told = real, told

    def receipt(self, name):
        return self.told.get(name) or self.real.receipt(name)

    def __getattr__(self, name):
        return getattr(self.real, name)


def test_permuted_labels_do_no_better_than_chance(run):
    make, _, _ = run
    made = make()
    made.run("select")
    scores = type(made).permutation(made)
    assert 0 <= scores["macro_f1"] < 0.35


def test_clients_of_train_are_refused_in_the_holdout(spark, run, tmp_path):
    make, _, inputs = run
    base = make()
    base.run("select")
    mixed = Protocol(spark, str(tmp_path / "other"), Inputs(inputs.train, inputs.labels, inputs.profiles, inputs.train, inputs.holdout_labels), base.recipes[1:], 2, (30,), ("original",), base.settings, cheap_bank)
    for name in ("prepare", "develop", "select"):
        mixed.leave(name, base.receipt(name))
    mixed.leave("permutation", {"macro_f1": 0.1})
    with pytest.raises(ContractError, match="are in train"):
        mixed.run("predict")
