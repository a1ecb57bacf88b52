"""From ledgers to submission through the command line, and the stored bundle."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom import cli, constants
from ledgerloom.plans import features, learning, predictor
from ledgerloom.sources import ledger as src
from ledgerloom.sources.ledger import ContractError
from tests.test_protocol import cheap_bank

DAYS = {"cloud": "cloud access", "gym": "gym membership", "insurance": "safe cover"}


def lines(clients):
    """A monthly payment of the client's family, and one of another family now and then."""
    out = []
    for k, family in clients:
        for n in range(6):
            for f, text, keep in ((family, DAYS[family], True), ("other", "coffee shop", n % 2 == 0)):
                if keep:
                    day = 28 - k % 9
                    out.append(
                        json.dumps(
                            {"client_id": f"C{k:03d}", "timestamp": f"2025-{12 - n:02d}-{day:02d}T08:00:00Z", "amount": 10.0 + k % 3 + 0.01 * n, "currency": "chf", "type": "card_payment",
                             "direction": "out", "description": text, "mcc": constants.MCC.get(f, "5812"), "fee": 0.0}
                        )
                    )
    return "\n".join(out) + "\n"


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    families = list(DAYS)
    train = [(k, families[k % 3]) for k in range(24)]
    test = [(k + 100, families[k % 3]) for k in range(6)]
    (folder / "train.jsonl").write_text(lines(train))
    (folder / "unlabeled_pretrain.jsonl").write_text(lines([(k + 500, f) for k, f in train]))
    (folder / "test.jsonl").write_text(lines(test))
    head = "client_id,cutoff_date,target_next_recurring_merchant\n"
    for name, rows in (("train_labels", train), ("test_labels", test)):
        (folder / f"{name}.csv").write_text(head + "".join(f"C{k:03d},2026-01-01,{f}\n" for k, f in rows))
    (folder / "sample.csv").write_text("client_id\n" + "".join(f"C{k:03d}\n" for k, _ in test))
    return folder


def test_train_evaluate_submit(spark, data, capsys, tmp_path, monkeypatch):
    quick = {"no_multiseed": learning.replace(learning.catalogue()["no_multiseed"], augment=False)}
    monkeypatch.setattr(learning, "catalogue", lambda: quick)
    monkeypatch.setattr(features, "feature_bank", cheap_bank)  # the whole bank has tests of its own
    monkeypatch.setattr(predictor.boosting, "LISTWISE", learning.replace(predictor.boosting.LISTWISE, min_rows=2, l2=0.1, learning_rate=0.5, columns=1.0, leaves=3))
    bundle = str(tmp_path / "bundle")
    at = lambda name: str(data / name)
    assert cli.main(["train", "--data", str(data), "--labels", at("train_labels.csv"), "--bundle", bundle, "--recipe", "no_multiseed", "--rounds", "2"]) == 0
    made = json.loads(capsys.readouterr().out)
    assert made["models"] == 2 and made["features"] == 3 and made["importances"]
    assert cli.main(["train", "--data", str(data), "--labels", at("train_labels.csv"), "--bundle", bundle, "--recipe", "unknown"]) == 2
    capsys.readouterr()
    assert cli.main(["evaluate", "--data", str(data), "--split", "test", "--labels", at("test_labels.csv"), "--bundle", bundle]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["clients"] == 6 and report["accuracy"] > 0.6 and report["log_loss"] > 0
    out = str(tmp_path / "submission")
    assert cli.main(["submit", "--data", str(data), "--sample", at("sample.csv"), "--bundle", bundle, "--output", out]) == 0
    capsys.readouterr()
    sent = src.read_strings(spark, out)
    assert sent.columns == ["client_id", "predicted_next_recurring_merchant"] and sent.count() == 6
    loaded = predictor.Bundle.load(spark, bundle)
    again = loaded.probabilities(predictor.read_split(spark, str(data), "test"))
    assert again.count() == 48 and again.groupBy("client_id").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    with pytest.raises(ContractError):
        loaded.save(bundle)


def test_views_of_a_bundle_share_their_columns(spark, data):
    ledger = predictor.read_split(spark, str(data), "train")
    hurt = predictor.corrupted(ledger, "test_like")
    assert hurt.count() == ledger.count() and hurt.columns[-2:] == ledger.columns[-2:]
    changed = hurt.where("description <> txt").count()
    assert changed <= hurt.count() and hurt.where("txt IS NULL").count() == 0
    x = features.project_vocabulary(cheap_bank(ledger, [30], None, "full"), ["client_id", "family", "n", "absent"])
    assert x.where("absent IS NOT NULL").count() == 0 and x.where("n > 0").count() >= 24
