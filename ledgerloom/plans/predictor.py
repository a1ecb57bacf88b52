"""The predictor from ledgers to submission: train, evaluate, submit, with a stored bundle.

A bundle is a folder of one format, written by Spark to any file system it
knows: fitted models, vocabulary and settings as JSON, price profiles as
Parquet.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import families, noise, scoring
from ..sources import ledger as src
from ..sources.ledger import ContractError, exists
from . import boosting, features, learning

WINDOWS = [30, 60, 90, 180]
VIEWS = ("original", "valid_like", "test_like")
FORMAT = 1


@dataclass
class Bundle:
    """All that predicting needs."""

    recipe: learning.Recipe
    windows: list[int]
    columns: list[str]
    rankers: list[boosting.Model]
    detectors: list[boosting.Model]
    profiles: DataFrame

    def save(self, path: str) -> None:
        """Written below ``path``; an existing bundle is refused."""
        spark = self.profiles.sparkSession
        if exists(spark, path):
            raise ContractError(f"{path} exists")
        parts = {"recipe": asdict(self.recipe), "windows": self.windows, "columns": self.columns, "format": FORMAT}
        rows = [("about", 0, json.dumps(parts))]
        rows += [(kind, k, m.to_json()) for kind, models in (("ranker", self.rankers), ("detector", self.detectors)) for k, m in enumerate(models)]
        self.profiles.write.parquet(f"{path}/profiles")
        # the models come last: a bundle without them is not one
        spark.createDataFrame(rows, "part string, k int, body string").coalesce(1).write.parquet(f"{path}/models")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        rows = sorted(spark.read.parquet(f"{path}/models").collect())
        about = json.loads(next(r["body"] for r in rows if r["part"] == "about"))
        if about["format"] != FORMAT:
            raise ContractError(f"bundle of format {about['format']}")
        recipe = learning.Recipe(**{k: tuple(v) if isinstance(v, list) else v for k, v in about["recipe"].items()})
        models = {kind: [boosting.Model.from_json(r["body"]) for r in rows if r["part"] == kind] for kind in ("ranker", "detector")}
        return cls(recipe, about["windows"], about["columns"], models["ranker"], models["detector"], spark.read.parquet(f"{path}/profiles"))

    def probabilities(self, ledger: DataFrame) -> DataFrame:
        """``(client_id, family, family_index, p)`` for every client of a ledger."""
        x = features.project_vocabulary(candidates(ledger, self.windows, self.profiles, self.recipe), ["client_id", "family", *self.columns])
        x = features.at_edge(x)
        seeded = lambda parts: learning.reduce(DataFrame.unionByName, [p.withColumn("seed", F.lit(k)) for k, p in enumerate(parts)])
        main = seeded(learning.candidate_scores(m, x) for m in self.rankers)
        none = seeded(learning.none_scores(m, x) for m in self.detectors) if self.detectors else None
        return scoring.combine(main, none, self.recipe.temperature, raw=self.recipe.postprocess == "raw_logits")


def candidates(ledger: DataFrame, windows: list[int], profiles: DataFrame, recipe: learning.Recipe) -> DataFrame:
    """The candidate matrix of a recipe, stored: models read it several times."""
    x = features.feature_bank(ledger, windows, profiles, recipe.feature_mode)
    features.check_features(x)
    return features.written(learning.recipe_columns(x, recipe), "matrix")


def corrupted(ledger: DataFrame, view: str) -> DataFrame:
    return noise.corruption_view(ledger, view).withColumn("txt", normalize(F.col("description")))


def train(
    ledger: DataFrame, targets: DataFrame, profiles: DataFrame, recipe: learning.Recipe | None = None, windows: list[int] | None = None,
    rounds: int | None = None, **settings,
) -> Bundle:
    """Fit a recipe's rankers and detectors on a ledger and ``targets`` (client_id, truth).

    With augmentation every client is seen in three views, of which two have
    corrupted texts and codes.  ``rounds`` and ``settings`` replace the
    boosters' own.  The legacy experts of a recipe are not part of a bundle.
    """
    recipe = replace(recipe or learning.Recipe(), legacy_weight=0.0)
    windows = windows or WINDOWS
    bad = scoring.set_report(ledger.select("client_id").distinct(), targets).first().asDict()
    if any(bad.values()):
        raise ContractError(f"labels and clients differ: {bad}")
    names = VIEWS if recipe.augment else VIEWS[:1]
    views = [candidates(corrupted(ledger, v), windows, profiles, recipe) for v in names]
    columns = list(dict.fromkeys(c for v in views for c in v.columns if c not in ("client_id", "family")))
    lists = [features.written(learning.labelled(features.at_edge(features.project_vocabulary(v, ["client_id", "family", *columns])), targets), "view") for v in views]
    tuned = lambda seed: replace(boosting.LISTWISE, seed=seed, leaves=recipe.leaves, **({"rounds": rounds} if rounds else {}), **settings)
    rankers = [learning.fit_list(lists, tuned(s)) for s in recipe.seeds]
    detectors = [learning.fit_none(lists, targets, tuned(s)) for s in recipe.seeds] if recipe.none_detector else []
    return Bundle(recipe, windows, columns, rankers, detectors, profiles)


def evaluate(bundle: Bundle, ledger: DataFrame, labels: DataFrame) -> dict:
    """Score, calibration and losses of a bundle on labelled clients, as a plain dict."""
    p = features.written(bundle.probabilities(ledger), "probabilities")
    scoring.check_probabilities(p)
    truth = labels.select("client_id", F.col("target_next_recurring_merchant").alias("truth"))
    decided = scoring.decide(p)
    said = decided.select("client_id", F.col("prediction").alias("predicted_next_recurring_merchant"))
    report = scoring.score_report(scoring.scored_confusion(labels, said, p.sparkSession))
    losses = scoring.probability_losses(p.join(truth, "client_id")).first().asDict()
    bins = scoring.calibration(decided.join(truth, "client_id"))
    return report | losses | {"ece": scoring.expected_calibration_error(bins).first()["ece"]}


def submission(bundle: Bundle, ledger: DataFrame, sample: DataFrame) -> DataFrame:
    """``(client_id, predicted_next_recurring_merchant)`` for exactly the sample's clients."""
    said = scoring.decide(bundle.probabilities(ledger)).select("client_id", F.col("prediction").alias("predicted_next_recurring_merchant"))
    made = features.written(said, "submission")
    scoring.validate_submission(made, sample.select("client_id"))
    return made


def importances(bundle: Bundle) -> dict[str, float]:
    """Share of the splits' gains by feature, averaged over the rankers."""
    shares: dict[str, float] = dict.fromkeys(bundle.columns, 0.0)
    for m in bundle.rankers:
        total = sum(m.gains.values()) or 1.0
        for c, gain in m.gains.items():
            shares[c] = shares.get(c, 0.0) + gain / total / len(bundle.rankers)
    return dict(sorted(shares.items(), key=lambda x: (-x[1], x[0])))


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The checked ledger of a split with its derived columns."""
    rows = src.canonical_transactions(src.read_ledger(spark, src.split_path(folder, split)))
    # equal rows share a number: where it breaks ties they are interchangeable
    return src.enrich(rows.withColumn("tx_id", F.xxhash64(*src.RAW)))


def profiles_of(spark: SparkSession, folder: str) -> DataFrame:
    """Price profiles from the unlabelled split."""
    return families.price_profiles(read_split(spark, folder, "unlabeled_pretrain"))
