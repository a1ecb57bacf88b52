"""The staged protocol: prepare, develop, select, permutation, freeze, predict, evaluate, report, verify.

Every stage leaves a receipt that can be written once.  A run goes on where an
earlier one stopped: stages with a receipt are read, fitted parts come from the
component store.  Labels of the holdout are read once, after the recipe was
frozen and the predictions were stored.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LABELS
from ..functions.text import normalize
from ..operators import audit, noise, scoring
from ..sources.ledger import ContractError, digest, exists
from ..sources.stored import written
from . import boosting, components, features, learning

STAGES = ("prepare", "develop", "select", "permutation", "freeze", "predict", "evaluate", "report", "verify")
SCENARIOS = ("original", "valid_like", "test_like")
# The score that permuted labels may reach, and the one that a submission needs.
PERMUTED_LIMIT = 0.20
SUBMISSION_LIMIT = 0.52


@dataclass(frozen=True)
class Inputs:
    """Ledgers with derived columns, ``labels`` (client_id, truth), price profiles.

    ``holdout_labels`` is called once, in the stage that evaluates.
    """

    train: DataFrame
    labels: DataFrame
    profiles: DataFrame
    holdout: DataFrame
    holdout_labels: Callable[[], DataFrame]
    test: DataFrame | None = None


@dataclass
class Protocol:
    """A run below ``folder``, on any file system that Spark knows.

    ``bank`` makes a candidate matrix of a ledger: ``(ledger, windows, profiles, mode)``.
    ``settings`` replace fields of the boosters of all recipes.
    """

    spark: SparkSession
    folder: str
    inputs: Inputs
    recipes: list[learning.Recipe] = field(default_factory=lambda: list(learning.catalogue().values()))
    folds: int = 5
    windows: tuple[int, ...] = (30, 60, 90, 180)
    scenarios: tuple[str, ...] = SCENARIOS
    settings: dict = field(default_factory=dict)
    bank: Callable[[DataFrame, list[int], DataFrame, str], DataFrame] = features.feature_bank
    seed: int = 42

    def __post_init__(self) -> None:
        self.folder = self.folder.rstrip("/")
        self.store = components.Store(self.spark, f"{self.folder}/components")
        self._digests: dict[str, str] = {}

    # --- receipts

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/receipts/{name}.json")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def receipt(self, name: str) -> dict | None:
        """What a stage left, or nothing."""
        if not exists(self.spark, f"{self.folder}/receipts/{name}.json"):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.folder}/receipts/{name}.json", wholetext=True).collect()))

    def leave(self, name: str, value: dict) -> dict:
        """Write a receipt; one that is there is never replaced."""
        path, files = self._path(name)
        try:
            out = files.create(path, False)
        except Exception as error:
            raise ContractError(f"receipt {name} exists") from error
        body = json.dumps(value, sort_keys=True, indent=1)
        out.write(bytearray(body.encode()))
        out.close()
        return json.loads(body)

    def run(self, upto: str = STAGES[-1]) -> dict[str, dict]:
        """All stages up to one, in order; those with a receipt are not run again."""
        done = {}
        for name in STAGES[: STAGES.index(upto) + 1]:
            done[name] = self.receipt(name) or self.leave(name, getattr(self, name)())
        return done

    # --- parts

    def source(self, name: str) -> str:
        """The digest of an input table."""
        if name not in self._digests:
            key = {"labels": "client_id", "profiles": "family"}.get(name, "tx_id")
            self._digests[name] = components.table_digest(getattr(self.inputs, name), [key])
        return self._digests[name]

    def matrix(self, part: str, scenario: str, mode: str) -> DataFrame:
        """The stored candidate matrix of an input in a scenario."""
        ledger = getattr(self.inputs, part)

        def make() -> DataFrame:
            seen = noise.corruption_view(ledger, scenario).withColumn("txt", normalize(F.col("description")))
            x = self.bank(seen, list(self.windows), self.inputs.profiles, mode)
            features.check_features(x)
            return x

        return self.store.table("features", {"source": self.source(part), "profiles": self.source("profiles"), "scenario": scenario, "mode": mode, "windows": list(self.windows)}, make)

    def views(self, recipe: learning.Recipe, part: str = "train") -> list[DataFrame]:
        names = self.scenarios if recipe.augment else self.scenarios[:1]
        return [learning.recipe_columns(self.matrix(part, s, recipe.feature_mode), recipe) for s in names]

    def placed(self) -> DataFrame:
        """``(client_id, truth, fold)``, stored."""
        spec = {"labels": self.source("labels"), "folds": self.folds, "seed": self.seed}
        return self.store.table("folds", spec, lambda: audit.stratified_folds(self.inputs.labels, "truth", "client_id", self.folds, self.seed))

    def parts(self, recipe: learning.Recipe, labels: DataFrame, tag: dict) -> tuple[list[boosting.Model], list[boosting.Model]]:
        """Rankers and detectors of a recipe's seeds, fitted on ``labels``.

        Recipes that share a part share its name in the store: what a part is
        made of does not include how predictions are put together.
        """
        views = self.views(recipe)
        columns = list(dict.fromkeys(c for v in views for c in v.columns if c not in ("client_id", "family")))
        lists: list[DataFrame] = []

        def rows() -> list[DataFrame]:
            if not lists:
                wide = [features.at_edge(features.project_vocabulary(v, ["client_id", "family", *columns])) for v in views]
                lists.extend(written(learning.labelled(v, labels), "view") for v in wide)
            return lists

        made: tuple[list, list] = ([], [])
        shared = {"source": self.source("train"), "labels": self.source("labels"), "folds": self.folds, "profiles": self.source("profiles"), "mode": recipe.feature_mode, "augment": recipe.augment, "payments": recipe.payments, "cadence": recipe.cadence}
        shared |= {"scenarios": list(self.scenarios), "windows": list(self.windows)} | tag
        for seed in recipe.seeds:
            s = replace(boosting.LISTWISE, seed=seed, leaves=recipe.leaves, **self.settings)
            spec = shared | {"settings": asdict(s)}
            made[0].append(self.store.model(spec | {"part": "ranker"}, lambda: learning.fit_list(rows(), s)))  # noqa: B023  called at once
            if recipe.none_detector:
                made[1].append(self.store.model(spec | {"part": "detector"}, lambda: learning.fit_none(rows(), labels, s)))  # noqa: B023
        return made

    def probabilities(self, recipe: learning.Recipe, parts: tuple[list, list], x: DataFrame, labels: DataFrame) -> DataFrame:
        seeded = lambda tables: learning.reduce(DataFrame.unionByName, [p.withColumn("seed", F.lit(k)) for k, p in enumerate(tables)])
        x = written(features.at_edge(x), "scored")
        main = seeded(learning.candidate_scores(m, x) for m in parts[0])
        none = seeded(learning.none_scores(m, x) for m in parts[1]) if parts[1] else None
        prior = scoring.prior(labels, self._classes()) if recipe.prior_bias else None
        return scoring.combine(main, none, recipe.temperature, None, 0.0, prior, recipe.prior_bias, raw=recipe.postprocess == "raw_logits")

    def _classes(self) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in LABELS], "label string")

    def _scores(self, said: DataFrame, labels: DataFrame) -> dict:
        pairs = labels.select("client_id", "truth").join(said.select("client_id", "prediction"), "client_id")
        return scoring.scores(scoring.confusion(pairs, self._classes())).first().asDict()

    def out_of_fold(self, recipe: learning.Recipe, scenario: str, labels: DataFrame, tag: dict) -> DataFrame:
        """``(client_id, prediction, confidence)`` of every labelled client by models of the other folds."""
        spec = {"recipe": {k: v for k, v in asdict(recipe).items() if k != "name"}, "scenario": scenario, "settings": self.settings, "source": self.source("train"), "labels": self.source("labels"), "profiles": self.source("profiles"), "folds": self.folds} | tag

        def make() -> DataFrame:
            out = None
            for (k,) in sorted(labels.select("fold").distinct().collect()):
                own = labels.where(F.col("fold") == k)
                others = labels.where(F.col("fold") != k).select("client_id", "truth")
                fitted = self.parts(recipe, others, {"fold": k} | tag)
                x = learning.recipe_columns(self.matrix("train", scenario, recipe.feature_mode), recipe).join(own.select("client_id"), "client_id")
                part = scoring.decide(self.probabilities(recipe, fitted, x, others))
                out = part if out is None else out.unionByName(part)
            return out

        return self.store.table("predictions", spec, make)

    # --- stages

    def prepare(self) -> dict:
        """Matrices of all scenarios and modes, with the digests of what they were made of."""
        modes = sorted({r.feature_mode for r in self.recipes})
        made = {f"{s}/{m}": len(self.matrix("train", s, m).columns) for s in self.scenarios for m in modes}
        bad = scoring.set_report(self.inputs.train.select("client_id").distinct(), self.inputs.labels).first().asDict()
        if any(bad.values()):
            raise ContractError(f"labels and clients differ: {bad}")
        return {"columns": made, "train": self.source("train"), "labels": self.source("labels")}

    def develop(self) -> dict:
        """Out-of-fold macro-F1 of each recipe in each scenario."""
        labels = self.placed()
        return {r.name: {s: self._scores(self.out_of_fold(r, s, labels, {}), labels)["macro_f1"] for s in self.scenarios} for r in self.recipes}

    def select(self) -> dict:
        """Best on the original scenario; of equal ones the simplest, then the first."""
        scores = self.receipt("develop")
        rows = [(r.name, scores[r.name][self.scenarios[0]], r.complexity, k) for k, r in enumerate(self.recipes)]
        return learning.select_recipe(self.spark.createDataFrame(rows, "recipe string, score double, complexity int, position int")).first().asDict()

    def chosen(self) -> learning.Recipe:
        return next(r for r in self.recipes if r.name == self.receipt("select")["recipe"])

    def permutation(self) -> dict:
        """The same recipe on labels that were dealt out anew: what chance reaches."""
        labels = self.placed()
        dealt = audit.permuted(labels.select("client_id", "truth"), "client_id", "truth", self.seed + 1)
        labels = written(labels.drop("truth").join(dealt, "client_id"), "permuted")
        recipe = replace(self.chosen(), seeds=self.chosen().seeds[:1])
        return self._scores(self.out_of_fold(recipe, self.scenarios[0], labels, {"permuted": self.seed + 1}), labels)

    def freeze(self) -> dict:
        """The recipe and the digests of all it rests on; refused if chance does too well."""
        chance = self.receipt("permutation")["macro_f1"]
        if chance > PERMUTED_LIMIT:
            raise ContractError(f"permuted labels reach {chance:.3f}")
        frozen = {"recipe": asdict(self.chosen()), "settings": self.settings, "prepare": self.receipt("prepare"), "develop": self.receipt("develop"), "holdout": self.source("holdout")}
        return frozen | {"sha256": digest(frozen)}

    def _frozen(self) -> dict:
        frozen = self.receipt("freeze")
        if digest({k: v for k, v in frozen.items() if k != "sha256"}) != frozen["sha256"]:
            raise ContractError("the frozen recipe was changed")
        if (frozen["prepare"]["train"], frozen["prepare"]["labels"], frozen["holdout"]) != tuple(map(self.source, ("train", "labels", "holdout"))):
            raise ContractError("tables differ from those the recipe was frozen on")
        return frozen

    def _predicted(self, part: str) -> DataFrame:
        recipe = self.chosen()
        spec = {"frozen": self.receipt("freeze")["sha256"], "part": part, "source": self.source(part)}

        def make() -> DataFrame:
            labels = self.inputs.labels.select("client_id", "truth")
            fitted = self.parts(recipe, labels, {"fold": "all"})
            x = learning.recipe_columns(self.matrix(part, self.scenarios[0], recipe.feature_mode), recipe)
            return self.probabilities(recipe, fitted, x, labels)

        return self.store.table("probabilities", spec, make)

    def predict(self) -> dict:
        """Probabilities of the holdout and the test clients, before any of their labels is read."""
        self._frozen()
        made = {}
        for part in ("holdout", *(["test"] if self.inputs.test is not None else [])):
            both = audit.overlap(self.inputs.train, getattr(self.inputs, part), "client_id").first()["both"]
            if both:
                raise ContractError(f"{both} clients of {part} are in train")
            p = self._predicted(part)
            scoring.check_probabilities(p)
            made[part] = {"clients": p.select("client_id").distinct().count(), "digest": components.table_digest(p, ["client_id", "family"])}
        return made

    def evaluate(self) -> dict:
        """The holdout's score.  That its labels are opened is noted first, and once."""
        self._frozen()
        self.leave("opened", {"frozen": self.receipt("freeze")["sha256"]})
        said = scoring.decide(self._predicted("holdout"))
        result = self._scores(said, self.inputs.holdout_labels())
        return result | {"submission": result["macro_f1"] >= SUBMISSION_LIMIT}

    def report(self) -> dict:
        """A report in Markdown from the receipts alone."""
        develop, frozen, result = self.receipt("develop"), self.receipt("freeze"), self.receipt("evaluate")
        lines = ["# Protocol", "", f"Recipe `{frozen['recipe']['name']}`, frozen as `{frozen['sha256'][:16]}`.", "", f"| recipe | {' | '.join(self.scenarios)} |", f"|{'---|' * (len(self.scenarios) + 1)}"]
        lines += [f"| {name} | {' | '.join(f'{scores[s]:.4f}' for s in self.scenarios)} |" for name, scores in develop.items()]
        lines += ["", f"Permuted labels: {self.receipt('permutation')['macro_f1']:.4f}. Holdout: macro-F1 {result['macro_f1']:.4f}, accuracy {result['accuracy']:.4f}."]
        return {"markdown": "\n".join(lines)}

    def verify(self) -> dict:
        """The stored predictions are those of the receipt, and the recipe is the frozen one."""
        self._frozen()
        for part, told in self.receipt("predict").items():
            if components.table_digest(self._predicted(part), ["client_id", "family"]) != told["digest"]:
                raise ContractError(f"predictions of {part} were changed")
        return {"verified": True}
