"""A store of features and fitted models by what they are made of, and what uses it.

A component's name is the digest of its recipe and of the tables it read, so a
run finds what an earlier one left, and a changed row, setting or column makes
another component.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import auc, stratified_folds
from ..operators.invariance import hash_tree
from ..sources.ledger import digest, exists
from . import boosting


def table_digest(df: DataFrame, key: list[str]) -> str:
    """A digest of a table's rows and columns, whatever their order."""
    root = hash_tree(df, key).where("level = 0").first()
    return digest([sorted(df.dtypes), str(root and root["rows"]), str(root and root["digest"])])


class Store:
    """Components below a folder of any file system that Spark knows.

    A component is written under a name of its own and then claimed by a
    rename that fails where another run was first; that run's is then used.
    Half-written components are never under a component's name.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.made: list[str] = []

    def path(self, kind: str, spec: dict) -> str:
        return f"{self.folder}/{kind}/{digest(spec)[:32]}"

    def _claim(self, made: str, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop
        source, target = hadoop.fs.Path(made), hadoop.fs.Path(path)
        files = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(target.getParent())
        # FileSystem.rename would move into an existing folder; this one fails
        context = hadoop.fs.FileContext.getFileContext(files.makeQualified(target).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(files.makeQualified(source), files.makeQualified(target), none)
            return True
        except Exception:
            if not exists(self.spark, f"{path}/_SUCCESS"):
                raise
            files.delete(source, True)
            return False

    def table(self, kind: str, spec: dict, make: Callable[[], DataFrame]) -> DataFrame:
        """The stored table of a recipe; made, and stored, if there is none."""
        path = self.path(kind, spec)
        if not exists(self.spark, f"{path}/_SUCCESS"):
            own = f"{self.folder}/making/{uuid.uuid4().hex}"
            make().write.parquet(own)
            if self._claim(own, path):
                self.made.append(f"{kind}/{path.rsplit('/', 1)[1]}")
        return self.spark.read.parquet(path)

    def model(self, spec: dict, make: Callable[[], boosting.Model]) -> boosting.Model:
        """The stored model of a recipe; fitted, and stored, if there is none."""
        body = self.table("models", spec, lambda: self.spark.createDataFrame([(make().to_json(),)], "body string").coalesce(1))
        return boosting.Model.from_json(body.first()["body"])


def fitted(
    store: Store, x: DataFrame, columns: list[str], label: str, group: list[str], order: str, settings: boosting.Boosting, source: str | None = None, **spec
) -> boosting.Model:
    """A boosted model, fitted once per table, columns and settings.

    ``source`` is the digest of ``x`` where the caller knows it; other words
    tell parts of one table apart.
    """
    read = list(dict.fromkeys([*group, order, label, *columns]))
    source = source or table_digest(x.select(*read), [*group, order])
    full = {"settings": asdict(settings), "columns": columns, "label": label, "group": group, "order": order, "source": source} | spec
    return store.model(full, lambda: boosting.fit(x, columns, label, group, order, settings))


def fold_models(
    store: Store, x: DataFrame, folds: DataFrame, columns: list[str], label: str, group: list[str], order: str, settings: boosting.Boosting, key: str = "client_id"
) -> Iterator[tuple[int, boosting.Model, DataFrame]]:
    """``(fold, model of the other folds, rows of the fold)`` for each fold."""
    placed = x.join(folds.select(key, "fold"), key)
    read = list(dict.fromkeys([key, *group, order, label, *columns, "fold"]))
    source = table_digest(placed.select(*read), [*group, order])
    for (k,) in sorted(folds.select("fold").distinct().collect()):
        model = fitted(store, placed.where(F.col("fold") != k), columns, label, group, order, settings, source, fold=k)
        yield k, model, placed.where(F.col("fold") == k)


def mean_importances(models: list[boosting.Model]) -> list[tuple[str, float, float]]:
    """``(feature, share of the gain, folds that use it)``, averaged over models, largest first."""
    shares: dict[str, list[float]] = {}
    for m in models:
        total = sum(m.gains.values()) or 1.0
        for c in m.features:
            shares.setdefault(c, []).append(m.gains.get(c, 0.0) / total)
    made = [(c, sum(v) / len(models), sum(x > 0 for x in v) / len(models)) for c, v in shares.items()]
    return sorted(made, key=lambda r: (-r[1], r[0]))


DRIFT = boosting.Boosting("logistic", rounds=10, leaves=8, learning_rate=0.2, min_rows=5, l2=1.0, columns=1.0)


def drift_report(store: Store, a: DataFrame, b: DataFrame, columns: list[str], folds: int = 5, seed: int = 931, settings: boosting.Boosting = DRIFT) -> tuple[DataFrame, list[tuple[str, float, float]]]:
    """How well a model tells rows of ``b`` from rows of ``a``, and by what.

    Returns ``(fold, auc)``, of out-of-fold probabilities, and the features'
    importances averaged over the folds.  A client may be in both tables.
    """
    side = lambda df, k: df.select("client_id", *[F.col(c).cast("double").alias(c) for c in columns]).withColumn("label", F.lit(k))
    x = side(a, 0).unionByName(side(b, 1)).withColumn("client_id", F.concat_ws("/", "label", "client_id")).withColumn("place", F.lit(0))
    placed = stratified_folds(x.select("client_id", "label"), "label", "client_id", folds, seed)
    scored, models = None, []
    for k, model, rows in fold_models(store, x, placed, columns, "label", ["client_id"], "place", settings):
        models.append(model)
        part = boosting.predict(model, rows, ["client_id", "label"]).select("label", F.get("scores", F.lit(0)).alias("score"), F.lit(k).alias("fold"))
        scored = part if scored is None else scored.unionByName(part)
    return auc(scored, "score", "label", by=("fold",)), mean_importances(models)
