"""Submission contract, classification metrics, ensemble algebra, bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LABELS
from ..functions.numeric import biased, softmax, substitute_none, uniform
from ..functions.text import valid_id
from ..sources.ledger import ContractError


def set_report(left: DataFrame, right: DataFrame, key: str = "client_id") -> DataFrame:
    """One row: missing, unexpected and repeated keys of ``right`` against ``left``."""
    a = left.groupBy(key).agg(F.count("*").alias("_a"))
    b = right.groupBy(key).agg(F.count("*").alias("_b"))
    return a.join(b, key, "full_outer").agg(
        F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("unexpected"),
        F.count_if(F.col("_a") > 1).alias("repeated_left"), F.count_if(F.col("_b") > 1).alias("repeated_right"),
    )


def align_targets(labels: DataFrame, ids: DataFrame, target: str = "target_next_recurring_merchant") -> DataFrame:
    """Ordinal target per client; both tables must hold the same clients once."""
    bad = set_report(ids, labels).first().asDict()
    if any(bad.values()):
        raise ContractError(f"labels and clients differ: {bad}")
    code = F.create_map(*[x for k, f in enumerate(LABELS) for x in (F.lit(f), F.lit(k))])
    return ids.select("client_id").join(labels, "client_id").select("client_id", F.element_at(code, F.col(target)).alias("y"))


def inspect_submission(submission: DataFrame, sample: DataFrame, column: str = "predicted_next_recurring_merchant") -> DataFrame:
    """One row of contract counts; all but ``rows`` are 0 in a valid submission."""
    form = submission.agg(
        F.count("*").alias("rows"), F.count_if(~F.coalesce(valid_id(F.col("client_id")), F.lit(False))).alias("bad_ids"),
        F.count_if(~F.coalesce(F.col(column).isin(LABELS), F.lit(False))).alias("bad_labels"),
    )
    return form.join(F.broadcast(set_report(sample, submission)), how="inner", on=F.lit(True))


def validate_submission(submission: DataFrame, sample: DataFrame, column: str = "predicted_next_recurring_merchant") -> None:
    if submission.columns != ["client_id", column]:
        raise ContractError(f"columns {submission.columns}")
    bad = {k: v for k, v in inspect_submission(submission, sample, column).first().asDict().items() if k != "rows" and v}
    if bad:
        raise ContractError(f"invalid submission: {bad}")


def in_sample_order(predictions: DataFrame, sample: DataFrame, position: str) -> DataFrame:
    """Predictions in the order of the sample's explicit ``position``."""
    return sample.join(predictions, "client_id").orderBy(position)


def confusion(pairs: DataFrame, classes: DataFrame, truth: str = "truth", prediction: str = "prediction", n: str | None = None) -> DataFrame:
    """Counts on the whole label grid, zeros kept.  ``classes`` is the label column ``label``."""
    weight = F.count("*") if n is None else F.sum(n)
    seen = pairs.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(weight.alias("n"))
    grid = classes.select(F.col("label").alias("truth")).join(F.broadcast(classes.select(F.col("label").alias("prediction"))), how="inner", on=F.lit(True))
    return grid.join(seen, ["truth", "prediction"], "left").select("truth", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """Support, predicted count, precision, recall and F1 (0 where undefined) per class."""
    each = matrix.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t")), F.struct(F.col("prediction").alias("label"), F.lit(0).alias("t")))).alias("x"), "n", "truth", "prediction")
    s = each.groupBy(F.col("x.label").alias("label")).agg(
        F.sum(F.when(F.col("x.t") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("x.t") == 0, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("truth") == F.col("prediction")) & (F.col("x.t") == 1), F.col("n")).otherwise(0)).alias("hit"),
    )
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = safe(F.col("hit"), F.col("predicted")), safe(F.col("hit"), F.col("support"))
    f1 = safe(2 * F.col("hit"), F.col("support") + F.col("predicted"))
    return s.select("label", "support", "predicted", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "hit")


def scores(matrix: DataFrame) -> DataFrame:
    """Macro-F1 over all classes of the grid (absent ones count 0) and accuracy."""
    return per_class(matrix).agg(F.avg("f1").alias("macro_f1"), F.try_divide(F.sum("hit").cast("double"), F.sum("support").cast("double")).alias("accuracy"))


def score_predictions(labels: DataFrame, predictions: DataFrame, spark) -> DataFrame:
    """The task's score: contract first, then macro-F1 over the eight labels."""
    return scores(scored_confusion(labels, predictions, spark))


def scored_confusion(labels: DataFrame, predictions: DataFrame, spark) -> DataFrame:
    """The confusion matrix of a valid submission."""
    renamed = labels.select("client_id", F.col("target_next_recurring_merchant").alias("truth"))
    validate_submission(predictions, renamed)
    pairs = renamed.join(predictions.select("client_id", F.col("predicted_next_recurring_merchant").alias("prediction")), "client_id")
    return confusion(pairs, spark.createDataFrame([(x,) for x in LABELS], "label string"))


def score_report(matrix: DataFrame) -> dict:
    """The score as a plain dict: totals, classes and confusions in label order."""
    cells = {(r["truth"], r["prediction"]): r["n"] for r in matrix.collect()}
    classes = {r["label"]: r for r in per_class(matrix).collect()}
    total = scores(matrix).first()
    return {
        "clients": sum(cells.values()), "macro_f1": total["macro_f1"], "accuracy": total["accuracy"], "label_order": LABELS, "undefined_class_f1": 0.0,
        "per_class": {x: {"support": classes[x]["support"], "predicted_count": classes[x]["predicted"], **{k: classes[x][k] for k in ("precision", "recall", "f1")}} for x in LABELS},
        "confusion_true_by_predicted": {a: {b: cells[a, b] for b in LABELS} for a in LABELS},
    }


def probability_losses(p: DataFrame, truth: str = "truth") -> DataFrame:
    """Log loss, entropy, confidence and Brier score of long ``(client_id, family, p)`` rows."""
    own = F.col("family") == F.col(truth)
    each = p.groupBy("client_id").agg(
        F.sum(F.when(own, -F.ln(F.greatest(F.col("p"), F.lit(1e-12))))).alias("ll"), F.sum(-F.col("p") * F.ln(F.greatest(F.col("p"), F.lit(1e-12)))).alias("h"),
        F.max("p").alias("c"), F.sum(F.pow(F.col("p") - own.cast("double"), F.lit(2.0))).alias("b"),
    )
    return each.agg(F.avg("ll").alias("log_loss"), F.avg("h").alias("entropy"), F.avg("c").alias("confidence"), F.avg("b").alias("brier"))


def decide(p: DataFrame) -> DataFrame:
    """The most probable family per client, the first in label order on ties."""
    return p.groupBy("client_id").agg(F.max_by("family", F.struct("p", -F.col("family_index"))).alias("prediction"), F.max("p").alias("confidence"))


def calibration(decided: DataFrame, bins: int = 10) -> DataFrame:
    """Right-closed bins of confidence with size, accuracy and mean confidence."""
    b = F.ceil(F.col("confidence") * bins).cast("int")
    return decided.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("prediction")).cast("double")).alias("accuracy"), F.avg("confidence").alias("confidence"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def combine(
    scores_: DataFrame, none: DataFrame | None, temperature: float = 1.0, legacy: DataFrame | None = None, legacy_weight: float = 0.0,
    prior_: DataFrame | None = None, prior_bias: float = 0.0, raw: bool = False,
) -> DataFrame:
    """Probabilities of an ensemble: ``(client_id, family, family_index, p)``.

    ``scores_`` and ``legacy`` hold a ``score`` per candidate and ``seed``.
    Each seed's scores are divided by ``temperature`` and turned into
    probabilities, none is substituted by ``none`` (client_id, seed, p_none),
    and seeds are averaged; with ``raw`` the scores are averaged instead and
    turned into probabilities once.  ``legacy`` enters with its weight, and
    ``prior_`` (label, prior) lowers frequent labels by ``prior_bias``.
    """
    each, client = Window.partitionBy("client_id", "seed"), Window.partitionBy("client_id")
    key = ["client_id", "family", "family_index"]
    part = lambda x: x if raw else x.withColumn("score", softmax(F.col("score") / temperature, each))
    main = part(scores_)
    if none is not None and not raw:
        main = main.join(none, ["client_id", "seed"]).withColumn("score", substitute_none(F.col("score"), F.col("p_none"), F.col("family") == "none", each))
    p = main.groupBy(*key).agg(F.avg("score").alias("p"))
    if legacy is not None and legacy_weight:
        p = blend([(p, 1 - legacy_weight), (part(legacy).groupBy(*key).agg(F.avg("score").alias("p")), legacy_weight)])
    if raw:
        p = p.withColumn("p", softmax(F.col("p") / temperature, client))
    if prior_ is not None and prior_bias:
        p = p.join(F.broadcast(prior_.withColumnRenamed("label", "family")), "family").withColumn("p", biased(F.col("p"), -prior_bias * F.ln("prior"), client)).select(*key, "p")
    return p


def check_probabilities(p: DataFrame) -> None:
    """Eight finite probabilities per client that sum to one; ``ContractError`` otherwise."""
    finite = F.col("p").isNotNull() & ~F.isnan("p") & F.col("p").between(0, 1)
    bad = p.groupBy("client_id").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.min(finite.cast("int")).alias("ok")).where("n <> 8 OR ok = 0 OR abs(s - 1) > 1e-6")
    if bad.limit(1).count():
        raise ContractError("invalid probabilities")


def blend(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted mean of aligned probability tables."""
    out = None
    for df, weight in parts:
        x = df.select("client_id", "family", "family_index", (F.col("p") * weight).alias("p"))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("client_id", "family", "family_index").agg(F.sum("p").alias("p"))


def prior(targets: DataFrame, classes: DataFrame) -> DataFrame:
    """Laplace-smoothed class frequencies."""
    n = targets.groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("n"))
    x = classes.join(n, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    every = Window.partitionBy(F.lit(1))
    return x.select("label", ((F.col("n") + 1) / (F.sum("n").over(every) + F.count("*").over(every))).alias("prior"))


#: Distribution function of Poisson draws with mean 1, up to six.
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]


def bootstrap(pairs: DataFrame, repetitions: int, seed: int, labels: list[str] = LABELS, rival: str | None = None) -> DataFrame:
    """``accuracy`` and ``macro_f1`` per replicate by Poisson weights: a draw per
    client and replicate, no gather.

    With a second prediction column ``rival`` also its macro-F1 and ``delta``,
    the first less the second of the same draw.  Each client's weight follows
    from a hash of client, replicate and seed, so replicates are reproducible
    and the aggregation is combined map-side.
    """
    u = uniform("client_id", "replicate", salt=seed)
    weight = sum((F.when(u >= s, 1).otherwise(0) for s in POISSON), F.lit(0))
    each = pairs.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1)))).withColumn("w", weight)
    w, truth = F.col("w"), F.col("truth")

    def macro(column: str):
        said = F.col(column)
        share = lambda x: F.sum(F.when(truth == x, w).otherwise(0)) + F.sum(F.when(said == x, w).otherwise(0))
        f1 = [F.coalesce(F.try_divide(2.0 * F.sum(F.when((truth == x) & (said == x), w).otherwise(0)), share(x)), F.lit(0.0)) for x in labels]
        return sum(f1[1:], f1[0]) / len(labels)

    hit = F.sum(F.when(truth == F.col("prediction"), w).otherwise(0))
    made = each.groupBy("replicate").agg(
        F.try_divide(hit, F.sum("w")).alias("accuracy"), macro("prediction").alias("macro_f1"), *([macro(rival).alias("rival_macro_f1")] if rival else [])
    )
    return made.withColumn("delta", F.col("macro_f1") - F.col("rival_macro_f1")) if rival else made


def interval(replicates: DataFrame, column: str = "accuracy") -> DataFrame:
    q = F.percentile(column, F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.agg(q.alias("q")).select(F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def intervals(replicates: DataFrame) -> DataFrame:
    """``(metric, low, high)`` of every metric of the replicates."""
    names = [c for c in replicates.columns if c != "replicate"]
    each = replicates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names])).alias("m"))
    q = F.percentile("m.value", F.array(F.lit(0.025), F.lit(0.975)))
    return each.groupBy("m.metric").agg(q.alias("q")).select("metric", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def cohorts(rows: DataFrame, flags: dict[str, object]) -> DataFrame:
    """Size, errors and accuracy of overlapping cohorts in one pass."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))
    hit = (F.col("truth") == F.col("prediction")).cast("long")
    return rows.withColumn("cohort", F.explode(named)).groupBy("cohort").agg(F.count("*").alias("n"), F.sum(1 - hit).alias("errors"), F.avg(hit.cast("double")).alias("accuracy"))


def best_examples(rows: DataFrame) -> DataFrame:
    """The surest correct client per class."""
    best = F.min_by(F.struct(*rows.columns), F.struct(-F.col("confidence"), "client_id"))
    return rows.where("truth = prediction").groupBy("prediction").agg(best.alias("r")).select("r.*")
