"""Assembled reports: amount streams beside their targets, and what a model got wrong and why.

Every report is a table; nothing is collected.  Reports describe, they fit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import clients, scoring, streams
from ..operators.ordered import percentiles

# Statistics that the forensic report compares.
COMPARED = [
    "count", "amount_cv", "last_age", "span", "unique_description", "description_top_fraction", "description_entropy", "gap_median", "gap_std", "gap_cv", "generic_fraction",
]
EVIDENCE = ["count", "gap_median", "last_age", "amount_median"]


def amount_clusters(ledger: DataFrame, labels: DataFrame, windows: list[int]) -> DataFrame:
    """Amount streams of labelled clients: statistics, texts by frequency (then
    by name), most frequent code (the smallest on ties), target, and whether
    the stream's family is the target.

    ``labels`` is ``(client_id, target)``.  Clients without a label or without
    a stream have no row; a repeated label gives its rows twice.
    """
    members = streams.amount_components(streams.card_out(ledger))
    texts = members.groupBy(*streams.KEYS, "txt").agg(F.count("*").alias("n")).groupBy(*streams.KEYS).agg(F.sort_array(F.collect_list(F.struct(-F.col("n"), "txt"))).alias("texts"))
    codes = members.groupBy(*streams.KEYS, "mcc").agg(F.count("*").alias("n")).groupBy(*streams.KEYS).agg(F.min_by("mcc", F.struct(-F.col("n"), "mcc")).alias("mcc_mode"))
    found = streams.stream_stats(members, windows, [])
    made = found.join(texts, streams.KEYS).join(codes, streams.KEYS).join(labels.select("client_id", "target"), "client_id")
    return made.withColumns({"descriptions": F.array_join("texts.txt", " | "), "matches_target": F.col("family") == F.col("target")}).drop("texts")


def cluster_report(clusters: DataFrame, columns: list[str] = COMPARED) -> DataFrame:
    """``(matches_target, statistic, n, mean, median)``: streams that fit their target beside those that do not.

    Two groups hold all streams: means are combined before the shuffle and
    medians are exact order statistics over ranges, so no task holds a group.
    """
    each = clusters.select("matches_target", F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e"))
    each, by = each.select("matches_target", "e.*"), ["matches_target", "statistic"]
    means = each.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    middle = percentiles(each, "value", [0.5], tuple(by)).toDF("_m", "_s", "q")
    on = F.col("matches_target").eqNullSafe(F.col("_m")) & F.col("statistic").eqNullSafe(F.col("_s"))
    return means.join(middle, on).select(*by, "n", "mean", F.get("q", F.lit(0)).alias("median"))


def interval_counts(clusters: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent median intervals in whole days (halves to even), the shorter first on ties."""
    days = clusters.select(F.bround("gap_median").cast("long").alias("days"))
    return days.groupBy("days").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "days").limit(k)


def text_streams(ledger: DataFrame, labels: DataFrame, windows: list[int], min_count: int = 3) -> DataFrame:
    """Outgoing card payments of a client with one text, ``min_count`` or more, summarised, with the target."""
    made = clients.summarize(streams.card_out(ledger), windows, ("client_id", "txt"))
    return made.where(F.col("count") >= min_count).join(labels.select("client_id", "target"), "client_id")


def with_own_evidence(known: DataFrame, features: DataFrame) -> DataFrame:
    """``known`` (client_id, truth, prediction) with the features of the true family's candidate; null where it has none."""
    names = ["client_total_count", *[f"amount0_{c}" for c in ("count", "last_age", "gap_cv")]]
    own = features.select("client_id", F.col("family").alias("truth"), *names)
    return known.join(own, ["client_id", "truth"], "left")


def error_cohorts(rows: DataFrame, few: int = 40, many: int = 100) -> DataFrame:
    """``(cohort, n, errors, accuracy)`` of ten overlapping cohorts; empty ones have n 0 and no accuracy.

    ``rows`` come from :func:`with_own_evidence`; a missing statistic (null or
    negative) is in no cohort that asks for it.
    """
    family = F.col("truth") != "none"
    count, age, cv = (F.coalesce(f"amount0_{c}", F.lit(-1.0)) for c in ("count", "last_age", "gap_cv"))
    candidate = family & (count >= 3)
    flags: dict[str, Column] = {
        "all": F.lit(True), "low_history": F.col("client_total_count") < few, "high_activity": F.col("client_total_count") > many,
        "true_none": ~family, "true_family": family, "family_without_candidate": family & (count < 3),
        "family_regular": candidate & (cv >= 0) & (cv <= 0.25), "family_irregular": candidate & (cv > 0.25),
        "family_recent": candidate & (age >= 0) & (age <= 45), "family_stale": candidate & (age > 90),
    }
    names = rows.sparkSession.createDataFrame([(c,) for c in flags], "cohort string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return names.join(scoring.cohorts(rows, flags), "cohort", "left").select("cohort", zero("n"), zero("errors"), "accuracy")


def error_kinds(known: DataFrame) -> DataFrame:
    """One row: errors in all, families missed, families invented, wrong families."""
    truth, said = F.col("truth"), F.col("prediction")
    kinds = {"errors": truth != said, "missed": (truth != "none") & (said == "none"), "invented": (truth == "none") & (said != "none")}
    kinds["wrong_family"] = (truth != said) & (truth != "none") & (said != "none")
    return known.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])


def explanations(known: DataFrame, features: DataFrame) -> DataFrame:
    """The surest correct client per label, with the stream that speaks for it.

    ``known`` has ``client_id, truth, prediction, confidence``.  The evidence is
    the first amount stream of the label's family if that has three payments,
    else the first broad stream; ``evidence`` is null where there is neither,
    and for ``none``, whose row counts the families that had such an amount
    stream.  Labels without a correct client have no row.  ``note`` says it in
    a sentence.
    """
    best = scoring.best_examples(known.select("client_id", "truth", "prediction", "confidence"))
    count = lambda s: F.coalesce(f"{s}_count", F.lit(0))
    available = features.where(F.col("family") != "none").groupBy("client_id").agg(F.count_if(count("amount0") >= 3).alias("available"))
    own = features.select("client_id", F.col("family").alias("prediction"), *[f"{s}_{c}" for s in ("amount0", "broad0") for c in [*EVIDENCE, "refund_count"]])
    x = best.join(own, ["client_id", "prediction"]).join(available, "client_id", "left")
    none = F.col("prediction") == "none"
    evidence = F.when(~none & (count("amount0") >= 3), "amount0").when(~none & (count("broad0") > 0), "broad0")
    x = x.withColumn("evidence", evidence)
    pick = lambda c: F.when(F.col("evidence") == "amount0", F.col(f"amount0_{c}")).when(F.col("evidence") == "broad0", F.col(f"broad0_{c}")).alias(c)
    x = x.select("client_id", F.col("prediction").alias("label"), "confidence", "evidence", F.coalesce("available", F.lit(0)).alias("available"), *[pick(c) for c in [*EVIDENCE, "refund_count"]])
    refunds = F.when(F.col("refund_count") >= 0, F.format_string("; refunds matched to it: %d", F.col("refund_count").cast("long"))).otherwise("")
    seen = F.format_string("%d payments, every %.1f days, the last %.1f days ago, %.2f each", F.col("count").cast("long"), "gap_median", "last_age", "amount_median")
    nothing = F.when(F.col("label") == "none", F.format_string("families with a repeated amount: %d", "available")).otherwise("no repeated payment of this family")
    return x.withColumn("note", F.when(F.col("evidence").isNotNull(), F.concat(seen, refunds)).otherwise(nothing))
