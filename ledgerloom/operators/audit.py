"""Profiles, overlaps, conditional tables, drift and folds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import RANGE_ROWS, numbered, percentiles as exact_percentiles


def describe(df: DataFrame, column: str, by: list[str] | None = None, percentiles: tuple[int, ...] = (25, 50, 75)) -> DataFrame:
    """Count, moments, extremes and percentiles of a column, of all rows or by group."""
    by = by or []
    made = df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    q = exact_percentiles(df, column, [x / 100 for x in percentiles], tuple(by)).toDF(*[f"_k{k}" for k in range(len(by))], "q")
    on = F.lit(True)
    for k, c in enumerate(by):
        on &= F.col(c).eqNullSafe(F.col(f"_k{k}"))
    # one row a group on both sides; without groups one row each
    return made.join(q if by else F.broadcast(q), on, "inner").select(*by, "n", "mean", "std", "min", *[F.get("q", F.lit(k)).alias(f"q{p}") for k, p in enumerate(percentiles)], "max")


def grouped_report(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Count, mean, median and sample deviation of several columns by group, long."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")
    return df.select(by, each).groupBy(by, "e.statistic").agg(
        F.count("e.value").alias("n"), F.avg("e.value").alias("mean"), F.median("e.value").alias("median"), F.stddev_samp("e.value").alias("std")
    )


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``ids``; no row is repeated, however often its id is."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def many_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that refuses a right side with a repeated key."""
    if right.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").limit(1).count():
        raise ValueError(f"repeated {key} on the right side")
    return left.join(right, key, "left")


def renamed(df: DataFrame, names: DataFrame, key: str, to: str) -> DataFrame:
    """Keys replaced through the lookup ``names`` (key, to); others keep theirs."""
    return df.join(names.select(key, F.col(to).alias("_to")), key, "left").withColumn(key, F.coalesce("_to", key)).drop("_to")


def first_rows(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The first row of each group: a minimum, combined before the shuffle."""
    rest = [c for c in df.columns if c not in (by, *order)]
    return df.groupBy(by).agg(F.min(F.struct(*order, *rest)).alias("r")).select(by, "r.*")


def unstack(df: DataFrame, row: str, column: str, values: list[str], names: list[str]) -> DataFrame:
    """Long to wide over a fixed vocabulary: ``<name>__<value>`` columns, absent ones null."""
    return df.groupBy(row).agg(*[F.max(F.when(F.col(column) == v, F.col(n))).alias(f"{n}__{v}") for n in names for v in values])


def profile(ledger: DataFrame) -> DataFrame:
    """One row about a split: sizes, range, vocabulary, duplicates."""
    rows = ledger.groupBy("client_id", "timestamp", "amount", "currency", "type", "direction", "description", "mcc", "fee").agg(F.count("*").alias("n"))
    return rows.agg(
        F.sum("n").alias("transactions"), F.count_distinct("client_id").alias("clients"), F.unix_micros(F.min("timestamp")).alias("first"), F.unix_micros(F.max("timestamp")).alias("last"),
        F.count_distinct("description").alias("descriptions"), F.sum(F.col("n") - 1).alias("repeated"),
    )


def top_confusions(pairs: DataFrame, k: int = 20) -> DataFrame:
    """The most frequent wrong pairs of truth and prediction."""
    return pairs.where("truth <> prediction").groupBy("truth", "prediction").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "truth", "prediction").limit(k)


def value_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values, smallest first on ties: TakeOrderedAndProject."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def mode(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The most frequent value per group, the smallest on ties."""
    n = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), column)
    return n.withColumn("k", F.row_number().over(w)).where("k = 1").select(*by, F.col(column).alias("mode"), "n")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts per row value over a fixed vocabulary, missing ones 0."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values])


def conditional(df: DataFrame, client: str, condition: str, outcome: str) -> DataFrame:
    """P(outcome | condition) with one vote per client and condition."""
    votes = df.select(client, condition, outcome).distinct().groupBy(condition, outcome).agg(F.count("*").alias("n"))
    return votes.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(condition)))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both, only in ``a`` and only in ``b``: one full outer join of distinct keys."""
    x = a.select(key).distinct().withColumn("_a", F.lit(1))
    y = b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full_outer").agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right")
    )


def unseen_rate(train: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Share of rows of ``other`` whose value never occurs in ``train``."""
    seen = train.select(column).distinct().withColumn("_seen", F.lit(1))
    return other.join(seen, column, "left").agg(F.count("*").alias("n"), F.count_if(F.col("_seen").isNull()).alias("unseen"), F.avg(F.col("_seen").isNull().cast("double")).alias("rate"))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def stratified_folds(labels: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42, rows: int = RANGE_ROWS) -> DataFrame:
    """Disjoint, covering folds with each label spread evenly; order by hash.

    A label is numbered in ranges of the hash, however many rows have it.
    """
    h = F.md5(F.concat_ws("|", key, F.lit(seed)))
    placed = numbered(labels, [h, F.col(key)], (label,), rows=rows)
    return placed.withColumn("fold", (F.col("_n") - 1) % folds).select(*labels.columns, "fold")


def sample_clients(ids: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` clients without replacement, the same for the same seed."""
    return ids.select(key).distinct().orderBy(F.md5(F.concat_ws("|", key, F.lit(seed))), key).limit(n)


def permuted(labels: DataFrame, key: str, target: str, seed: int, rows: int = RANGE_ROWS) -> DataFrame:
    """Targets shuffled over clients: two hash orders joined by position."""

    def by_hash(salt):
        return numbered(labels, [F.md5(F.concat_ws("|", key, F.lit(salt))), F.col(key)], rows=rows)

    return by_hash(seed).select(key, "_n").join(by_hash(seed + 1).select(target, "_n"), "_n").drop("_n")


def quartiles(df: DataFrame, column: str) -> DataFrame:
    """Right-closed quartile bin (0 to 3) of a column; edges are exact and one row."""
    edges = exact_percentiles(df, column, [0.25, 0.5, 0.75]).withColumnRenamed("q", "e")
    x = F.col(column)
    return df.join(F.broadcast(edges), how="inner", on=F.lit(True)).withColumn(
        "bin", F.when(x <= F.get("e", F.lit(0)), 0).when(x <= F.get("e", F.lit(1)), 1).when(x <= F.get("e", F.lit(2)), 2).otherwise(3)
    ).drop("e")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence statistic and degrees of freedom of two categorical columns."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    ra, rb = n.groupBy(a).agg(F.sum("n").alias("na")), n.groupBy(b).agg(F.sum("n").alias("nb"))
    # the sum of (n - e)^2 / e over the grid needs the occupied cells only
    seen = n.join(ra, a).join(rb, b)
    return seen.agg(
        (F.sum("n") * (F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))) - 1)).alias("chi2"),
        ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("df"),
    )


def chi_square_tail(chi2: float, df: int) -> float:
    """Probability of a larger statistic: the regularised upper gamma function."""
    a, x = df / 2, chi2 / 2
    if df <= 0 or x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # series of the lower function
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - scale * total)
    back, ahead = 1e300, 1 / (x + 1 - a)  # continued fraction of the upper one
    total = ahead
    for k in range(1, 10_000):
        step, b = k * (a - k), x + 1 - a + 2 * k
        ahead, back = 1 / (step * ahead + b), b + step / back
        total *= ahead * back
        if abs(ahead * back - 1) < 1e-15:
            break
    return scale * total


def auc(scored: DataFrame, score: str, positive: str, buckets: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve from average ranks of tied scores, of all rows or by group.

    Scores are cut into buckets at approximate quantiles; ranks run within
    buckets, and only bucket totals meet in one task.
    """
    t = scored.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("p"))
    cuts = scored.agg(F.percentile_approx(score, [k / buckets for k in range(1, buckets)]).alias("cuts"))
    t = t.join(F.broadcast(cuts), how="inner", on=F.lit(True)).withColumn("_b", F.size(F.filter("cuts", lambda c: c < F.col(score)))).drop("cuts")
    before = Window.partitionBy(*by, "_b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = t.groupBy(*by, "_b").agg(F.sum("n").alias("_c")).select(*by, "_b", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_base"))
    r = t.withColumn("_in", F.coalesce(F.sum("n").over(before), F.lit(0))).join(base, [*by, "_b"]).withColumn("rank", F.col("_base") + F.col("_in") + (F.col("n") + 1) / 2)
    return r.groupBy(*by).agg(F.sum(F.col("p") * F.col("rank")).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n")).select(
        *by, F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc")
    )
