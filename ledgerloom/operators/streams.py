"""Recurring payment streams: detection and statistics.

All windows and aggregates below cluster on the client (first), so the whole
chain runs behind one exchange; each stream is as small as a client's history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BACKGROUND, EPS, FAMILIES, GENERIC, MCC, PATTERNS, PERIODS, TEMPLATES
from ..functions.numeric import cadence_error, circular, divided, label, log

KEYS = ["client_id", "currency", "group_type", "comp"]


def card_out(ledger: DataFrame) -> DataFrame:
    return ledger.where("type = 'card_payment' AND direction = 'out'")


def without_background(ledger: DataFrame) -> DataFrame:
    return ledger.where(~F.col("txt").rlike(BACKGROUND))


def amount_components(rows: DataFrame, eps: float = EPS, min_count: int = 3, by: tuple[str, ...] = ("client_id", "currency")) -> DataFrame:
    """Rows of chains of amounts whose neighbouring logarithms differ by ``eps`` at most.

    Gaps and islands in the order of amount: the one-dimensional case of
    density clustering with two or three neighbours.  ``comp`` numbers the
    chains of a client and currency; chains under ``min_count`` rows go.
    A zero has no finite logarithm: it is near no amount, nor another zero.
    Rows without an amount come last and begin no chain, as in the SQL.
    """
    if min_count not in (2, 3):
        raise ValueError("chains of two or three payments")
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last("amount"), "tx_id")
    value = log(F.col("amount"))
    start = F.when(value - F.lag(value).over(w) > eps, 1).otherwise(0)
    marked = rows.withColumn("_start", start).withColumn("comp", F.sum("_start").over(w).cast("long"))
    sized = marked.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "comp")))
    return sized.where(F.col("_n") >= min_count).drop("_start", "_n").withColumn("group_type", F.lit("amount"))


def broad_members(rows: DataFrame, min_count: int = 2) -> DataFrame:
    """Rows of broad family streams: matched by text, or by code and template."""
    flags = [
        F.when(
            F.col("txt").rlike(PATTERNS[f]) | ((F.col("mcc") == MCC[f]) & F.col("txt").isin(TEMPLATES[f] + GENERIC)),
            F.lit(f"family_{f}"),
        )
        for f in FAMILIES
    ]
    each = rows.withColumn("group_type", F.explode(F.array_compact(F.array(*flags)))).withColumn("comp", F.lit(-1).cast("long"))
    sized = each.withColumn("_n", F.count("*").over(Window.partitionBy("client_id", "currency", "group_type")))
    return sized.where(F.col("_n") >= min_count).drop("_n")


def stream_members(ledger: DataFrame, eps: float = EPS, min_count: int = 3, filter_background: bool = False) -> DataFrame:
    rows = card_out(ledger)
    if filter_background:
        rows = without_background(rows)
    amount = amount_components(rows, eps, min_count)
    return amount.unionByName(broad_members(rows).select(*amount.columns))


def distinct(column: str):
    """Exact distinct count of a small group: several of them in one aggregate
    would otherwise multiply its input rows."""
    return F.size(F.collect_set(column))


def stream_stats(members: DataFrame, windows: list[int], periods: list[float] = PERIODS) -> DataFrame:
    """One row per stream with its amount, time, text and cadence statistics.

    Gap statistics are null below two events.  Standard deviations divide by n.
    Ratios to a zero amount are infinite, or NaN for 0 / 0.
    """
    key = Window.partitionBy(*KEYS)
    time = key.orderBy("t", "tx_id")
    m = (
        members.withColumn("_gap", F.col("t") - F.lag("t").over(time))
        .withColumn("_i", (F.row_number().over(time) - 1).cast("double"))
        .withColumn("_back", F.row_number().over(key.orderBy(F.col("t").desc(), F.col("tx_id").desc())))
        .withColumn("_share", F.count("*").over(Window.partitionBy(*KEYS, "txt")) / F.count("*").over(key))
        .withColumn("_mshare", F.count("*").over(Window.partitionBy(*KEYS, "mcc")) / F.count("*").over(key))
        .withColumn("_amed", F.median("amount").over(key))
    )
    m = m.withColumn("_gmed", F.median("_gap").over(key))
    n, a, t, g = F.count("*"), F.col("amount"), F.col("t"), F.col("_gap")
    known = F.when(a.isNotNull(), F.col("_i"))
    aggs = {
        "count": n, "amount_mean": F.avg(a), "amount_std": F.stddev_pop(a), "amount_cv": divided(F.stddev_pop(a), F.avg(a)),
        "amount_min": F.min(a), "amount_max": F.max(a), "amount_median": F.first("_amed"),
        "amount_mad": divided(F.median(F.abs(a - F.col("_amed"))), F.first("_amed")),
        "first_age": -F.min(t), "last_age": -F.max(t), "span": F.max(t) - F.min(t),
        "unique_description": distinct("txt"), "description_top_fraction": F.max("_share"), "description_entropy": F.avg(-F.ln("_share")),
        "unique_mcc": distinct("mcc"), "mcc_top_fraction": F.max("_mshare"),
        "generic_fraction": F.avg(F.col("txt").isin(GENERIC).cast("double")),
        "dom_std": F.stddev_pop(F.dayofmonth("timestamp")), "dow_std": F.stddev_pop(F.weekday("timestamp")), "currency_count": F.lit(1),
        "gap_median": F.first("_gmed"), "gap_mean": F.avg(g), "gap_std": F.stddev_pop(g), "gap_mad": F.median(F.abs(g - F.col("_gmed"))),
        "gap_min": F.min(g), "gap_max": F.max(g), "gap_cv": F.stddev_pop(g) / F.greatest(F.avg(g), F.lit(1e-6)),
        "gap_last": F.max_by(g, F.col("_i")), "gap_recent": F.median(F.when(F.col("_back") <= 3, g)), "_last": F.max(t),
        "amount_change": divided(F.max_by(a, known), F.min_by(a, known)) - 1,
        "linear_period": F.regr_slope(t, F.col("_i")), "_intercept": F.regr_intercept(t, F.col("_i")),
        "linear_residual": F.sqrt(F.greatest(F.lit(0.0), F.regr_syy(t, F.col("_i")) * (1 - F.regr_r2(t, F.col("_i"))) / n)),
    }
    aggs |= {f"count_{w}": F.count_if(t >= -w) for w in windows}
    for f in FAMILIES:
        aggs[f"semantic_{f}"] = F.avg(F.col("txt").rlike(PATTERNS[f]).cast("double"))
        aggs[f"mcc_{f}"] = F.avg((F.col("mcc") == MCC[f]).cast("double"))
        aggs[f"template_{f}_diversity"] = F.size(F.array_intersect(F.collect_set("txt"), F.array(*map(F.lit, TEMPLATES[f]))))
        aggs[f"template_{f}_count"] = F.count_if(F.col("txt").isin(TEMPLATES[f]))
    for p in periods:
        strength, phase = circular(t, p)
        aggs |= {f"period_error_{label(p)}": cadence_error(g, p), f"phase_strength_{label(p)}": strength, f"phase_next_{label(p)}": phase}
    made = m.groupBy(*KEYS).agg(*[c.alias(k) for k, c in aggs.items()])
    several = F.col("count") >= 2
    only = lambda c: F.when(several, c)
    made = made.withColumns(
        {f"next_{k}": only(F.col("_last") + F.col(f"gap_{k}")) for k in ("median", "mean", "last", "recent")}
        | {"overdue_ratio": only(-F.col("_last") / F.greatest(F.col("gap_median"), F.lit(1.0))), "amount_change": only(F.col("amount_change"))}
        | {"linear_next": F.col("_intercept") + F.col("linear_period") * F.col("count")}
        | {c: only(F.col(c)) for p in periods for c in (f"phase_strength_{label(p)}", f"phase_next_{label(p)}")}
    )
    return with_family(made.drop("_last", "_intercept"))


def with_family(streams: DataFrame) -> DataFrame:
    """Best family by text and a quarter of the code share; first family on ties."""
    scores = F.array(
        *[
            F.struct((F.col(f"semantic_{f}") + 0.25 * F.col(f"mcc_{f}")).alias("score"), F.lit(-k).alias("k"), F.lit(f).alias("family"))
            for k, f in enumerate(FAMILIES)
        ]
    )
    return streams.withColumn("_best", F.array_max(scores)).withColumns(
        {"family": F.col("_best.family"), "family_score": F.col("_best.score"), "eps": F.lit(EPS)}
    ).drop("_best")


def extract_streams(ledger: DataFrame, windows: list[int], eps: float = EPS, min_count: int = 3, filter_background: bool = False, periods: list[float] = PERIODS) -> DataFrame:
    return stream_stats(stream_members(ledger, eps, min_count, filter_background), windows, periods)
