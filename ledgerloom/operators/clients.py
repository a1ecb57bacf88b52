"""Client-level features, payment context and rule baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BACKGROUND, FAMILIES, GENERIC, LABELS, MCC, NO_EVENT, PATTERNS
from ..functions.numeric import business_day, day, divided, next_month, right_closed
from ..functions.text import enriched
from .streams import amount_components, card_out, distinct, without_background

VOCABULARY = {
    "type": ["card_payment", "topup", "p2p_transfer", "transfer", "atm", "refund", "fee"],
    "direction": ["out", "in"],
    "currency": ["chf", "eur", "usd", "gbp"],
}


def client_globals(ledger: DataFrame, windows: list[int], vocabulary: dict[str, list[str]] = VOCABULARY) -> DataFrame:
    """Counts and moments per client; category columns come from a fixed vocabulary.

    A mean adds its amounts in the order of ``tx_id``: its last bits depend on no partition.
    """
    age = -F.col("t")
    in_order = Window.partitionBy("client_id").orderBy("tx_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ledger.withColumn("_mean", F.avg("amount").over(in_order)).groupBy("client_id").agg(
        F.count("*").alias("total_count"), F.first("_mean").alias("amount_mean"), F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("amount_std"),
        F.max(age).alias("first_age"), F.min(age).alias("last_age"),
        *[F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c, vs in vocabulary.items() for v in vs],
        *[F.count_if(age <= w).alias(f"count_{w}") for w in windows],
    )


def summarize(ledger: DataFrame, windows: list[int], by: tuple[str, ...] = ("client_id",), periods: tuple[int, ...] = (7, 14, 28, 30, 31, 60, 90, 365)) -> DataFrame:
    """Summary block of any grouping of the ledger (wide tabular baseline)."""
    key = Window.partitionBy(*by)
    m = (
        ledger.withColumn("_gap", F.col("t") - F.lag("t").over(key.orderBy("t", "tx_id")))
        .withColumn("_share", F.count("*").over(Window.partitionBy(*by, "description")) / F.count("*").over(key))
    )
    m = m.withColumn("_gmed", F.median("_gap").over(key))
    a, t, g = F.col("amount"), F.col("t"), F.col("_gap")
    return m.groupBy(*by).agg(
        F.count("*").alias("count"), F.avg(a).alias("amount_mean"), F.stddev_pop(a).alias("amount_std"), F.min(a).alias("amount_min"), F.max(a).alias("amount_max"),
        F.median(a).alias("amount_median"), (F.stddev_pop(a) / F.greatest(F.avg(a), F.lit(1e-6))).alias("amount_cv"),
        (-F.min(t)).alias("first_age"), (-F.max(t)).alias("last_age"), (F.max(t) - F.min(t)).alias("span"),
        distinct("description").alias("unique_description"), F.max("_share").alias("description_top_fraction"), F.avg(-F.ln("_share")).alias("description_entropy"),
        distinct("mcc").alias("unique_mcc"), distinct("currency").alias("unique_currency"), F.avg((F.col("fee") > 0).cast("double")).alias("fee_fraction"),
        F.stddev_samp(F.dayofmonth("timestamp")).alias("dom_std"), F.stddev_samp(F.weekday("timestamp")).alias("dow_std"),
        F.size(F.collect_set(F.date_format("timestamp", "yyyy-MM"))).alias("month_count"),
        *[F.count_if(t >= -w).alias(f"count_{w}") for w in windows],
        F.first("_gmed").alias("gap_median"), F.avg(g).alias("gap_mean"), F.stddev_pop(g).alias("gap_std"), F.min(g).alias("gap_min"), F.max(g).alias("gap_max"),
        F.median(F.abs(g - F.col("_gmed"))).alias("gap_mad"), (F.stddev_pop(g) / F.greatest(F.avg(g), F.lit(1e-6))).alias("gap_cv"),
        (F.max(t) + F.first("_gmed")).alias("next_median"), F.max_by(g, F.struct("t", "tx_id")).alias("gap_last"),
        *[F.median(F.abs(g - p)).alias(f"period_error_{p}") for p in periods],
    )


def nearest_card(ledger: DataFrame, slots: DataFrame) -> DataFrame:
    """The card row of the client whose age is nearest to ``last_age`` (the earliest on ties).

    Cards and slots of a client are sorted together, once from each end, and
    the last card before a slot is carried along: the work is linear in both.
    """
    cards = ledger.where("type = 'card_payment'").groupBy("client_id", "timestamp").agg(F.min("t").alias("t"), F.min(F.struct("tx_id", "currency", "fee")).alias("c"))
    card = F.struct("t", "timestamp", "c")
    both = cards.select("client_id", "t", F.lit(0).alias("kind"), card.alias("card")).unionByName(
        slots.select("client_id", (-F.col("last_age")).alias("t"), F.lit(1).alias("kind"), F.struct(*slots.columns).alias("slot")), allowMissingColumns=True
    )
    carried = lambda order: F.last("card", True).over(Window.partitionBy("client_id").orderBy(order, "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = both.select("kind", "slot", carried(F.asc("t")).alias("before"), carried(F.desc("t")).alias("after")).where("kind = 1")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(-F.col(f"{c}.t") - F.col("slot.last_age")).alias("d"), f"{c}.timestamp", f"{c}.c"))
    best = found.select("slot", F.least(near("before"), near("after")).alias("b")).where("b IS NOT NULL")
    return best.select("slot.*", F.col("b.c.currency").alias("currency"), F.col("b.c.fee").alias("last_fee"))


def payment_context(ledger: DataFrame, slots: DataFrame, windows: tuple[int, int] = (90, 30), tolerance: float = 0.04, grace: float = 10) -> DataFrame:
    """Refund, fee and time evidence of streams ``(client_id, family, prefix, amount_median, last_age)``.

    Log amounts are cut into cells as wide as the band: a stream meets the rows
    of its client, currency, own and two neighbouring cells only.  Refunds
    count by the strict trailing windows.
    """
    near = nearest_card(ledger, slots)
    cell = lambda a: F.floor(F.ln(a) / (tolerance * (1 + 1e-9))).cast("long")
    rows = ledger.where("type IN ('card_payment', 'refund')").select(
        "client_id", "currency", cell("amount").alias("_cell"), "type", "amount", "t", F.col("fee").alias("_fee"), "timestamp"
    )
    probes = near.withColumn("_cell", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: cell("amount_median") + k)))
    hit = probes.join(rows, ["client_id", "currency", "_cell"]).where(F.abs(F.ln(F.col("amount") / F.col("amount_median"))) < tolerance)
    refund, card, age = F.col("type") == "refund", F.col("type") == "card_payment", -F.col("t")
    keys = [c for c in near.columns]
    made = hit.groupBy(*keys).agg(
        F.count_if(refund).alias("refund_count"), F.count_if(card).alias("_cards"), F.min(F.when(refund, age)).alias("_refund_age"),
        F.max(F.when(refund, (F.col("last_age") - age).between(0, grace).cast("int"))).alias("_after"),
        *[F.count_if(refund & (age < w)).alias(f"refund_count{w}") for w in windows],
        F.avg(F.when(card, (F.col("_fee") > 0).cast("double"))).alias("fee_fraction"), F.avg(F.when(card, F.col("_fee"))).alias("fee_mean"),
        F.stddev_samp(F.when(card, F.hour("timestamp"))).alias("hour_std"), F.avg(F.when(card, (F.weekday("timestamp") >= 5).cast("double"))).alias("weekend_fraction"),
    )
    return made.withColumns(
        {
            "refund_ratio": F.col("refund_count") / F.greatest(F.col("_cards"), F.lit(1)),
            "refund_last_age": F.coalesce("_refund_age", F.lit(float(NO_EVENT))),
            "refund_after_last": F.coalesce("_after", F.lit(0)),
        }
    ).drop("_cards", "_refund_age", "_after")


def minimum_next_rule(ledger: DataFrame, min_gap: float = 5, horizon: float = 90) -> DataFrame:
    """One row per client with an active stream: the one that is due first."""
    rows = amount_components(without_background(card_out(ledger)))
    w = Window.partitionBy("client_id", "currency", "comp").orderBy("t", "tx_id")
    s = rows.withColumn("gap", F.col("t") - F.lag("t").over(w)).groupBy("client_id", "currency", "comp").agg(
        F.count("*").alias("n"), F.median("gap").alias("gap_median"), F.max("t").alias("last")
    )
    live = s.where((F.col("gap_median").between(min_gap, 100)) & (-F.col("last") < 1.6 * F.col("gap_median")) & (F.col("last") + F.col("gap_median") < horizon))
    first = Window.partitionBy("client_id").orderBy(F.greatest(F.col("last") + F.col("gap_median"), F.lit(0.0)), F.desc("n"), "currency", "comp")
    return live.withColumn("k", F.row_number().over(first)).where("k = 1").select(
        "client_id", "n", F.round("gap_median", 6).alias("gap_median"), F.round(F.col("last") + F.col("gap_median"), 6).alias("next_event")
    )


RULES = {
    "most_frequent": lambda: [F.desc("count")],
    "most_recent": lambda: [F.asc("last_age")],
    "minimum_next": lambda: [F.asc(F.greatest("next_median", F.lit(0.0)))],
    "regularity": lambda: [F.asc("gap_cv")],
}


def stream_rule(streams: DataFrame, ids: DataFrame, rule: str, min_gap: float = 5, min_score: float = 0.25) -> DataFrame:
    """The family of each client's best active amount stream, else none."""
    live = streams.where(
        (F.col("group_type") == "amount") & (F.col("family_score") > min_score) & F.col("gap_median").between(min_gap, 100)
        & (F.col("last_age") < 1.6 * F.col("gap_median")) & (F.col("next_median") < 90)
    )
    w = Window.partitionBy("client_id").orderBy(*RULES[rule](), "currency", "comp")
    best = live.withColumn("k", F.row_number().over(w)).where("k = 1").select("client_id", "family")
    return ids.join(best, "client_id", "left").select("client_id", F.coalesce("family", F.lit("none")).alias("prediction"))


def diversity_rule(rollups: DataFrame, ids: DataFrame, window: int = 999) -> DataFrame:
    """The label with most code-agreeing templates, the first label on ties (or without any)."""
    d = rollups.where((F.col("scope") == "mcc") & (F.col("window") == window))
    place = F.create_map(*[x for k, f in enumerate(LABELS) for x in (F.lit(f), F.lit(-k))])
    best = d.groupBy("client_id").agg(F.max_by("family", F.struct("diversity", F.element_at(place, F.col("family")))).alias("family"))
    return ids.join(best, "client_id", "left").select("client_id", F.coalesce("family", F.lit(LABELS[0])).alias("prediction"))


def weak_labels(ledger: DataFrame, cutoff_day: float, horizon: float, min_prior: int = 3, min_gap: float = 7, max_gap: float = 100, max_cv: float = 0.4) -> DataFrame:
    """Labels from a replay at an earlier day: the family of the first future event.

    Streams chain over the whole history; only the cadence looks at the past.
    """
    from .streams import stream_stats

    members = amount_components(card_out(ledger))
    keys = ["client_id", "currency", "comp"]
    w = Window.partitionBy(*keys).orderBy("t", "tx_id")
    gap = F.col("t") - F.lag("t").over(w)
    past = F.col("t") < cutoff_day
    pace = members.withColumn("gap", gap).groupBy(*keys).agg(
        F.count_if(past).alias("prior"), F.median(F.when(past, F.col("gap"))).alias("gm"),
        divided(F.stddev_pop(F.when(past, F.col("gap"))), F.avg(F.when(past, F.col("gap")))).alias("cv"),
        F.min(F.when(~past & (F.col("t") < cutoff_day + horizon), F.col("t"))).alias("future"),
    ).where((F.col("prior") >= min_prior) & F.col("gm").between(min_gap, max_gap) & (F.col("cv") <= max_cv) & F.col("future").isNotNull())
    family = stream_stats(members, [], []).where("family_score > 0.25").select(*keys, "family")
    best = pace.join(family, keys).groupBy("client_id").agg(F.min(F.struct("future", "family")).alias("m"))
    return ledger.select("client_id").distinct().join(best, "client_id", "left").select("client_id", F.coalesce("m.family", F.lit("none")).alias("label"))


def cadence_audit(ledger: DataFrame, cutoff: str, min_events: int = 5, gaps: tuple[float, float] = (24, 35), max_cv: float = 0.25) -> DataFrame:
    """Walk-forward date forecasts of regular streams from their fourth event on.

    Absolute errors in days of: the last event plus the median gap so far, the
    same day next month, and that day rolled to a business day.
    """
    members = amount_components(without_background(card_out(ledger)))
    keys = ["client_id", "currency", "comp"]
    key = Window.partitionBy(*keys)
    w = key.orderBy("t", "tx_id")
    m = members.withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("i", F.row_number().over(w)).withColumn("prev", F.lag("timestamp").over(w))
    regular = (F.count("*").over(key) >= min_events) & (F.stddev_pop("gap").over(key) <= max_cv * F.avg("gap").over(key)) & F.median("gap").over(key).between(*gaps)
    m = m.withColumn("gm", F.percentile("gap", F.lit(0.5)).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("regular", regular)
    m = m.where(F.col("regular") & (F.col("i") >= 4))
    month = next_month(F.col("prev"))
    return m.select(
        *keys, "i", "tx_id", F.abs(F.col("gm") - F.col("gap")).alias("median_interval"),
        F.abs(day(month, cutoff) - F.col("t")).alias("same_day"), F.abs(day(business_day(month), cutoff) - F.col("t")).alias("business_day"),
    )


def document_text(ledger: DataFrame, kind: str = "normalized") -> DataFrame:
    """The client's descriptions in time order, joined by `` ; ``: ``raw``,
    ``normalized`` or ``enriched`` with code and type."""
    text = {"raw": F.col("description"), "normalized": F.col("txt"), "enriched": enriched(F.col("txt"), F.col("mcc"), F.col("type"))}[kind]
    ordered = F.sort_array(F.collect_list(F.struct("timestamp", "tx_id", text.alias("text"))))
    return ledger.groupBy("client_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ; ").alias("document"))


def row_text():
    """A ledger row as text: microseconds, amount and fee to six decimals, the rest as it is."""
    money = lambda c: F.col(c).cast("decimal(20,6)").cast("string")
    return F.concat_ws("|", F.unix_micros("timestamp").cast("string"), money("amount"), "currency", "type", "direction", "description", "mcc", money("fee"))


def fingerprints(ledger: DataFrame) -> DataFrame:
    """SHA-256 of a client's ordered rows without its id: equal histories, equal hash."""
    rows = F.sort_array(F.collect_list(row_text()))
    return ledger.groupBy("client_id").agg(F.sha2(F.array_join(rows, "\n"), 256).alias("history"))


def blocks(ledger: DataFrame) -> DataFrame:
    """The ledger's rows once for each block of the wide tabular baseline they belong to.

    Blocks are ``global``; of outgoing card payments ``card``, ``mcc<code>``,
    ``generic``, and per family ``text_<f>`` (text matches) and ``joint_<f>``
    (text and code match).
    """
    out = (F.col("type") == "card_payment") & (F.col("direction") == "out")
    names = {"card": F.lit(True), **{f"mcc{m}": F.col("mcc") == m for m in sorted(set(MCC.values()))}, "generic": F.col("txt").isin(GENERIC)}
    for f in FAMILIES:
        text = F.col("txt").rlike(PATTERNS[f])
        names |= {f"text_{f}": text, f"joint_{f}": text & (F.col("mcc") == MCC[f])}
    own = F.array_compact(F.array(F.lit("global"), *[F.when(out & c, F.lit(k)) for k, c in names.items()]))
    return ledger.withColumn("block", F.explode(own))


def block_names() -> list[str]:
    return ["global", "card", *[f"mcc{m}" for m in sorted(set(MCC.values()))], "generic", *[f"{k}_{f}" for f in FAMILIES for k in ("text", "joint")]]


def tabular(ledger: DataFrame, windows: list[int], statistics: list[str] | None = None) -> DataFrame:
    """Wide tabular baseline: a row per client with every block's summary, counts
    of the global categories, and incoming payments that match a family's text.

    Blocks are summarised in long form with one aggregation and put side by
    side over their fixed names; missing values are null, ``count`` is 0.
    """
    long = summarize(blocks(ledger), windows, ("client_id", "block"))
    stats = statistics or [c for c in long.columns if c not in ("client_id", "block")]
    cell = lambda b, c: F.max(F.when(F.col("block") == b, F.col(c)))
    wide = long.groupBy("client_id").agg(
        *[(F.coalesce(cell(b, c), F.lit(0)) if c == "count" else cell(b, c)).alias(f"{b}__{c}") for b in block_names() for c in stats]
    )
    counts = ledger.groupBy("client_id").agg(
        *[F.count_if(F.col(c) == v).alias(f"global__{c}_{v}") for c, vs in VOCABULARY.items() for v in vs],
        *[F.count_if((F.col("direction") == "in") & F.col("txt").rlike(PATTERNS[f])).alias(f"text_{f}__refund_count") for f in FAMILIES],
    )
    return wide.join(counts, "client_id")


def forecast_errors(audit: DataFrame) -> DataFrame:
    """Mean and median absolute error of each kind of date forecast."""
    kinds = ("median_interval", "same_day", "business_day")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("forecast"), F.col(k).alias("error")) for k in kinds])).alias("e")
    return audit.select(each).groupBy("e.forecast").agg(F.count("e.error").alias("n"), F.avg("e.error").alias("mean_error"), F.median("e.error").alias("median_error"))


def repeated_descriptions(ledger: DataFrame, min_count: int = 2) -> DataFrame:
    """A row per client and text that returns, with its pace and bands of it.

    Bands are numbers of right-closed bins, null outside of them.
    """
    w = Window.partitionBy("client_id", "txt").orderBy("t", "tx_id")
    s = card_out(ledger).withColumn("gap", F.col("t") - F.lag("t").over(w)).groupBy("client_id", "txt").agg(
        F.count("*").alias("count"), (-F.max("t")).alias("recency_days"), (F.max("t") - F.min("t")).alias("span_days"), F.median("gap").alias("median_interval_days"),
        F.stddev_pop("gap").alias("interval_std_days"), F.avg("amount").alias("amount_mean"), F.stddev_pop("amount").alias("amount_std"),
    ).where(F.col("count") >= min_count)
    s = s.withColumn("interval_cv", F.col("interval_std_days") / F.greatest(F.col("median_interval_days"), F.lit(0.01)))
    # Bin edges.
    bands = {
        "occurrence_band": ("count", [1, 2, 4, 8, 16, 1e18]), "recency_band": ("recency_days", [0, 15, 30, 60, 90, 180, 1e18]),
        "interval_band": ("median_interval_days", [0, 10, 20, 35, 65, 100, 200, 1e18]), "regularity_band": ("interval_cv", [-0.001, 0.1, 0.25, 0.5, 1, 1e18]),
    }
    return s.withColumns({k: right_closed(F.col(c), edges) for k, (c, edges) in bands.items()})


def labels_frame(spark) -> DataFrame:
    return spark.createDataFrame([(k, x) for k, x in enumerate(LABELS)], "family_index int, family string")


def is_background(text):
    return text.rlike(BACKGROUND)
