"""Candidate families of a client: assignment, top streams, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import FAMILIES, LABELS, MCC, NO_EVENT, PATTERNS, PERIODS, TEMPLATES
from ..functions.numeric import floor_mod, label, price_support
from .ordered import percentiles
from .streams import card_out

DESCENDING = ("count", "diversity")


def price_profiles(ledger: DataFrame) -> DataFrame:
    """Price range per family of anchor payments: raw text matches and code agrees."""
    anchors = F.array_compact(
        F.array(*[F.when(F.col("description").rlike(PATTERNS[f]) & (F.col("mcc") == MCC[f]), F.lit(f)) for f in FAMILIES])
    )
    rows = card_out(ledger).select("amount", F.explode(anchors).alias("family"))
    made = percentiles(rows, "amount", [0.005, 0.995, 0.5], ("family",)).join(rows.groupBy("family").agg(F.count("*").alias("n_anchor_events")), "family")
    return made.select("family", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), F.get("q", F.lit(2)).alias("median"), "n_anchor_events")


def wide_profiles(profiles: DataFrame) -> DataFrame:
    """The profiles as one row of maps: seven families at most, so it is broadcast."""
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct("family", c))).alias(f"p_{c}")
    return profiles.agg(entry("low"), entry("high"))


def assign_hard(streams: DataFrame) -> DataFrame:
    """``(stream, candidate)``: amount streams to their family, broad ones to theirs."""
    own = F.when(F.col("group_type") == "amount", F.col("family")).otherwise(F.replace("group_type", F.lit("family_"), F.lit("")))
    return streams.withColumn("candidate", own)


def assign_soft(streams: DataFrame, profiles: DataFrame) -> DataFrame:
    """Amount streams to every family of near-best likelihood, broad ones to theirs."""
    s = streams.join(F.broadcast(wide_profiles(profiles)), how="inner", on=F.lit(True))
    own = {
        f: (3 * F.col(f"semantic_{f}") + F.col(f"mcc_{f}") + 0.05)
        * F.coalesce(price_support(F.col("amount_median"), F.try_element_at("p_low", F.lit(f)), F.try_element_at("p_high", F.lit(f))), F.lit(0.0))
        for f in FAMILIES
    }
    best = F.greatest(*own.values())
    fits = F.array_compact(F.array(*[F.when((own[f] >= 0.4 * best) & (own[f] > 0.02), F.lit(f)) for f in FAMILIES]))
    broad = F.array(F.replace("group_type", F.lit("family_"), F.lit("")))
    made = s.withColumn("candidate", F.explode(F.when(F.col("group_type") == "amount", fits).otherwise(broad)))
    low, high = F.try_element_at("p_low", F.col("candidate")), F.try_element_at("p_high", F.col("candidate"))
    return made.withColumns(
        {"price_support": price_support(F.col("amount_median"), low, high), "normalized_price": F.try_divide(F.col("amount_median") - low, high - low), "prior_low": low, "prior_high": high}
    ).drop("p_low", "p_high")


def pick(prefix: str) -> Column:
    """The candidate's own value among the columns ``prefix.format(family)``."""
    out = F.lit(None)
    for f in FAMILIES:
        out = F.when(F.col("candidate") == f, F.col(prefix.format(f))).otherwise(out)
    return out


def top_streams(assigned: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` strongest streams per client, candidate and kind, ``rank`` from 0.

    Strength is the count, halved about every six weeks since the last event;
    ties go to the larger count, the later event, the first group.
    """
    kind = F.when(F.col("group_type") == "amount", "amount").otherwise("broad")
    other = F.greatest(*[F.when(F.col("candidate") != f, F.col(f"semantic_{f}")) for f in FAMILIES])
    s = assigned.withColumns(
        {
            "stream_count": F.count("*").over(Window.partitionBy("client_id", "candidate")), "kind": kind, "strength": F.col("count") * F.exp(-F.col("last_age") / 60), "own_semantic": pick("semantic_{}"), "own_mcc": pick("mcc_{}"),
            "own_template_diversity": pick("template_{}_diversity"), "own_template_count": pick("template_{}_count"), "other_semantic": other,
        }
    )
    w = Window.partitionBy("client_id", "candidate", "kind").orderBy(F.desc("strength"), F.desc("count"), "last_age", "currency", "comp")
    return s.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def kept_statistics(top: DataFrame) -> list[str]:
    """Numeric statistics of a stream that a candidate carries."""
    skip = ("semantic_", "mcc_", "template_")
    numeric = [f.name for f in top.schema.fields if f.dataType.typeName() in ("double", "long", "integer")]
    own = ["own_semantic", "own_mcc", "own_template_diversity", "own_template_count", "other_semantic"]
    return [c for c in numeric if not any(x in c for x in skip) and c not in ("eps", "family_score", "comp", "rank", "strength", "stream_count", "prior_low", "prior_high", *own)] + own


def candidates(ids: DataFrame) -> DataFrame:
    """Eight rows per client, in label order: the labels are a literal array."""
    labels = F.posexplode(F.array(*[F.lit(x) for x in LABELS])).alias("family_index", "family")
    return ids.select("client_id", labels).withColumn("is_none", (F.col("family") == "none").cast("int"))


def assigned_top(streams: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    return top_streams(assign_hard(streams) if profiles is None else assign_soft(streams, profiles))


def family_features(streams: DataFrame, ids: DataFrame, profiles: DataFrame | None = None, statistics: list[str] | None = None) -> DataFrame:
    """A row per client and label with its top streams' statistics side by side."""
    return wide_candidates(assigned_top(streams, profiles), ids, statistics)


def wide_candidates(top: DataFrame, ids: DataFrame, statistics: list[str] | None = None) -> DataFrame:
    """The pivot is a conditional aggregate over a fixed vocabulary: kind x rank.

    Missing values are null; the sentinel appears at the edge only.
    """
    stats = statistics or kept_statistics(top)
    slots = [(kind, r) for kind in ("amount", "broad") for r in (0, 1)]
    wide = top.groupBy("client_id", F.col("candidate").alias("family")).agg(
        F.max("stream_count").alias("stream_count"),
        *[F.expr(f"max(CASE WHEN kind = '{kind}' AND rank = {r} THEN {c} END) AS {kind}{r}_{c}") for kind, r in slots for c in stats],
    )
    return candidates(ids).join(wide, ["client_id", "family"], "left")


def place(c: str, down: bool = False) -> str:
    """Rank among the client's few candidates ``_all``, ties take the first place; null for null.

    Counting the better values needs no order, so any number of ranks share
    one list of the client's candidates instead of a sort each.
    """
    return f"if({c} IS NULL, NULL, size(filter(_all, v -> v.{c} {'>' if down else '<'} {c})) + 1)"


#: Hundreds of columns are given as SQL text: one call to the JVM each, not one for each operator.
OVER = "OVER (PARTITION BY client_id)"


def ranks(x: DataFrame, columns: list[str], missing: int | None = 8) -> DataFrame:
    """``_rank`` (nulls ``missing``) and ``_vs_best`` per client; counts and diversity descend."""
    made = []
    for c in columns:
        down = any(d in c for d in DESCENDING)
        rank = place(c, down)
        made.append(f"{rank if missing is None else f'coalesce({rank}, {missing})'} AS {c}_rank")
        made.append(f"{c} - {'max' if down else 'min'}({c}) {OVER} AS {c}_vs_best")
    return x.selectExpr("*", f"collect_list(struct({', '.join(columns)})) {OVER} AS _all").selectExpr("*", *made).drop("_all")


def competition(x: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, maximum, mean, ascending rank and distance to the minimum per client."""
    made = []
    for c in columns:
        made += [f"{f}({c}) {OVER} AS {c}_competition_{k}" for k, f in (("min", "min"), ("max", "max"), ("mean", "avg"))]
        made += [f"{place(c)} AS {c}_competition_rank", f"{c} - min({c}) {OVER} AS {c}_competition_delta"]
    return x.selectExpr("*", f"collect_list(struct({', '.join(columns)})) {OVER} AS _all").selectExpr("*", *made).drop("_all")


def activity(x: DataFrame, prefix: str) -> dict[str, Column]:
    """Active flag, next event and rounded period of a stream slot."""
    gap, count = F.col(f"{prefix}_gap_median"), F.col(f"{prefix}_count")
    near = F.array_min(F.array(*[F.struct(F.abs(gap - p).alias("d"), F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate((14, 28, 30, 60, 90))]))
    period = near["p"]
    observed = F.coalesce((count >= 2) & (gap >= 5) & (gap <= 120), F.lit(False))
    active = observed & F.coalesce(F.col(f"{prefix}_last_age") < period * 1.35, F.lit(False))
    return {
        f"{prefix}_active": active.cast("int"),
        f"{prefix}_next_active": F.when(active, floor_mod(F.col(f"{prefix}_next_median"), period)).otherwise(F.lit(float(NO_EVENT))),
        f"{prefix}_period_rounded": F.when(observed, period),
    }


def clock(x: DataFrame, prefix: str, periods: list[float] = PERIODS) -> dict[str, Column]:
    """The clock that explains phase and event density best, and what follows."""
    col = lambda c: F.col(f"{prefix}_{c}")
    gap = col("gap_median")
    fits = [
        F.struct(
            ((1 - col(f"phase_strength_{label(p)}")) + 0.8 * F.abs(F.ln(F.greatest(gap, F.lit(1.0)) / p))).alias("fit"), F.lit(k).alias("k"),
            F.lit(float(p)).alias("p"), col(f"phase_next_{label(p)}").alias("phase"), col(f"phase_strength_{label(p)}").alias("strength"),
        )
        for k, p in enumerate(periods)
    ]
    best = F.array_min(F.array(*fits))
    valid = F.coalesce((gap > 0) & (col("count") >= 3), F.lit(False))
    active = valid & F.coalesce(col("last_age") < best["p"] * 1.4, F.lit(False))
    none = F.lit(float(NO_EVENT))
    return {
        f"{prefix}_clock_period": F.when(valid, best["p"]),
        f"{prefix}_clock_next": F.when(valid, best["phase"]).otherwise(none),
        f"{prefix}_clock_active_next": F.when(active, best["phase"]).otherwise(none),
        f"{prefix}_clock_strength": F.when(valid, best["strength"]).otherwise(0.0),
        f"{prefix}_clock_active": active.cast("int"),
        f"{prefix}_next_modulo": F.when(valid, floor_mod(col("next_median"), best["p"])).otherwise(none),
    }


def template_counts(ledger: DataFrame, windows: tuple[int, ...] = (999, 90), mode: str = "strict") -> DataFrame:
    """Long evidence ``(client, family, scope, window, template, n)``; zeros are absent."""
    from ..functions.text import canonical

    rows = card_out(ledger)
    if mode == "canonical":
        rows = rows.withColumn("txt", canonical(F.col("description")))
    owners = {}
    for f, names in TEMPLATES.items():
        for name in names:
            owners.setdefault(name, []).append(f)
    pairs = F.create_map(*[x for name, fs in owners.items() for x in (F.lit(name), F.array(*map(F.lit, fs)))])
    code = F.create_map(*[F.lit(x) for kv in MCC.items() for x in kv])
    each = rows.where(F.col("txt").isin(list(owners))).select("client_id", "txt", "t", "mcc", F.explode(F.try_element_at(pairs, F.col("txt"))).alias("family"))
    coded = (F.col("family") == "none") | F.coalesce(F.try_element_at(code, F.col("family")) == F.col("mcc"), F.lit(False))
    scoped = each.withColumn("scope", F.explode(F.when(coded, F.array(F.lit("any"), F.lit("mcc"))).otherwise(F.array(F.lit("any")))))
    ranged = scoped.withColumn("window", F.explode(F.array(*map(F.lit, windows)))).where((F.col("window") == 999) | (F.col("t") >= -F.col("window")))
    return ranged.groupBy("client_id", "family", "scope", "window", F.col("txt").alias("template")).agg(F.count("*").alias("n"))


def template_rollups(counts: DataFrame) -> DataFrame:
    """Diversity, repeated, sum, max, and the counts in descending order."""
    ordered = F.sort_array(F.collect_list("n"), asc=False)
    made = counts.groupBy("client_id", "family", "scope", "window").agg(
        F.count("*").alias("diversity"), F.count_if(F.col("n") >= 2).alias("repeated"), F.sum("n").alias("sum"), F.max("n").alias("max"), ordered.alias("_o")
    )
    return made.withColumns({f"rank{r}": F.coalesce(F.get("_o", F.lit(r)), F.lit(0)) for r in range(4)}).drop("_o")


def wide_templates(rollups: DataFrame, windows: tuple[int, ...] = (999, 90)) -> DataFrame:
    """``own_template_{scope}_{window}_{roll-up}`` per client and family, missing 0."""
    stats = ["diversity", "repeated", "sum", "max", "rank0", "rank1", "rank2", "rank3"]
    return rollups.groupBy("client_id", "family").agg(
        *[
            F.expr(f"coalesce(max(CASE WHEN scope = '{s}' AND window = {w} THEN {c} END), 0) AS own_template_{s}_{w}_{c}")
            for s in ("any", "mcc") for w in windows for c in stats
        ]
    )


def template_moments(ledger: DataFrame) -> DataFrame:
    """Amounts (sample deviation) and ages of each template text, per client."""
    names = sorted({x for xs in TEMPLATES.values() for x in xs})
    return card_out(ledger).where(F.col("txt").isin(names)).groupBy("client_id", F.col("txt").alias("template")).agg(
        F.avg("amount").alias("amount_mean"), F.stddev_samp("amount").alias("amount_std"), F.max(-F.col("t")).alias("first_age"), F.min(-F.col("t")).alias("last_age")
    )


def none_aggregates(x: DataFrame) -> DataFrame:
    """Minimum, maximum and mean of every numeric candidate column per client."""
    skip = ("client_id", "family", "family_index", "is_none")
    return x.groupBy("client_id").agg(*[f(c).alias(f"{c}_{k}") for c in x.columns if c not in skip for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
