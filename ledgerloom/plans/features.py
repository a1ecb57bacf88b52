"""Feature DAG of the predictor: one call per matrix, all lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MISSING, PERIODS
from ..operators import clients, families, streams
from ..sources.stored import written

MODES = ("full", "no_unlabeled", "hard")
SLOTS = ("amount0", "amount1", "broad0", "broad1")
# Names of the statistics that candidates are compared by.
COMPETE = ["amount0_count", "amount0_gap_cv", "amount0_linear_next", "broad0_next_median", "broad0_count"]
COMPARED = ["clock_active_next", "next_modulo", "last_age", "clock_active"]
# Names of the statistics of a stream in the compact matrix.
COMPACT = [
    "count", "amount_mean", "amount_median", "amount_cv", "amount_mad", "amount_change", "first_age", "last_age", "span", "gap_median", "gap_mean", "gap_std",
    "gap_mad", "gap_cv", "gap_last", "gap_recent", "next_median", "next_recent", "linear_period", "linear_residual", "linear_next", "overdue_ratio", "own_semantic",
    "own_mcc", "own_template_diversity", "own_template_count", "other_semantic", "description_top_fraction", "generic_fraction",
]
RANKED = ["amount0_next_median", "amount0_last_age", "amount0_count", "amount0_own_template_diversity", "broad0_next_median", "broad0_count", "broad0_own_template_diversity"]
GLOBAL = ["amount0_next_active", "amount0_active", "amount0_count", "amount0_last_age", "amount0_amount_cv", "amount0_own_semantic", "broad0_active", "broad0_count", "broad0_next_active"]


def build_features(ledger: DataFrame, windows: list[int], profiles: DataFrame | None = None, min_count: int = 3) -> DataFrame:
    """Compact candidate matrix: eight rows per client, nulls for missing values.

    The top streams are written once: statistics and payment context both start from them.
    """
    ids = ledger.select("client_id").distinct()
    found = streams.extract_streams(ledger, windows, min_count=min_count, periods=[])
    stats = COMPACT + [f"count_{w}" for w in windows] + (["price_support", "normalized_price"] if profiles is not None else [])
    top = written(families.assigned_top(found, profiles), "top")
    x = families.wide_candidates(top, ids, stats)
    x = with_templates(x, ledger)
    x = families.ranks(x, RANKED)
    for prefix in ("amount0", "broad0", "amount1"):
        x = x.withColumns(families.activity(x, prefix))
        per_event = {
            f"{prefix}_{c}_per_event": F.expr(f"coalesce(greatest(double({prefix}_{c}), 0D) / greatest({prefix}_count, 1), 0D)")
            for c in ("own_semantic", "own_mcc", "own_template_diversity", "own_template_count")
        }
        x = x.withColumns(per_event)
    x = families.competition(x, GLOBAL + COMPETE[1:3])
    globals_ = clients.client_globals(ledger, windows)
    x = x.join(globals_.toDF(*[c if c == "client_id" else f"client_{c}" for c in globals_.columns]), "client_id", "left")
    slots = top.where("rank = 0 AND amount_median > 0 AND count >= 2").select(
        "client_id", F.col("candidate").alias("family"), F.concat("kind", F.lit("0")).alias("prefix"), "amount_median", "last_age"
    )
    context = clients.payment_context(ledger, slots)
    names = [c for c in context.columns if c not in ("client_id", "family", "prefix", "amount_median", "last_age", "currency")]
    wide = context.groupBy("client_id", "family").agg(
        *[F.expr(f"max(CASE WHEN prefix = '{p}' THEN {c} END) AS {p}_{c}") for p in ("amount0", "broad0") for c in names]
    )
    return x.join(wide, ["client_id", "family"], "left")


def with_templates(x: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates with their template evidence, 0 where they have none."""
    templates = families.wide_templates(families.template_rollups(families.template_counts(ledger)))
    names = [c for c in templates.columns if c not in ("client_id", "family")]
    return x.join(templates, ["client_id", "family"], "left").na.fill(0, names)


def ranking_features(ledger: DataFrame, windows: list[int], profiles: DataFrame | None = None, min_count: int = 3, clocks: bool = True) -> DataFrame:
    """Ranking matrix: every statistic of four stream slots, template evidence of the
    candidate and of none, clocks, and the comparison with the client's other candidates.
    """
    ids = ledger.select("client_id").distinct()
    found = streams.extract_streams(ledger, windows, min_count=min_count, periods=list(PERIODS) if clocks else [])
    x = with_templates(families.wide_candidates(written(families.assigned_top(found, profiles), "top"), ids), ledger)
    own = [c for c in x.columns if c.startswith("own_template_")]
    none = "max(CASE WHEN family = 'none' THEN {c} END) OVER (PARTITION BY client_id) AS global_none_{n}"
    x = x.selectExpr("*", *[none.format(c=c, n=c.removeprefix("own_template_")) for c in own])
    compared = [f"{s}_last_age" for s in SLOTS] + [c for c in own if "mcc_999" in c] + COMPETE
    if clocks:
        x = x.withColumns({k: v for s in SLOTS for k, v in families.clock(x, s).items()})
        compared = [f"{s}_{c}" for s in SLOTS for c in COMPARED] + compared[len(SLOTS) :]
    return families.competition(families.ranks(x, RANKED), compared)


def feature_bank(ledger: DataFrame, windows: list[int], profiles: DataFrame, mode: str) -> DataFrame:
    """``full`` and ``no_unlabeled`` assign softly, the latter without price columns; ``hard`` assigns hard."""
    if mode not in MODES:
        raise ValueError(mode)
    x = build_features(ledger, windows, None if mode == "hard" else profiles)
    return x.drop(*[c for c in x.columns if "price" in c or "prior" in c]) if mode == "no_unlabeled" else x


def check_features(x: DataFrame) -> None:
    """Unique, numeric columns that name neither client nor target."""
    names = [c for c in x.columns if c not in ("client_id", "family")]
    if len(names) != len(set(names)) or any("client_id" in c or "target" in c for c in names):
        raise ValueError("feature names")
    wrong = [f.name for f in x.schema.fields if f.name in names and f.dataType.typeName() not in ("double", "float", "long", "integer", "short")]
    if wrong:
        raise ValueError(f"not numeric: {wrong}")


def at_edge(x: DataFrame) -> DataFrame:
    """The sentinel for missing values, as learners expect it."""
    return x.na.fill(MISSING)


def column_subset(x: DataFrame, drop: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Ablation: columns without ``drop`` words and, if given, with a ``keep`` word."""
    names = [c for c in x.columns if c in ("client_id", "family") or (not any(d in c for d in drop) and (not keep or any(k in c for k in keep)))]
    return x.select(*names)


def union_views(views: list[DataFrame]) -> DataFrame:
    """Augmented views below each other, columns aligned, equal mass per client."""
    out = None
    for k, v in enumerate(views):
        v = v.withColumn("view", F.lit(k)).withColumn("weight", F.lit(1.0 / len(views)))
        out = v if out is None else out.unionByName(v, allowMissingColumns=True)
    return out


def project_vocabulary(x: DataFrame, columns: list[str]) -> DataFrame:
    """The training columns only; absent ones are null."""
    return x.select(*[F.col(c) if c in x.columns else F.lit(None).cast("double").alias(c) for c in columns])
