"""Queries over the test tables, by name; :mod:`ledgerloom.oracles` has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .constants import FAMILIES, LABELS, PATTERNS, PERIODS, TEST_CUTOFF, TEST_WINDOWS
from .functions import numeric, text
from .operators import audit, clients, families, invariance, noise, ordered, scoring, streams
from .plans import boosting, components, features, learning, reports
from .plans.textmodel import SublinearTfidf
from .sources import ledger as src
from .sources.stored import fresh_dir, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# Names of statistics of a stream.
CORE = [
    "count", "amount_mean", "amount_std", "amount_median", "amount_mad", "first_age", "last_age", "span", "unique_description", "description_top_fraction",
    "description_entropy", "unique_mcc", "generic_fraction", "gap_median", "gap_mean", "gap_std", "gap_mad", "gap_min", "gap_max", "gap_cv",
]
WINDOW_COLUMNS = [f"count_{w}" for w in TEST_WINDOWS]
KEY = ["client_id", "currency", "group_type", "comp"]


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def led(spark: SparkSession, d: str) -> DataFrame:
    return src.events_ledger(spark, d)


def tab(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def out(df: DataFrame, *columns: str, rounded: bool = True) -> DataFrame:
    """The columns, counts as long and doubles to six places, or as they are.

    Spark rounds the decimal text of a double: one just below a five that prints as the five goes up.
    """
    kinds = dict(df.dtypes)
    shown = dict.fromkeys(("double", "float"), "round(`{c}`, 6) + 0.0D AS `{c}`" if rounded else "`{c}` + 0.0D AS `{c}`")
    shown |= {k: "CAST(`{c}` AS BIGINT) AS `{c}`" for k in ("int", "bigint", "smallint", "tinyint")}
    return df.selectExpr(*[shown.get(kinds[c], "`{c}`").format(c=c) for c in (columns or df.columns)])


def ids(df: DataFrame) -> DataFrame:
    return df.select("client_id").distinct()


def amount_members(spark, d):
    return streams.amount_components(streams.card_out(led(spark, d)))


def found(spark, d, periods=()):
    return streams.extract_streams(led(spark, d), TEST_WINDOWS, periods=list(periods))


@query
def flagship_minimum_next(spark, d):
    return out(clients.minimum_next_rule(led(spark, d), min_gap=1))


@query
def card_out_filter(spark, d):
    return streams.without_background(streams.card_out(led(spark, d))).select("tx_id", "client_id", "txt")


@query
def canonical_violations(spark, d):
    return out(src.violations(led(spark, d), "2024-01-25 00:00:00"))


@query
def text_normalize(spark, d):
    return led(spark, d).select("tx_id", "txt")


@query
def text_canonical(spark, d):
    return led(spark, d).select("tx_id", text.canonical(F.col("description")).alias("canonical"))


@query
def semantic_flags(spark, d):
    return led(spark, d).groupBy("txt").agg(F.count("*").alias("n")).select("txt", "n", *[F.col("txt").rlike(PATTERNS[f]).alias(f"is_{f}") for f in FAMILIES])


@query
def tokens_by_class(spark, d):
    words = led(spark, d).select("client_id", "type", F.explode(F.array_distinct(text.tokens(text.letters(F.col("description"))))).alias("token"))
    return out(audit.conditional(words, "client_id", "type", "token"), "type", "token", "n", "p")


@query
def word_ngrams(spark, d):
    w = text.tokens(F.col("txt"))
    grams = led(spark, d).select(F.explode(F.concat(text.ngrams(w, 1), text.ngrams(w, 2), text.ngrams(w, 3))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query
def enriched_tokens(spark, d):
    return led(spark, d).select("tx_id", text.enriched(F.col("txt"), F.col("mcc"), F.col("type")).alias("token"))


@query
def client_globals(spark, d):
    return out(clients.client_globals(led(spark, d), TEST_WINDOWS, {"type": ["card_payment", "refund", "topup"], "currency": ["chf", "eur"], "mcc": noise.merchant_codes()}))


@query
def type_crosstab(spark, d):
    return audit.crosstab(led(spark, d), "client_id", "type", ["card_payment", "refund", "topup", "atm"])


@query
def conditional_probability(spark, d):
    return out(audit.conditional(led(spark, d), "client_id", "mcc", "type"))


@query
def value_counts_topk(spark, d):
    return audit.value_counts(led(spark, d), "txt", 20)


@query
def describe_by_type(spark, d):
    return out(audit.describe(led(spark, d), "amount", ["type"]))


@query
def mode_mcc(spark, d):
    return audit.mode(led(spark, d), "mcc", ["client_id"])


@query
def string_agg_docs(spark, d):
    return clients.document_text(led(spark, d))


@query
def history_fingerprint(spark, d):
    return clients.fingerprints(led(spark, d))


@query
def gap_stats(spark, d):
    w = Window.partitionBy("client_id").orderBy("t", "tx_id")
    g = led(spark, d).withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("m", F.median("gap").over(Window.partitionBy("client_id")))
    made = g.groupBy("client_id").agg(F.count("gap").alias("n"), F.first("m").alias("gap_median"), F.median(F.abs(F.col("gap") - F.col("m"))).alias("gap_mad"), F.stddev_pop("gap").alias("gap_std"))
    return out(made)


@query
def amount_components(spark, d):
    m = amount_members(spark, d)
    return out(m.groupBy("client_id", "currency").agg(F.count("*").alias("n"), F.count_distinct("comp").alias("components"), F.sum("tx_id").alias("id_sum")))


@query
def amount_pairs(spark, d):
    m = streams.amount_components(streams.card_out(led(spark, d)), min_count=2)
    return m.groupBy("client_id", "currency", "comp").agg(F.count("*").alias("n"), F.min("tx_id").alias("first_id")).drop("comp")


@query
def stream_stats_core(spark, d):
    return out(found(spark, d), *KEY, *CORE, *WINDOW_COLUMNS, "family", "family_score")


@query
def stream_circular(spark, d):
    return out(found(spark, d, PERIODS), *KEY, *[f"phase_{k}_{numeric.label(p)}" for p in PERIODS for k in ("strength", "next")])


@query
def stream_ols(spark, d):
    x = found(spark, d).withColumn("linear_residual", F.round("linear_residual", 4))
    return out(x, *KEY, "linear_period", "linear_residual", "linear_next")


@query
def cadence_error(spark, d):
    return out(found(spark, d, PERIODS), *KEY, *[f"period_error_{numeric.label(p)}" for p in PERIODS], rounded=False)


@query
def recent_gap_median(spark, d):
    return out(found(spark, d), *KEY, "gap_last", "gap_recent", "next_median", "next_recent", "next_last", "overdue_ratio")


@query
def amount_change(spark, d):
    return out(found(spark, d), *KEY, "amount_change")


@query
def broad_streams(spark, d):
    m = streams.broad_members(streams.card_out(led(spark, d)))
    return m.groupBy("client_id", "currency", "group_type").agg(F.count("*").alias("n"), F.sum("tx_id").alias("id_sum"))


@query
def summary_block(spark, d):
    columns = ["count", "amount_median", "amount_cv", "unique_description", "description_entropy", "unique_currency", "fee_fraction", "dom_std", "month_count", "gap_median", "gap_mad", "next_median", "gap_last", "period_error_7"]
    return out(clients.summarize(led(spark, d), TEST_WINDOWS, ("client_id", "mcc")), "client_id", "mcc", *columns)


@query
def price_profiles(spark, d):
    return out(families.price_profiles(led(spark, d)))


@query
def price_support(spark, d):
    p = families.price_profiles(led(spark, d))
    m = streams.card_out(led(spark, d)).join(F.broadcast(p), how="inner", on=F.lit(True))
    return out(m.select("tx_id", "family", numeric.price_support(F.col("amount"), F.col("low"), F.col("high")).alias("support")))


@query
def soft_assignment(spark, d):
    s = families.assign_soft(found(spark, d), families.price_profiles(led(spark, d)))
    return out(s.groupBy("client_id", "candidate").agg(F.count("*").alias("n"), F.max("price_support").alias("support")))


@query
def hard_assignment(spark, d):
    return families.assign_hard(found(spark, d)).groupBy("client_id", "candidate").agg(F.count("*").alias("n"))


@query
def top2_streams(spark, d):
    t = families.top_streams(families.assign_hard(found(spark, d)))
    return out(t, "client_id", "candidate", "kind", "rank", "count", "last_age", "own_semantic", "own_mcc", "own_template_diversity", "other_semantic")


def family_matrix(spark, d, periods=()):
    source = led(spark, d)
    stats = ["count", "last_age", "next_median", "gap_median", "gap_cv", "linear_next", "own_template_diversity"]
    stats += [f"phase_{k}_{numeric.label(p)}" for p in periods for k in ("strength", "next")]
    stats += ["own_semantic"]
    return families.family_features(streams.extract_streams(source, TEST_WINDOWS, periods=list(periods)), ids(source), None, stats)


@query
def family_ranks(spark, d):
    x = families.ranks(family_matrix(spark, d).where("family <> 'none'"), ["amount0_next_median", "amount0_count", "broad0_count"])
    return out(x, "client_id", "family", *[f"{c}_{k}" for c in ("amount0_next_median", "amount0_count", "broad0_count") for k in ("rank", "vs_best")], rounded=False)


@query
def candidate_frame(spark, d):
    return out(families.candidates(ids(led(spark, d))))


@query
def competition_features(spark, d):
    x = families.competition(family_matrix(spark, d), ["broad0_count"])
    return out(x, "client_id", "family", *[f"broad0_count_competition_{k}" for k in ("min", "max", "mean", "rank", "delta")])


@query
def template_counts(spark, d):
    return out(families.template_counts(led(spark, d), (999, 14)))


@query
def template_rollups(spark, d):
    return out(families.template_rollups(families.template_counts(led(spark, d), (999, 14))))


@query
def template_moments(spark, d):
    return out(families.template_moments(led(spark, d)))


@query
def compact_activity(spark, d):
    x = family_matrix(spark, d)
    made = {k.replace("broad0_", ""): v for k, v in families.activity(x, "broad0").items()}
    return out(x.select("client_id", "family", *[v.alias(k) for k, v in made.items()]))


@query
def clock_selection(spark, d):
    x = family_matrix(spark, d, PERIODS)
    made = {k: v for s in features.SLOTS for k, v in families.clock(x, s).items()}
    return out(x.select("client_id", "family", *[v.alias(k) for k, v in made.items()]), rounded=False)


def slots(spark, d):
    s = found(spark, d).where("group_type LIKE 'family_%' AND count >= 2")
    return s.select("client_id", F.replace("group_type", F.lit("family_"), F.lit("")).alias("family"), F.col("currency").alias("prefix"), "amount_median", "last_age")


@query
def refund_match(spark, d):
    c = clients.payment_context(led(spark, d), slots(spark, d), (21, 7), tolerance=0.4)
    return out(c, "client_id", "family", "prefix", "refund_count", "refund_ratio", "refund_last_age", "refund_after_last", "refund_count21", "refund_count7")


@query
def payment_context(spark, d):
    c = clients.payment_context(led(spark, d), slots(spark, d), (21, 7), tolerance=0.4)
    return out(c, "client_id", "family", "prefix", "fee_fraction", "fee_mean", "hour_std", "weekend_fraction", "last_fee")


@query
def none_aggregates(spark, d):
    return out(families.none_aggregates(family_matrix(spark, d).select("client_id", "family", "stream_count", "broad0_count")))


@query
def feature_matrix(spark, d):
    return out(features.build_features(led(spark, d), TEST_WINDOWS, families.price_profiles(led(spark, d))))


@query
def rule_template_diversity(spark, d):
    source = led(spark, d)
    return clients.diversity_rule(families.template_rollups(families.template_counts(source)), ids(source))


def _rule(name):
    def run(spark, d):
        return clients.stream_rule(found(spark, d), ids(led(spark, d)), name, min_gap=1)

    QUERIES[f"rule_{name}"] = run


for _name in clients.RULES:
    _rule(_name)


@query
def weak_labels(spark, d):
    return clients.weak_labels(led(spark, d), cutoff_day=-12.0, horizon=12.0, min_gap=0.5, max_cv=5.0)


@query
def cadence_audit(spark, d):
    return out(clients.cadence_audit(led(spark, d), TEST_CUTOFF, min_events=5, gaps=(0.1, 35), max_cv=9.0), rounded=False)


def _halves(spark, d):
    x = led(spark, d)
    return x.where("t < -15"), x.where("t >= -15")


@query
def split_overlap(spark, d):
    a, b = _halves(spark, d)
    return out(audit.overlap(a, b, "description"))


@query
def unseen_vocab_rate(spark, d):
    a, b = _halves(spark, d)
    return out(audit.unseen_rate(a, b, "description"))


@query
def duplicate_rows(spark, d):
    return audit.duplicates(tab(spark, d, "orders"), ["o_custkey", "o_orderdate"])


@query
def union_minus_intersection(spark, d):
    a, b = (x.select("description").distinct() for x in _halves(spark, d))
    return a.unionByName(b).distinct().exceptAll(a.intersect(b))


def truth_pairs(spark, d):
    x = tab(spark, d, "labels").select(F.col("doc_id").alias("client_id"), F.col("quality").cast("string").alias("truth"), F.col("toxic").cast("string").alias("prediction"))
    return x, spark.createDataFrame([("0",), ("1",), ("2",)], "label string")


@query
def confusion_matrix(spark, d):
    return out(scoring.confusion(*truth_pairs(spark, d)))


@query
def per_class_f1(spark, d):
    return out(scoring.per_class(scoring.confusion(*truth_pairs(spark, d))), "label", "support", "predicted", "precision", "recall", "f1")


@query
def macro_scores(spark, d):
    return out(scoring.scores(scoring.confusion(*truth_pairs(spark, d))))


def probabilities(spark, d):
    """A probability table from the family matrix: softmax of stream counts."""
    x = family_matrix(spark, d).withColumn("score", F.coalesce("stream_count", F.lit(0)) / 4.0)
    return x.withColumn("p", numeric.softmax(F.col("score"), Window.partitionBy("client_id"))).withColumn("truth", label_of(1)).select("client_id", "family", "family_index", "p", "truth")


def number():
    return F.substring("client_id", 2, 10).cast("long")


def label_of(step: int):
    """A label for each client: the eight in turn, ``step`` at a time."""
    return F.element_at(F.array(*map(F.lit, LABELS)), (number() * step % 8 + 1).cast("int"))


@query
def prob_losses(spark, d):
    return out(scoring.probability_losses(probabilities(spark, d)))


@query
def calibration_bins(spark, d):
    return out(scoring.calibration(scoring.decide(probabilities(spark, d)).withColumn("truth", label_of(1))))


@query
def calibration_error(spark, d):
    return out(scoring.expected_calibration_error(scoring.calibration(scoring.decide(probabilities(spark, d)).withColumn("truth", label_of(1)))))


@query
def softmax_none_substitution(spark, d):
    w = Window.partitionBy("client_id")
    p = probabilities(spark, d)
    q = numeric.substitute_none(F.col("p"), F.lit(0.3), F.col("family") == "none", w)
    p = p.withColumn("q", q).withColumn("biased", numeric.biased(F.col("p"), -0.1 * F.col("family_index"), w))
    return out(p, "client_id", "family", "p", "q", "biased")


@query
def laplace_prior(spark, d):
    pairs, classes = truth_pairs(spark, d)
    return out(scoring.prior(pairs, classes))


@query
def submission_check(spark, d):
    sample = tab(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("client_id"), "c_custkey")
    sent = sample.where("c_custkey % 50 <> 0").select("client_id", F.when(F.col("c_custkey") % 7 == 0, "bad").otherwise("none").alias("predicted_next_recurring_merchant"))
    bad = spark.createDataFrame([("", "none"), (" C2", "none"), (None, "cloud")], sent.schema)
    return out(scoring.inspect_submission(sent.unionByName(sent.where("client_id = 'C1'")).unionByName(bad), sample.select("client_id")))


@query
def exact_cover(spark, d):
    return out(scoring.set_report(tab(spark, d, "customer").select(F.col("c_custkey").alias("client_id")), tab(spark, d, "orders").select(F.col("o_custkey").alias("client_id"))))


@query
def cohort_errors(spark, d):
    x, _ = truth_pairs(spark, d)
    x = audit.many_to_one(x, tab(spark, d, "documents").select(F.col("doc_id").alias("client_id"), "lang", "n_chars"), "client_id")
    return out(scoring.cohorts(x, {"english": F.col("lang") == "en", "long": F.col("n_chars") > 2000, "all": F.lit(True)}))


@query
def amount_bands(spark, d):
    edges = [0, 5, 10, 20, 50, 100, 200, 500, 1000, 10000]
    return led(spark, d).groupBy(numeric.right_closed(F.col("amount"), edges, lowest=True).cast("long").alias("band")).agg(F.count("*").alias("n"), F.min("tx_id").alias("first_id"))


@query
def qcut_chi2(spark, d):
    x = audit.quartiles(led(spark, d).withColumn("suffix", F.substring("client_id", 2, 10).cast("double")), "suffix")
    return out(audit.chi_square(x, "bin", "type"))


@query
def rank_auc(spark, d):
    x = tab(spark, d, "labels").join(tab(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return out(audit.auc(x, "n_chars", "quality"))


@query
def calendar_parts(spark, d):
    ts = F.col("timestamp")
    made = led(spark, d).select(
        "tx_id", F.hour(ts).alias("h"), F.minute(ts).alias("mi"), F.weekday(ts).alias("wd"), F.dayofmonth(ts).alias("dom"), F.date_format(ts, "yyyy-MM").alias("ym"),
        F.date_format(numeric.next_month(ts), "yyyy-MM-dd HH:mm:ss").alias("nm"), F.date_format(numeric.business_day(ts), "yyyy-MM-dd HH:mm:ss").alias("bd"),
    )
    return out(made)


@query
def orders_by_priority_cube(spark, d):
    o = tab(spark, d, "orders")
    return out(o.cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))


@query
def order_streams(spark, d):
    o = tab(spark, d, "orders").select(F.col("o_custkey").alias("client_id"), F.lit("chf").alias("currency"), F.col("o_orderkey").alias("tx_id"), F.col("o_totalprice").alias("amount"))
    return streams.amount_components(o, min_count=2).groupBy("client_id").agg(F.count("*").alias("n"), F.count_distinct("comp").alias("components"))


@query
def html_links(spark, d):
    return src.links(tab(spark, d, "pages")).groupBy("href").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


@query
def fold_assignment(spark, d):
    labels = tab(spark, d, "labels")
    return audit.stratified_folds(labels, "quality", "doc_id").groupBy("quality", "fold").agg(F.count("*").alias("n"))


@query
def masked_view(spark, d):
    return noise.mask_descriptions(led(spark, d), 0.3, 7).groupBy("type").agg(F.count("*").alias("n"), F.count_if("masked").alias("masked"))


@query
def corrupted_view(spark, d):
    return noise.corruption_view(led(spark, d), "valid_like").groupBy("mcc").agg(F.count("*").alias("n"))


@query
def bootstrap_ci(spark, d):
    x, _ = truth_pairs(spark, d)
    x = x.withColumn("rival", (F.col("client_id") % 2).cast("string"))
    return out(scoring.intervals(scoring.bootstrap(x, 2000, 20260925, ["0", "1", "2"], "rival")))


RANK_FEATURES = ["stream_count", "broad0_count", "broad0_gap_median", "family_index"]


def ranking_rows(spark, d):
    """Candidates with the weak label of their client."""
    labels = weak_labels(spark, d)
    return family_matrix(spark, d).join(labels, "client_id").withColumn("label", (F.col("family") == F.col("label")).cast("double"))


def _first_gains(spark, d, settings):
    x = written(ranking_rows(spark, d).select("client_id", "label", *RANK_FEATURES), "candidates")
    cuts = boosting.fit_cuts(x, RANK_FEATURES, settings.bins)
    rows = boosting.unscored(boosting.training_rows(x, RANK_FEATURES, cuts, "label", ["client_id"], "family_index"), settings)
    gains = boosting.split_gains(boosting.histogram(rows, settings, len(RANK_FEATURES), {}, [1], [], 0), settings)
    return out(gains.withColumn("feature", F.element_at(F.array(*map(F.lit, RANK_FEATURES)), (F.col("feature") + 1).cast("int"))), *"feature bin gain g h n gl hl nl".split())


@query
def listwise_round(spark, d):
    """All splits of the first listwise tree's root: bins, lambdas, gains."""
    return _first_gains(spark, d, boosting.Boosting(bins=16, min_rows=5))


@query
def pairwise_round(spark, d):
    """All splits of the first pairwise tree's root."""
    return _first_gains(spark, d, boosting.Boosting("pairwise", bins=16, min_rows=1, min_hessian=10.0))


@query
def gbt_ranker(spark, d):
    x = ranking_rows(spark, d).drop("is_none").na.fill(-999)
    settings = boosting.Boosting(rounds=5, min_rows=20, learning_rate=0.2)
    model = boosting.fit(x, [c for c in learning.feature_columns(x)], "label", ["client_id"], "family_index", settings)
    return learning.candidate_scores(model, x)


@query
def target_encoding(spark, d):
    x = tab(spark, d, "labels").join(tab(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    made = boosting.target_statistics(x.select("doc_id", "lang", "quality"), "lang", "quality", 2, ["doc_id"], seed=42, rows=100)
    return made.select("doc_id", "lang_ts_0", "lang_ts_1")  # exact fractions: rounding would part ties


@query
def symmetric_scores(spark, d):
    """Quality of documents by symmetric trees, scored by an expression."""
    x = tab(spark, d, "labels").join(tab(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id").withColumn("place", F.lit(0))
    for c in ("lang", "source"):
        x = boosting.target_statistics(x, c, "quality", 2, ["doc_id"])
    columns = ["n_chars", *[f"{c}_ts_{k}" for c in ("lang", "source") for k in (0, 1)]]
    settings = learning.replace(boosting.SYMMETRIC, rounds=5, classes=2, learning_rate=0.3)
    model = boosting.fit(x, columns, "quality", ["doc_id"], "place", settings)
    s = boosting.symmetric_scores(model)
    return out(x.select("doc_id", "quality", F.get(s, F.lit(0)).alias("score_0"), F.get(s, F.lit(1)).alias("score_1")))


@query
def bias_trials(spark, d):
    """Macro-F1 of every first step of the bias search, over two probability sets."""
    p = QUERIES["ensemble"](spark, d)
    rival = QUERIES["raw_ensemble"](spark, d)
    truth = ids(led(spark, d)).withColumn("truth", label_of(3))
    trials = [learning.centred([0.0] * len(LABELS), k, step) for k in range(len(LABELS)) for step in (-0.2, 0.2)]
    return out(learning.bias_scores(learning.log_probabilities([p, rival], truth), trials))


def _client_statistics(ledger):
    """What the invariance queries watch: exact numbers, so that no order of sums shows."""
    return ledger.groupBy("client_id").agg(
        F.count("*").alias("n"), F.max("amount").alias("largest"), F.min("t").alias("first"), F.count_distinct("mcc").alias("codes"), F.sum((F.col("fee") > 0).cast("long")).alias("fees")
    )


@query
def invariance_rename(spark, d):
    """Other names and another order of rows change nothing."""
    x = led(spark, d).select("client_id", "amount", "t", "mcc", "fee")
    return invariance.changes(_client_statistics(x), invariance.renamed_back(_client_statistics, x, "client_id"), ["client_id"])


@query
def invariance_shuffle(spark, d):
    """Features of candidates from shuffled rows, against those from rows as they are."""
    x = led(spark, d)
    make = lambda rows: out(families.template_rollups(families.template_counts(rows, (999, 14))))
    return invariance.changes(make(x), make(x.repartition(7, F.md5(F.col("tx_id").cast("string")))), ["client_id", "family", "scope", "window"])


@query
def invariance_poison(spark, d):
    """Poisoned rows of some clients change these clients' statistics and no other's."""
    x = led(spark, d).select("client_id", "amount", "t", "mcc", "fee")
    hit = number() % 10 == 3
    poisoned = x.withColumn("amount", F.when(hit, F.col("amount") * 2).otherwise(F.col("amount"))).withColumn("fee", F.when(hit, F.lit(1.0)).otherwise(F.col("fee")))
    return invariance.changes(_client_statistics(x), _client_statistics(poisoned), ["client_id"])


@query
def semi_filter(spark, d):
    return audit.semi(led(spark, d), led(spark, d).where("type = 'refund'"), "client_id").select("tx_id", "client_id")


@query
def derived_keys(spark, d):
    keys = [F.concat_ws(" | ", a, "mcc").alias(k) for k, a in (("description_mcc", "txt"), ("type_mcc", "type"))]
    return led(spark, d).groupBy(*keys).agg(F.count("*").alias("n"))


@query
def renamed_clients(spark, d):
    names = ids(led(spark, d)).where(number() % 2 == 0).withColumn("new", F.concat(F.lit("R"), F.reverse("client_id")))
    return audit.renamed(led(spark, d).select("client_id", "tx_id"), names, "client_id", "new")


@query
def describe_all(spark, d):
    return out(audit.describe(led(spark, d), "amount", percentiles=(1, 10, 50, 90, 99)))


@query
def grouped_report(spark, d):
    return out(audit.grouped_report(found(spark, d), "family", ["count", "last_age", "span", "gap_median", "gap_cv"]))


@query
def forecast_errors(spark, d):
    return out(clients.forecast_errors(clients.cadence_audit(led(spark, d), TEST_CUTOFF, min_events=5, gaps=(0.1, 35), max_cv=9.0)))


@query
def unstacked_families(spark, d):
    return out(audit.unstack(family_matrix(spark, d), "client_id", "family", LABELS, ["stream_count", "broad0_count"]))


@query
def date_parts(spark, d):
    parts = {"s": F.second, "mi": F.minute, "h": F.hour, "day": F.dayofmonth, "month": F.month, "wd": F.weekday}
    return out(led(spark, d).select("tx_id", *[f("timestamp").alias(k) for k, f in parts.items()], F.unix_micros(F.col("timestamp") + F.expr("INTERVAL 92 DAYS")).alias("shifted")))


@query
def repeated_texts(spark, d):
    return out(clients.repeated_descriptions(led(spark, d)))


@query
def row_json(spark, d):
    return led(spark, d).select("tx_id", F.to_json(F.struct("client_id", "type", "mcc", "txt")).alias("json"))


@query
def json_rows_parsed(spark, d):
    """The ledger through JSON and back."""
    x = led(spark, d).select("tx_id", "client_id", "timestamp", "amount", "type", "mcc", "description", "fee")
    back = src.from_json_rows(src.to_json_rows(x, "tx_id"), "tx_id", x.schema)
    return back.withColumn("timestamp", F.unix_micros("timestamp")).withColumnRenamed("timestamp", "at_us")


@query
def first_rows(spark, d):
    return audit.first_rows(led(spark, d).select("client_id", "timestamp", "tx_id", "txt", "amount"), "client_id", ["timestamp", "tx_id"]).drop("timestamp")


@query
def total_order(spark, d):
    x = ordered.numbered(led(spark, d), ["timestamp", "client_id", "amount", "tx_id"], rows=2000)
    return out(x.select("tx_id", F.col("_n").alias("position")))


@query
def recipe_selection(spark, d):
    """Rules as recipes: their macro-F1 against the weak labels decides, then their place."""
    labels = weak_labels(spark, d).withColumnRenamed("label", "truth")
    classes = spark.createDataFrame([(x,) for x in LABELS], "label string")
    tried = None
    for k, name in enumerate(("most_frequent", "most_recent", "minimum_next", "regularity")):
        pairs = QUERIES[f"rule_{name}"](spark, d).join(labels, "client_id")
        row = scoring.scores(scoring.confusion(pairs, classes)).select(F.lit(name).alias("recipe"), F.round("macro_f1", 9).alias("score"), F.lit(1 + k % 2).alias("complexity"), F.lit(k).alias("position"))
        tried = row if tried is None else tried.unionByName(row)
    return out(learning.select_recipe(tried))


@query
def best_examples(spark, d):
    x, _ = truth_pairs(spark, d)
    return out(scoring.best_examples(x.withColumn("confidence", (F.col("client_id") * 37 % 100) / 100)))


@query
def top_confusions(spark, d):
    return audit.top_confusions(truth_pairs(spark, d)[0])


@query
def client_sample(spark, d):
    return audit.sample_clients(led(spark, d), "client_id", 20, 7)


@query
def fold_membership(spark, d):
    return out(audit.stratified_folds(tab(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id"))


@query
def permuted_labels(spark, d):
    return out(audit.permuted(tab(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", 5))


@query
def masked_rows(spark, d):
    return noise.mask_descriptions(led(spark, d), 0.3, 7).select("tx_id", "description", "masked")


def _corrupted(scenario):
    def run(spark, d):
        return noise.corruption_view(led(spark, d), scenario).select("tx_id", "description", "mcc")

    QUERIES[f"corrupted_rows_{scenario}"] = run


for _scenario in ("valid_like", "test_like"):
    _corrupted(_scenario)


@query
def ensemble(spark, d):
    x = family_matrix(spark, d)
    score = lambda c, k, s: x.select("client_id", "family", "family_index", (F.coalesce(c, F.lit(0)) / k).alias("score"), F.lit(s).alias("seed"))
    who = ids(led(spark, d))
    none = who.select("client_id", F.lit(1).alias("seed"), (number() % 10 / 20 + 0.1).alias("p_none")).unionByName(who.select("client_id", F.lit(2).alias("seed"), F.lit(0.3).alias("p_none")))
    prior = spark.createDataFrame([(x, (k + 1) / 36) for k, x in enumerate(LABELS)], "label string, prior double")
    p = scoring.combine(score("stream_count", 4.0, 1).unionByName(score("broad0_count", 4.0, 2)), none, 1.5, score("broad0_count", 8.0, 0), 0.25, prior, 0.25)
    return out(p)


@query
def raw_ensemble(spark, d):
    x = family_matrix(spark, d)
    score = lambda c, k, s: x.select("client_id", "family", "family_index", (F.coalesce(c, F.lit(0)) / k).alias("score"), F.lit(s).alias("seed"))
    return out(scoring.combine(score("stream_count", 4.0, 1).unionByName(score("broad0_count", 4.0, 2)), None, 1.5, score("broad0_count", 8.0, 0), 0.5, raw=True))


@query
def rank_auc_by_language(spark, d):
    x = tab(spark, d, "labels").join(tab(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return out(audit.auc(x, "n_chars", "quality", by=("lang",)))


@query
def split_profile(spark, d):
    return out(audit.profile(led(spark, d)))


def mean_of_cents(column):
    """A mean at four places.  Means of few amounts in cents often end in a five
    behind them; a little on top rounds all of these up everywhere."""
    return F.round(F.col(column) + 1e-9, 4)


@query
def description_structure(spark, d):
    x = audit.describe(led(spark, d), "amount", ["txt", "mcc", "type", "direction"], (50,))
    return out(x.withColumn("mean", mean_of_cents("mean")))


@query
def official_score(spark, d):
    who = ids(led(spark, d))
    labels = who.withColumn("target_next_recurring_merchant", label_of(1))
    said = who.withColumn("predicted_next_recurring_merchant", F.when(number() % 3 == 0, label_of(1)).otherwise(label_of(5)))
    return out(scoring.score_predictions(labels, said, spark))


@query
def aligned_targets(spark, d):
    who = ids(led(spark, d))
    return out(scoring.align_targets(who.withColumn("target_next_recurring_merchant", label_of(3)), who))


@query
def sample_order(spark, d):
    who = ids(led(spark, d))
    sample = who.withColumn("position", (number() * 7919) % 100_003)
    return out(scoring.in_sample_order(who.withColumn("prediction", label_of(1)), sample, "position"))


@query
def documents_raw(spark, d):
    return clients.document_text(led(spark, d), "raw")


@query
def documents_enriched(spark, d):
    return clients.document_text(led(spark, d), "enriched")


@query
def tfidf_weights(spark, d):
    return out(learning.tfidf(clients.document_text(led(spark, d))))


@query
def tfidf_characters(spark, d):
    return out(learning.tfidf(clients.document_text(led(spark, d)), "char"))


@query
def tabular_blocks(spark, d):
    columns = ["count", "amount_mean", "amount_std", "amount_min", "amount_max", "amount_median", "first_age", "last_age", "span", "unique_mcc", "gap_mean", "gap_max", "period_error_30"]
    x = clients.summarize(clients.blocks(led(spark, d)), TEST_WINDOWS, ("client_id", "block")).withColumn("amount_mean", mean_of_cents("amount_mean"))
    return out(x, "client_id", "block", *columns)


@query
def tabular_wide(spark, d):
    return out(clients.tabular(led(spark, d), TEST_WINDOWS, ["count", "amount_median", "gap_median"]))


@query
def edge_values(spark, d):
    x = features.at_edge(family_matrix(spark, d)).select("client_id", "family", "amount0_count", "broad0_gap_median")
    return out(x.withColumn("broad0_gap_known", F.nullif("broad0_gap_median", F.lit(-999.0))), rounded=False)


@query
def ablation_columns(spark, d):
    x = features.column_subset(family_matrix(spark, d), drop=("gap", "phase", "own", "linear", "next", "index", "none"), keep=("count", "age"))
    return out(features.project_vocabulary(x, ["client_id", "family", "stream_count", "broad0_count", "broad1_last_age", "unknown"]))


@query
def view_union(spark, d):
    a = family_matrix(spark, d).select("client_id", "family", "stream_count", "broad0_count")
    return out(features.union_views([a, a.drop("broad0_count")]))


@query
def page_words(spark, d):
    return src.page_words(tab(spark, d, "pages"))


def matrix(spark, d):
    return features.build_features(led(spark, d), TEST_WINDOWS, families.price_profiles(led(spark, d)))


MATRIX_STATS = [*features.COMPACT, *WINDOW_COLUMNS, "price_support", "normalized_price"]


def _matrix(name, columns):
    def run(spark, d):
        x = matrix(spark, d)
        x = x.withColumns({c: F.round(c, 4) for c in x.columns if c.endswith("linear_residual")})
        return out(x, "client_id", "family", *columns, rounded=False)

    QUERIES[f"matrix_{name}"] = run


for _slot in ("amount0", "amount1", "broad0", "broad1"):
    _matrix(_slot, [f"{_slot}_{c}" for c in MATRIX_STATS])
TEMPLATE_STATS = [f"{s}_{w}_{c}" for s in ("any", "mcc") for w in (999, 90) for c in ("diversity", "repeated", "sum", "max", "rank0", "rank1", "rank2", "rank3")]
_matrix("templates", ["stream_count", *[f"own_template_{c}" for c in TEMPLATE_STATS]])
_matrix("ranks", [f"{c}_{k}" for c in features.RANKED for k in ("rank", "vs_best")])
_matrix(
    "activity",
    [f"{p}_{c}" for p in ("amount0", "broad0", "amount1") for c in ("active", "next_active", "period_rounded", *(f"{x}_per_event" for x in ("own_semantic", "own_mcc", "own_template_diversity", "own_template_count")))],
)
_matrix("competition", [f"{c}_competition_{k}" for c in features.GLOBAL + features.COMPETE[1:3] for k in ("min", "max", "mean", "rank", "delta")])
_matrix("globals", ["client_total_count", "client_amount_mean", "client_amount_std", "client_first_age", "client_last_age", *[f"client_{c}_{v}" for c, vs in clients.VOCABULARY.items() for v in vs], *[f"client_{c}" for c in WINDOW_COLUMNS]])
CONTEXT = ["last_fee", "refund_count", "refund_count90", "refund_count30", "fee_fraction", "fee_mean", "hour_std", "weekend_fraction", "refund_ratio", "refund_last_age", "refund_after_last"]
_matrix("context", [f"{p}_{c}" for p in ("amount0", "broad0") for c in CONTEXT])
RANKING = [f"{s}_{c}" for s in features.SLOTS for c in features.COMPARED] + [f"own_template_{c}" for c in TEMPLATE_STATS if c.startswith("mcc_999")] + features.COMPETE


@query
def ranking_matrix(spark, d):
    x = features.ranking_features(led(spark, d), TEST_WINDOWS, families.price_profiles(led(spark, d)))
    clocks = [f"{s}_{c}" for s in features.SLOTS for c in ("clock_period", "clock_next", "clock_strength", "clock_active", "next_modulo")]
    return out(x, "client_id", "family", *clocks, *[f"global_none_{c}" for c in TEMPLATE_STATS], rounded=False)


@query
def ranking_competition(spark, d):
    x = features.ranking_features(led(spark, d), TEST_WINDOWS, families.price_profiles(led(spark, d)))
    return out(x, "client_id", "family", *[f"{c}_competition_{k}" for c in RANKING for k in ("min", "max", "mean", "rank", "delta")], rounded=False)


@query
def stream_stats_rest(spark, d):
    s = found(spark, d)
    by_family = [f"{k}_{f}" for f in FAMILIES for k in ("semantic", "mcc")] + [f"template_{f}_{k}" for f in FAMILIES for k in ("diversity", "count")]
    return out(s, *KEY, "amount_min", "amount_max", "mcc_top_fraction", "dom_std", "dow_std", "next_mean", "next_last", "overdue_ratio", *by_family)


@query
def template_canonical(spark, d):
    return out(families.template_counts(led(spark, d), (999, 14), "canonical"))


@query
def drift_auc(spark, d):
    """How well clients' statistics tell early from late ledgers: out-of-fold AUC per fold."""
    x = led(spark, d)
    half = lambda rows: clients.client_globals(rows, TEST_WINDOWS).na.fill(0)
    store = components.Store(spark, fresh_dir(spark, "components"))
    return out(components.drift_report(store, half(x.where("t < -15")), half(x.where("t >= -15")), ["total_count", "amount_mean", "amount_std"], 3, settings=learning.replace(components.DRIFT, rounds=3, leaves=4))[0])


@query
def tfidf_vectors(spark, d):
    """Vectors of late documents by a vocabulary learnt from early ones, long."""
    from pyspark.ml.functions import vector_to_array

    x = led(spark, d)
    text_of = lambda rows: learning.terms(clients.document_text(rows))
    model = SublinearTfidf(minDF=2, vocabSize=200).fit(text_of(x.where("t < -15")))
    names = F.array(*map(F.lit, model.vocabulary))
    made = model.transform(text_of(x.where("t >= -15"))).select("client_id", F.posexplode(vector_to_array("features")).alias("k", "weight")).where("weight > 0")
    return out(made.select("client_id", F.get(names, F.col("k")).alias("term"), "weight"))


def targets(spark, d):
    return weak_labels(spark, d).withColumnRenamed("label", "target")


def clusters(spark, d):
    return reports.amount_clusters(led(spark, d), targets(spark, d), TEST_WINDOWS)


@query
def forensic_clusters(spark, d):
    return out(clusters(spark, d), *KEY[:2], "comp", "target", "descriptions", "mcc_mode", "family", "matches_target", *reports.COMPARED, rounded=False)


@query
def forensic_report(spark, d):
    x = reports.cluster_report(written(clusters(spark, d).select("matches_target", *reports.COMPARED), "clusters"))
    # means of shares of few streams often end in a five behind the sixth place
    return out(x.withColumn("mean", F.round(F.col("mean") + 1e-9, 6)))


@query
def forensic_intervals(spark, d):
    return out(reports.interval_counts(clusters(spark, d)))


@query
def forensic_texts(spark, d):
    x = reports.text_streams(led(spark, d), targets(spark, d), TEST_WINDOWS)
    return out(x, "client_id", "txt", "target", "count", "amount_median", "unique_description", "description_entropy", "fee_fraction", "month_count", "gap_median", "gap_mad", "next_median", "gap_last")


def judged(spark, d):
    """Decisions by the softmax of stream counts beside the weak labels."""
    p = probabilities(spark, d).groupBy("client_id").agg(F.max_by("family", F.struct("p", -F.col("family_index"))).alias("prediction"), F.max("p").alias("confidence"))
    return p.join(weak_labels(spark, d).withColumnRenamed("label", "truth"), "client_id").withColumn("confidence", F.round("confidence", 9))


@query
def error_cohorts(spark, d):
    return out(reports.error_cohorts(reports.with_own_evidence(judged(spark, d), matrix(spark, d)), 20, 30))


@query
def error_kinds(spark, d):
    return out(reports.error_kinds(judged(spark, d)))


@query
def explanations(spark, d):
    return out(reports.explanations(judged(spark, d), matrix(spark, d)).drop("note"))
