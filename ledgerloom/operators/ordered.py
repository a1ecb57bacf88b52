"""Row numbers, running sums and exact quantiles whose tasks do not grow with the data.

Rows are dealt into ranges of the wanted order, as many as their number asks
for; only a few totals per range meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import written

#: Rows of a range, about, and of a bucket that quantiles are selected in.
RANGE_ROWS = 1_000_000
#: Cuts of a group per round of the selection.
CUTS = 255


def ranged(df: DataFrame, order: list, by: tuple[str, ...] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` in ranges of ``(by, order)``, stored, with ``_part`` and the place ``_at`` in it.

    ``order`` should end with a unique column: rows that tie in all of it lie
    in one range.  The table is read twice (its size decides the ranges).
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    named = df.withColumns({f"_o{k}": c for k, c in enumerate(keys)})
    sort = [*by, *[f"_o{k}" for k in range(len(keys))]]
    parts = -(-df.count() // rows) or 1
    placed = named.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id())
    split = {"_part": F.shiftright("_id", 33).cast("int"), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}
    return written(placed.withColumns(split).drop("_id", *sort[len(by) :]), "ranged")


def _before(totals: DataFrame, by: tuple[str, ...], names: list[str]) -> DataFrame:
    """Totals of a group's earlier ranges: a window over a row per group and range."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({n: F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names})


def _matched(rows: DataFrame, totals: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``rows`` with the totals of their group and range; null groups match too."""
    right = totals.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate((*by, "_part"))], *[c for c in totals.columns if c not in (*by, "_part")])
    on = rows["_part"] == right[f"_k{len(by)}"]
    for k, c in enumerate(by):
        on &= rows[c].eqNullSafe(right[f"_k{k}"])
    return rows.join(right, on).drop(*[f"_k{k}" for k in range(len(by) + 1)])


def numbered(df: DataFrame, order: list, by: tuple[str, ...] = (), name: str = "_n", rows: int = RANGE_ROWS) -> DataFrame:
    """Row numbers from 1, of all rows or by group, in ``order``.

    A row's number is its place in its range, less the place of its group's
    first row there, plus the group's rows in earlier ranges.
    """
    placed = ranged(df, order, by, rows)
    totals = placed.groupBy(*by, "_part").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    totals = _before(totals, by, ["_c"])
    return _matched(placed, totals, by).withColumn(name, F.col("_at") - F.col("_first") + F.col("_c") + 1).drop("_at", "_first", "_c", "_part")


def running(df: DataFrame, order: list, by: tuple[str, ...], sums: dict[str, Column], rows: int = RANGE_ROWS) -> DataFrame:
    """Sums of whole numbers over the rows of the group that come before, 0 for the first.

    Running sums are taken inside a range, and each range adds the totals of
    those before: no group, however large, is ordered in one task.
    """
    placed = ranged(df, order, by, rows)
    named = placed.withColumns(sums)
    inside = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    made = named.withColumns({n: F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in sums})
    totals = named.groupBy(*by, "_part").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    totals = _before(totals, by, [f"_t_{n}" for n in sums])
    return _matched(made, totals, by).withColumns({n: F.col(n) + F.col(f"_t_{n}") for n in sums}).drop("_part", "_at", *[f"_t_{n}" for n in sums])


def order_statistics(values: DataFrame, wanted: DataFrame, rows: int = RANGE_ROWS, largest: int | None = None) -> DataFrame:
    """``(g, rank, value)``: the ``rank``-th smallest value (from 0) of each group.

    ``values`` holds ``(g, value)``, ``wanted`` ``(g, rank)``; ``g`` is any
    column, null included.  As long as a group has more than ``rows`` distinct
    values, approximate quantiles cut it into buckets; their sizes tell which
    holds a wanted rank, and only such buckets are looked at further.  Then
    the distinct values are ordered.  Cuts only decide where is looked: the
    result is exact.  ``largest`` is the size of the largest group, if known.
    """
    key, level = F.col("g"), 0
    asked = wanted.select("g", F.col("rank").alias("want"), "rank")
    rows_ = values.select("g", F.col("value").cast("double").alias("value")).where("value IS NOT NULL")
    state = rows_.groupBy("g", "value").agg(F.count("*").alias("n"))  # combined before it is shuffled
    most = lambda: state.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    distinct = most() if largest is None or largest > rows else largest
    while distinct > rows:
        # of distinct values, so that a frequent one cannot keep the others together
        cuts = state.groupBy("g").agg(F.percentile_approx("value", [k / (CUTS + 1) for k in range(1, CUTS + 1)]).alias("cuts"))
        cuts = cuts.select(F.col("g").alias("g_"), F.array_distinct("cuts").alias("cuts"))
        # a value lies in the bucket of the first cut that is not below it
        bucket = F.size(F.filter("cuts", lambda c: c < F.col("value")))
        cut = written(state.join(cuts, key.eqNullSafe(F.col("g_"))).withColumn("b", bucket).drop("g_", "cuts"), "cut")
        sizes = cut.groupBy("g", "b").agg(F.sum("n").alias("n"), F.count("*").alias("d"))
        upto = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        sizes = sizes.withColumn("upto", F.sum("n").over(upto)).select(F.col("g").alias("g_"), "b", "n", "d", "upto")
        inside = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
        found = asked.join(sizes, key.eqNullSafe(F.col("g_")) & inside).select(
            F.struct("g", "b").alias("g"), "want", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "d"
        )
        asked, level = written(found, "ranks"), level + 1
        buckets = asked.select(F.col("g").alias("g_")).distinct()
        state = cut.select(F.struct("g", "b").alias("g"), "value", "n").join(buckets, key.eqNullSafe(F.col("g_")), "left_semi")
        distinct = asked.agg(F.max("d")).first()[0] or 0
    w = Window.partitionBy("g").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = state.withColumn("upto", F.sum("n").over(w)).select(F.col("g").alias("g_"), "value", F.col("n").alias("n_"), "upto")
    own = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n_"))
    group = "g" + ".g" * level
    return asked.join(placed, key.eqNullSafe(F.col("g_")) & own).select(F.col(group).alias("g"), F.col("want").alias("rank"), "value")


def percentiles(df: DataFrame, column: str, probabilities: list[float], by: tuple[str, ...] = (), rows: int = RANGE_ROWS) -> DataFrame:
    """``(by, q)``: the percentiles of a column as an array, equal to those of ``percentile``.

    Groups without a value have a null array.  Between two values the
    percentile is interpolated.
    """
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    values = df.select(group.alias("g"), F.col(column).cast("double").alias("value"))
    sizes = values.groupBy("g").agg(F.count("value").alias("n"))
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ends = F.array(*[f(at(p)).cast("long") for p in probabilities for f in (F.floor, F.ceil)])
    sizes = written(sizes, "sizes")
    asked = sizes.where("n > 0").select("g", F.explode(F.array_distinct(ends)).alias("rank"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    found = order_statistics(values, asked, rows, largest).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("of")).select(F.col("g").alias("g_"), "of")
    every = sizes.join(found, F.col("g").eqNullSafe(F.col("g_")), "left")

    def between(p: float) -> Column:
        low, high = F.floor(at(p)).cast("long"), F.ceil(at(p)).cast("long")
        a, b = F.try_element_at("of", low), F.try_element_at("of", high)
        return F.when((low == high) | (a == b), a).otherwise((high - at(p)) * a + (at(p) - low) * b)

    q = F.when(F.col("n") > 0, F.array(*[between(p) for p in probabilities]))
    return every.select(*[F.col(f"g.{c}").alias(c) for c in by], q.alias("q"))
