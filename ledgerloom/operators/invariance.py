"""Changes between two tables, found from digests: a hash tree over buckets of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import ContractError
from ..sources.stored import written

#: Bits of the bucket number per level, from the root to the leaves.
LEVELS = (0, 4, 8, 12, 16)


def _bucket(keys: list[str]):
    return F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in keys], F.lit(17)), 64 - LEVELS[-1])


def hash_tree(df: DataFrame, keys: list[str]) -> DataFrame:
    """``(level, node, rows, digest)``: counts and digests of buckets of keys, stored.

    A row's digest covers the names and values of all columns, whatever their
    order; a bucket's is the sum of its rows', so it depends neither on the
    order of rows nor on partitions, and repeated rows count.  Leaves are
    65,536 at most; upper levels are sums of lower ones.
    """
    columns = sorted(df.columns)
    row = F.xxhash64(F.lit("|".join(columns)), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns], *[F.col(c).isNull() for c in columns])
    leaves = df.select(_bucket(keys).alias("node"), row.cast("decimal(20,0)").alias("h")).groupBy("node").agg(F.count("*").alias("rows"), F.sum("h").alias("digest"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftrightunsigned(F.col("node"), LEVELS[-1] - b).alias("node")) for k, b in enumerate(LEVELS)])).alias("n")
    return written(leaves.select(each, "rows", "digest").groupBy("n.level", "n.node").agg(F.sum("rows").alias("rows"), F.sum("digest").alias("digest")), "digests")


def changed_buckets(a: DataFrame, b: DataFrame) -> tuple[DataFrame | None, list[int]]:
    """Leaves of two hash trees that differ (null if none), and the nodes compared per level.

    Only below nodes that differ is the next level looked at.
    """
    found, seen = None, []
    for k in range(len(LEVELS)):
        x, y = (t.where(F.col("level") == k).select("node", F.col("rows").alias(f"rows_{s}"), F.col("digest").alias(f"digest_{s}")) for t, s in ((a, "a"), (b, "b")))
        both = x.join(y, "node", "full_outer")
        if found is not None:
            both = both.join(found.select(F.col("node").alias("up")), F.shiftrightunsigned(F.col("node"), LEVELS[k] - LEVELS[k - 1]) == F.col("up"), "left_semi")
        both = written(both.withColumn("same", F.col("rows_a").eqNullSafe(F.col("rows_b")) & F.col("digest_a").eqNullSafe(F.col("digest_b"))), "nodes")
        seen.append(both.count())
        found = both.where("NOT same").select("node")
        if not found.limit(1).count():
            return None, seen
    return found, seen


def changes(a: DataFrame, b: DataFrame, keys: list[str], trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``(keys, column)``: where two tables with unique keys and the same columns differ.

    A key of one table only is named with each of its columns.  Rows outside
    the buckets that differ are not compared, and with stored ``trees`` equal
    tables are not read at all.  Null keys match; repeated keys are refused.
    """
    if sorted(a.columns) != sorted(b.columns):
        raise ContractError("tables with different columns")
    rest = sorted(c for c in a.columns if c not in keys)
    buckets, _ = changed_buckets(*(trees or (hash_tree(a, keys), hash_tree(b, keys))))
    if buckets is None:
        return a.select(*keys, F.lit("").alias("column")).where("false")
    side = lambda df: df.withColumn("_node", _bucket(keys)).join(F.broadcast(buckets), F.col("_node") == F.col("node"), "left_semi").drop("_node")  # noqa: E731  65,536 numbers at most
    named = [side(df).select(F.struct(*keys).alias(f"k_{s}"), F.struct(*rest).alias(s)) for df, s in ((a, "a"), (b, "b"))]
    for df, s in zip(named, "ab"):
        if df.groupBy(f"k_{s}").count().where("count > 1").limit(1).count():
            raise ContractError("repeated keys")
    both = named[0].join(named[1], F.col("k_a").eqNullSafe(F.col("k_b")), "full_outer")
    one = F.col("k_a").isNull() | F.col("k_b").isNull()
    differs = F.array_compact(F.array(*[F.when(one | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in rest]))
    key = F.coalesce("k_a", "k_b")
    return both.select(key.alias("k"), F.explode(differs).alias("column")).select(*[F.col(f"k.{c}").alias(c) for c in keys], "column")


def renamed_back(make, df: DataFrame, key: str, prefix: str = "renamed_") -> DataFrame:
    """``make(df)`` on clients with other names, in another order, named as before."""
    other = df.withColumn(key, F.concat(F.lit(prefix), F.reverse(key)))
    made = make(other.repartition(7, F.reverse(F.col(key)))).withColumn(key, F.reverse(F.substring(key, len(prefix) + 1, 1 << 30)))
    return made.select(*make(df).columns)
