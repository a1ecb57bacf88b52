"""URL rules by a sort-merge range join with a sweep over nested intervals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, table, written

# Fixed values: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
RULE_TYPE = "array<struct<host: string, path: string, verdict: string>>"
#: A domain name has at most so many labels (RFC 1035: 255 bytes).
MAX_LABELS = 127


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(rows: DataFrame, url_col: str) -> DataFrame:
    """Add ``host`` and ``path``: native string functions, no shuffle.

    The host stands between the first ``://`` and the next ``/``, ``?`` or
    ``#``, the path from there to the next ``?`` or ``#``.  Upper-case A-Z of
    the host are lowered, other letters stay.  A null URL and one without
    ``://`` have both empty; repeated rows stay, an empty table has no rows,
    and other columns pass through.
    """
    rest = F.expr(f"if(instr({url_col}, '://') > 0, substring({url_col}, instr({url_col}, '://') + 3), '')")
    rows = rows.withColumn("rest", F.coalesce(rest, F.lit("")))
    part = lambda k: F.regexp_extract("rest", r"(?s)^([^/?#]*)([^?#]*)", k)
    return rows.select("*", lower_ascii(part(1)).alias("host"), part(2).alias("path")).drop("rest")


def host_key(host: Column) -> Column:
    """Reversed labels, each ended by ``/``: subdomains share the prefix.

    No host of a URL holds a ``/``, so keys of different hosts differ and a
    label is never taken for two.
    """
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def rule_intervals(rules: DataFrame) -> DataFrame:
    """``(key, until, depth, own)`` per rule host: its rules hold from ``key`` to below ``until``.

    A host and its subdomains are the strings that start with its key, which
    are those from the key up to the key with its last ``/`` raised to the next
    character, ``0``.  Intervals nest or are apart, and of nested ones the
    inner has the greater ``depth``, its number of labels.  Rules with a null
    are left out; repeated rules count once.
    """
    hosts = (
        rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
        .na.drop()
        .groupBy("host")
        .agg(F.array_sort(F.collect_set(F.struct("host", "path", "verdict"))).alias("own"))
        .withColumn("key", host_key(F.col("host")))
    )
    return hosts.select(
        "key", F.expr("concat(substring(key, 1, length(key) - 1), '0')").alias("until"), F.size(F.split("host", r"\.")).alias("depth"), "own"
    )


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, rules)``: for each of the distinct ``hosts`` the rules of its own
    and its parent domains.

    Keys of hosts and starts of intervals are sorted together into ranges and
    swept in order.  The stack has a place for each depth: a start takes the
    place of its depth, and an interval whose end has been passed is popped.
    Within a range the places are running last values, and the last ones of a
    range are carried into the ranges behind it, so however many rules a
    domain has, no task sweeps them alone.  A host's own rules are one row.
    """
    intervals = written(rule_intervals(rules), "intervals")
    depths = sorted(r[0] for r in intervals.select("depth").distinct().limit(MAX_LABELS + 1).collect())
    if len(depths) > MAX_LABELS:
        raise ValueError(f"rule hosts of more than {MAX_LABELS} different numbers of labels")
    rule = F.struct("key", "until", "own")
    events = hosts.select(host_key(F.col("host")).alias("key"), "host", F.lit(1).alias("kind")).unionByName(
        intervals.select("key", F.lit(0).alias("kind"), "depth", rule.alias("rule")), allowMissingColumns=True
    )
    # ranges are fixed by writing them: a task run again keeps its rows
    ranged = written(
        events.repartitionByRange(shuffle_partitions(hosts.sparkSession), "key").withColumn("part", F.spark_partition_id()), "events"
    )
    so_far = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    parts_before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at = lambda d: F.when(F.col("depth") == d, F.col("rule"))
    carried = (
        ranged.groupBy("part")
        .agg(F.count("*").alias("n"), *[F.max_by(at(d), F.when(F.col("depth") == d, F.col("key"))).alias(f"last{d}") for d in depths])
        .select("part", *[F.last(f"last{d}", ignorenulls=True).over(parts_before).alias(f"carried{d}") for d in depths])
    )
    swept = (
        ranged.select("part", "key", "kind", "host", *[F.last(at(d), ignorenulls=True).over(so_far).alias(f"place{d}") for d in depths])
        .where("kind = 1")
        .join(carried, "part")
    )
    stack = F.array(*[F.coalesce(f"place{d}", f"carried{d}") for d in depths]) if depths else F.lit(None)
    opened = swept.select("key", "host", stack.alias("stack"))
    if not depths:
        return opened.select("host", F.lit(None).cast(RULE_TYPE).alias("rules"))
    return opened.select("host", F.expr("flatten(transform(filter(stack, r -> r IS NOT NULL AND key < r.until), r -> r.own))").alias("rules"))


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` per row of ``pages``.

    Distinct hosts are swept together with the rules (:func:`active_rules`), so
    a host that many rows have is swept once.  Of the active rules whose path
    starts the URL's path the longest ``host/path`` wins, then the longest
    host, then the greater verdict; without one, ``default``.  The rules of a
    host's ancestors travel with it: cost per row follows their number.  Null
    and malformed URLs have an empty host and path and take the default (unless
    a rule has both empty); without rules all rows do; repeated rows stay; an
    empty table gives no rows; other columns are not read.  DataFrame
    expressions only.
    """
    rows = url_parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url_")), "url_").drop("url_")
    swept = active_rules(rows.select("host").distinct(), rules)
    best = F.expr(
        "try_element_at(array_sort(transform(filter(rules, r -> startswith(path, r.path)), r -> "
        "struct(length(r.host) + length(r.path) AS size, length(r.host) AS depth, r.verdict AS verdict, concat(r.host, r.path) AS rule))), -1)"
    )
    judged = rows.join(swept, "host", "left").select("id", "host", "path", best.alias("best"))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def rules_frame(spark, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark))


OP4_SQL = """
WITH r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
       ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
     u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
     m AS (SELECT p.*, r.host || r.path AS rule, r.verdict,
                  row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
           FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
