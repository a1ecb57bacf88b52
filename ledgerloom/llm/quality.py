"""Quality rules per document and, shrunk by an empirical beta prior, per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, numbered, table, written

#: A host is rejected if its shrunk failure rate exceeds this: if more of its
#: documents are expected to fail than to pass.
MAX_HOST_RATE = 0.5
#: Own rules of the method: symbols per word, with the limit published for web
#: text (Rae et al., 2021), and share of repeated lines.  Half of the lines must
#: repeat, so that one repeated page header does not fail a text of three lines.
MAX_SYMBOLS = 0.1
MAX_DUP_LINES = 0.5


def bind(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "own_failed", "host_rate", "kept"]


def counted(text: str) -> list[Column]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` of a text column.

    The words are split once.  Repeated windows are found by sorting (hash of
    three words, position) in the row and comparing neighbours, where a text
    has any; the words they cover follow from the gaps between the sorted
    positions.  Cost per row is n log n.  Null has no words and one line.
    """
    t = f"coalesce({text}, '')"
    space = SPACE_CLASS.replace("\\", "\\\\")
    windows = "if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))))"
    again = "filter(s, (x, k) -> x.h <=> get(s, k - 1).h OR x.h <=> get(s, k + 1).h)"
    covered = (
        f"aggregate(array_sort(transform({again}, x -> x.i)), named_struct('end', 0, 'n', 0), "
        "(a, i) -> named_struct('end', i + 3, 'n', a.n + i + 3 - greatest(i, a.end)), a -> CAST(a.n AS BIGINT))"
    )
    # most texts repeat no window: their sort is skipped
    repeat = bind(
        windows, "v", f"if(size(array_distinct(v)) = size(v), 0L, {bind('sort_array(transform(v, (h, i) -> struct(h AS h, i AS i)))', 's', covered)})"
    )
    words = f"named_struct('n', CAST(size(w) AS BIGINT), 'chars', CAST(length(array_join(w, '')) AS BIGINT), 'again', {repeat})"
    lines = f"filter(split({t}, '\\\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    return [
        F.expr(bind(f"array_remove(split({t}, '{space}'), '')", "w", words)).alias("words"),
        F.expr(f"CAST(length({t}) - length(translate({t}, '#*$%&|<>', '')) AS BIGINT)").alias("n_symbols"),
        F.expr(bind(lines, "l", "CAST(size(l) - size(array_distinct(l)) AS BIGINT)")).alias("n_dup_lines"),
        F.expr(f"CAST(length({t}) - length(translate({t}, '\\n', '')) + 1 AS BIGINT)").alias("n_lines"),
    ]


def quality_verdicts(docs: DataFrame, text_col: str = "text", host_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus the counters, ``base_failed``, ``own_failed``, ``host_rate`` and ``kept``.

    ``base_failed``: under 50 words, or over half of the words in repeated
    three-word windows.  A document fails the method's rules if it fails these
    or has more than ``MAX_SYMBOLS`` symbols a word or ``MAX_DUP_LINES`` of its
    lines repeated.  Failures are summed by host; a host's rate is shrunk to
    ``(failed + a) / (n + a + b)`` with a beta prior of the hosts' own mean and
    variance (moments; where hosts do not vary more than chance, the prior
    weighs as much as the largest host).  Kept are documents that pass all
    rules on hosts whose shrunk rate is at most ``MAX_HOST_RATE``; the other
    documents of a host beyond it go with those that failed.

    Null text has no words and fails; null hosts form one host; repeated rows
    count each; an empty table gives no rows; columns with the names of the
    added ones are replaced, all others pass through whatever their names.
    ``keep`` names the columns of ``docs`` to carry (all by default): the
    counters are stored once with them, so leave out the text where it is not
    needed.  DataFrame expressions only.
    """
    rows, at = numbered(docs)
    carried = [c for c in docs.columns if c not in ADDED and (keep is None or c in keep)]
    judged = rows.select(*[f"in_{k}" for k, c in enumerate(docs.columns) if c in carried], F.col(at(host_col)).alias("host"), *counted(at(text_col)))
    judged = judged.withColumns({"n_words": F.col("words.n"), "word_chars": F.col("words.chars"), "n_repeat_words": F.col("words.again")})
    judged = judged.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    own = F.col("base_failed") | (F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words")) | (F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"))
    judged = written(judged.withColumn("own_failed", own).drop("words", "n_lines"), "counters")
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("own_failed").cast("long")).alias("failed"))
    hosts = written(hosts, "hosts")
    rate = F.col("failed") / F.col("n")
    moments = hosts.agg(
        (F.sum("failed") / F.sum("n")).alias("m"), F.var_pop(rate).alias("v"),
        F.avg(1 / F.col("n")).alias("noise"), F.max("n").alias("most"),
    )
    spread = F.expr("m * (1 - m)")
    extra = F.col("v") - spread * F.col("noise")
    weight = F.when((extra > 0) & (spread > extra), F.least(spread / extra - 1, F.col("most"))).otherwise(F.col("most"))
    prior = moments.select((F.col("m") * weight).alias("a"), ((1 - F.col("m")) * weight).alias("b")).first()
    a, b = (float(x or 0.0) for x in prior)
    rates = hosts.select(F.col("host").alias("of"), ((F.col("failed") + a) / (F.col("n") + (a + b))).alias("host_rate"))
    joined = judged.join(rates, F.col("host").eqNullSafe(F.col("of")))
    verdict = joined.withColumn("kept", ~F.col("own_failed") & (F.col("host_rate") <= MAX_HOST_RATE))
    return verdict.select(*[c for c in judged.columns if c.startswith("in_")], *ADDED).toDF(*carried, *ADDED)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("host_rate", 9).alias("host_rate"), "kept"
    )


OP7_SQL = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
     w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS ls FROM t),
     l AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
     c AS (SELECT doc_id, source, length(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (length(l) - length(list_distinct(l)))::BIGINT AS n_dup_lines, length(ls) AS n_lines FROM l),
     g AS (SELECT doc_id, unnest(range(1, length(w) - 1)) AS i, w FROM w WHERE length(w) >= 3),
     h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS k FROM g),
     r AS (SELECT doc_id, count(DISTINCT i + d)::BIGINT AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS d FROM h WHERE k > 1) GROUP BY doc_id),
     b AS (SELECT c.*, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN r USING (doc_id)),
     f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
     o AS (SELECT *, base_failed OR n_symbols > {MAX_SYMBOLS} * n_words OR n_dup_lines > {MAX_DUP_LINES} * n_lines AS own_failed FROM f),
     s AS (SELECT source, count(*) AS n, sum(own_failed::INT) AS failed FROM o GROUP BY source),
     m AS (SELECT sum(failed) / sum(n) AS m, var_pop(failed / n) AS v, avg(1.0::DOUBLE / n) AS noise, max(n)::DOUBLE AS most FROM s),
     q AS (SELECT *, v - m * (1 - m) * noise AS extra FROM m),
     p AS (SELECT m, CASE WHEN extra > 0 AND m * (1 - m) > extra THEN least(m * (1 - m) / extra - 1, most) ELSE most END AS k FROM q),
     z AS (SELECT source, (failed + m * k) / (n + k) AS host_rate FROM s, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(host_rate, 9) AS host_rate, NOT own_failed AND host_rate <= {MAX_HOST_RATE} AS kept
FROM o JOIN z ON o.source IS NOT DISTINCT FROM z.source
"""
