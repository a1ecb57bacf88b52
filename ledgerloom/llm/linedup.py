"""Cross-site line removal: spread by HyperLogLog, exact near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, numbered, table, written

MIN_SITES = 3
#: Estimates within this factor of the threshold are counted exactly.  Sketches
#: of 2**12 registers hold so few values nearly exactly (a few per thousand).
BAND = 1.5


def _lines(docs: DataFrame) -> DataFrame:
    """``(id, stamp, site, pos, a, b)`` per line with a word; (a, b) hash it.

    Lines compare lower-cased, white space folded.  Two hash functions keep
    accidental equality negligible at any corpus size.
    """
    norm = F.trim(F.regexp_replace(F.lower("line"), SPACE_CLASS, " "))
    return (
        docs.select("id", "stamp", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .withColumn("norm", norm)
        .where("norm <> ''")
        .select("id", "stamp", "site", "pos", F.xxhash64("norm").alias("a"), F.hash("norm").alias("b"))
    )


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """``(a, b, keeper)`` of lines on at least ``min_sites`` sites.

    Each line hash gets a HyperLogLog sketch of its sites, merged map-side and
    after one shuffle; only lines whose estimate is near the threshold take
    part in the exact count.  ``keeper`` is the smallest id that has the line.
    """
    spread = lines.groupBy("a", "b").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", 12)).alias("sites"), F.min("id").alias("keeper")
    ).where(F.col("sites") >= min_sites / band)
    spread = written(spread, "spread")
    sure = spread.where(F.col("sites") > min_sites * band)
    near = spread.where(F.col("sites") <= min_sites * band)
    exact = (
        lines.select("a", "b", "site")
        .join(near.select("a", "b"), ["a", "b"], "left_semi")
        .distinct()
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_sites)
    )
    return sure.select("a", "b", "keeper").unionByName(near.join(exact, ["a", "b"]).select("a", "b", "keeper"))


def remove_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source"
) -> DataFrame:
    """Rows of ``docs`` with ``text`` cleaned, plus ``n_lines`` and ``n_removed``.

    A line that stands on ``min_sites`` or more distinct sites is boilerplate:
    it stays in the document with the smallest id that has it and goes from
    all others.  Lines without a word never count or go.  A null text stays
    null with 0 lines; a null site is one site of its own; a null id is never
    a keeper unless all ids of the line are null; repeated rows are treated
    alike; an empty table gives no rows.  Other columns pass through, whatever
    their names; columns named ``n_lines`` or ``n_removed`` are replaced.

    Only hashes and positions are shuffled by line, and their hot lines are
    combined map-side or split by adaptive execution; the texts move once, by
    document.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows, at = numbered(docs)
    id_, text, site = (F.col(at(c)) for c in (id_col, text_col, site_col))
    stamped = rows.select(
        id_.alias("id"), F.xxhash64(text).alias("stamp"),
        F.coalesce(site.cast("string"), F.lit("\u0000")).alias("site"), text.alias("text"),
    )
    lines = written(_lines(stamped), "lines")
    bad = written(boilerplate(lines, min_sites), "boilerplate")
    hits = lines.join(bad, ["a", "b"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    gone = hits.groupBy("id", "stamp").agg(F.collect_set("pos").alias("gone"))
    joined = rows.join(gone, id_.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("stamp")), "left").withColumn("lines", F.split(text, "\n"))
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(
        # array(lines) binds the split once for all elements
        F.expr(
            "array_join(flatten(transform(array(lines), l -> "
            "transform(array_except(sequence(0, size(l) - 1), gone), i -> get(l, i)))), '\\n')"
        )
    )
    return joined.select(
        *[cleaned if c == text_col else F.col(f"in_{k}") for k, c in enumerate(docs.columns) if c in names],
        F.when(text.isNull(), F.lit(0)).otherwise(F.size("lines")).cast("long"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long"),
    ).toDF(*names, "n_lines", "n_removed")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_removed", "text")


OP5_SQL = rf"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
     n AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM l),
     b AS (SELECT norm, min(doc_id) AS keeper FROM n WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT coalesce(source, chr(1))) >= {MIN_SITES}),
     m AS (SELECT n.*, b.norm IS NOT NULL AND doc_id <> keeper AS gone FROM n LEFT JOIN b USING (norm))
SELECT doc_id, source, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM m GROUP BY doc_id, source
"""
