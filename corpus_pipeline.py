"""Training-corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that its
predecessor kept; all but the last return the columns of ``documents``.
Further columns of ``docs``, whatever their names, are left behind.  Null ids
are ids like others, a null source is a source of its own, and an empty table
gives no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table, written
from ledgerloom.llm.decontam import find_contamination
from ledgerloom.llm.linedup import remove_boilerplate
from ledgerloom.llm.neardup import one_per_group
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.quality import quality_verdicts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go.

    Null, empty and word-free texts are rejected; repeated rows are judged, and
    counted for their host, one by one.
    """
    return _columns(quality_verdicts(docs).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; so does a document of which nothing else is left.

    The document with the smallest id keeps the line, and so do all rows of
    that id; a document that had no line to lose stays as it is, null and empty
    texts included.
    """
    clean = remove_boilerplate(docs).where("n_removed = 0 OR trim(text) <> ''")
    return _columns(clean.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    A repeated row stays once.  Null texts and texts without a word are one
    group; a null id stays only where its group has no other.
    """
    return _columns(one_per_group(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.

    Null and empty texts hold none and stay; repeated rows are treated alike;
    an empty benchmark takes nothing away.
    """
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return _columns(found.where(F.size("spans") == 0))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, a row per piece.

    A null or empty text is its end id alone; each repeated row is packed.
    """
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]
#: Shingle hashes and tokens are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is stored as Parquet and read back."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
