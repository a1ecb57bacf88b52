"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..sources.stored import fresh_dir, shared_dir, written  # noqa: F401

# Byte classes.  Words of the lower-cased alphabet are runs of [0-9a-z] and of
# bytes >= 0x80, so a text can be split without decoding it.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_SHIPPED: set[str] = set()
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` words; null has none."""
    return text.translate(_WORD_BYTES).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Lower-cased ``[^\\x20\\x09-\\x0D]+`` words; null has none."""
    return text.lower().split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """``df`` with its columns named ``in_0, in_1, ...`` and the new name of an old one.

    Operators that pass the caller's columns through work on these names, so
    neither the operator's own columns nor repeated names can clash with them.
    """
    names = df.columns
    return df.toDF(*[f"in_{k}" for k in range(len(names))]), lambda name: f"in_{names.index(name)}"


def session(df: DataFrame) -> SparkSession:
    """The session of ``df``, with this package shipped to the executors.

    Arrow batches of the session are set to 1,000 rows and 8 MB at most: tasks
    hold a batch of whole texts at a time, however long or repeated they are.
    The setting is read when a lazy result runs, so it stays set.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom.zip"
        with zipfile.ZipFile(path, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 8 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or int(now.removesuffix("B").removesuffix("b")) > most:
            spark.conf.set(key, str(most))
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
