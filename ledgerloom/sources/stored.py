"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset a temporary folder is used if driver and tasks are one
    process (``local``, as in tests); on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        folder = _LOCAL[context.applicationId]
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; it is removed when the JVM ends."""
    path = f"{shared_dir(spark)}/ledgerloom-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return fs.makeQualified(p).toString()


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: store ``df`` as Parquet in the shared folder, read it back.

    Unlike executor-local storage, the files outlive lost executors.
    """
    path = f"{fresh_dir(df.sparkSession, tag)}/t"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
