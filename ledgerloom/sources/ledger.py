"""Ledger sources and sinks, contracts, and the ledger view of the test tables."""

from __future__ import annotations

import csv
import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CUTOFF, FAMILIES, GENERIC, LABELS, MCC, TEMPLATES, TEST_CUTOFF
from ..functions.numeric import day
from ..functions.text import normalize

LEDGER = T.StructType(
    [
        T.StructField("client_id", T.StringType()), T.StructField("timestamp", T.TimestampType()), T.StructField("amount", T.DoubleType()),
        T.StructField("currency", T.StringType()), T.StructField("type", T.StringType()), T.StructField("direction", T.StringType()),
        T.StructField("description", T.StringType()), T.StructField("mcc", T.StringType()), T.StructField("fee", T.DoubleType()),
    ]
)
RAW = LEDGER.fieldNames()
SPLITS = ("train", "valid", "test", "unlabeled_pretrain")
LABEL = T.StructType([T.StructField(n, T.StringType()) for n in ("client_id", "cutoff_date", "target_next_recurring_merchant")])


class ContractError(ValueError):
    """Data that breaks the ledger, label or submission contract."""


def violations(ledger: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """One row of violation counts: a single aggregate over the ledger."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in RAW]
    return ledger.agg(
        *nulls,
        F.count_if(F.col("timestamp") >= F.lit(cutoff).cast("timestamp")).alias("late"),
        F.count_if(F.col("amount") <= 0).alias("not_positive"),
    )


def canonical_transactions(ledger: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """The whitelisted columns of a valid ledger; ``ContractError`` otherwise."""
    missing = [c for c in RAW if c not in ledger.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    bad = {k: v for k, v in violations(ledger, cutoff).first().asDict().items() if v}
    if bad:
        raise ContractError(f"invalid ledger: {bad}")
    return ledger.select(*RAW)


def read_ledger(spark: SparkSession, path: str, cutoff: str = CUTOFF, cache: str | None = None, use_cache: bool = True) -> DataFrame:
    """JSON Lines (explicit schema: ``mcc`` stays text) or Parquet, cutoff checked.

    With ``cache``, a Parquet path, the checked ledger is written there once and
    read from there later; ``use_cache=False`` reads the source in any case.
    """
    if cache and use_cache and exists(spark, f"{cache}/_SUCCESS"):
        return spark.read.parquet(cache)
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.schema(LEDGER).option("mode", "FAILFAST").json(path)
    if df.agg(F.coalesce(F.max("timestamp") >= F.lit(cutoff).cast("timestamp"), F.lit(False))).first()[0]:
        raise ContractError("transactions at or after the cutoff")
    if cache and use_cache:
        df.write.mode("overwrite").parquet(cache)
        return spark.read.parquet(cache)
    return df


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def split_path(data_dir: str, split: str) -> str:
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return f"{data_dir}/{split}.jsonl"


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with all columns as text: ``none`` and empty stay, ``\\r\\r\\n`` is read.

    Each file begins with the header, which may be quoted; a row of data that
    reads like it stays.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.regexp_replace("value", "\r+$", "").alias("v"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    ).where("v <> ''")
    heads = lines.where("block = 0").groupBy("file").agg(F.min(F.struct("at", "v")).alias("h")).select("h.*").collect()
    if not heads:
        raise ContractError(f"no header in {path}")
    names = next(csv.reader([heads[0]["v"]]))
    schema = ", ".join(f"c{k} string" for k in range(len(names)))
    options = {"nullValue": "\u0001", "emptyValue": "", "delimiter": ",", "escape": "\"", "mode": "FAILFAST"}
    rows = lines.where(~F.col("at").isin([h["at"] for h in heads])).select(F.from_csv("v", schema, options).alias("r")).select("r.*")
    return rows.fillna("").toDF(*names)


def read_labels(spark: SparkSession, path: str, split: str = "train", allow_holdout: bool = False, cutoff_date: str = CUTOFF[:10]) -> DataFrame:
    """Labels with their contract: unique clients, legal labels, one cutoff."""
    if split == "valid" and not allow_holdout:
        raise ContractError("the holdout labels are closed")
    df = spark.read.schema(LABEL).csv(path, header=True)
    check_labels(df, cutoff_date)
    return df


def check_labels(df: DataFrame, cutoff_date: str = CUTOFF[:10]) -> None:
    r = df.agg(
        F.count("*").alias("n"), F.count_distinct("client_id").alias("ids"),
        F.count_if(~F.coalesce(F.col("target_next_recurring_merchant").isin(LABELS), F.lit(False))).alias("illegal"),
        F.count_if(~F.coalesce(F.col("cutoff_date") == cutoff_date, F.lit(False))).alias("cutoff"),
    ).first()
    if r["n"] != r["ids"] or r["illegal"] or r["cutoff"]:
        raise ContractError(f"invalid labels: {r.asDict()}")


def write_csv(df: DataFrame, path: str, order_by: list[str]) -> None:
    """Rows in order, in CSV files with a header; one range-sorted file set."""
    df.orderBy(*order_by).write.option("header", True).mode("errorifexists").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_probabilities(p: DataFrame, path: str, labels: list[str] = LABELS, folds: DataFrame | None = None) -> None:
    """A row per client in order: its decision, its probabilities, and its fold if given."""
    wide = p.groupBy("client_id").agg(
        F.max_by("family", F.struct("p", -F.col("family_index"))).alias("prediction"), *[F.max(F.when(F.col("family") == x, F.col("p"))).alias(f"p_{x}") for x in labels]
    )
    write_csv(wide if folds is None else wide.join(folds.select("client_id", "fold"), "client_id"), path, ["client_id"])


def append_log(path: str, record: dict) -> None:
    """A line of a driver-side CSV log, its header once, and the same in Markdown beside it."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    new = not target.exists()
    with target.open("a", newline="") as f:
        writer = csv.DictWriter(f, list(record))
        if new:
            writer.writeheader()
        writer.writerow(record)
    with target.with_suffix(".md").open("a") as f:
        if new:
            f.write(f"| {' | '.join(record)} |\n|{'---|' * len(record)}\n")
        f.write(f"| {' | '.join(map(str, record.values()))} |\n")


def write_json(path: str, value, exclusive: bool = False) -> None:
    """A small driver-side receipt; ``exclusive`` refuses to overwrite."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "x" if exclusive else "w") as f:
        json.dump(value, f, indent=2, sort_keys=True)


# JSON keeps milliseconds only, if it is not told otherwise.
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def to_json_rows(df: DataFrame, key: str) -> DataFrame:
    """``(key, json)``: each row's other columns as one JSON object; null fields are left out."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key]), _MICROS).alias("json"))


def from_json_rows(rows: DataFrame, key: str, schema: T.StructType) -> DataFrame:
    """Rows of :func:`to_json_rows` as columns again; absent fields are null.

    A text that is not JSON, or a field that is not of its type, ends the job
    when it is reached; null texts give null fields.
    """
    return rows.select(key, F.from_json("json", schema, _MICROS | {"mode": "FAILFAST"}).alias("_row")).select(key, *[F.col("_row")[f.name].alias(f.name) for f in schema.fields if f.name != key])


def digest(value) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def manifest(spark: SparkSession, glob: str) -> DataFrame:
    """Path, size and SHA-256 of files; paths that leave the folder are refused."""
    files = spark.read.format("binaryFile").load(glob)
    if files.where("path LIKE '%/../%'").limit(1).count():
        raise ContractError("path outside the folder")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, expected: DataFrame) -> None:
    """The same files with the same sizes and digests; ``ContractError`` otherwise."""
    key = ["file", "bytes", "sha256"]
    wrong = found.select(*key).exceptAll(expected.select(*key)).unionByName(expected.select(*key).exceptAll(found.select(*key)))
    names = sorted({r["file"] for r in wrong.limit(20).collect()})
    if names:
        raise ContractError(f"files differ from the manifest: {names}")


def rebuild_runs(spark: SparkSession, glob: str) -> DataFrame:
    """One row per JSON receipt, by time and id; ``disposition`` follows from its kind."""
    runs = spark.read.option("multiLine", True).json(glob)
    if runs.count() != runs.select("id").distinct().count():
        raise ContractError("repeated run id")
    kind = F.lower(F.col("kind"))
    return runs.withColumn(
        "disposition", F.when(kind.rlike("final|frozen"), "selected").when(kind.rlike("ablation|audit"), "diagnostic").otherwise("explored")
    ).orderBy("timestamp", "id")


def links(pages: DataFrame) -> DataFrame:
    """Targets of the links of each page, in double, single or no quotes."""
    href = r"regexp_extract_all(html, '(?i)href\\s*=\\s*(\"[^\"]*\"|\'[^\']*\'|[^\\s>\"\']+)', 1)"
    return pages.select("page_id", F.explode(F.expr(href)).alias("href")).withColumn("href", F.regexp_replace("href", "^[\"']|[\"']$", ""))


def page_words(pages: DataFrame) -> DataFrame:
    """``(page_id, text)``: a page without its markup, blanks folded."""
    return pages.select("page_id", F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "), "[ \t\n\r]+", " ")).alias("text"))


# Descriptions for the test ledger and their merchant codes, in parallel: each
# family's texts with its code, texts of no family, and everyday payments.
_OWNERS = {text: MCC[f] for f in reversed(FAMILIES) for text in TEMPLATES[f]}
_TEXTS = list(dict.fromkeys(text for f in FAMILIES for text in TEMPLATES[f]))
_EVERYDAY = {"coffee shop": "5812", "grocery market": "5411", "hotel booking": "7011"}
_PAIRS = [(x, _OWNERS[x]) for x in _TEXTS] + [(x, "6012") for x in GENERIC if x not in _OWNERS] + list(_EVERYDAY.items())
VOCABULARY, CODES = ("|".join(column) for column in zip(*_PAIRS))


def events_ledger(spark: SparkSession, sf_dir: str, cutoff: str = TEST_CUTOFF) -> DataFrame:
    """The ``events`` table as a ledger, with ``tx_id``, normalised text ``txt`` and day ``t``.

    Adds per-row expressions only, so filters and column pruning reach the scan.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("timestamp"), "event_type", "value", k.alias("k"))
    at = ((F.col("user_id") * 3 + F.col("k")) % 30 + 1).cast("int")
    word = F.split_part(F.lit(VOCABULARY), F.lit("|"), at)
    df = e.select(
        F.col("event_id").alias("tx_id"),
        F.concat(F.lit("C"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("client_id"),
        "timestamp",
        F.col("value").alias("amount"),
        F.when(F.col("user_id") % 3 == 0, "eur").otherwise("chf").alias("currency"),
        F.when(F.col("event_type") == "error", "refund").when(F.col("event_type") == "signup", "topup").otherwise("card_payment").alias("type"),
        F.when(F.col("event_type").isin("error", "signup"), "in").otherwise("out").alias("direction"),
        F.when(F.col("event_id") % 11 == 0, "5812").otherwise(F.split_part(F.lit(CODES), F.lit("|"), at)).alias("mcc"),
        F.concat(
            F.when(F.col("k") % 5 == 0, "PAY ").otherwise(""),
            F.when(F.col("event_id") % 3 == 0, F.upper(word)).otherwise(word),
            F.when(F.col("k") % 4 == 0, F.concat(F.lit(" #"), F.col("k").cast("string"))).when(F.col("k") % 4 == 1, " online").otherwise(""),
        ).alias("description"),
        F.when(F.col("event_id") % 10 == 0, 0.5).otherwise(0.0).alias("fee"),
    )
    return enrich(df, cutoff)


def enrich(ledger: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """Add normalised text ``txt`` and day ``t`` relative to the cutoff."""
    return ledger.withColumn("txt", normalize(F.col("description"))).withColumn("t", day(F.col("timestamp"), cutoff))
