"""Reproducible corruption of ledgers; draws follow from row hashes, not row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BACKGROUND, CONFUSED, CORRUPTION, FAMILIES, GENERIC, MCC, PREFIX_NOISE, SUFFIX_NOISE, TEMPLATES
from ..functions.numeric import draw, uniform
from .clients import fingerprints, row_text

MERCHANT_TEXTS = sorted({t for f in FAMILIES for t in TEMPLATES[f]})


def choose(values: list[str], *key, salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (draw(*key, salt=salt) % len(values) + 1).cast("int"))


def mask_descriptions(ledger: DataFrame, probability: float, seed: int, key: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """Replace merchant texts of card payments and refunds by generic ones."""
    able = F.col("type").isin("card_payment", "refund") & ~F.col("txt").rlike(BACKGROUND) & ~F.col("txt").isin(GENERIC)
    hit = able & (uniform(*key, salt=seed) < probability)
    text = F.when(hit, choose(GENERIC, *key, salt=seed + 1)).otherwise(F.col("description"))
    return ledger.withColumn("description", text).withColumn("masked", hit)


def corrupt(ledger: DataFrame, severity: str, seed: int, key: tuple[str, ...] = ("tx_id",)) -> DataFrame:
    """Mask, confuse codes, turn background into merchants, vary affixes.

    Only ``description`` and ``mcc`` change.  Background is judged on the text
    before masking, and code confusion reads the original code.
    """
    r1, r2, r3, r4 = CORRUPTION[severity]
    merchant = F.col("type").isin("card_payment", "refund") & ~F.col("txt").rlike(BACKGROUND)
    back = F.col("type").isin("card_payment", "refund") & F.col("txt").rlike(BACKGROUND)
    masked = mask_descriptions(ledger, r1, seed, key).drop("masked")
    swap = F.lit(None).cast("string")
    for source, options in CONFUSED.items():
        swap = F.when(F.col("mcc") == source, choose(options, *key, salt=seed + 8)).otherwise(swap)
    confused = merchant & (uniform(*key, salt=seed + 2) < r2) & F.col("mcc").isin(list(CONFUSED))
    planted = back & (uniform(*key, salt=seed + 3) < r3)
    varied = F.col("type").isin("card_payment", "refund") & (uniform(*key, salt=seed + 4) < r4)
    prefix, suffix = choose(PREFIX_NOISE, *key, salt=seed + 5), choose(SUFFIX_NOISE, *key, salt=seed + 6)
    text = F.when(planted, choose(MERCHANT_TEXTS, *key, salt=seed + 7)).otherwise(F.col("description"))
    return masked.withColumns(
        {"description": F.when(varied, F.concat(prefix, text, suffix)).otherwise(text), "mcc": F.when(confused, swap).otherwise(F.col("mcc"))}
    )


def corruption_view(ledger: DataFrame, scenario: str, seed: int = 2026) -> DataFrame:
    """A corrupted copy that does not depend on client ids: rows are keyed by
    the history's hash and their content, so renaming clients changes nothing
    (and equal rows of a client change alike)."""
    if scenario == "original":
        return ledger
    keyed = ledger.join(fingerprints(ledger), "client_id").withColumn("content", row_text())
    return corrupt(keyed, scenario, seed, ("history", "content")).drop("history", "content")


def merchant_codes() -> list[str]:
    return sorted(set(MCC.values()))
