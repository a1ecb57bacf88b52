"""Token counts: a broadcast table of frequent pre-tokens, worker caches for the rest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, shuffle_partitions, table

SPACE = "▁"  # how the vocabulary writes a space
#: A table has at most this many pre-tokens of at most ``KEY_CHARS`` characters,
#: so its broadcast stays below 9 MB; so does a summary of a task.
TABLE_SIZE = 1 << 15
KEY_CHARS = 64
#: Summaries that a task merges, beyond the first step.
FAN_IN = 32
#: A worker forgets its cached misses beyond this many.
CACHE_SIZE = 1 << 18
#: Characters of a text that are split at a time.
STRETCH = 1 << 20
# A pre-token begins at a line feed or at the first of some spaces.
_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")
_BEGIN = re.compile(r"\n|(?<! ) ")
_COUNTERS: dict[str, PieceCounter] = {}


def pre_tokens(text: str | None) -> Iterator[list[str]]:
    """Pre-tokens of a text, some ``STRETCH`` characters at a time.

    The text gets the space in front that the model adds; the vocabulary's own
    sign for a space counts as one, as in the model.
    """
    if not text:
        return
    text = " " + text.replace(SPACE, " ")
    at = 0
    while at < len(text):
        cut = _BEGIN.search(text, at + STRETCH)
        end = cut.start() if cut else len(text)
        yield _TOKEN.findall(text, at, end)
        at = end


class PieceCounter:
    """Lengths of pre-tokens under a sentencepiece BPE model, with a bounded cache.

    Counting pre-tokens one by one is exact if no piece of the vocabulary
    reaches over the start of a pre-token; the vocabulary is checked for that.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        crossing = [p for p in pieces if "\n" in p or SPACE in p.lstrip(SPACE)]
        kept = "".join(self.model.encode("  ﬁ", out_type=str)) == SPACE * 3 + "ﬁ"
        if crossing or not kept:  # spaces are joined, or characters exchanged, before pieces are looked up
            raise ValueError(f"{path}: pre-tokens of this vocabulary are not independent {crossing[:3]}")
        self.cache: dict[str, int] = {}

    def encoded(self, tokens: list[str]) -> list[int]:
        """Lengths by the model.  It puts a space before each text: that is the
        pre-token's own first space, or one token more before a line feed."""
        ids = self.model.encode([t[1:] if t[0] == " " else t for t in tokens], num_threads=1)
        return [len(i) - (t[0] == "\n") if t != " " else 1 for t, i in zip(tokens, ids)]

    def count(self, tokens: list[str], frequent: dict[str, int]) -> int:
        found = list(map(frequent.get, tokens))
        if None not in found:
            return sum(found)
        missed = Counter(t for t, n in zip(tokens, found) if n is None)
        total = sum(n for n in found if n is not None)
        new = [t for t in missed if t not in self.cache]
        lengths = dict(zip(new, self.encoded(new)))
        total += sum(c * (self.cache[t] if t in self.cache else lengths[t]) for t, c in missed.items())
        if len(self.cache) + len(lengths) > CACHE_SIZE:
            self.cache.clear()
        self.cache.update((t, n) for t, n in lengths.items() if len(t) <= KEY_CHARS)
        return total


def counter(vocabulary: str) -> PieceCounter:
    """The counter of a vocabulary file, once per worker process."""
    import public_tokenizers

    path = public_tokenizers.path(vocabulary)
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


class FrequentTable(NamedTuple):
    """Pre-tokens as one blob with their ends, and their lengths in tokens."""

    blob: bytes
    ends: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, tokens: list[str], lengths: list[int]) -> FrequentTable:
        keys = [t.encode() for t in tokens]
        return cls(b"".join(keys), np.cumsum([len(k) for k in keys], dtype=np.uint32), np.array(lengths, np.uint16))

    def lookup(self) -> dict[str, int]:
        starts = [0, *self.ends[:-1].tolist()] if len(self.ends) else []
        return {self.blob[a:b].decode(): n for a, b, n in zip(starts, self.ends.tolist(), self.lengths.tolist())}


def pruned(held: Counter, size: int) -> Counter:
    """A summary of at most ``size`` entries (Misra and Gries, 1982).

    The largest count that is left out is taken from all, so a token of more
    than one in ``size`` of all occurrences stays, whatever the order.
    """
    if len(held) <= size:
        return held
    counts = np.fromiter(held.values(), np.int64, len(held))
    least = int(np.partition(counts, len(counts) - size - 1)[len(counts) - size - 1])
    return Counter({t: n - least for t, n in held.items() if n > least})


SUMMARY = "tokens array<string>, counts array<bigint>"


def _summary(held: Counter, size: int) -> pa.RecordBatch:
    held = pruned(held, size)
    return pa.RecordBatch.from_arrays([pa.array([list(held)], pa.list_(pa.string())), pa.array([list(held.values())], pa.list_(pa.int64()))], ["tokens", "counts"])


def _merge(size: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for row in b.to_pylist():
                for t, n in zip(row["tokens"], row["counts"]):
                    held[t] += n
                held = pruned(held, size)
        yield _summary(held, size)

    return merge


def frequent_table(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", size: int = TABLE_SIZE, text_col: str = "text") -> FrequentTable:
    """The most frequent pre-tokens of all texts and their lengths.

    Each task sums up its texts, and summaries of at most ``size`` entries are
    merged in a tree, ``FAN_IN`` by ``FAN_IN``: no pre-token is shuffled, and
    the driver gets one summary.  Which pre-tokens it holds decides speed, never counts.
    """
    spark = session(docs)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                for tokens in pre_tokens(text.as_py()):
                    held.update(t for t in tokens if len(t) <= KEY_CHARS)
                    if len(held) > 8 * size:
                        held = pruned(held, size)
        yield _summary(held, size)

    summaries = docs.select(F.col(text_col).alias("text")).mapInArrow(summarise, SUMMARY)
    parts = shuffle_partitions(spark)
    merged = summaries.repartition(parts).mapInArrow(_merge(size), SUMMARY)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        merged = merged.repartition(parts).mapInArrow(_merge(size), SUMMARY)
    last = merged.first()
    tokens = [t for t, _ in sorted(zip(last["tokens"], last["counts"]), key=lambda x: (-x[1], x[0]))] if last else []
    return FrequentTable.of(tokens, counter(vocabulary).encoded(tokens) if tokens else [])


def count_tokens(
    docs: DataFrame,
    vocabulary: str = "piece_bpe_32k.model",
    limit: int = 4096,
    frequent: FrequentTable | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``.

    ``n_tokens`` is the length of the model's own encoding without begin or
    end.  A pre-token's length is looked up in the broadcast table of frequent
    ones (``frequent``, made from ``docs`` if not given), then in the worker's
    cache; what is in neither is encoded.  Longer pre-tokens than ``KEY_CHARS``
    are encoded each time.  Nothing is shuffled.

    A null or empty text has no bytes and no tokens; null ids and repeated rows
    are rows like others; an empty table gives no rows; other columns are not
    read.
    """
    spark = session(docs)
    shared = spark.sparkContext.broadcast(frequent or frequent_table(docs, vocabulary, text_col=text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = counter(vocabulary), shared.value.lookup()
        for b in batches:
            n = [sum(known.count(tokens, lengths) for tokens in pre_tokens(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    schema = T.StructType([rows.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    counted = rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
    return counted.withColumnRenamed("id", id_col)


def whole_counts(texts: Iterable[str | None], vocabulary: str = "piece_bpe_32k.model") -> list[int]:
    """Lengths of whole texts by the model alone: the plain version for tests."""
    return [len(counter(vocabulary).model.encode(t or "")) for t in texts]


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
