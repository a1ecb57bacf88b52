"""Sequence packing: shortest pack first over the histogram of piece lengths."""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import session, table, written

END_ID = 1
SPECIAL = "<|endoftext|>"
_ENCODERS: dict[tuple[str, str], object] = {}


class Encoder:
    """Ids of a byte-level BPE, as its ``tokenizers`` file gives them.

    tiktoken runs the same vocabulary about four times as fast and gives the
    same ids; texts that hold the special token's string, which only the file
    knows, go through ``tokenizers``, which is loaded with the first of them.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if SPECIAL in text:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def encoder(vocabulary: str) -> Encoder:
    """The encoder of a vocabulary name, once per worker process."""
    import public_tokenizers

    key = (public_tokenizers.path(f"{vocabulary}.json"), public_tokenizers.path(f"{vocabulary}.tiktoken"))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns ``(lengths, count)`` for a histogram of lengths.

    Lengths are placed longest first, each into the open packs with the most
    room.  Without room new packs open; lengths that then fill a pack several
    times over are put together.  All steps move counts, never single pieces.
    """
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            space = max((s for s in room if s >= length and room[s]), default=0)
            if space:
                pattern, count = room[space].pop()
                used = min(count, left)
                if used < count:
                    room[space].append((pattern, count - used))
                room[space - length].append((pattern + (length,), used))
                left -= used
                continue
            per_pack = min(capacity // length, left)
            used = left // per_pack
            room[capacity - per_pack * length].append(((length,) * per_pack, used))
            left -= used * per_pack
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for packs in room.values():
        for pattern, count in packs:
            merged[pattern] += count
    return sorted(merged.items(), reverse=True)


class Placement:
    """Runs of ranks per length: rank to sequence and offset by bisection."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        taken: dict[int, int] = defaultdict(int)
        runs, sequence = [], 0
        for pattern, count in patterns:
            at = 0
            for length in pattern:
                runs.append((length << 44 | taken[length], sequence, at))
                taken[length] += count
                at += length
            sequence += count
        runs.sort()
        self.key, self.sequence, self.offset = (np.array(c, np.int64) for c in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
        self.sequences = sequence

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << 44) | rank
        k = np.searchsorted(self.key, key, "right") - 1
        return self.sequence[k] + (key - self.key[k]), self.offset[k]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, then the rest."""
    return [(s, min(capacity, n - s)) for s in range(0, n, capacity)]


def pieces(docs: DataFrame, capacity: int, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """Tokenized pieces with their rank among those of equal length and task."""
    session(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, ranks = encoder(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            made = []
            for k, text in enumerate(b.column(1)):
                ids = np.append(enc.ids(text.as_py()), np.uint32(END_ID)).astype("<u4")
                for start, length in cut(len(ids), capacity):
                    made.append((k, start, length, zlib.crc32(ids[start : start + length]), len(ids), part, ranks[length]))
                    ranks[length] += 1
            table_ = np.array(made, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(table_[:, 0])), *map(pa.array, table_[:, 1:].T)], names)

    schema = T.StructType([rows.schema["id"], *(T.StructField(n, T.LongType()) for n in names[1:])])
    return rows.mapInArrow(tokenize, schema)


def pack_documents(
    docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and the end id; longer ones are cut every
    ``capacity`` ids.  The driver sees the histogram only (``capacity`` rows at
    most).  A piece's rank among equal lengths is its rank in its task plus the
    counts of the tasks before, so no length, however common, is gathered in a
    task.  A null or empty text is its end id alone; repeated rows and null ids
    are packed like others; an empty table gives no rows; other columns are
    not read.
    """
    table_ = written(pieces(docs, capacity, vocabulary, id_col, text_col), "pieces")
    counts = table_.groupBy("part", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = Placement(shortest_pack_first(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = table_.join(base, ["part", "length"]).select(
        "id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.place(b.column(2).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    schema = T.StructType([*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id_col)


def op6_sequence_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
