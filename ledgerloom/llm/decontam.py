"""Benchmark decontamination by a prefix-filtered containment join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from .common import alnum_words, numbered, session, table, written

WINDOW = 10
SHINGLE = 3
#: The bitmap that tasks look shingles up in before the join has sixteen bits a
#: shingle and at most this many (32 MB); beyond that more shingles pass it that
#: the join then drops.
MAX_BITS = 28
#: Words of an item that a task holds as windows at a time.
STRETCH_WORDS = 100_000
#: Odd multiplier of the shingle codes.
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64)


def shingle_codes(hashes: np.ndarray, s: int) -> np.ndarray:
    """64-bit codes of the ``s``-word shingles of a sequence, other ones for each ``s``."""
    n = max(len(hashes) - s + 1, 0)
    code = np.full(n, s, np.uint64)
    for k in range(s):
        code = code * MIX + hashes[k : k + n]
    return code.view(np.int64)


def benchmark_windows(benchmark: DataFrame, window: int, shingle: int, item_col: str, text_col: str, words: int = STRETCH_WORDS) -> DataFrame:
    """``(item, n, text, codes)``: the windows of all items with the codes of their shingles.

    An item of fewer words than ``window`` is one window; items without a word
    have none.  Long items are cut into stretches that share ``window - 1``
    words, so every window is made once.
    """
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    names = ["item", "n", "text", "codes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1)):
                every = alnum_words(text.as_py())
                for k in range(0, max(len(every) - window + 1, min(1, len(every))), words):
                    ws = every[k : k + words + window - 1]
                    n = min(window, len(ws))
                    codes = shingle_codes(word_hashes(ws), min(shingle, n))
                    width = n - min(shingle, n) + 1
                    texts = [b" ".join(ws[i : i + n]).decode() for i in range(len(ws) - n + 1)]
                    spread = codes[np.arange(len(texts))[:, None] + np.arange(width)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, spread.size + 1, width), pa.int32()), pa.array(spread.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(texts), pa.string()), pa.array([n] * len(texts), pa.int32()), pa.array(texts), lists], names)

    return rows.mapInArrow(cut, "item string, n int, text string, codes array<bigint>")


class CodeFilter:
    """Bitmap of codes, looked up before the join: three bits a code.

    Its size follows the number of codes up to ``2**MAX_BITS`` bits.  A code
    that is not among them may pass; the join decides.
    """

    def __init__(self, codes: DataFrame):
        count = codes.count()
        self.bits = int(min(max(count * 16, 1 << 12), 1 << MAX_BITS)).bit_length()
        self.bits = min(self.bits, MAX_BITS)
        place = lambda shift: F.shiftrightunsigned("code", shift) if shift else F.col("code")
        at = F.explode(F.array(*[place(k).bitwiseAND((1 << self.bits) - 1) for k in self.shifts()])).alias("at")
        word = F.shiftright("at", 6)
        set_ = codes.select(at).groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits"))
        found = set_.toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.int64)
        self.words[found["word"].to_numpy()] = found["bits"].to_numpy()

    def shifts(self) -> tuple[int, int, int]:
        """Where in a code its three places in the bitmap begin."""
        return 0, 18, 64 - self.bits

    def passing(self, codes: np.ndarray) -> np.ndarray:
        """The places of codes that may be known."""
        u, keep = codes.view(np.uint64), np.ones(len(codes), bool)
        for shift in self.shifts():
            at = ((u >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            keep &= (self.words[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return np.flatnonzero(keep)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list[bytes]], np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Per batch the words of its texts (column 0), the hashes of all and where each text starts."""
    for b in batches:
        words = [alnum_words(t.as_py()) for t in b.column(0)]
        yield words, word_hashes(chain.from_iterable(words)), np.cumsum([0, *map(len, words)]), b


def _inside(codes: np.ndarray, first: np.ndarray, s: int) -> np.ndarray:
    """Whether the shingle at each place lies in one text."""
    at = np.arange(len(codes))
    return first[np.searchsorted(first, at, "right")] >= at + s if len(codes) else np.zeros(0, bool)


def shingle_counts(texts: DataFrame, known: CodeFilter, sizes: list[int]) -> DataFrame:
    """``(code, n)``: occurrences in all texts of the shingles that pass the bitmap."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, first, _ in _hashed(batches):
            for s in sizes:
                codes = shingle_codes(hashes, s)
                at = shared.value.passing(codes)
                code, n = np.unique(codes[at[_inside(codes, first, s)[at]]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    return texts.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``(code, at, n, window)``: each window's rarest shingle, the first on ties, and its place.

    A window occurs only where all its shingles do, so its prefix in the order
    of rarity needs one token.
    """
    each = windows.select("text", "n", F.posexplode("codes").alias("at", "code"))
    rarity = F.struct(F.coalesce("times", F.lit(0)).alias("times"), "at")
    counted = each.join(counts.select("code", F.col("n").alias("times")), "code", "left")
    best = counted.groupBy("text").agg(F.min_by(F.struct("code", "at", "n"), rarity).alias("p"))
    return best.select("p.code", "p.at", "p.n", F.col("text").alias("window"))


def prefix_places(texts: DataFrame, known: CodeFilter, sizes: list[int], window: int) -> DataFrame:
    """``(digest, mark, code, place, before, context)``: where prefixes may stand in texts.

    ``context`` has the words that windows over the place can reach, ``before``
    the number of those in front of it.  Texts go by their digest: what is
    found depends on the text alone, so equal texts share it.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known)
    names = ["digest", "mark", "code", "place", "before", "context"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, hashes, first, b in _hashed(batches):
            digests: dict[int, bytes] = {}
            for s in sizes:
                codes = shingle_codes(hashes, s)
                at = shared.value.passing(codes)
                at = at[_inside(codes, first, s)[at]]
                doc = np.searchsorted(first, at, "right") - 1
                made: list[tuple] = []
                for d, p, code in zip(doc.tolist(), (at - first[doc]).tolist(), codes[at].tolist()):
                    if d not in digests:
                        digests[d] = text_digest(b.column(0)[d].as_py())
                    before = min(p, window - 1)
                    made.append((digests[d], mark_of(digests[d]), code, p, before, b" ".join(words[d][p - before : p + window]).decode()))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [()] * 6, kinds)], names)

    return texts.mapInArrow(find, "digest binary, mark long, code long, place long, before int, context string")


def text_digest(text: bytes | None) -> bytes:
    return hashlib.blake2b(text or b"", digest_size=16).digest()


def mark_of(digest: bytes) -> int:
    """Half of a digest as a number, for the bitmap."""
    return int.from_bytes(digest[:8], "little", signed=True)


def occurrences(places: DataFrame, prefix: DataFrame) -> DataFrame:
    """``(digest, mark, start, end, window)``: occurrences of windows, compared word by word.

    A hash join on the prefix; the positions bound where a window may begin
    and end, and its words are compared as text.  A hot prefix is split by the
    adaptive skew join, for the side of the windows is small at any code.
    """
    words = F.split("context", " ")
    near = places.join(prefix, "code").where((F.col("at") <= F.col("before")) & (F.col("before") - F.col("at") + F.col("n") <= F.size(words)))
    same = near.where(F.array_join(F.slice(words, F.col("before") - F.col("at") + 1, F.col("n")), " ") == F.col("window"))
    return same.select("digest", "mark", (F.col("place") - F.col("at")).alias("start"), (F.col("place") - F.col("at") + F.col("n")).alias("end"), "window").distinct()


def merged_spans(found: DataFrame) -> DataFrame:
    """``(digest, spans)``: the ranges of words that occurrences cover, those that touch merged."""
    order = Window.partitionBy("digest").orderBy("start", "end")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.coalesce(F.col("start") > upto, F.lit(True))).cast("int")
    ranges = found.select("digest", "start", "end").distinct().withColumn("fresh", fresh)
    parts = ranges.withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = parts.groupBy("digest", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """``(id, n_words, spans, items)`` per row of ``docs``.

    ``spans`` are the word ranges [start, end) covered by occurrences of item
    windows (``window`` consecutive words; the whole item if it is shorter),
    merged and in order; ``items`` the ids, as sorted strings, of the items
    whose windows occur.  Null texts have no words; items without words have
    no window; windows of items with a null id count in ``spans`` only;
    repeated rows stay, repeated items count once; an empty table gives no
    rows, an empty benchmark no spans; other columns are not read, but those
    named in ``keep`` pass through in place of the id, whatever their names.

    Shingles are ordered by their rarity in all texts.  The documents are read
    four times whatever the benchmark's size: to count its shingles, to find
    the places of the windows' prefixes, and to give the rows with and without
    occurrences.  What is joined are these places, so work grows with the
    documents and with what they share with the benchmark, not with the
    product of both; only rows with occurrences are shuffled.
    """
    session(docs)
    rows, at = numbered(docs)
    texts = rows.select(F.col(at(text_col)).cast("binary").alias("text"))
    made = written(benchmark_windows(benchmark, window, shingle, item_col, item_text_col), "windows")
    sizes = sorted(r[0] for r in made.select(F.least("n", F.lit(shingle))).distinct().collect())
    windows = made.groupBy("text").agg(F.first("n").alias("n"), F.first("codes").alias("codes"))
    counts = shingle_counts(texts, CodeFilter(made.select(F.explode("codes").alias("code")).distinct()), sizes)
    prefix = written(prefixes(windows, counts), "prefixes")
    places = prefix_places(texts, CodeFilter(prefix.select("code").distinct()), sizes, window)
    found = written(occurrences(places, prefix), "occurrences")
    owners = made.where("item IS NOT NULL").select(F.col("text").alias("window"), "item").distinct()
    items = found.select("digest", "window").distinct().join(owners, "window").groupBy("digest").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = merged_spans(found).join(items, "digest", "left")

    kept = [id_col] if keep is None else keep
    carried = rows.select(F.col(at(text_col)).cast("binary").alias("text"), *(F.col(at(c)).alias(f"_{k}") for k, c in enumerate(kept)))
    names = [*carried.columns[1:], "n_words", "digest", "maybe"]
    shared = docs.sparkSession.sparkContext.broadcast(CodeFilter(found.select(F.col("mark").alias("code")).distinct()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [t.as_py() for t in b.column(0)]
            digests = [text_digest(t) for t in raw]
            maybe = np.zeros(len(raw), bool)
            maybe[shared.value.passing(np.array([mark_of(d) for d in digests], np.int64))] = True
            columns = [pa.array([len(alnum_words(t)) for t in raw], pa.int64()), pa.array(digests, pa.binary()), pa.array(maybe)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *columns], names)

    kinds = (("n_words", T.LongType()), ("digest", T.BinaryType()), ("maybe", T.BooleanType()))
    every = carried.mapInArrow(measured, T.StructType([*carried.schema.fields[1:], *(T.StructField(n, t) for n, t in kinds)]))
    # rows without an occurrence do not move, whatever they carry
    joined = every.where("maybe").join(hits, "digest", "left").select(*names[:-2], "spans", "items")
    made = joined.unionByName(every.where("NOT maybe").select(*names[:-2]), allowMissingColumns=True)
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return made.select(
        *names[:-2], none("spans", "array<struct<start:bigint,end:bigint>>"), none("items", "array<string>")
    ).toDF(*kept, "n_words", "spans", "items")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)").alias("n_hit"),
        F.expr("CAST(size(items) AS BIGINT)").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP9_SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
     s AS (SELECT item_id, w, least({WINDOW}, length(w)) AS n FROM i WHERE length(w) > 0),
     v AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS x FROM (SELECT *, unnest(range(1, length(w) - n + 2)) AS k FROM s)),
     d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     p AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS x
           FROM (SELECT doc_id, w, n, unnest(range(1, length(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v) WHERE length(w) >= n)),
     m AS (SELECT p.doc_id, p.k, p.n, v.item_id FROM p JOIN v ON p.n = v.n AND p.x = v.x),
     h AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS q FROM m) GROUP BY doc_id),
     t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, length(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
