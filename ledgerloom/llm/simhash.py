"""SimHash fingerprints, exact tiled comparison and near-duplicate groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import session, space_words, table, written
from .components import connected_components

CHUNK = 65536
#: A corpus is cut into so many tiles at least, to occupy more than a few cores.
MIN_TILES = 6
#: Members of a tile.  A task compares two tiles: some 7e10 pairs, a minute or
#: two, from 25 MB of fingerprints.
TILE = 1 << 18


def shingle_hashes(words: list[bytes], shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined shingles in chunks; a short text is one shingle."""
    body = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first = end - size
    last = end[min(shingle, len(words)) - 1 :]
    for lo in range(0, len(last), CHUNK):
        spans = zip(first[lo : lo + CHUNK].tolist(), last[lo : lo + CHUNK].tolist())
        yield np.array([xxh64_intdigest(body[a:b], seed) for a, b in spans], np.uint64)


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats included; no word gives 0."""
    words, ones, n = space_words(text), np.zeros(64, np.int64), 0
    if not words:
        return 0
    for h in shingle_hashes(words, shingle, seed):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` per row, ``fp`` the fingerprint as a signed long; no shuffle."""
    session(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    schema = T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())])
    return rows.mapInArrow(scan, schema)


def _near_pairs(
    a: np.ndarray, b: np.ndarray | None, radius: int, wide: tuple[np.ndarray, np.ndarray] | None, limit: int, rows: int = 64, columns: int = 8192
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows of ``a`` and ``b`` (of ``a`` behind them if None), block by block.

    Both sides are sorted by the population count of their low half: the
    halves' differences bound the distance, so blocks too far apart are
    skipped.  A block fits the processor's cache.
    """
    half = np.uint64(0xFFFFFFFF)
    ca = np.bitwise_count(a & half).astype(np.int64)
    other, cb = (a, ca) if b is None else (b, np.bitwise_count(b & half).astype(np.int64))
    for lo in range(0, len(a), rows):
        hi = min(len(a), lo + rows)
        begin = lo if b is None else int(np.searchsorted(cb, ca[lo] - radius, "left"))
        end = int(np.searchsorted(cb, ca[hi - 1] + radius, "right"))
        for left in range(begin, end, columns):
            right = min(end, left + columns)
            r, c = np.nonzero(np.bitwise_count(a[lo:hi, None] ^ other[None, left:right]) <= radius)
            r, c = r + lo, c + left
            if b is None:
                r, c = r[c > r], c[c > r]
            if wide is not None and len(r):
                close = np.bitwise_count(wide[0][r] ^ wide[1][c]).sum(axis=1, dtype=np.int64) <= limit
                r, c = r[close], c[close]
            if len(r):
                yield r, c


def tile_forest(
    a: np.ndarray, b: np.ndarray | None, radius: int, wide: tuple[np.ndarray, np.ndarray] | None = None, limit: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers that connect what the tile pair links, under one a row.

    Rows are numbered through ``a`` and then ``b``.  With ``wide``, the further
    words of both sides, a link also needs at most ``limit`` differing bits in
    all.  A dense group costs its comparisons and no list of pairs.
    """
    half = np.uint64(0xFFFFFFFF)
    oa = np.argsort(np.bitwise_count(a & half), kind="stable")
    ob = oa if b is None else np.argsort(np.bitwise_count(b & half), kind="stable")
    shift = 0 if b is None else len(a)
    parent = np.arange(len(a) + (0 if b is None else len(b)))

    def roots(x: np.ndarray) -> np.ndarray:
        r = parent[x]
        while (parent[r] != r).any():
            r = parent[r]
        parent[x] = r
        return r

    if wide is not None:
        wide = wide[0][oa], wide[1 if b is not None else 0][ob]
    for r, c in _near_pairs(a[oa], None if b is None else b[ob], radius, wide, limit):
        r, c = oa[r], ob[c] + shift
        cuts = np.flatnonzero(np.diff(r)) + 1
        for i, js in zip(r[np.append(0, cuts)], np.split(c, cuts)):
            found = np.unique(roots(np.append(js, i)))
            parent[found[1:]] = found[0]
    label = roots(np.arange(len(parent)))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def count_bands(counts: dict[int, int], tile: int) -> list[tuple[int, int, int]]:
    """``(lowest count, highest count, tiles)`` of bands of population counts, in order.

    Neighbouring counts are joined while they hold ``tile`` members together.
    """
    bands, held = [], 0
    for c in sorted(c for c, n in counts.items() if n):
        if bands and held + counts[c] <= tile:
            bands[-1], held = (bands[-1][0], c, 1), held + counts[c]
        else:
            bands.append((c, c, -(-counts[c] // tile)))
            held = counts[c]
    return bands


def near_links(distinct: DataFrame, radius: int = 4, tile: int = TILE, wide_limit: int | None = None) -> DataFrame:
    """Edges ``(u, v)`` between nodes that connect all fingerprints within ``radius``.

    ``distinct`` holds each ``node`` once with its ``fp``; with ``wide_limit``
    also all words of a wider fingerprint, ``wide``, whose first is ``fp`` and
    which then may differ in that many bits at most.  Fingerprints are
    dealt into tiles of at most about ``tile`` members: neighbouring population counts
    share a tile while they fit, a larger count is split by hash.  Pairs of
    tiles whose counts differ by more than ``radius`` are skipped, every other
    pair is compared exactly, with numpy exclusive-or and bit counts, and
    returns at most one edge per member, not its pairs.  A fingerprint goes to
    the tiles within its radius: a dozen at most below ``MIN_TILES`` full tiles,
    beyond them one more for each further tile.  Null nodes do not occur; a
    repeated node links to itself.  The driver holds the 65 counts.
    """
    session(distinct)
    counts = dict(distinct.groupBy(F.bit_count("fp").alias("c")).count().collect())
    bands = count_bands(counts, min(tile, max(1024, -(-sum(counts.values()) // MIN_TILES))))
    if not bands:
        return distinct.sparkSession.createDataFrame([], "u long, v long")
    band_of = {c: k for k, (lo, hi, _) in enumerate(bands) for c in range(lo, hi + 1)}
    # the first and the last band that a band meets
    least = [min(k for k, b in enumerate(bands) if b[1] >= lo - radius) for lo, _, _ in bands]
    most = [max(k for k, b in enumerate(bands) if b[0] <= hi + radius) for _, hi, _ in bands]

    def lookup(values: list[int], index: str) -> str:
        return f"get(array({', '.join(f'{x}L' for x in values)}), CAST({index} AS INT))"

    splits = [b[2] for b in bands]
    # the first word of the wide fingerprint is the narrow one
    own = ["node", "fp"] if wide_limit is None else ["node", "wide"]
    mine = (
        distinct.select("*", F.expr(lookup([band_of.get(c, 0) for c in range(65)], "bit_count(fp)")).alias("p"))
        .withColumn("i", F.expr(f"pmod(xxhash64(node), {lookup(splits, 'p')})"))
    )
    size = lookup(splits, "q")
    spans = lambda lo, hi, first, keep: (
        f"flatten(transform(sequence({lo}, {hi}), q -> transform(filter(sequence(0L, {size} - 1), j -> {keep}), j -> {first})))"
    )
    home = spans("p", lookup(most, "p"), "struct(p AS p, i AS i, q AS q, j AS j, 0 AS side)", "q > p OR j >= i")
    guest = spans(lookup(least, "p"), "p", "struct(q AS p, j AS i, p AS q, i AS j, 1 AS side)", "q < p OR j < i")
    dealt = mine.select(*own, F.explode(F.expr(f"concat({home}, {guest})")).alias("t")).select(*own, "t.*")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("side")
        node = group.column("node").to_numpy()
        n = int((group.column("side").to_numpy() == 0).sum())
        words = None
        if wide_limit is None:
            fp = group.column("fp").to_numpy().view(np.uint64)
        else:
            bits = np.frombuffer(b"".join(group.column("wide").to_pylist()), np.uint64).reshape(len(node), -1)
            fp = np.ascontiguousarray(bits[:, 0])
            words = bits[:n], bits[:n] if n == len(fp) else bits[n:]
        if n == len(fp):
            same = all(group.column(x)[0] == group.column(y)[0] for x, y in (("p", "q"), ("i", "j")))
            u, v = tile_forest(fp, None if same else fp[:0], radius, words, wide_limit or 0)
        else:
            u, v = tile_forest(fp[:n], fp[n:], radius, words, wide_limit or 0)
        return pa.table({"u": pa.array(node[u], pa.int64()), "v": pa.array(node[v], pa.int64())})

    return dealt.groupBy("p", "i", "q", "j").applyInArrow(compare, "u long, v long")


def simhash_groups(
    docs: DataFrame, shingle: int = 4, radius: int = 4, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, fp, component_id)`` per row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked, and
    ``component_id`` is the smallest id reachable.  Null and word-free texts
    have fingerprint 0 and link like any other.  Null ids never name a group
    unless all its ids are null; repeated rows and ids stay.  An empty table
    gives no rows; other columns are not read.  Equal fingerprints are merged
    first, so exact copies cost one comparison however many they are.
    """
    fps = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("rep")).withColumn("node", F.col("fp")), "distinct")
    roots = connected_components(near_links(distinct, radius, tile))
    rooted = distinct.join(roots, "node", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
