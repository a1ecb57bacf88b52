"""Near-duplicate groups: SimHash finds candidates, shingle sets decide.

256 bits of SimHash keep unrelated texts apart at any corpus size.  Their
first 64 are compared tile by tile as in :mod:`simhash`, the others where those
are near, with room for the estimate's error.  Candidates form loose groups;
within each, exact Jaccard similarities link the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_dir, numbered, session, shuffle_partitions, space_words, written
from .components import connected_components
from .simhash import TILE, near_links, shingle_hashes

WIDE = 4
#: Bits of sets up to so many shingles tie often: they differ up to ``SHORT_TIES``
#: times as much as the angle says (four shingles within five: 0.1875 to 0.1515).
SHORT = 16
SHORT_TIES = 1.25
#: Odd multipliers and rounds of the splitmix64 generator.
GOLDEN = 0x9E3779B97F4A7C15
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; empty without a word."""
    words = space_words(text)
    return np.unique(np.concatenate(list(shingle_hashes(words, shingle)))) if words else np.zeros(0, np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WIDE`` 64-bit words of a shingle set; the empty set has zeros."""
    ones = np.zeros((WIDE, 64), np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = hashes[lo : lo + (1 << 14)]
        for k in range(WIDE):
            z = part + np.uint64(GOLDEN * (k + 1) % 2**64)
            z = (z ^ (z >> np.uint64(30))) * MIX[0]
            z = (z ^ (z >> np.uint64(27))) * MIX[1]
            z ^= z >> np.uint64(31)
            bits = np.unpackbits(z.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def distance_limit(similarity: float, bits: int, slack: float = 4.5, ties: float = 1.0) -> int:
    """Differing bits that two sets of this Jaccard similarity hardly exceed.

    Their vectors have the cosine 2J / (1 + J), a bit differs with probability
    angle / pi times ``ties``, and ``slack`` standard deviations are added.
    """
    p = min(0.5, ties * math.acos(2 * similarity / (1 + similarity)) / math.pi)
    return math.ceil(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def jaccard_forest(a: list[np.ndarray], b: list[np.ndarray] | None, similarity: float) -> tuple[list[int], list[int]]:
    """Pairs of row numbers (through ``a``, then ``b``) that connect all similar sets.

    The sets of one side are indexed by element, so a row finds what it has in
    common with all of them at once, exactly.  A row with few entries in the
    index looks at these.  One with more of them than there are rows first asks
    which possible partners are not connected to it yet, and compares itself
    with these alone where they are fewer: a dense group costs little more than
    its members, and unlike sets what they share.
    """
    sets = [*a, *(b or [])]
    shift = 0 if b is None else len(a)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    label, members = np.arange(len(sets)), [[k] for k in range(len(sets))]
    other = size[shift:]
    whole, begin = np.concatenate([*sets[shift:], np.zeros(0, np.uint32)]), np.cumsum(other) - other
    order = np.argsort(whole, kind="stable")
    element, owner = whole[order], np.repeat(np.arange(len(sets) - shift), other)[order]
    spread = lambda lo, n: np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
    us, vs = [], []
    asked, ends = np.concatenate([*a, np.zeros(0, np.uint32)]), np.cumsum(size[: len(a)])
    lows = np.searchsorted(element, asked, "left")
    counts = np.searchsorted(element, asked, "right") - lows
    total = np.diff(np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], ends))])
    # a row that only finds itself has no partner
    for i in np.flatnonzero(total > (size[: len(a)] if b is None else 0)).tolist():
        hits, first = int(total[i]), i + 1 if b is None else 0
        lo, n = lows[ends[i] - size[i] : ends[i]], counts[ends[i] - size[i] : ends[i]]
        if hits >= len(other):
            may = (label[shift:] != label[i]) & (np.minimum(size[i], other) >= similarity * np.maximum(size[i], other))
            may[:first] = False
            js = np.flatnonzero(may)
            if not len(js):
                continue
            if other[js].sum() < hits:
                near = whole[spread(begin[js], other[js])]
                same = sets[i][np.minimum(np.searchsorted(sets[i], near), size[i] - 1)] == near
                both = np.bincount(np.repeat(np.arange(len(js)), other[js]), same, len(js))
            else:
                both = np.bincount(owner[spread(lo, n)], minlength=len(other))[js]
        else:
            js, both = np.unique(owner[spread(lo, n)], return_counts=True)
            keep = (js >= first) & (label[js + shift] != label[i])
            js, both = js[keep], both[keep]
        js = js[both + 1e-9 >= similarity * (size[i] + other[js] - both)] + shift
        if not len(js):
            continue
        found, one = np.unique(label[js], return_index=True)
        us += [i] * len(found)
        vs += js[one].tolist()
        joined = sorted({int(label[i]), *found.tolist()}, key=lambda x: len(members[x]))
        for x in joined[:-1]:  # the smaller ones take the label of the largest
            label[members[x]] = joined[-1]
            members[joined[-1]] += members[x]
            members[x] = []
    return us, vs


def similar_links(path: str, loose: DataFrame, similarity: float, unit_shingles: int = 4_000_000) -> DataFrame:
    """Edges between the nodes of each loose group that connect all similar sets.

    ``loose`` has ``root, node, n, at``: the node's number of shingles and its
    row in the written fingerprints below ``path``.  A group is dealt, by hash,
    into parts of about ``unit_shingles`` hashes, and each pair of its parts is
    a unit of its own: memory is bounded however large a group is.  Shingles
    are read where they lie and move only for loose groups, once to each unit.
    No loose group gives no edges.
    """
    spark = session(loose)
    sizes = loose.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / unit_shingles), F.lit(1)).alias("parts"))
    placed = (
        loose.join(sizes, "root")
        .select("root", "node", "parts", F.pmod(F.xxhash64("node"), "parts").alias("i"), "at.file", "at.row")
        .repartition(shuffle_partitions(spark), "file")
        .sortWithinPartitions("file", "row")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pafs.FileSystem.from_uri(path)
        name, groups, held = None, None, None
        for b in batches:
            files, wanted = b.column(4).to_pylist(), b.column(5).to_numpy()
            found: list[bytes] = []
            for file, row in zip(files, wanted.tolist()):
                if file != name:
                    name, groups = file, pq.ParquetFile(fs.open_input_file(f"{folder}/{file}"))
                    ends = np.cumsum([groups.metadata.row_group(g).num_rows for g in range(groups.num_row_groups)])
                    held = None
                g = int(np.searchsorted(ends, row, "right"))
                if g != held:
                    held, column = g, groups.read_row_group(g, ["shingles"]).column(0)
                found.append(column[row - int(ends[g]) + len(column)].as_py())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, pa.binary())], [*b.schema.names[:4], "shingles"])

    schema = T.StructType([*placed.schema.fields[:4], T.StructField("shingles", T.BinaryType())])
    units = F.expr(
        "transform(sequence(0L, parts - 1), j -> if(j >= i, struct(i AS i, j AS j, 0 AS side), struct(j AS i, i AS j, 1 AS side)))"
    )
    dealt = placed.mapInArrow(read, schema).select("root", "node", "shingles", F.explode(units).alias("t")).select("root", "node", "shingles", "t.*")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("side")
        node = group.column("node").to_numpy()
        n = int((group.column("side").to_numpy() == 0).sum())
        sets = [np.frombuffer(x, np.uint32) for x in group.column("shingles").to_pylist()]
        u, v = jaccard_forest(sets[:n], None if group.column("i")[0] == group.column("j")[0] else sets[n:], similarity)
        return pa.table({"u": pa.array(node[u], pa.int64()), "v": pa.array(node[v], pa.int64())})

    return dealt.groupBy("root", "i", "j").applyInArrow(compare, "u long, v long")


def near_duplicate_groups(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, stamp, node, component)`` per row; ``stamp`` hashes the text.

    Two texts are linked if the Jaccard similarity of their shingle sets is
    ``similarity`` or more (hashes of 32 bits stand for shingles) and SimHash
    puts them into one loose group, which by the binomial model it does for all
    but about one pair in ten thousand at the limit and for practically all
    above it; within a loose group no pair is left out.  Groups are the
    components of the links.  Null texts and texts without a word are one
    group.  Repeated rows and null ids stay; an empty table gives no rows;
    other columns are not read.
    """
    spark = session(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("stamp"), F.col(text_col).cast("binary").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, wide, shingles = [], [], []
            for t in b.column(2):
                hashes = shingle_set(t.as_py(), shingle)
                words = wide_fingerprint(hashes)
                first.append(int(words.view(np.int64)[0]))
                wide.append(words.tobytes())
                shingles.append(np.unique(hashes.astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(first, pa.int64()), pa.array(wide, pa.binary()), pa.array(shingles, pa.binary())],
                ["id", "stamp", "fp", "wide", "shingles"],
            )

    kinds = (("fp", T.LongType()), ("wide", T.BinaryType()), ("shingles", T.BinaryType()))
    schema = T.StructType([*rows.schema.fields[:2], *(T.StructField(n, t) for n, t in kinds)])
    scanned = rows.mapInArrow(scan, schema).withColumn("node", F.xxhash64("shingles")).withColumn("n", F.octet_length("shingles") / 4)
    path = f"{fresh_dir(spark, 'fingerprints')}/t"
    scanned.write.option("compression", "zstd").parquet(path)
    prints = spark.read.schema(scanned.schema).parquet(path)
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    distinct = written(
        prints.select("node", "fp", "wide", "n", at.alias("at")).groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "wide", "n")], F.min("at").alias("at")),
        "distinct",
    )
    near = lambda d, ties: near_links(
        d, distance_limit(similarity, 64, ties=ties), tile, wide_limit=distance_limit(similarity, 64 * WIDE, ties=ties)
    )
    groups = connected_components(near(distinct, 1.0).unionByName(near(distinct.where(F.col("n") <= SHORT), SHORT_TIES)))
    loose = written(groups.join(distinct.select("node", "n", "at"), "node"), "loose")
    roots = connected_components(similar_links(path, loose, similarity))
    return prints.select("id", "stamp", "node").join(roots, "node", "left").select(
        "id", "stamp", "node", F.coalesce("root", "node").alias("component")
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay if one of each group of near duplicates does.

    It is the row with the smallest id (a null id only if there is no other; of
    rows with one id and different texts, the one whose text hashes lowest).
    A row that repeats id and text stays once, with the other columns of any of
    its rows.  Null texts and texts without a word are one group; an empty
    table gives no rows; all columns pass through, whatever their names.
    """
    rows, at = numbered(docs)
    id_, text = at(id_col), at(text_col)
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    groups = written(near_duplicate_groups(rows, id_col=id_, text_col=text, **options), "groups")
    texts = groups.groupBy("component", key("id").alias("id_key"), "stamp").agg(
        F.first(F.struct(F.col("id").isNull().alias("none"), "id", "stamp")).alias("k")
    )
    best = texts.groupBy("component").agg(F.min("k").alias("best"), F.count("*").alias("texts")).where("texts > 1")
    gone = written(texts.join(best, "component").where("k <> best").select("id_key", "stamp"), "gone")
    # the exchange that finds repeated rows has the keys of the anti join
    once = rows.withColumn("id_key", key(id_)).withColumn("stamp", F.xxhash64(text)).dropDuplicates(["id_key", "stamp"])
    return once.join(gone, ["id_key", "stamp"], "left_anti").drop("id_key", "stamp").toDF(*docs.columns)
