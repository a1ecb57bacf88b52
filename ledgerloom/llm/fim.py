"""Fill-in-middle: cuts at token ends, found by rank in a compressed boundary set."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import session, table

# The strings that announce prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Offsets of a container share all but their low 16 bits.
SPAN = 1 << 16
_SPACES = np.zeros(0x21, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


class ArrayContainer:
    """Sorted low halves; two bytes an offset."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """One bit an offset, with the counts before each of its 1,024 words; 12 KB."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.bitwise_count(self.words).cumsum()[:-1])).astype(np.uint32)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits)[k - int(self.before[word])])


class RunContainer:
    """Starts of runs of consecutive offsets, with the counts before each."""

    def __init__(self, low: np.ndarray, starts: np.ndarray):
        self.start, self.before = low[starts].astype(np.uint16), starts.astype(np.uint32)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.start[run]) + k - int(self.before[run])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container for the sorted low halves of one span."""
    starts = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    sizes = {"array": 2 * len(low), "bitmap": 12 << 10, "runs": 6 * len(starts)}
    best = min(sizes, key=sizes.get)
    return ArrayContainer(low) if best == "array" else BitmapContainer(low) if best == "bitmap" else RunContainer(low, starts)


class BoundarySet:
    """Set of offsets with ``select``: search the containers' counts, then one container."""

    def __init__(self, spans: Iterator[tuple[int, np.ndarray]]):
        filled = [(base, low) for base, low in spans if len(low)]
        self.base = [base for base, _ in filled]
        self.containers = [container(low) for _, low in filled]
        self.before = np.cumsum([0, *(len(low) for _, low in filled)])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The ``k``-th smallest offset, counted from 0."""
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return self.base[at] + self.containers[at].select(k - int(self.before[at]))


def token_ends(text: str) -> Iterator[tuple[int, np.ndarray]]:
    """(base, low halves) of the token ends of ``text``, a span of code points at a time.

    A token ends after a character that is no white space where white space or
    the end of the text follows, and after white space that ends the text.
    """
    n = len(text)
    for base in range(0, n + 1, SPAN):
        # characters base - 1 to base + SPAN - 1; an end at p lies between p - 1 and p
        part = text[max(base - 1, 0) : base + SPAN]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        space = _SPACES[np.minimum(codes, 0x20)] & (codes <= 0x20)
        first = np.array([], bool) if base else np.array([True])
        before = np.concatenate((first, space))
        after = np.concatenate((before[1:], [True]))
        ends = ~before & after
        if base + SPAN <= n:  # the last character belongs to the next span's first end
            ends = ends[:-1]
        elif n:
            ends[-1] = True
        yield base, np.flatnonzero(ends)


def fim_output(text: str, key: str, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, prefix length, middle length, output) of one text."""
    ends = BoundarySet(token_ends(text))
    n = len(ends)
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (k and ends.select(k - 1) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(
    docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)``, one row per row of ``docs``.

    Tokens are white space with the word behind it, or white space that ends
    the text; ``n`` counts them.  SHA-256 of ``seed:id`` draws the two cuts
    (numbers of tokens) and the form: ``rate`` in a hundred texts are
    rearranged, of these ``spm_rate`` in a hundred suffix first.  Texts that
    hold one of the control strings stay plain, as do null and empty texts
    (null counts as empty).  A null id is an empty one; repeated rows are
    treated alike; an empty table gives no rows; other columns are not read.
    No shuffle.  A task holds one Arrow batch, and per text the boundary set:
    an offset costs two bytes at most (12 KB per 65,536 code points).
    """
    session(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("key"))
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [fim_output(t.as_py() or "", f"{seed}:{k.as_py() or ''}", rate, spm_rate) for t, k in zip(b.column(1), b.column(2))]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*made) if made else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    schema = T.StructType([rows.schema["id"], *(T.StructField(n, T.StringType() if n in ("form", "output") else T.LongType()) for n in names[1:])])
    return rows.mapInArrow(transform, schema).withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form") -> Column:
    """The original text from an output and its form; null where the form is unknown."""
    parts = f"split({output}, '{PREFIX}|{SUFFIX}|{MIDDLE}', -1)"
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    cases = " ".join(f"WHEN '{f}' THEN concat({', '.join(f'get({parts}, {k})' for k in ks)})" for f, ks in order.items())
    return F.expr(f"CASE {form} WHEN 'plain' THEN {output} {cases} END")


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     w AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM d),
     c AS (SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                  WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
     p AS (SELECT *, array_to_string(w[1:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m,
             array_to_string(w[greatest(a, b) + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
