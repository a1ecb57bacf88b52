"""Licence scan by a positional rare-token index."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, session, table

# Phrases whose every occurrence is reported, with their labels.
BASE_PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
# Notices and short texts of common licences, as words.  Double
# brackets enclose the key phrases that a match must contain word by word.
NOTICES = [
    ("agpl", "licensed under the [[gnu affero general public license]] version 3"),
    ("apache", "licensed under the [[apache license]] version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "[[redistribution and use in source and binary forms]] with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a [[creative commons attribution]] 4 0 international license"),
    ("cc-by-nc", "licensed under [[cc by nc]] 4 0"),
    ("cc-by-nd", "licensed under [[cc by nd]] 4 0"),
    ("cc-by-sa", "licensed under [[cc by sa]] 4 0"),
    ("cc0", "[[cc0 1 0 universal]] public domain dedication"),
    ("epl", "made available under the terms of the [[eclipse public license]] 2 0"),
    ("gpl", "this work is licensed under the [[gnu general public license]] version 3"),
    ("isc", "[[permission to use copy modify and or distribute this software]] for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the [[gnu lesser general public license]] version 2 1"),
    ("mit", "[[permission is hereby granted free of charge]] to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the [[mit license]]"),
    ("mpl", "this source code form is subject to the terms of the [[mozilla public license]] v 2 0"),
    ("unlicense", "this is [[free and unencumbered software]] released into the public domain"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "[[to deal in the software without restriction]] including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind "
        "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the "
        "authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
        "connection with the software or the use or other dealings in the software",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
        "and this permission notice appear in all copies the software is provided as is and the [[author disclaims all warranties with regard to this software]] "
        "including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential "
        "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising "
        "out of or in connection with the use or performance of this software",
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[redistributions in binary form "
        "must reproduce]] the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with "
        "the distribution",
    ),
    (
        "apache",
        "unless required by applicable law or agreed to in writing software [[distributed under the license is distributed on an as is basis]] without warranties or "
        "conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the [[gnu general public license as published by the free software "
        "foundation]] either version 3 of the license or at your option any later version",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of "
        "this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it "
        "freely subject to the following restrictions [[the origin of this software must not be misrepresented]]",
    ),
]

MATCH = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("base", T.BooleanType()),
        T.StructField("start", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)


class LicenseIndex:
    """Templates with token postings, rarity from document frequencies.

    A template's key words are mandatory, so each occurrence holds its two
    rarest key words at their distance: the rarest finds the template, the
    second is intersected with it by relative position.
    """

    def __init__(
        self, phrases: Iterable[tuple[str, str]] = BASE_PHRASES, notices: Iterable[tuple[str, str]] = NOTICES,
        files: int = 0, frequency: dict[bytes, int] | None = None,
    ):
        """``frequency``: how many of ``files`` texts hold a word (none: all alike)."""
        self.templates = [(label, True, *self._parse(f"[[{text}]]")) for label, text in phrases]
        self.templates += [(label, False, *self._parse(text)) for label, text in notices]
        self.vocabulary = frozenset(w for _, _, words, _ in self.templates for w in words)
        frequency = frequency or {}
        self.idf = {w: math.log((2 + files) / (1 + frequency.get(w, 0))) for w in self.vocabulary}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.second: list[int] = []
        for k, (_, _, words, keys) in enumerate(self.templates):
            by_rarity = sorted(keys, key=lambda p: (-self.idf[words[p]], p))
            self.postings.setdefault(words[by_rarity[0]], []).append((k, by_rarity[0]))
            self.second.append(by_rarity[min(1, len(by_rarity) - 1)])
        self.weight = [sum(self.idf[w] for w in words) for _, _, words, _ in self.templates]
        self.tokens = frozenset(self.postings) | {self.templates[k][2][p] for k, p in enumerate(self.second)}

    @staticmethod
    def _parse(text: str) -> tuple[list[bytes], list[int]]:
        words: list[bytes] = []
        keys: list[int] = []
        for k, part in enumerate(re.split(r"\[\[|\]\]", text)):
            found = alnum_words(part.encode())
            if k % 2:
                keys += range(len(words), len(words) + len(found))
            words += found
        if not keys:
            raise ValueError(f"template without key phrase: {text!r}")
        return words, keys

    def scan(self, words: list[bytes]) -> list[tuple[str, bool, int, float]]:
        """Matches (label, base, start of the first key word, score), in order.

        The score is the share of the template's rarity that stands in place.
        """
        at: dict[bytes, list[int]] = {w: [] for w in self.tokens.intersection(words)}
        if not at:
            return []
        for i, w in enumerate(words):
            if w in at:
                at[w].append(i)
        out = []
        # the file's licence words, rarest first: those that are the rarest of a template lead to it
        for token in sorted(self.postings.keys() & at.keys(), key=lambda w: (-self.idf[w], w)):
            for k, p in self.postings[token]:
                label, base, body, keys = self.templates[k]
                q = self.second[k]
                if body[q] not in at:
                    continue
                for s in {i - p for i in at[token]}.intersection(i - q for i in at[body[q]]):
                    if s + keys[0] < 0 or s + keys[-1] >= len(words) or any(words[s + x] != body[x] for x in keys):
                        continue
                    hit = sum(self.idf[b] for x, b in enumerate(body) if 0 <= s + x < len(words) and words[s + x] == b)
                    out.append((label, base, s + keys[0], min(1.0, hit / self.weight[k])))
        return sorted(out)


def fitted_index(docs: DataFrame, text_col: str = "text", **templates) -> LicenseIndex:
    """An index whose rarity is that of the words in ``docs``.

    One aggregation over all rows counts the texts that hold each word of the
    templates; the driver gets a row per such word, never per document.
    """
    session(docs)
    vocabulary = LicenseIndex(**templates).vocabulary
    rows = docs.select(F.col(text_col).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for b in batches:
            total[b""] = total.get(b"", 0) + b.num_rows
            for text in b.column(0):
                for w in vocabulary.intersection(alnum_words(text.as_py())):
                    total[w] = total.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counts = rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequency = {bytes(r["word"]): r["n"] for r in counts.collect()}
    return LicenseIndex(**templates, files=frequency.pop(b"", 0), frequency=frequency)


def find_licenses(docs: DataFrame, index: LicenseIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words`` and ``matches``.

    ``matches`` lists (label, base, start word, score), sorted.  Without an
    ``index`` one is fitted to ``docs``, which are then read twice.  A null
    text has no words; null and repeated ids pass through unchanged; an empty
    table gives no rows; other columns of ``docs`` are not read, whatever
    their name.  No shuffle of texts: each row is scanned where it is read,
    and the index holds only the templates, never the data.  Memory follows
    the longest text.
    """
    session(docs)
    index = index or fitted_index(docs, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType(
        [rows.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(MATCH))]
    )
    match_type = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, found = [], []
            for text in b.column(1):
                words = alnum_words(text.as_py())
                counts.append(len(words))
                found.append([dict(zip(("label", "base", "start", "score"), m)) for m in index.scan(words)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(found, match_type)], ["id", "n_words", "matches"]
            )

    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"))
    base = "filter(matches, m -> m.base)"
    names = "array_join(array_sort(array_distinct(transform({}, m -> m.label))), ',')"
    return found.select(
        "doc_id",
        "n_words",
        F.expr(f"CAST(size({base}) AS BIGINT)").alias("n_base"),
        F.expr(f"array_min(transform({base}, m -> m.start))").alias("first_word"),
        F.expr(f"array_max(transform({base}, m -> m.start))").alias("last_word"),
        F.expr(names.format(base)).alias("base_labels"),
        F.expr(names.format("matches")).alias("labels"),
        F.expr("coalesce(array_max(transform(matches, m -> m.score)), 0D)").alias("score"),
    )
