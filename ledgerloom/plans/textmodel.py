"""TF-IDF with sublinear counts as a stage of Spark ML pipelines."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Columns(HasInputCol, HasOutputCol):
    minDF = Param(Params._dummy(), "minDF", "documents that a term must be in", TypeConverters.toInt)
    vocabSize = Param(Params._dummy(), "vocabSize", "terms to keep at most", TypeConverters.toInt)


class SublinearTfidf(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the vocabulary and the rarity of terms from a column of term arrays.

    Kept are the ``vocabSize`` most frequent terms of at least ``minDF``
    documents, by their occurrences, then by name; that bounds what the driver
    and each worker hold.  Null arrays have no terms.
    """

    @keyword_only
    def __init__(self, *, inputCol: str = "terms", outputCol: str = "features", minDF: int = 2, vocabSize: int = 30_000):
        super().__init__()
        self._setDefault(minDF=2, vocabSize=30_000, inputCol="terms", outputCol="features")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SublinearTfidfModel:
        numbered = dataset.select(F.monotonically_increasing_id().alias("row"), F.col(self.getInputCol()).alias("terms"))
        rows = numbered.select("row", F.explode("terms").alias("term"))
        each = rows.groupBy("row", "term").count().groupBy("term").agg(F.count("*").alias("docs"), F.sum("count").alias("n"))
        kept = each.where(F.col("docs") >= self.getOrDefault(self.minDF)).orderBy(F.desc("n"), "term").limit(self.getOrDefault(self.vocabSize)).collect()
        total = dataset.count()
        model = SublinearTfidfModel([r["term"] for r in kept], [math.log((1 + total) / (1 + r["docs"])) + 1 for r in kept])
        return self._copyValues(model)


class SublinearTfidfModel(Model, _Columns, MLReadable, MLWritable):
    """Vectors of ``(1 + ln n) * idf`` of length one; unknown terms do not count."""

    def __init__(self, vocabulary: list[str] | None = None, idf: list[float] | None = None):
        super().__init__()
        self._setDefault(minDF=2, vocabSize=30_000, inputCol="terms", outputCol="features")
        self.vocabulary, self.idf = vocabulary or [], idf or []

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Vectors are made by Arrow batches; a worker holds the vocabulary, ``vocabSize`` terms."""
        shared = dataset.sparkSession.sparkContext.broadcast({t: (k, w) for k, (t, w) in enumerate(zip(self.vocabulary, self.idf))})
        size, place, out = len(self.vocabulary), dataset.columns.index(self.getInputCol()), self.getOutputCol()
        schema = T.StructType([*dataset.schema.fields, T.StructField(out, VectorUDT())])

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for b in batches:
                indices, values = [], []
                for terms in b.column(place).to_pylist():
                    counts = Counter(known[t] for t in terms or () if t in known)
                    found = sorted((k, (1 + math.log(n)) * w) for (k, w), n in counts.items())
                    length = math.sqrt(sum(w * w for _, w in found))
                    indices.append([k for k, _ in found])
                    values.append([w / length for _, w in found])
                n = len(indices)
                parts = [pa.array([0] * n, pa.int8()), pa.array([size] * n, pa.int32()), pa.array(indices, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))]
                made = pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, out])

        return dataset.mapInArrow(vectors, schema)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: SublinearTfidfModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        rows = list(zip(range(len(self.model.vocabulary)), self.model.vocabulary, self.model.idf))
        self.sparkSession.createDataFrame(rows, "k int, term string, idf double").coalesce(1).write.parquet(f"{path}/vocabulary")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SublinearTfidfModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        rows = self.sparkSession.read.parquet(f"{path}/vocabulary").orderBy("k").collect()
        model = self.cls([r["term"] for r in rows], [r["idf"] for r in rows])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
