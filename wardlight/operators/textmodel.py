"""A character n-gram model that outlives the rows it was fitted on: fitted, saved in versions, loaded, applied to new rows.

Its parts are stages of Spark ML, so a whole model is one `PipelineModel` and is saved in that format. The document frequencies
are a table beside it, joined by gram; they are never gathered on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsReadable, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight import values as V
from wardlight.functions.staging import stage
from wardlight.operators import folds, models
from wardlight.session import drop_staged, staged_once


class _Settings(Params):
    keyCol = Param(Params._dummy(), "keyCol", "column that tells texts apart", TypeConverters.toString)
    textCol = Param(Params._dummy(), "textCol", "column of the texts", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of the vectors", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "length of the vectors that grams are hashed into", TypeConverters.toInt)

    def __init__(self, **given):
        super().__init__()
        self._setDefault(keyCol="msg_id", textCol="text", outputCol="features", size=1 << 18)
        self._set(**given)

    def at(self, name: str):
        return self.getOrDefault(name)


class CharTfidf(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the document frequencies of character n-grams."""

    def _fit(self, rows: DataFrame) -> CharTfidfModel:
        made = CharTfidfModel(**{name: self.at(name) for name in ("keyCol", "textCol", "outputCol", "size")})
        made.idf = staged_once(models.fitted_idf(models.document_frequency(rows, self.at("textCol")), rows.count()))
        return made


class _Writer(MLWriter):
    def __init__(self, model: CharTfidfModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.idf.write.parquet(f"{path}/data")


class _Reader(MLReader):
    def load(self, path: str) -> CharTfidfModel:
        made = CharTfidfModel()
        DefaultParamsReader.getAndSetParams(made, DefaultParamsReader.loadMetadata(path, self.sparkSession))
        made.idf = self.sparkSession.read.parquet(f"{path}/data")
        return made


class CharTfidfModel(Model, _Settings, MLWritable, MLReadable):
    """Adds a vector of weights by the document frequencies that were learned; a text without known grams gets zeros."""

    idf: DataFrame

    def weights(self, rows: DataFrame) -> DataFrame:
        """(key, at, w): places and weights of each text's known grams."""
        return models.weighted(rows, self.idf, self.at("keyCol"), self.at("textCol"), self.at("size"))

    def _transform(self, rows: DataFrame) -> DataFrame:
        key, out, size = self.at("keyCol"), self.at("outputCol"), self.at("size")
        vectors = models.ngram_vectors(self.weights(rows), key, size).withColumnRenamed("features", out)
        empty = models.sparse_vector(F.lit(size), F.array().cast("array<struct<i:int,w:double>>"))
        return rows.join(vectors, key, "left").withColumn(out, F.coalesce(out, empty))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _WeightsWriter(MLWriter):
    def __init__(self, model: CharLogisticModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        held = self.model.weights
        at = np.flatnonzero(held)
        self.sparkSession.createDataFrame([(len(held), at.tolist(), held[at].tolist())], "size int, at array<int>, w array<double>").write.parquet(f"{path}/data")


class _WeightsReader(MLReader):
    def load(self, path: str) -> CharLogisticModel:
        made, held = CharLogisticModel(), self.sparkSession.read.parquet(f"{path}/data").first()
        DefaultParamsReader.getAndSetParams(made, DefaultParamsReader.loadMetadata(path, self.sparkSession))
        made.weights = np.zeros(held["size"])
        made.weights[held["at"]] = held["w"]
        return made


def _dots(weights: np.ndarray):
    @F.udf("double")
    def dot(v):
        return float(v.values @ weights[v.indices] + weights[-1])
    return dot


def _probabilities(weights: np.ndarray):
    def run(texts: pa.Table, idf: pa.Table) -> pa.Table:
        idf, values, each = models.looked_up(texts, idf, 1)
        of, z = values[:, 0], []
        weight = of * weights[idf.column("at").to_numpy()]
        for at, n in each:
            tf = 1.0 + np.log(n)
            length = float(np.sqrt(((tf * of[at]) ** 2).sum()))
            z.append(float((tf * weight[at]).sum()) / (length or 1.0) + weights[-1])
        return pa.table({"row_": texts.column("row_"), "proba_": pa.array(1 / (1 + np.exp(-np.clip(np.array(z), -500, 500))))})
    return run


class CharLogisticModel(Model, _Settings, MLWritable, MLReadable):
    """A logistic regression on the vectors of a `CharTfidfModel`: a weight for each place and the bias. Adds `probability`."""

    weights: np.ndarray

    def _transform(self, rows: DataFrame) -> DataFrame:
        p = 1 / (1 + F.exp(-_dots(self.weights)(F.col(self.at("outputCol")))))
        return stage(rows, {"p_": p}).withColumn("probability", array_to_vector(F.array(1 - F.col("p_"), F.col("p_")))).drop("p_")

    def probabilities(self, rows: DataFrame, tfidf: CharTfidfModel, out: str) -> DataFrame:
        """What both stages give, without a vector of any text: a text goes to its block and comes back with a number."""
        blocks = models.gram_blocks(rows.select("*", F.struct(*rows.columns).alias("row_")), tfidf.at("keyCol"), tfidf.at("textCol"), ("row_",), write=lambda df: df)
        schema = T.StructType([blocks.schema["row_"], T.StructField("proba_", T.DoubleType())])
        idf = tfidf.idf.select("gram", F.array("idf").alias("idf"))
        found = models.with_grams(blocks.select("block_", "latin_", "row_"), models.block_frequency(blocks.select("block_", "latin_")), idf, tfidf.at("size"), _probabilities(self.weights), schema)
        return found.select("row_.*", F.col("proba_").alias(out))

    def write(self) -> MLWriter:
        return _WeightsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _WeightsReader()


def fit_character_model(rows: DataFrame, key: str, text: str = "text", label: str = "label", c: float = V.CHAR_C) -> PipelineModel:
    """Document frequencies and a balanced logistic regression, fitted on labelled texts with distinct keys."""
    tfidf = CharTfidf(keyCol=key, textCol=text).fit(rows)
    features = folds.text_features(rows.select(key, text, F.col(label).alias("label"), F.lit(-1).alias("fold")), key, 1, text, tfidf.at("size"))
    made = CharLogisticModel(keyCol=key, textCol=text)
    made.weights = folds.fit_folds(features, 1, tfidf.at("size"), c)[0][0]
    drop_staged(features)
    return PipelineModel([tfidf, made])


def char_proba(rows: DataFrame, model: PipelineModel, out: str = "char_proba") -> DataFrame:
    """Adds the probability that a saved or fitted model gives each text."""
    return model.stages[1].probabilities(rows, model.stages[0], out)


# ---------------------------------------------------------------- versions
def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete versions in a folder, oldest first. A version is complete once its marker stands beside it."""
    where, files = _files(spark, folder)
    names = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n.removeprefix("version=").removesuffix(".complete")) for n in names if n.endswith(".complete"))


def save_version(model: PipelineModel, folder: str, spark: SparkSession) -> int:
    """Saves a model as the next version. Readers see it only when it is whole."""
    number = max(versions(spark, folder), default=0) + 1
    model.write().overwrite().save(f"{folder}/version={number}")
    where, files = _files(spark, f"{folder}/version={number}.complete")
    files.create(where, True).close()
    return number


def load_version(spark: SparkSession, folder: str, number: int | None = None) -> PipelineModel:
    """A version of a folder, or its newest."""
    known = versions(spark, folder)
    if not known or number is not None and number not in known:
        raise ValueError(f"{folder} has no version {number or ''}".rstrip())
    return PipelineModel.load(f"{folder}/version={number or known[-1]}")
