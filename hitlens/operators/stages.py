"""Stages of Spark ML pipelines around the column expressions, so that a whole chain is one stored object.

A stored stage names its class, so this package must be importable where a pipeline is loaded.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.feature import HashingTF, OneHotEncoderModel, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitlens.operators.embed import add_path_tokens, embed_paths, fit_path_embedding
from hitlens.operators.enrich import accept_class
from hitlens.operators.features import PATH_GRAM, SITE_BUCKETS, SITE_FEATURES, add_site_terms


class SiteTerms(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Path n-grams and query keys of a request as one array."""

    n = Param(Params._dummy(), "n", "characters of an n-gram", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, n=PATH_GRAM, outputCol="url_features"):
        super().__init__()
        self._setDefault(n=PATH_GRAM, outputCol="url_features")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return add_site_terms(dataset, self.getOrDefault(self.n), self.getOutputCol())


class SiteLabel(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Label of the most probable class where it is sure enough, else ``other``; drops the columns ``dropped``."""

    labels = Param(Params._dummy(), "labels", "labels by class", TypeConverters.toListString)
    threshold = Param(Params._dummy(), "threshold", "a label needs more than this", TypeConverters.toFloat)
    dropped = Param(Params._dummy(), "dropped", "columns left out of the result", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, labels=(), threshold=0.70, dropped=(), inputCol="probability", outputCol="prediction_domain"):
        super().__init__()
        self._setDefault(labels=[], threshold=0.70, dropped=[], inputCol="probability", outputCol="prediction_domain")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        chances = vector_to_array(F.col(self.getInputCol()))
        label = accept_class(chances, self.getOrDefault(self.labels), self.getOrDefault(self.threshold))
        return dataset.withColumn(self.getOutputCol(), label).drop(*self.getOrDefault(self.dropped))


def site_pipeline(
    indexer: StringIndexerModel,
    encoder: OneHotEncoderModel,
    classifier: Model,
    labels: list[str],
    threshold: float = 0.70,
    n: int = PATH_GRAM,
    buckets: int = SITE_BUCKETS,
) -> PipelineModel:
    """From extracted requests to ``prediction_domain``; rows of a method that was not trained are skipped.

    Adds method_index, method_onehot, features, probability, prediction and prediction_domain.
    """
    terms, hashed = "url_features", "hash_url_features"
    return PipelineModel(
        [
            indexer.copy().setHandleInvalid("skip"),
            encoder,
            SiteTerms(n=n, outputCol=terms),
            HashingTF(inputCol=terms, outputCol=hashed, numFeatures=buckets),
            VectorAssembler(inputCols=SITE_FEATURES, outputCol="features"),
            classifier,
            SiteLabel(labels=list(labels), threshold=threshold, dropped=[terms, hashed, "rawPrediction"]),
        ]
    )


class PathTokens(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Classified tokens of path and query keys."""

    @keyword_only
    def __init__(self, *, outputCol="url_features"):
        super().__init__()
        self._setDefault(outputCol="url_features")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return add_path_tokens(dataset, self.getOutputCol())


class _VectorParams(HasInputCol, HasOutputCol):
    size = Param(Params._dummy(), "size", "components of a vector", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(inputCol="url_features", outputCol="url_embedding", size=100)


class PathVectors(Estimator, _VectorParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns word vectors of token arrays; the model stays a table, no vocabulary reaches the driver."""

    minCount = Param(Params._dummy(), "minCount", "occurrences a token needs", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "of the first vectors", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="url_features", outputCol="url_embedding", size=100, minCount=5, seed=1):
        super().__init__()
        self._setDefault(minCount=5, seed=1)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PathVectorsModel:
        size = self.getOrDefault(self.size)
        vectors = fit_path_embedding(
            dataset,
            self.getInputCol(),
            size,
            self.getOrDefault(self.minCount),
            seed=self.getOrDefault(self.seed),
        )
        return self._copyValues(PathVectorsModel(vectors))


class PathVectorsModel(Model, _VectorParams, MLReadable, MLWritable):
    """Adds the mean vector of each row's tokens; unknown tokens and rows without any count as zero."""

    VECTORS = "word string, vector array<double>"

    def __init__(self, vectors: DataFrame | None = None):
        super().__init__()
        self.vectors = vectors

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return embed_paths(
            dataset, self.vectors, self.getInputCol(), self.getOrDefault(self.size), self.getOutputCol()
        )

    def write(self) -> MLWriter:
        return _VectorsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _VectorsReader()


class _VectorsWriter(MLWriter):
    def __init__(self, model: PathVectorsModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.vectors.write.parquet(f"{path}/vectors")


class _VectorsReader(MLReader):
    def load(self, path: str) -> PathVectorsModel:
        told = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        vectors = self.sparkSession.read.schema(PathVectorsModel.VECTORS).parquet(f"{path}/vectors")
        model = PathVectorsModel(vectors)._resetUid(told["uid"])
        DefaultParamsReader.getAndSetParams(model, told)
        return model
