"""The classifier as stages of a Spark ML pipeline whose model is a pair of tables.

The library's own vectoriser keeps its vocabulary on the driver, and its Naive
Bayes a dense matrix of it. Here the fitted stage holds the term table and the
class table of `operators.bayes`, so a vocabulary of any size stays distributed,
also when it is saved and loaded. Streams are scored batch by batch, by
`streaming.classify`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol
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

from lexitally.functions.text import count_terms
from lexitally.operators.bayes import NaiveBayesModel, fit, predict


class TermCounter(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """An array of terms to an array of (term, tf), each distinct term once. Null is an empty text."""

    @keyword_only
    def __init__(self, *, inputCol: str = "words", outputCol: str = "terms"):
        super().__init__()
        self._setDefault(inputCol="words", outputCol="terms")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        words = F.coalesce(F.col(f"`{self.getInputCol()}`"), F.array().cast("array<string>"))
        return dataset.withColumn(self.getOutputCol(), count_terms(F.filter(words, lambda w: w.isNotNull())))


class _TermBayesParams(HasLabelCol, HasPredictionCol):
    termsCol = Param(Params._dummy(), "termsCol", "array of (term, tf)", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "unique key of a text", TypeConverters.toString)
    weighting = Param(Params._dummy(), "weighting", "count or tfidf", TypeConverters.toString)
    minDF = Param(Params._dummy(), "minDF", "texts a term has to be in", TypeConverters.toInt)
    alpha = Param(Params._dummy(), "alpha", "what every count is raised by", TypeConverters.toFloat)
    labels = Param(Params._dummy(), "labels", "the classes", TypeConverters.toListInt)

    def _with_defaults(self) -> None:
        self._setDefault(
            termsCol="terms", idCol="doc_id", labelCol="label", predictionCol="prediction",
            weighting="count", minDF=1, alpha=1.0, labels=[0, 1],
        )


class TermBayes(Estimator, _TermBayesParams, DefaultParamsReadable, DefaultParamsWritable):
    """Multinomial Naive Bayes on counted terms; rows of other classes or none are left out.

    A class without any row keeps a null prior and is never predicted.
    """

    @keyword_only
    def __init__(
        self,
        *,
        termsCol: str = "terms",
        idCol: str = "doc_id",
        labelCol: str = "label",
        predictionCol: str = "prediction",
        weighting: str = "count",
        minDF: int = 1,
        alpha: float = 1.0,
        labels: Sequence[int] = (0, 1),
    ):
        super().__init__()
        self._with_defaults()
        self._set(**{k: list(v) if k == "labels" else v for k, v in self._input_kwargs.items()})

    def _fit(self, dataset: DataFrame) -> TermBayesModel:
        g = self.getOrDefault
        counted = dataset.select(
            F.col(f"`{g('idCol')}`").alias("doc_id"),
            F.col(f"`{g('labelCol')}`").alias("label"),
            F.col(f"`{g('termsCol')}`").alias("terms"),
        )
        tables = fit(counted, g("weighting"), g("minDF"), g("labels"), g("alpha")).staged()
        return self._copyValues(TermBayesModel(tables))


class TermBayesModel(Model, _TermBayesParams, MLReadable, MLWritable):
    """The fitted tables. Adds score_<class> and the prediction; all other columns stay.

    The key of a text has to be unique; a repeated one is an error.
    """

    def __init__(self, tables: NaiveBayesModel | None = None):
        super().__init__()
        self._with_defaults()
        self.tables = tables

    def _transform(self, dataset: DataFrame) -> DataFrame:
        g = self.getOrDefault
        key, terms, out = g("idCol"), g("termsCol"), g("predictionCol")
        # Columns travel under neutral names, so that none clashes with those of the scoring.
        names = {c: f"_in{i}" for i, c in enumerate(dataset.columns)}
        rows = dataset.select(
            F.col(f"`{key}`").alias("doc_id"),
            F.col(f"`{terms}`").alias("terms"),
            *[F.col(f"`{c}`").alias(n) for c, n in names.items() if c != key],
        )
        scored = predict(rows, self.tables)
        columns = [F.col("doc_id" if c == key else n).alias(c) for c, n in names.items()]
        scores = [f"score_{c}" for c in self.tables.labels]
        return scored.select(*columns, *scores, F.col("prediction").alias(out))

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class _TableWriter(MLWriter):
    def __init__(self, model: TermBayesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.tables.save(f"{path}/tables")


class _TableReader(MLReader):
    def __init__(self, cls: type[TermBayesModel]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> TermBayesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.tables = NaiveBayesModel.load(self.sparkSession, f"{path}/tables", model.getOrDefault("labels"))
        return model


def text_classifier(terms: str = "words", label: str = "label", min_df: int = 1, labels: Sequence[int] = (0, 1), **settings) -> Pipeline:
    """Counting and Naive Bayes as one estimator over an array column of terms."""
    bayes = TermBayes(labelCol=label, minDF=min_df, labels=list(labels), **settings)
    return Pipeline(stages=[TermCounter(inputCol=terms, outputCol=bayes.getOrDefault("termsCol")), bayes])


def fit_pipeline(train: DataFrame, terms: str = "words", label: str = "label", min_df: int = 1, labels: Sequence[int] = (0, 1), **settings) -> PipelineModel:
    """Fit counts and Naive Bayes on an array column of terms."""
    return text_classifier(terms, label, min_df, labels, **settings).fit(train)
