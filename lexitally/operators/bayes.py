"""Multinomial Naive Bayes whose model is a pair of tables.

Fitting is aggregation, scoring is a join and a sum, so both run on any number
of executors and the vocabulary never visits the driver.

All functions take `by`, extra key columns such as `variant`: several models
are then fitted and scored in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.operators.terms import is_small, long_rows, lookup, smooth_idf, term_stats, with_totals
from lexitally.sources.stage import stage


@dataclass(frozen=True)
class NaiveBayesModel:
    """Fitted model.

    classes: one row per `by`: n_docs, normalised, log_prior_<c> for each class
    terms:   one row per (`by`, term): df, weight, log_prob_<c> for each class
    small:   True once the term table was counted and found fit to broadcast
    """

    classes: DataFrame
    terms: DataFrame
    labels: tuple[int, ...]
    by: tuple[str, ...] = ()
    small: bool = False

    def staged(self) -> NaiveBayesModel:
        """Write both tables out once, so that later jobs do not fit again."""
        return self._sized(stage(self.classes), stage(self.terms))

    def save(self, path: str) -> None:
        self.classes.write.mode("overwrite").parquet(f"{path}/classes")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")

    @classmethod
    def load(
        cls, spark: SparkSession, path: str, labels: Sequence[int] = (0, 1), by: Sequence[str] = ()
    ) -> NaiveBayesModel:
        model = cls(None, None, tuple(labels), tuple(by))
        return model._sized(spark.read.parquet(f"{path}/classes"), spark.read.parquet(f"{path}/terms"))

    def _sized(self, classes: DataFrame, terms: DataFrame) -> NaiveBayesModel:
        return replace(self, classes=classes, terms=terms, small=is_small(terms))

    def priors(self) -> DataFrame:
        """Long form: (label, n, log_prior)."""
        return _unpivot(self.classes, self.labels, self.by, n="n", log_prior="log_prior")

    def likelihoods(self) -> DataFrame:
        """Long form: (term, label, log_prob)."""
        return _unpivot(self.terms, self.labels, (*self.by, "term"), log_prob="log_prob")

    def transform(self, counted: DataFrame) -> DataFrame:
        return predict(counted, self)


def _unpivot(df: DataFrame, labels: Sequence[int], keys: Sequence[str], **columns: str) -> DataFrame:
    rows = [
        F.struct(F.lit(c).alias("label"), *[F.col(f"{stem}_{c}").alias(name) for name, stem in columns.items()])
        for c in labels
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


def class_priors(counted: DataFrame, labels: Sequence[int] = (0, 1), by: Sequence[str] = ()) -> DataFrame:
    """One row per `by`: n_docs, and per class n_<c> and the unsmoothed log prior."""
    sizes = counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.count_if(F.col("label") == c).alias(f"n_{c}") for c in labels]
    )
    priors = [F.ln(F.try_divide(f"n_{c}", "n_docs")).alias(f"log_prior_{c}") for c in labels]
    return sizes.select("*", *priors)


def fit(
    counted: DataFrame,
    weighting: str = "count",
    min_df: int | Column = 1,
    labels: Sequence[int] = (0, 1),
    alpha: float = 1.0,
    by: Sequence[str] = (),
) -> NaiveBayesModel:
    """Fit on counted documents; rows without a known label are left out."""
    if weighting not in ("count", "tfidf"):
        raise ValueError(f"unknown weighting {weighting!r}")
    by, labels = tuple(by), tuple(labels)
    counted = counted.where(F.col("label").isin(*labels))
    if weighting == "tfidf":
        counted = stage(counted)
    classes = class_priors(counted, labels, by).withColumn("normalised", F.lit(weighting == "tfidf"))
    stats = term_stats(counted, labels, min_df, by)
    if weighting == "tfidf":
        stats = _tfidf_stats(counted, stats, classes.select(*by, "n_docs"), labels, by)
    else:
        stats = stats.withColumn("weight", F.lit(1.0))

    mass = stats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_terms"), *[F.sum(f"total_{c}").alias(f"mass_{c}") for c in labels]
    )
    log_prob = [
        (F.ln(F.col(f"total_{c}") + alpha) - F.ln(F.col(f"mass_{c}") + alpha * F.col("n_terms"))).alias(
            f"log_prob_{c}"
        )
        for c in labels
    ]
    terms = with_totals(stats, mass, by).select(*by, "term", "df", "weight", *log_prob)
    return NaiveBayesModel(classes, terms, labels, by)


def _tfidf_stats(counted, stats, n_docs, labels, by) -> DataFrame:
    """Class sums of normalised TF-IDF weights.

    The weight of a term is the same in every text, so the sum over texts is
    weight x sum(tf / norm): only one norm per text has to be joined back, on
    the document key, and no weighted copy of the long table is shuffled.
    The weights are written out once, to be sized and then read twice; `counted`
    is read twice as well and comes staged.
    """
    keys = [*by, "term"]
    idf = with_totals(stats.select(*keys, "df"), n_docs, by).select(
        *keys, "df", smooth_idf(F.col("n_docs"), F.col("df")).alias("weight")
    )
    idf = stage(idf)
    rows = long_rows(counted.select(*by, "doc_id", "terms"))
    uses = idf.select(*keys, F.col("df").alias("uses"))
    weighted = lookup(rows, idf.select(*keys, "weight"), is_small(idf), keys, uses)
    square = F.col("tf") * F.col("weight") * F.col("tf") * F.col("weight")
    norms = weighted.groupBy(*by, "doc_id").agg(F.sqrt(F.sum(square)).alias("norm"))
    share = F.col("tf") / F.col("norm")
    sums = (
        long_rows(counted.join(norms, [*by, "doc_id"]))
        .groupBy(*keys)
        .agg(*[F.sum(F.when(F.col("label") == c, share).otherwise(0.0)).alias(f"sum_{c}") for c in labels])
    )
    totals = [(F.col("weight") * F.col(f"sum_{c}")).alias(f"total_{c}") for c in labels]
    return idf.join(sums, keys).select(*keys, "df", "weight", *totals)


def predict(counted: DataFrame, model: NaiveBayesModel) -> DataFrame:
    """Score every document: score_<c> per class and the `prediction`.

    Each text contributes one empty row of its own, so a text without any known
    term is still scored, by the priors, and no join back is needed. Other
    columns are carried along. A `doc_id` that two texts share is an error: their
    terms could not be told apart. A class without training texts has no prior
    and is never predicted.
    """
    labels, by = model.labels, model.by
    if not model.small and not counted.isStreaming:
        # Three parts below read it.
        counted = stage(counted)
    keep = [c for c in counted.columns if c != "terms"]
    keys = [*by, "term"]
    carried = [c for c in keep if c not in (*by, "doc_id")]
    rows = long_rows(counted.select(*by, "doc_id", "terms"))
    table = model.terms.select(*keys, "weight", *[f"log_prob_{c}" for c in labels])
    matched = lookup(rows, table, model.small, keys)

    value = F.col("tf") * F.col("weight")
    parts = matched.select(
        *by,
        "doc_id",
        *[F.lit(None).cast(counted.schema[c].dataType).alias(c) for c in carried],
        F.lit(0).alias("own"),
        (value * value).alias("square"),
        *[(value * F.col(f"log_prob_{c}")).alias(f"part_{c}") for c in labels],
    )
    own = counted.select(
        *by, "doc_id", *carried, F.lit(1).alias("own"), F.lit(0.0).alias("square"), *[F.lit(0.0).alias(f"part_{c}") for c in labels]
    )
    sums = (
        own.unionByName(parts)
        .groupBy(*by, "doc_id")
        .agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in carried],
            F.sum("own").alias("own"),
            F.sqrt(F.sum("square")).alias("norm"),
            *[F.sum(f"part_{c}").alias(f"part_{c}") for c in labels],
        )
    )
    repeated = F.raise_error(F.concat(F.lit("more than one text has the doc_id "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sums = sums.withColumn("norm", F.when(F.col("own") > 1, repeated.cast("double")).otherwise(F.col("norm")))
    # A text without known terms has norm 0 and all parts 0.
    scale = F.when(F.col("normalised") & (F.col("norm") > 0), F.col("norm")).otherwise(1.0)
    scored = with_totals(sums, model.classes.select(*by, "normalised", *[f"log_prior_{c}" for c in labels]), by)
    scored = scored.select(
        *by,
        "doc_id",
        *carried,
        *[(F.col(f"log_prior_{c}") + F.col(f"part_{c}") / scale).alias(f"score_{c}") for c in labels],
    )
    return scored.withColumn("prediction", best_class(labels))


def best_class(labels: Sequence[int], prefix: str = "score_") -> Column:
    """Class of the highest score; equal scores go to the lowest class."""
    ranked = F.array_max(
        F.array(*[F.struct(F.col(f"{prefix}{c}").alias("score"), F.lit(-c).alias("low")) for c in labels])
    )
    return (-ranked["low"]).cast("int")
