"""Projection, filtering, label encoding and corpus profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.functions.text import tokenize


def encode_label(label: Column, negative: str, positive: str) -> Column:
    """0 for the negative class, 1 for the positive one, null for anything else."""
    return F.when(label == negative, 0).when(label == positive, 1)


def drop_null_pairs(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    return df.na.drop(subset=[text, label])


def head_rows(df: DataFrame, n: int = 5, order: str = "doc_id") -> DataFrame:
    """First rows in a stated order; only the n best of each task move."""
    return df.orderBy(order).limit(n)


def split_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def class_balance(corpus: DataFrame) -> DataFrame:
    """(label, n, total, share). The total is summed over the class rows."""
    sizes = corpus.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    return sizes.select("label", "n", total.alias("total"), (F.col("n") / total).alias("share"))


def corpus_profile(corpus: DataFrame) -> DataFrame:
    """Per class: texts, null texts, and the lengths in characters and words."""
    measured = corpus.select(
        "label",
        F.col("text").isNull().alias("missing"),
        F.length("text").alias("chars"),
        F.size(tokenize(F.col("text"))).alias("words"),
    )
    return measured.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("missing").alias("n_null"),
        F.min("chars").alias("min_chars"),
        F.avg("chars").alias("avg_chars"),
        F.max("chars").alias("max_chars"),
        F.min("words").alias("min_words"),
        F.avg("words").alias("avg_words"),
        F.max("words").alias("max_words"),
    )
