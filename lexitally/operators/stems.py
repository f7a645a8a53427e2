"""Stemming as a vocabulary job: each distinct word is stemmed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.functions.stem import stem_word


def stem_vocabulary(df: DataFrame, words: Column, mode: str = "extended") -> DataFrame:
    """(word, n, stem) for every distinct word; repeats meet before the stemmer runs."""
    each = df.select(F.explode_outer(words).alias("word")).where(F.col("word").isNotNull())
    distinct = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return distinct.select("word", "n", stem_word(F.col("word"), mode).alias("stem"))


def stem_families(vocabulary: DataFrame) -> DataFrame:
    """(stem, words, n, shortest): how many words fold into each stem."""
    return vocabulary.groupBy("stem").agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"), F.min(F.length("word")).alias("shortest")
    )
