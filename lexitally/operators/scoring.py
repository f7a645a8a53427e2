"""Batch scoring with a model the caller supplies.

The model function is built once per Python worker and sees NumPy batches, so
weights are not shipped per row and no row crosses alone. Networks over token
ids get two tensors, ids and mask: the rows that reach a worker together are
put in order of length, cut into batches and padded to the longest of their own
batch only, and the results go back to the rows they belong to. Only the ids
visit Python; all other columns stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType

from lexitally.functions.text import clean_words, empty_if_null, truncate_tokens

BATCH_SIZE = 16
MAX_TOKENS = 128
PAD, START = 0, 1
# Ids below this are the model's own signs.
FIRST_ID = 2


def argmax(scores: Column) -> Column:
    """Position of the largest score; equal scores go to the lowest position."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def score_vectors(
    df: DataFrame,
    make_model: Callable[[], Callable],
    width: int,
    vector: str = "embedding",
    batch_size: int = BATCH_SIZE,
    return_type=ArrayType(FloatType()),
) -> DataFrame:
    """Add `scores` and `prediction`. The model maps [n, width] to [n, classes]."""
    score = predict_batch_udf(
        make_model, return_type=return_type, batch_size=batch_size, input_tensor_shapes=[[width]]
    )
    return df.withColumn("scores", score(F.col(vector))).withColumn("prediction", argmax(F.col("scores")))


def score_texts(
    df: DataFrame,
    make_model: Callable[[], Callable],
    text: str = "text",
    batch_size: int = BATCH_SIZE,
    max_tokens: int | None = None,
) -> DataFrame:
    """Add `scores` and `prediction` from a model over strings.

    The model gets the whole text and truncates by its own tokens. With
    `max_tokens`, texts are cut here after that many words.
    """
    value = empty_if_null(F.col(text))
    if max_tokens is not None:
        value = F.array_join(truncate_tokens(clean_words(value), max_tokens), " ")
    score = predict_batch_udf(make_model, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn("scores", score(value)).withColumn("prediction", argmax(F.col("scores")))


def embed_texts(
    df: DataFrame,
    make_model: Callable[[], Callable],
    text: str = "text",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add `embedding`, one vector per text, from a model over strings."""
    embed = predict_batch_udf(make_model, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return df.withColumn("embedding", embed(empty_if_null(F.col(text))))


def hashed_ids(tokens: Column, buckets: int, max_tokens: int = MAX_TOKENS) -> Column:
    """Token ids without a vocabulary: the start sign, then hashes of the words, `max_tokens` ids at most."""
    ids = F.transform(
        truncate_tokens(tokens, max_tokens - 1),
        lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(buckets)) + FIRST_ID,
    )
    return F.concat(F.array(F.lit(START).cast("long")), F.coalesce(ids, F.array().cast("array<bigint>")))


def token_model(
    make_model: Callable[[], Callable],
    pooling: str | None = None,
    batch_size: int = BATCH_SIZE,
    return_type: DataType = ArrayType(FloatType()),
    pad: int = PAD,
) -> Callable[[Column], Column]:
    """A column function from token ids to the output of a network over padded batches.

    The network maps ids [n, width] and mask [n, width] to [n, outputs]. With
    `pooling` it gives [n, width, outputs], which is reduced to a vector per row
    inside the batch: "first" takes that of the first token, "mean" the average
    over the tokens that are not padding. Null ids count as none.
    """
    if pooling not in (None, "first", "mean"):
        raise ValueError(f"unknown pooling {pooling!r}")

    def of_batch(model: Callable, rows: list[np.ndarray]) -> np.ndarray:
        width = max(1, max(map(len, rows)))
        ids = np.full((len(rows), width), pad, dtype=np.int64)
        mask = np.zeros((len(rows), width), dtype=np.int64)
        for i, row in enumerate(rows):
            ids[i, : len(row)] = row
            mask[i, : len(row)] = 1
        out = np.asarray(model(ids, mask))
        if pooling == "first":
            return out[:, 0]
        if pooling == "mean":
            count = np.maximum(mask.sum(axis=1, keepdims=True), 1)
            return (out * mask[:, :, None]).sum(axis=1) / count
        return out

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for series in batches:
            rows = [np.zeros(0, dtype=np.int64) if ids is None else np.asarray(ids) for ids in series]
            order = np.argsort([len(r) for r in rows], kind="stable")
            found: list = [None] * len(rows)
            for at in range(0, len(rows), batch_size):
                part = order[at : at + batch_size]
                for i, out in zip(part.tolist(), of_batch(model, [rows[i] for i in part]), strict=True):
                    found[i] = out
            yield pd.Series(found, dtype=object)

    # Given as objects: the annotations above are text, and this module need not be installed on the workers.
    apply.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(apply, returnType=return_type)


def score_tokens(
    df: DataFrame,
    ids: Column,
    make_model: Callable[[], Callable],
    batch_size: int = BATCH_SIZE,
    return_type: DataType = ArrayType(DoubleType()),
) -> DataFrame:
    """Add `scores` and `prediction` of a network that maps (ids, mask) to [n, classes]."""
    score = token_model(make_model, None, batch_size, return_type)
    return df.withColumn("scores", score(ids)).withColumn("prediction", argmax(F.col("scores")))


def embed_tokens(
    df: DataFrame,
    ids: Column,
    make_model: Callable[[], Callable],
    pooling: str = "first",
    batch_size: int = BATCH_SIZE,
    return_type: DataType = ArrayType(DoubleType()),
) -> DataFrame:
    """Add `embedding`, one vector per row, from a network that maps (ids, mask) to [n, tokens, width]."""
    return df.withColumn("embedding", token_model(make_model, pooling, batch_size, return_type)(ids))
