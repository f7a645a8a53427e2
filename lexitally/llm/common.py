"""Helpers several operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.functions.text import let
from lexitally.sources.stage import stage

__all__ = ["ASCII_LOWER", "WORD", "bounded", "join_split", "let", "lower_ascii", "plain", "ship", "stage", "table", "whole_text", "words_of"]

# A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

Query = Callable[[SparkSession, str], DataFrame]


def ship(df: DataFrame) -> DataFrame:
    """Let Spark carry this package to the Python workers, once per session.

    Caches of a worker live in its modules, so functions have to be imported
    there. The archive is the driver's own file; Spark sends it to executors.
    """
    bounded(df.sparkSession)
    context = df.sparkSession.sparkContext
    if any(os.path.basename(f) == "lexitally.zip" for f in context.listFiles):
        return df
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="lexitally-"), "lexitally.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    return df


# Bytes and rows that wait in one batch to Python or in one row group of a written table, per task.
BOUNDS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20,
    "spark.sql.execution.arrow.maxRecordsPerBatch": 4_096,
    "parquet.block.size": 32 << 20,
}


def bounded(spark: SparkSession) -> None:
    """Lower these settings of the session to the bounds, so that long texts do not fill a task's memory."""
    for name, most in BOUNDS.items():
        given = spark.conf.get(name, None)
        if given is None or not given.isdigit() or not 0 < int(given) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with all but the `keep` columns under neutral names, and the way back.

    So a column of a table may have any name, also one that an operator uses.
    """
    names = {c: c if c in keep else f"_c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return renamed, lambda df: df.select(*[F.col(n).alias(c) for c, n in names.items()])


def whole_text(text: str | Column = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: str | Column = "text") -> Column:
    return F.regexp_extract_all(whole_text(text), F.lit(WORD), F.lit(0))


def lower_ascii(value: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# A key is heavy from 1/HEAVY of all rows on, so at most HEAVY keys are.
HEAVY = 10_000


def join_split(rows: DataFrame, table: DataFrame, key: str, n: str = "n", heavy: int = HEAVY) -> DataFrame:
    """Inner join of staged rows with a staged table of one row per key, where `n` counts the rows of the key.

    The few heavy keys are broadcast, `heavy` rows at most, and their rows stay
    where they are; the rows of all other keys meet by a shuffle that is even.
    """
    total = table.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    is_heavy = F.col(n) * heavy >= total
    near = rows.join(F.broadcast(table.where(is_heavy).drop(n)), key)
    far = rows.join(F.broadcast(table.where(is_heavy).select(key)), key, "left_anti").join(table.where(~is_heavy).drop(n), key)
    return near.unionByName(far)
