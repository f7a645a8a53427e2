"""Reading and writing labelled corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexitally.operators.columns import encode_label
from lexitally.sources.split_csv import read_csv_split

# The columns of a corpus file and the two written classes.
CORPUS_SCHEMA = "rewire_id string, text string, label_sexist string, label_category string, label_vector string, split string"
CORPUS_ID = "rewire_id"
CORPUS_LABEL = "label_sexist"
CORPUS_CLASSES = ("not sexist", "sexist")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | StructType = CORPUS_SCHEMA,
    multi_line: bool = True,
    split: bool = False,
    null: str = "",
) -> DataFrame:
    """CSV with a header; quoted fields may span lines and double their quotes.

    The schema is stated, so the files are read once, and checked against the
    header. Spark's reader gives a file of such fields to one task; with `split`
    large files are read in blocks by `sources.split_csv`. Without line breaks in
    texts, `multi_line` may be False, which splits files as well.
    """
    if split:
        return read_csv_split(spark, path, schema, null=null)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", null)
        .csv(path)
    )


def as_corpus(
    df: DataFrame,
    doc_id: str = CORPUS_ID,
    label: str = CORPUS_LABEL,
    classes: tuple[str, str] = CORPUS_CLASSES,
) -> DataFrame:
    """(doc_id, text, label) with the written class encoded as 0 or 1."""
    return df.select(
        F.col(doc_id).alias("doc_id"), "text", encode_label(F.col(label), *classes).alias("label")
    )


def labelled_documents(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, text, lang, label) of the documents that carry a label.

    How the two meet is left to Spark, which knows their sizes: labels that are
    small are sent to the texts, which then stay where they are.
    """
    known = labels.select("doc_id", F.col(label).alias("label"))
    return documents.select("doc_id", "text", "lang").join(known, "doc_id")


def split_column(doc_id: Column, parts: int = 5) -> Column:
    """Hold-out split: one part in `parts` is the test side, the rest trains."""
    return F.when(F.pmod(doc_id, F.lit(parts)) == 0, "test").otherwise("train")


def with_split(corpus: DataFrame, parts: int = 5) -> DataFrame:
    return corpus.withColumn("split", split_column(F.col("doc_id"), parts))


def train_of(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("split") == "train").drop("split")


def test_of(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("split") == "test").drop("split")


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Parquet partitioned by split: fitting and scoring each read their side only."""
    corpus.write.mode("overwrite").partitionBy("split").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
