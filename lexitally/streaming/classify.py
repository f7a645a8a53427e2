"""Scoring new texts as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexitally.operators.bayes import NaiveBayesModel, predict


def classify_stream(
    texts: DataFrame,
    model: NaiveBayesModel,
    count: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Score a stream of texts with the table model and append to Parquet.

    `count` turns texts into counted documents. Every micro-batch overwrites
    the folder of its own number, so a batch that is run again after a failure
    leaves its rows once.
    """

    def score(batch: DataFrame, number: int) -> None:
        predict(count(batch), model).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return _started(texts, score, checkpoint, trigger)


def classify_stream_pipeline(
    texts: DataFrame, model: PipelineModel, sink: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Score a stream with a fitted ML pipeline, batch by batch as `classify_stream` does."""

    def score(batch: DataFrame, number: int) -> None:
        scored = model.transform(batch).select("doc_id", "prediction")
        scored.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return _started(texts, score, checkpoint, trigger)


def read_scored(spark: SparkSession, sink: str, key: str = "string") -> DataFrame:
    """(doc_id, prediction) of all batches written so far; a stream without any text has no rows."""
    schema = f"doc_id {key}, prediction int"
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(sink).select("doc_id", "prediction")


def _started(texts: DataFrame, score: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        texts.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
