"""The classifier as ML pipeline stages."""

import math
from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from lexitally.functions import text as tx
from lexitally.operators.pipeline import TermBayesModel, fit_pipeline, text_classifier
from lexitally.plans import catalog
from lexitally.plans import variants as vs
from lexitally.streaming.classify import classify_stream_pipeline, read_scored

SMALL = "/root/testdata/sf0.001"
WORDS = "doc_id string, words array<string>, label int, label_given map<string,int>"


def by_hand(train, test, labels=(0, 1)):
    """Predictions of the multinomial model in plain Python; ties to the lower class."""
    train = [r for r in train if r[2] in labels]
    sums = {c: Counter(w for r in train if r[2] == c for w in r[1] or ()) for c in labels}
    vocabulary = set().union(*sums.values())
    size = Counter(r[2] for r in train)
    out = {}
    for key, words, *_ in test:
        scores = {}
        for c in labels:
            if size[c]:
                scores[c] = math.log(size[c] / len(train)) + sum(
                    math.log(sums[c][w] + 1) - math.log(sum(sums[c].values()) + len(vocabulary)) for w in words or () if w in vocabulary
                )
        out[key] = max(scores, key=lambda c: (scores[c], -c))
    return out


@pytest.fixture(scope="module")
def rows():
    return [
        ("a", ["x", "x", "y"], 0, {"k": 1}),
        ("b", ["y", "z"], 1, None),
        ("c", None, 1, {}),
        ("d", ["z", "z", "q"], 1, {"k": 2}),
        ("e", ["x"], 0, None),
        ("f", ["q"], 7, None),
    ]


def test_matches_plain_python(spark, rows):
    frame = spark.createDataFrame(rows, WORDS)
    test = [("t1", ["x", "y"], None, {"m": 1}), ("t2", ["z"], None, None), ("t3", ["unseen"], None, None), ("t4", None, None, None)]
    scored = fit_pipeline(frame).transform(spark.createDataFrame(test, WORDS))
    assert {r.doc_id: r.prediction for r in scored.collect()} == by_hand(rows, test)
    assert {r.doc_id: r.label_given for r in scored.collect()} == {t[0]: t[3] for t in test}
    assert set(frame.columns) < set(scored.columns)


def test_twin_of_the_tables(spark):
    train, test = catalog.split_corpus(spark, SMALL)
    words = lambda df: df.select("doc_id", "label", tx.tokenize(F.col("text")).alias("words"))
    found = fit_pipeline(words(train)).transform(words(test)).select("doc_id", "score_0", "score_1", "prediction")
    wanted = vs.predict_variant(train, test, vs.variant("C1")).select(found.columns)
    as_rows = lambda df: sorted((r.doc_id, round(r.score_0, 6), round(r.score_1, 6), r.prediction) for r in df.collect())
    assert as_rows(found) == as_rows(wanted)


@pytest.mark.parametrize("weighting", ["count", "tfidf"])
def test_saved_and_loaded(spark, rows, tmp_path, weighting):
    frame = spark.createDataFrame(rows, WORDS)
    estimator = text_classifier(weighting=weighting, predictionCol="guess", labels=(0, 1))
    estimator.write().overwrite().save(str(tmp_path / "estimator"))
    model = estimator.fit(frame)
    model.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert isinstance(again.stages[-1], TermBayesModel) and again.stages[-1].uid == model.stages[-1].uid
    assert again.stages[-1].getOrDefault("weighting") == weighting
    assert sorted(map(str, again.transform(frame).collect())) == sorted(map(str, model.transform(frame).collect()))


def test_class_without_rows(spark, rows):
    zeros = [r for r in rows if r[2] == 0]
    frame = spark.createDataFrame(zeros, WORDS)
    scored = fit_pipeline(frame).transform(spark.createDataFrame(rows, WORDS)).collect()
    assert [r.prediction for r in scored] == [0] * len(rows)
    assert all(r.score_1 is None and r.score_0 is not None for r in scored)
    nothing = fit_pipeline(frame.limit(0)).transform(frame)
    assert [r.prediction for r in nothing.collect()] == [0, 0]


def test_repeated_key_is_an_error(spark, rows):
    frame = spark.createDataFrame([*rows, rows[0]], WORDS)
    with pytest.raises(Exception, match="more than one text has the doc_id a"):
        fit_pipeline(frame).transform(frame).collect()


def test_vocabulary_above_a_million(spark):
    """Every text has 120 words of its own and one word of its class: more terms than a driver list should hold."""
    docs, own = 10_000, 120
    words = F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(own - 1)), lambda i: F.concat(F.lit("w"), F.col("id") * own + i)),
        F.array(F.concat(F.lit("class"), F.col("id") % 2)),
    )
    frame = spark.range(docs).select(F.col("id").alias("doc_id"), words.alias("words"), (F.col("id") % 2).cast("int").alias("label"))
    model = fit_pipeline(frame)
    assert model.stages[-1].tables.terms.count() == docs * own + 2 > 1 << 20
    assert not model.stages[-1].tables.small
    test = spark.range(200).select("id", F.array(F.concat(F.lit("class"), F.col("id") % 2), F.lit("unseen")).alias("words"))
    scored = model.transform(test.withColumnRenamed("id", "doc_id"))
    assert scored.where(F.col("prediction") == F.col("doc_id") % 2).count() == 200


def test_stream_without_texts(spark, rows, tmp_path):
    model = fit_pipeline(spark.createDataFrame(rows, WORDS))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(WORDS).parquet(str(tmp_path / "in"))
    job = classify_stream_pipeline(stream, model, str(tmp_path / "sink"), str(tmp_path / "state"))
    job.awaitTermination()
    assert read_scored(spark, str(tmp_path / "sink")).collect() == []
