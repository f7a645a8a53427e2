import numpy as np
import pytest

from lexitally.operators.scoring import embed_texts, score_texts
from lexitally.plans import catalog
from lexitally.plans.experiment import run
from lexitally.sources import corpus as src
from lexitally.streaming.classify import classify_stream_pipeline

SMALL = "/root/testdata/sf0.001"
HEADER = "rewire_id,text,label_sexist,label_category,label_vector,split\n"


@pytest.fixture
def files(tmp_path):
    train = tmp_path / "train.csv"
    train.write_text(
        HEADER
        + 'a1,"good ""good"" day",not sexist,none,none,train\n'
        + 'a2,"good\nnight, friends",not sexist,none,none,train\n'
        + "a3,bad day,sexist,x,y,train\n"
        + "a4,bad,other,x,y,train\n"
    )
    test = tmp_path / "test.csv"
    test.write_text(HEADER + "b1,bad bad,sexist,x,y,test\nb2,,not sexist,none,none,test\nb3,good,not sexist,none,none,test\n")
    return str(train), str(test)


def test_csv(spark, files):
    rows = {r.doc_id: r for r in src.as_corpus(src.read_csv(spark, files[0])).collect()}
    assert rows["a1"].text == 'good "good" day' and rows["a2"].text == "good\nnight, friends"
    assert [rows[k].label for k in ("a1", "a2", "a3", "a4")] == [0, 0, 1, None]


@pytest.mark.parametrize("name", ["C1", "C3", "C5"])
def test_experiment(spark, files, name):
    report = run(spark, *files, name)
    assert report.splitlines()[1].startswith(name) and "accuracy: 1.00000" in report


def test_corpus_table_prunes_by_split(spark, tmp_path):
    both = src.with_split(catalog.corpus(spark, SMALL))
    src.write_corpus(both, str(tmp_path))
    stored = src.read_corpus(spark, str(tmp_path))
    assert stored.count() == both.count()
    test = src.test_of(stored)
    assert test.count() == both.where("split = 'test'").count()
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def length_model():
    def make_model():
        def score(texts):
            sizes = np.array([[len(t.split())] for t in texts], dtype=np.float32)
            return np.hstack([2.5 - sizes, sizes - 2.5])

        return score

    return make_model


def test_text_scoring(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, "one"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.prediction for r in score_texts(df, length_model()).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    cut = {r.doc_id: r.prediction for r in score_texts(df, length_model(), max_tokens=2).collect()}
    assert cut == {1: 0, 2: 0, 3: 0}
    assert len(embed_texts(df, length_model()).first().embedding) == 2


def test_stream_equals_batch(spark):
    rows = lambda df: sorted((r.doc_id, r.prediction) for r in df.collect())
    assert rows(catalog.classify_new_texts_stream(spark, SMALL)) == rows(catalog.classify_new_texts(spark, SMALL))


def test_pipeline_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from lexitally.functions.text import tokenize
    from lexitally.operators.pipeline import fit_pipeline

    words = lambda df: df.withColumn("words", tokenize(F.col("text"))).select("doc_id", "words")
    train = catalog.corpus(spark, SMALL).withColumn("words", tokenize(F.col("text")))
    model = fit_pipeline(train)
    batch = words(catalog.new_texts(catalog.table(spark, SMALL, "conversations")))
    schema = catalog.table(spark, SMALL, "conversations").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "conversations.parquet").parquet(SMALL)
    job = classify_stream_pipeline(words(catalog.new_texts(stream)), model, str(tmp_path / "s"), str(tmp_path / "c"))
    job.awaitTermination()
    got = {r.doc_id: r.prediction for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert got == {r.doc_id: int(r.prediction) for r in model.transform(batch).collect()}


def test_staged_tables_are_packed(spark):
    from lexitally.sources.stage import stage

    staged = stage(spark.range(10))
    assert staged.count() == 10 and all(f.endswith(".zstd.parquet") for f in staged.inputFiles())
