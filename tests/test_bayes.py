import math

import pytest
from pyspark.sql import functions as F

from lexitally.functions.text import tokenize
from lexitally.operators import terms
from lexitally.operators.bayes import NaiveBayesModel, fit, predict
from lexitally.operators.lexical import discriminative_words
from lexitally.plans import catalog
from lexitally.plans import variants as vs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def train(spark):
    rows = [(1, "good good day", 0), (2, "good night", 0), (3, "bad day", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def counted(df):
    return vs.counted(df, vs.variant("C1"))


def table(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_hand_made_model(train):
    model = fit(counted(train))
    priors = {r.label: r.log_prior for r in model.priors().collect()}
    assert priors == pytest.approx({0: -0.405465, 1: -1.098612}, abs=1e-6)
    wanted = {
        ("bad", 0): -2.197225, ("day", 0): -1.504077, ("good", 0): -0.810930, ("night", 0): -1.504077,
        ("bad", 1): -1.098612, ("day", 1): -1.098612, ("good", 1): -1.791759, ("night", 1): -1.791759,
    }
    found = {(r.term, r.label): r.log_prob for r in model.likelihoods().collect()}
    assert found == pytest.approx(wanted, abs=1e-6)


@pytest.mark.parametrize("staged", [False, True])
def test_hand_made_scores(spark, train, staged):
    rows = [(1, "bad bad night", 1), (2, "unknown", 0), (3, "", None), (4, None, 1)]
    test = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = fit(counted(train))
    model = model.staged() if staged else model
    assert model.small is staged
    got = table(predict(counted(test), model), "doc_id")
    assert (got[1].score_0, got[1].score_1) == pytest.approx((-6.303992, -5.087596), abs=1e-6)
    assert [got[i].prediction for i in (1, 2, 3, 4)] == [1, 0, 0, 0]
    assert got[2].score_1 == pytest.approx(math.log(1 / 3))
    assert got[3].label is None


def test_equal_scores_go_to_lower_class(spark):
    rows = [(1, "aa", 0), (2, "aa", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    assert {r.prediction for r in predict(counted(df), fit(counted(df))).collect()} == {0}


def test_tfidf_rows(train):
    idf = terms.idf_weights(counted(train))
    weights = {r.term: r.weight for r in idf.collect()}
    assert weights == pytest.approx({"bad": 1.693147, "day": 1.287682, "good": 1.287682, "night": 1.693147}, abs=1e-6)
    rows = table(terms.tfidf(counted(train), idf), "doc_id", "term")
    assert rows[1, "day"].value == pytest.approx(0.447214, abs=1e-6)
    assert rows[1, "good"].value == pytest.approx(0.894427, abs=1e-6)


def test_min_df(train):
    assert {r.term for r in terms.vocabulary(counted(train), 2).collect()} == {"day", "good"}
    assert {r.term for r in fit(counted(train), min_df=2).terms.collect()} == {"day", "good"}


def test_unlabelled_rows_do_not_count(spark, train):
    extra = spark.createDataFrame([(9, "bad bad bad", None)], train.schema)
    one, two = fit(counted(train)), fit(counted(train.union(extra)))
    assert sorted(one.likelihoods().collect()) == sorted(two.likelihoods().collect())
    assert sorted(one.priors().collect()) == sorted(two.priors().collect())


@pytest.mark.parametrize("weighting", ["count", "tfidf"])
def test_model_properties(spark, weighting):
    train, _ = catalog.split_corpus(spark, SMALL)
    model = fit(vs.counted(train, vs.Variant("x", high=2)), weighting, 3)
    sums = model.likelihoods().groupBy("label").agg(F.sum(F.exp("log_prob")).alias("s")).collect()
    assert [r.s for r in sums] == pytest.approx([1.0, 1.0])
    assert model.priors().agg(F.sum(F.exp("log_prior"))).first()[0] == pytest.approx(1.0)


def test_attach_equals_plain_join_on_hot_keys(spark):
    # One key holds a third of the rows, long terms and unknown terms included.
    rows = (
        spark.range(30_000)
        .select(
            F.col("id").alias("doc_id"),
            F.when(F.col("id") % 3 == 0, "hot")
            .when(F.col("id") % 7 == 0, F.repeat(F.lit("x"), 5_000))
            .when(F.col("id") % 11 == 0, "unknown")
            .otherwise(F.concat(F.lit("t"), F.col("id"))).alias("term"),
        )
        .withColumn("tf", F.lit(1))
    )
    known = rows.select("term").distinct().where("term <> 'unknown'").withColumn("v", F.length("term"))
    uses = rows.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    got, wanted = terms.attach(rows, known, uses), rows.join(known, "term")
    key = lambda df: df.select("doc_id", "term", "v")
    assert key(got).exceptAll(key(wanted)).isEmpty() and key(wanted).exceptAll(key(got)).isEmpty()


@pytest.mark.parametrize("name", ["C2", "C3"])
def test_large_and_small_models_agree(spark, name):
    train, test = catalog.split_corpus(spark, SMALL)
    v = vs.variant(name)
    model = vs.fit_variant(train, v)
    rows = lambda m: {
        r.doc_id: (round(r.score_0, 6), round(r.score_1, 6), r.prediction)
        for r in predict(vs.counted(test, v), m).collect()
    }
    assert rows(model) == rows(model.staged())


def test_grid_equals_single_variants(spark):
    train, test = catalog.split_corpus(spark, SMALL)
    chosen = [vs.variant(n) for n in ("C1", "C3", "C5", "C7")]
    grid = {}
    for r in vs.predict_variants(train, test, chosen).collect():
        grid.setdefault(r.variant, {})[r.doc_id] = (round(r.score_0, 6), round(r.score_1, 6), r.prediction)
    for v in chosen:
        single = vs.predict_variant(train, test, v).collect()
        assert grid[v.name] == {r.doc_id: (round(r.score_0, 6), round(r.score_1, 6), r.prediction) for r in single}


def test_save_and_load(spark, train, tmp_path):
    model = fit(counted(train))
    model.save(str(tmp_path))
    loaded = NaiveBayesModel.load(spark, str(tmp_path))
    assert loaded.small
    assert sorted(loaded.likelihoods().collect()) == sorted(model.likelihoods().collect())
    assert predict(counted(train), loaded).count() == 3


def test_pipeline_twin(spark):
    ml = {r.doc_id: r.prediction for r in catalog.nb_ml_pipeline(spark, SMALL).collect()}
    tables = {r.doc_id: r.prediction for r in catalog.predictions(spark, SMALL, "C1").collect()}
    assert ml == tables


def test_discriminative_words(train):
    rows = discriminative_words(fit(counted(train)), 1).collect()
    assert {(r.label, r.term) for r in rows} == {(1, "bad"), (0, "good")}


def test_tokenizer_on_column(spark):
    df = spark.createDataFrame([("Äpfel, 2 x 33",)], "t string")
    assert df.select(tokenize(F.col("t")).alias("t")).first().t == ["äpfel", "33"]


def test_grid_writes_texts_and_whole_numbers(spark, monkeypatch):
    # Neither counted runs of every text nor weights of every term; a word of all new texts that no text of the fit has is heavy too.
    written, staged = [], vs.stage
    monkeypatch.setattr(vs, "stage", lambda df: written.append(dict(df.dtypes)) or staged(df))
    monkeypatch.setattr(terms, "BROADCAST_TERMS", 1)
    heavy, attach = [], terms.attach
    monkeypatch.setattr(terms, "attach", lambda rows, table, uses, on: heavy.append(uses) or attach(rows, table, uses, on))
    rows = lambda texts: spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, label int")
    train, test = rows(["good day here", "bad day", "good good thing", "bad bad day"]), rows(["brandnew good day", "brandnew bad", None])
    chosen = [vs.variant(n) for n in ("C1", "C2", "C3")]
    got = {(r.variant, r.doc_id): r.prediction for r in vs.predict_variants(train, test, chosen).collect()}
    for v in chosen:
        assert {k[1]: p for k, p in got.items() if k[0] == v.name} == {r.doc_id: r.prediction for r in vs.predict_variant(train, test, v).collect()}
    assert not any("array" in kind for table in written for kind in table.values())
    assert not any(c.startswith("log_prob") and "term" in table for table in written for c in table)
    assert any(r.term == "brandnew" and r.uses == 2 for uses in heavy for r in uses.collect())
