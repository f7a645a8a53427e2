import pytest
from pyspark.sql import functions as F

from lexitally.operators import evaluate


@pytest.fixture(scope="module")
def golden(spark):
    """The published counts, spread out to one row per text."""
    cells = [(0, 0, 2877), (0, 1, 153), (1, 0, 610), (1, 1, 360)]
    df = spark.createDataFrame(cells, "label int, prediction int, n int")
    return df.select("label", "prediction", F.explode(F.sequence(F.lit(1), "n")).alias("i"))


def test_golden_report(golden):
    rows = {r.label: r for r in evaluate.class_report(golden).collect()}
    assert (rows[0].precision, rows[0].recall, rows[0].f1, rows[0].support) == (0.8251, 0.9495, 0.8829, 3030)
    assert (rows[1].precision, rows[1].recall, rows[1].f1, rows[1].support) == (0.7018, 0.3711, 0.4855, 970)
    assert evaluate.accuracy(golden).first().accuracy == pytest.approx(0.80925)
    cells = {(r.label, r.prediction): r.n for r in evaluate.confusion_matrix(golden).collect()}
    assert cells == {(0, 0): 2877, (0, 1): 153, (1, 0): 610, (1, 1): 360}
    averages = {r.average: r for r in evaluate.report_averages(golden).collect()}
    assert averages["macro"].f1 == pytest.approx(0.6842, abs=1e-4)
    assert averages["weighted"].recall == pytest.approx(0.8093, abs=1e-4)
    text = evaluate.text_report("C1", golden)
    assert "0.80925" in text and "0.4855" in text and "2877" in text


def test_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    row = {r.label: r for r in evaluate.class_report(df).collect()}[1]
    assert (row.precision, row.recall, row.f1, row.support) == (0.0, 0.0, 0.0, 1)
    assert evaluate.confusion_matrix(df).count() == 4


def test_by_groups(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("b", 0, 1), ("b", 1, 1)], "v string, label int, prediction int")
    rows = {r.v: r for r in evaluate.summary(df, by=("v",)).collect()}
    assert (rows["a"].accuracy, rows["b"].accuracy, rows["b"].precision, rows["b"].recall) == (1.0, 0.5, 0.5, 1.0)


def test_comparison(spark):
    """Ranks with ties, and the paired counts against the first model."""
    truth = {i: i % 2 for i in range(40)}
    wrong = {"a": {1, 3}, "b": {1, 3}, "c": set(range(0, 40, 2)), "d": {1}}
    rows = [(m, i, t, 1 - t if i in bad else t) for m, bad in wrong.items() for i, t in truth.items()]
    df = spark.createDataFrame(rows, "variant string, doc_id int, label int, prediction int")
    found = {r.variant: r for r in evaluate.comparison(df).collect()}
    assert [m for m in sorted(found, key=lambda m: found[m]["rank"])] == ["d", "a", "b", "c"]
    assert (found["d"].worse, found["d"].better, found["d"].chi2) == (0, 0, 0.0)
    assert (found["a"].worse, found["a"].better, found["a"].chi2) == (1, 0, 0.0)
    assert (found["c"].worse, found["c"].better) == (20, 1)
    assert found["c"].chi2 == round((19 - 1) ** 2 / 21, 4)
