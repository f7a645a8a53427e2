"""Confusion matrix, accuracy and per-class report.

Everything is derived from one small row of cell counts, so a set of
predictions is read once whatever is reported.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 4


def _cell(actual: int, predicted: int) -> str:
    return f"cell_{actual}_{predicted}"


def confusion_cells(predictions: DataFrame, labels: Sequence[int] = (0, 1), by: Sequence[str] = ()) -> DataFrame:
    """One row per `by` with a count for every (label, prediction) pair."""
    hit = lambda a, p: (F.col("label") == a) & (F.col("prediction") == p)
    return predictions.groupBy(*by).agg(
        *[F.count_if(hit(a, p)).alias(_cell(a, p)) for a in labels for p in labels]
    )


def confusion_matrix(
    predictions: DataFrame, labels: Sequence[int] = (0, 1), by: Sequence[str] = ()
) -> DataFrame:
    """(label, prediction, n) for every pair of classes, zeros kept."""
    rows = [
        F.struct(F.lit(a).alias("label"), F.lit(p).alias("prediction"), F.col(_cell(a, p)).alias("n"))
        for a in labels
        for p in labels
    ]
    return confusion_cells(predictions, labels, by).select(*by, F.inline(F.array(*rows)))


def _sum(columns: list[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def _ratio(top: Column, bottom: Column) -> Column:
    """Division where 0/0 counts as 0."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def accuracy(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    right = (F.col("label") == F.col("prediction")).cast("int")
    return predictions.groupBy(*by).agg(F.avg(right).alias("accuracy"))


def _class_rows(labels: Sequence[int]) -> Column:
    cell = lambda a, p: F.col(_cell(a, p))
    rows = []
    for c in labels:
        hits = cell(c, c)
        support = _sum([cell(c, p) for p in labels])
        chosen = _sum([cell(a, c) for a in labels])
        rows.append(
            F.struct(
                F.lit(c).alias("label"),
                _ratio(hits, chosen).alias("precision"),
                _ratio(hits, support).alias("recall"),
                _ratio(2 * hits, support + chosen).alias("f1"),
                support.alias("support"),
            )
        )
    return F.array(*rows)


def class_report(
    predictions: DataFrame, labels: Sequence[int] = (0, 1), by: Sequence[str] = (), digits: int | None = DIGITS
) -> DataFrame:
    """(label, precision, recall, f1, support); digits=None leaves values exact."""
    rows = confusion_cells(predictions, labels, by).select(*by, F.inline(_class_rows(labels)))
    return _rounded(rows, digits)


def report_averages(
    predictions: DataFrame, labels: Sequence[int] = (0, 1), by: Sequence[str] = (), digits: int | None = DIGITS
) -> DataFrame:
    """Macro and support-weighted averages of the per-class report."""
    classes = class_report(predictions, labels, by, None)
    weighted = lambda x: _ratio(F.sum(F.col(x) * F.col("support")), F.sum("support"))
    names = ("precision", "recall", "f1")
    both = classes.groupBy(*by).agg(
        *[F.avg(x).alias(f"macro_{x}") for x in names],
        *[weighted(x).alias(f"weighted_{x}") for x in names],
        F.sum("support").alias("support"),
    )
    rows = [
        F.struct(
            F.lit(kind).alias("average"), *[F.col(f"{kind}_{x}").alias(x) for x in names], F.col("support")
        )
        for kind in ("macro", "weighted")
    ]
    return _rounded(both.select(*by, F.inline(F.array(*rows))), digits)


def _rounded(df: DataFrame, digits: int | None) -> DataFrame:
    if digits is None:
        return df
    return df.withColumns({x: F.round(x, digits) for x in ("precision", "recall", "f1")})


def summary(predictions: DataFrame, by: Sequence[str] = (), positive: int = 1) -> DataFrame:
    """One row per `by`: accuracy and the report of the positive class, for comparing models."""
    cells = confusion_cells(predictions, (0, 1), by)
    total = _sum([F.col(_cell(a, p)) for a in (0, 1) for p in (0, 1)])
    right = F.col(_cell(0, 0)) + F.col(_cell(1, 1))
    row = F.element_at(_class_rows((0, 1)), positive + 1)
    names = ("precision", "recall", "f1")
    return cells.select(
        *by,
        total.alias("n"),
        F.round(_ratio(right, total), DIGITS).alias("accuracy"),
        *[F.round(row[x], DIGITS).alias(x) for x in names],
    )


def comparison(predictions: DataFrame, model: str = "variant", key: str = "doc_id", positive: int = 1) -> DataFrame:
    """Models ranked by the F1 of the positive class, with a paired test against the first.

    (model, rank, n, accuracy, precision, recall, f1, worse, better, chi2): `worse`
    counts texts that the first model has right and this one wrong, `better` the
    other way round, and chi2 is McNemar's statistic with continuity correction;
    above 3.841 the two differ at the 5 % level. Predictions are matched by key.
    Ties go to the higher accuracy, then to the smaller name.
    """
    table = summary(predictions, by=(model,), positive=positive)
    # One row per model.
    order = Window.orderBy(F.desc("f1"), F.desc("accuracy"), model)
    ranked = table.withColumn("rank", F.row_number().over(order))
    first = ranked.where(F.col("rank") == 1).select(model)
    right = predictions.select(model, key, (F.col("label") == F.col("prediction")).alias("right"))
    best = right.join(F.broadcast(first), model, "left_semi").select(key, F.col("right").alias("best"))
    paired = (
        right.join(best, key)
        .groupBy(model)
        .agg(F.count_if(F.col("best") & ~F.col("right")).alias("worse"), F.count_if(~F.col("best") & F.col("right")).alias("better"))
    )
    apart = F.greatest(F.abs(F.col("worse") - F.col("better")) - 1, F.lit(0)).cast("double")
    chi2 = _ratio(apart * apart, F.col("worse") + F.col("better"))
    rows = ranked.join(paired, model).withColumn("chi2", F.round(chi2, DIGITS))
    return rows.select(model, "rank", "n", "accuracy", "precision", "recall", "f1", "worse", "better", "chi2")


def text_report(title: str, predictions: DataFrame, labels: Sequence[int] = (0, 1)) -> str:
    """The printed report: title, accuracy, per-class table, confusion matrix.

    Only the cell counts, one row, reach the driver.
    """
    cells = confusion_cells(predictions, labels).first().asDict()
    at = lambda a, p: cells[_cell(a, p)]
    total = sum(cells.values())
    lines = [title, "-" * len(title)]
    lines.append(f"accuracy: {sum(at(c, c) for c in labels) / total if total else 0.0:.5f}")
    lines.append(f"{'class':>8} {'precision':>10} {'recall':>10} {'f1':>10} {'support':>10}")
    for c in labels:
        support = sum(at(c, p) for p in labels)
        chosen = sum(at(a, c) for a in labels)
        shown = [at(c, c) / d if d else 0.0 for d in (chosen, support)]
        shown.append(2 * at(c, c) / (support + chosen) if support + chosen else 0.0)
        lines.append(f"{c:>8} " + " ".join(f"{v:>10.{DIGITS}f}" for v in shown) + f" {support:>10}")
    lines.append("confusion matrix (rows: label, columns: prediction)")
    lines.extend(" ".join(f"{at(a, p):>10}" for p in labels) for a in labels)
    return "\n".join(lines)
