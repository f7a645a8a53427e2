"""Quality rules whose cutoffs come with a guarantee.

A rule rejects texts above a cutoff of one measure. Which cutoff is safe is read
from labelled texts: on each stratum, a cutoff passes if the exact binomial test
refutes, at a level shared out over all rules, cutoffs and strata, that it would
reject more than an allowed share of good texts. The strictest cutoff that passes
is used. Where too few labels speak for any, the rule stays off. The grid of
cutoffs is fixed before any text is seen and nothing else is fitted, so every
labelled text is a holdout; the correction over the whole grid pays for the choice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitally.llm.common import WORD, let, plain, stage, whole_text, words_of

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Terms of a binomial tail below which the rest is bounded by a geometric series.
TERMS = 4096


@dataclass(frozen=True)
class Rule:
    """Rejects a text whose `measure` exceeds the cutoff; cutoffs from the mildest to the strictest."""

    name: str
    measure: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / n_words", (1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03)),
    Rule("repeated_lines", "n_dup_lines / n_words", (0.2, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01)),
    Rule("repeated_words", "n_repeat_words / n_words", (0.19, 0.15, 0.12, 0.1, 0.07, 0.05)),
    Rule("long_words", "word_chars / n_words", (40.0, 20.0, 15.0, 12.0, 10.0, 8.0)),
)


@dataclass(frozen=True)
class Risk:
    """At most `share` of a stratum's good texts may go, over all rules; wrong with probability `error` at most."""

    share: float = 0.02
    error: float = 0.05
    strata: str = "lang"
    rules: Sequence[Rule] = field(default=RULES)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash, sorted with their places; every
    place of a repeated window covers the words up to the next such place, or
    the whole window.
    """

    def hashed(w: Column) -> Column:
        heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - (window - 1), F.lit(0)))
        return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, window)]))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeats(p: Column) -> Column:
            same = lambda x, j: (F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(p, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda x, j: F.least(F.coalesce(F.get(at, j + 1) - x, F.lit(window)), F.lit(window)))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return let(placed, lambda p: let(repeats(p), total))

    any_twice = lambda h: F.size(F.array_distinct(h)) < F.size(h)
    return let(hashed(words), lambda h: F.when(any_twice(h), covered(h)).otherwise(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to the rows.

    Columns of these names that were there before are replaced.
    """
    text = whole_text()
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    # Bound once: the words would be found again for each window otherwise.
    counted = let(
        words_of(), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeats"))
    )
    return docs.withColumn("_counted", counted).withColumns(
        {
            "n_words": F.col("_counted.n"),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_repeat_words": F.col("_counted.repeats"),
        }
    ).drop("_counted")


def log_factorial(n: Column) -> Column:
    """ln(n!), by Stirling's series, exact to 1e-10; sums of logs below 16."""
    small = [math.log(math.factorial(i)) for i in range(16)]
    x = n.cast("double")
    series = x * F.ln(x) - x + 0.5 * F.ln(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 16, F.get(F.array(*map(F.lit, small)), n.cast("int"))).otherwise(series)


def binomial_tail(k: Column, n: Column, share: Column) -> Column:
    """P(X <= k) for X of n trials with probability `share`, for k below the mean, else 1.

    The sum runs from k downwards, where terms fall at least geometrically; what
    is left after TERMS of them is bounded from above, so the result never
    claims too much.
    """
    top = F.exp(
        log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.ln(share) + (n - k) * F.ln(1 - share)
    )
    ratio = lambda i: i * (1 - share) / ((n - i + 1) * share)
    steps = F.sequence(F.lit(0).cast("long"), F.least(k, F.lit(TERMS).cast("long")))
    summed = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, j: F.struct(
            (acc["term"] * ratio((k - j).cast("double"))).alias("term"), (acc["total"] + acc["term"]).alias("total")
        ),
        lambda acc: acc["total"] + F.when(k > TERMS, acc["term"] / (1 - ratio((k - TERMS).cast("double")))).otherwise(0.0),
    )
    return F.when(k >= n * share, F.lit(1.0)).otherwise(top * summed)


def base_failed() -> Column:
    """Fixed rules: under 10 words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measure(rule: Rule) -> Column:
    top, bottom = rule.measure.split(" / ")
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


def fit_cutoffs(rows: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(stratum, rule, cutoff): the strictest cutoff that passed; no row where none did.

    `labels` has doc_id and quality; texts of quality 1 are good. Texts that the
    fixed rules reject take no part: the guarantee is about what is left. Repeated
    labels of a text count once, as good if one of them says so.
    """
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("_quality")).where(F.col("_quality") == 1).select("doc_id")
    seen = rows.where(~base_failed()).join(good, "doc_id", "left_semi")
    # One pass: good texts and, per rule and cutoff, how many of them exceed it.
    steps = [(rule, cutoff) for rule in risk.rules for cutoff in rule.cutoffs]
    over = [F.count_if(measure(rule) > cutoff).alias(f"k_{i}") for i, (rule, cutoff) in enumerate(steps)]
    counts = seen.groupBy(F.col(risk.strata).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *over)
    strata = counts.agg(F.count(F.lit(1))).scalar()
    cells = counts.withColumn("strata", strata).select(
        "stratum",
        "n",
        "strata",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(rule.name).alias("rule"), F.lit(cutoff).alias("cutoff"), F.col(f"k_{i}").alias("k"))
                    for i, (rule, cutoff) in enumerate(steps)
                ]
            )
        ),
    )
    tail = binomial_tail(F.col("k"), F.col("n"), F.lit(risk.share / len(risk.rules)))
    passed = cells.where(tail * len(steps) * F.col("strata") <= risk.error)
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(rows: DataFrame, cutoffs: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """Adds base_failed and kept. A stratum without cutoffs is judged by the fixed rules alone."""
    wide = cutoffs.groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == rule.name, F.col("cutoff"))).alias(f"_{rule.name}") for rule in risk.rules]
    )
    # Written, so that Spark knows its size: few strata are sent to the rows, many are joined.
    wide = stage(wide)
    met = rows.join(wide, F.col(risk.strata).eqNullSafe(F.col("stratum")), "left")
    fails = F.lit(False)
    for rule in risk.rules:
        fails = fails | F.coalesce(measure(rule) > F.col(f"_{rule.name}"), F.lit(False))
    return met.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~fails)


def quality_report(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    Null texts count as empty and fail the fixed rules. A null stratum is a
    stratum. Repeated rows are judged alike. Without labels only the fixed rules
    apply; an empty table gives no rows.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = stage(measured(docs.select("doc_id", "text", risk.strata)).select("doc_id", risk.strata, *names))
    return judged(rows, fit_cutoffs(rows, labels, risk), risk).select("doc_id", *names, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The rows that `quality_report` keeps, with their own columns.

    Texts are measured once and written with their measures; fitting reads the
    measures alone.
    """
    docs, restored = plain(docs, ("doc_id", "text", risk.strata))
    rows = stage(measured(docs))
    return restored(judged(rows, fit_cutoffs(rows, labels, risk), risk).where("kept"))
