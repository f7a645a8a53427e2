"""What sets the classes apart: words, n-grams and style."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitally.functions.text import count_ngrams, empty_if_null, tokenize
from lexitally.functions.words import STYLE_LEXICON
from lexitally.operators.bayes import NaiveBayesModel
from lexitally.operators.terms import is_small, long_rows, lookup, term_stats, with_totals
from lexitally.sources.stage import stage


def discriminative_words(model: NaiveBayesModel, k: int = 20) -> DataFrame:
    """(label, term, margin): the k terms that speak most for each class.

    Each side is a top-k over the term table, of which every task sends k rows.
    """
    margin = F.col("log_prob_1") - F.col("log_prob_0")
    terms = model.terms.select("term", margin.alias("margin"))
    # Rounded before ordering, so that equal margins fall back on the term.
    key = F.round("margin", 9)
    positive = terms.orderBy(key.desc(), "term").limit(k)
    negative = terms.orderBy(key.asc(), "term").limit(k)
    return positive.select(F.lit(1).alias("label"), "term", "margin").unionByName(
        negative.select(F.lit(0).alias("label"), "term", "margin")
    )


def top_ngrams_by_class(counted: DataFrame, k: int = 20, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """(label, rank, term, n): the k most frequent terms of each class.

    The rank filter lets Spark keep k rows per class and task before shuffling.
    """
    stats = term_stats(counted, labels)
    rows = stats.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("label"), "term", F.col(f"total_{c}").alias("n")) for c in labels])
        )
    ).where(F.col("n") > 0)
    order = Window.partitionBy("label").orderBy(F.desc("n"), "term")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_difference(counted: DataFrame) -> DataFrame:
    """Per term: relative frequency in each class, add-one smoothed log ratio and
    the share of each class's texts that use it."""
    labelled = counted.where(F.col("label").isin(0, 1))
    rows = long_rows(labelled.select("label", "terms"))
    sums = lambda c: F.sum(F.when(F.col("label") == c, F.col("tf")).otherwise(0)).alias(f"n_{c}")
    docs = lambda c: F.count_if(F.col("label") == c).alias(f"docs_{c}")
    stats = rows.groupBy("term").agg(sums(0), sums(1), docs(0), docs(1))
    # All four columns are summed: with fewer, the aggregate below would differ and be computed again.
    mass = stats.agg(
        F.count(F.lit(1)).alias("v"),
        F.sum("n_0").alias("mass_0"),
        F.sum("n_1").alias("mass_1"),
        F.sum(F.col("docs_0") + F.col("docs_1")).alias("postings"),
    )
    sizes = labelled.agg(
        F.count_if(F.col("label") == 0).alias("size_0"), F.count_if(F.col("label") == 1).alias("size_1")
    )
    smoothed = lambda c: (F.col(f"n_{c}") + 1.0) / (F.col(f"mass_{c}") + F.col("v"))
    both = with_totals(with_totals(stats, mass), sizes).where(F.col("postings") > 0)
    return both.select(
        "term",
        "n_0",
        "n_1",
        F.try_divide("n_0", "mass_0").alias("rate_0"),
        F.try_divide("n_1", "mass_1").alias("rate_1"),
        F.ln(smoothed(1) / smoothed(0)).alias("log_ratio"),
        F.try_divide("docs_0", "size_0").alias("presence_0"),
        F.try_divide("docs_1", "size_1").alias("presence_1"),
    )


def style_lexicon_rates(
    corpus: DataFrame, lexicon: Mapping[str, Sequence[str]] = STYLE_LEXICON, by: Sequence[str] = ("label",)
) -> DataFrame:
    """(`by`, category, hits, tokens, per_1000): words of each category per 1,000 tokens.

    Words are counted inside each text against constant sets, so one row per
    text and category is summed and no token is shuffled.
    """
    texts = corpus.select(*by, tokenize(F.col("text")).alias("t"))

    def category(name: str, words: list[str]) -> Column:
        hits = F.size(F.filter("t", lambda w: w.isin(words)))
        return F.struct(F.lit(name).alias("category"), hits.alias("hits"))

    hits = F.array(*[category(name, list(words)) for name, words in sorted(lexicon.items())])
    rows = texts.select(*by, F.size("t").alias("tokens"), F.inline_outer(hits))
    sums = rows.groupBy(*by, "category").agg(F.sum("hits").alias("hits"), F.sum("tokens").alias("tokens"))
    rate = F.coalesce(F.try_divide(1000.0 * F.col("hits"), F.col("tokens")), F.lit(0.0))
    return sums.select("*", rate.alias("per_1000"))


def phrase_lexicon(lexicon: DataFrame) -> DataFrame:
    """(term, categories, words) of a lexicon table (category, phrase), one row per phrase as the tokenizer sees it.

    Phrases without a token are left out; a repeated entry counts once; a phrase
    may be in several categories.
    """
    tokens = lexicon.select(F.col("category").cast("string").alias("category"), tokenize(F.col("phrase")).alias("t")).where(F.size("t") > 0)
    terms = tokens.select("category", F.array_join("t", " ").alias("term"), F.size("t").alias("words"))
    return terms.groupBy("term").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.max("words").alias("words"))


def lexicon_rates(corpus: DataFrame, lexicon: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """(`by`, category, hits, tokens, per_1000) for a lexicon table of words and phrases, of any size.

    A phrase counts wherever its words stand side by side among a text's tokens,
    also inside another phrase. Texts are counted in runs as long as the
    longest phrase; the runs meet the lexicon by a broadcast if it was counted
    and found small, else by a join that no frequent run makes uneven. Every
    category has a row for every `by` value of the corpus.
    """
    known = stage(phrase_lexicon(lexicon))
    longest = known.agg(F.coalesce(F.max("words"), F.lit(1))).first()[0]
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    grouped = [F.col(c).alias(n) for c, n in names.items()]
    texts = corpus.select(*grouped, tokenize(F.col("text")).alias("t"))
    small = is_small(known)
    # Runs are many times their text: they are written out only where they are read more than once.
    counted = texts.select(*names.values(), count_ngrams(F.col("t"), 1, longest).alias("terms"))
    rows = long_rows(counted if small else stage(counted))
    met = lookup(rows, known.select("term", "categories"), small)
    hits = met.select(*names.values(), F.explode("categories").alias("category"), "tf")
    sums = hits.groupBy(*names.values(), "category").agg(F.sum("tf").alias("hits"))
    totals = texts.groupBy(*names.values()).agg(F.sum(F.size("t").cast("long")).alias("tokens"))
    # As many rows as there are categories, for each `by` value.
    every = known.select(F.explode("categories").alias("category")).distinct()
    listed = every.agg(F.array_sort(F.collect_set("category"))).scalar()
    cells = totals.select("*", F.explode(listed).alias("category"))
    same = [F.col(f"c.{n}").eqNullSafe(F.col(f"s.{n}")) for n in names.values()]
    joined = cells.alias("c").join(sums.alias("s"), [*same, F.col("c.category") == F.col("s.category")], "left")
    found = F.coalesce("s.hits", F.lit(0))
    rate = F.coalesce(F.try_divide(1000.0 * found, F.col("c.tokens")), F.lit(0.0))
    return joined.select(
        *[F.col(f"c.{n}").alias(c) for c, n in names.items()], "c.category", found.alias("hits"), F.col("c.tokens").alias("tokens"), rate.alias("per_1000")
    )


# Marks counted by the punctuation report.
PUNCTUATION_PATTERNS = {
    "exclamation": "!",
    "question": r"\?",
    "ellipsis": r"\.\.\.|…",
    "quote": "[\"“”«»]",
}


def punctuation_patterns(corpus: DataFrame, patterns: Mapping[str, str] = PUNCTUATION_PATTERNS) -> DataFrame:
    """Per class: texts, and the number of each mark and of all-caps words, in all and per text."""
    text = empty_if_null(F.col("text"))
    counts = {name: F.regexp_count(text, F.lit(p)) for name, p in patterns.items()}
    letters = F.regexp_extract_all(text, F.lit(r"\p{L}{2,}"), F.lit(0))
    counts["all_caps"] = F.size(F.filter(letters, lambda w: w.rlike(r"^\p{Lu}+$")))
    marks = corpus.select("label", *[c.alias(name) for name, c in counts.items()])
    return marks.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(name).alias(name) for name in counts],
        *[F.avg(name).alias(f"{name}_per_text") for name in counts],
    )
