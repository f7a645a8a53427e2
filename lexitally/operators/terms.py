"""Vocabulary, counts and TF-IDF over a long (doc_id, term, tf) table.

A corpus is carried as counted documents: one row per text with an array
`terms` of (term, tf). It is the sparse document-term matrix, one sparse row
per text, and needs no shuffle to build. `long_rows` opens it into the long
table when terms have to meet across texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitally.functions.text import count_terms, let
from lexitally.sources.stage import stage

# A key is heavy when it holds at least 1/HEAVY_SHARE of all rows, or its length
# in units of UNIT_CHARS times as much. Shares sum to 1, so whatever the data
# there are at most HEAVY_SHARE heavy keys of HEAVY_SHARE x UNIT_CHARS characters
# together, which bounds the broadcast below.
HEAVY_SHARE = 10_000
UNIT_CHARS = 256

# A term table is broadcast whole only after it was counted and found to have at
# most this many rows and bytes.
BROADCAST_TERMS = 1_000_000
BROADCAST_BYTES = 64_000_000


def count_documents(df: DataFrame, terms: Column, keep: Sequence[str] = ("doc_id", "label")) -> DataFrame:
    """Counted documents: the kept columns plus `terms` as (term, tf) pairs."""
    return df.select(*keep, count_terms(terms).alias("terms"))


def long_rows(counted: DataFrame) -> DataFrame:
    """One row per (document, term). Documents without terms give no row.

    The outer form with a filter behind it is on purpose: for the inner form the
    optimizer tests the array for emptiness below earlier joins, and so counts
    the terms of every text twice more.
    """
    keep = [c for c in counted.columns if c != "terms"]
    return counted.select(*keep, F.inline_outer("terms")).where(F.col("term").isNotNull())


def with_totals(df: DataFrame, totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the columns of `totals`: one row in all, or one row per `by` value.

    Without `by` the row is a scalar subquery, so nothing is joined. With `by`
    the table has one row per variant, a list written in the code.
    """
    if by:
        return df.join(F.broadcast(totals), list(by))
    names = totals.columns
    row = totals.select(F.struct(*names).alias("row")).scalar()
    return df.select("*", row.alias("_row")).select(*df.columns, *[F.col("_row")[n].alias(n) for n in names])


def term_stats(
    counted: DataFrame, labels: Sequence[int] = (0, 1), min_df: int | Column = 1, by: Sequence[str] = ()
) -> DataFrame:
    """Per term: `df` and the summed `tf` of each class, in one shuffle.

    Every (document, term) is one row already, so the document frequency is a
    row count and shares the aggregate with the class sums. Partial sums are
    formed before the shuffle: a term of every text sends one row per task.
    """
    sums = [F.sum(F.when(F.col("label") == c, F.col("tf")).otherwise(0)).alias(f"total_{c}") for c in labels]
    stats = long_rows(counted).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"), *sums)
    return stats.where(F.col("df") >= min_df)


def vocabulary(counted: DataFrame, min_df: int = 1) -> DataFrame:
    """Distinct terms with their document frequency."""
    return (
        long_rows(counted).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    )


def term_totals(counted: DataFrame) -> DataFrame:
    """Occurrences of each term in the corpus."""
    return long_rows(counted).groupBy("term").agg(F.sum("tf").alias("n"))


def top_terms(totals: DataFrame, k: int = 30) -> DataFrame:
    """The k most frequent terms; ties go to the smaller term."""
    return totals.orderBy(F.desc("n"), "term").limit(k)


def attach(rows: DataFrame, table: DataFrame, uses: DataFrame, on: Sequence[str] = ("term",)) -> DataFrame:
    """Inner join of long rows with a table of one row per key, safe for hot keys.

    `uses` holds the exact number of rows per key. Heavy keys are looked up in a
    broadcast of bounded size and their rows never move. Every remaining key
    holds so few of the rows that the shuffle join of the rest has no large
    partition. Nothing is dropped: the two parts together are the whole join.
    """
    on = list(on)
    total = uses.agg(F.sum("uses")).scalar()
    # One comparison of both numbers: a test of the term alone would move below
    # the aggregate and keep Spark from reusing its shuffle.
    units = F.greatest(F.lit(1.0), F.length("term") / UNIT_CHARS)
    heavy = uses.where(F.col("uses") * HEAVY_SHARE >= total * units).select(*on)
    near = rows.join(F.broadcast(heavy.join(table, on)), on)
    far = rows.join(F.broadcast(heavy), on, "left_anti").join(table, on)
    return near.unionByName(far)


def is_small(table: DataFrame) -> bool:
    """Whether a staged term table may be broadcast whole."""
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    return rows <= BROADCAST_TERMS and size <= BROADCAST_BYTES


def lookup(
    rows: DataFrame, table: DataFrame, small: bool, on: Sequence[str] = ("term",), uses: DataFrame | None = None
) -> DataFrame:
    """Inner join of long rows with a term table: one broadcast if the table is
    `small`, else by `attach`. `uses` counts the rows per key when already known."""
    if small:
        return rows.join(F.broadcast(table), list(on))
    if uses is None:
        uses = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("uses"))
    return attach(rows, table, uses, on)


def known_counts(counted: DataFrame, terms: DataFrame) -> DataFrame:
    """Counts against a fixed vocabulary; unseen terms are dropped."""
    known = stage(terms.select("term"))
    small = is_small(known)
    return lookup(long_rows(counted if small else stage(counted)), known, small)


def dense(counted: DataFrame, chosen: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds `dense`: the counts of a short list of terms, in its order, zeros included.

    The list, which sets the width of every row, is read once and becomes a set
    that each term of a text is looked up in; only the few found are searched for
    each place. No text is moved.
    """
    width = Window.orderBy(*[F.expr(o.split()[0]).desc() if o.endswith(" desc") else F.col(o) for o in order])
    numbered = chosen.select("term", F.row_number().over(width).alias("at"))
    listed = [r.term for r in numbered.orderBy("at").collect()]
    found = F.filter("terms", lambda t: t["term"].isin(listed)) if listed else F.slice("terms", 1, 0)
    # Bound once per row: the terms would be counted again for each place otherwise.
    values = let(
        F.map_from_entries(found),
        lambda tf: F.transform(
            F.array(*map(F.lit, listed)).cast("array<string>"), lambda t: F.coalesce(F.try_element_at(tf, t), F.lit(0)).cast("double")
        ),
    )
    return counted.withColumn("dense", values).drop("terms")


def smooth_idf(n_docs: Column, df: Column) -> Column:
    return F.ln((1.0 + n_docs) / (1.0 + df)) + 1.0


def idf_weights(counted: DataFrame, min_df: int = 1) -> DataFrame:
    """(term, df, weight) with the smoothed inverse document frequency."""
    n_docs = counted.agg(F.count(F.lit(1)).alias("n_docs"))
    return with_totals(vocabulary(counted, min_df), n_docs).select(
        "term", "df", smooth_idf(F.col("n_docs"), F.col("df")).alias("weight")
    )


def tfidf(counted: DataFrame, idf: DataFrame) -> DataFrame:
    """L2-normalised TF-IDF rows (doc_id, term, value).

    The window works on one document at a time, never on a shared key.
    """
    weights = stage(idf.select("term", "weight"))
    small = is_small(weights)
    counted = counted.select("doc_id", "terms")
    raw = lookup(long_rows(counted if small else stage(counted)), weights, small).select(
        "doc_id", "term", (F.col("tf") * F.col("weight")).alias("raw")
    )
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return raw.select("doc_id", "term", (F.col("raw") / norm).alias("value"))


def tfidf_rows(counted: DataFrame, min_df: int = 1) -> DataFrame:
    """TF-IDF rows of a corpus by its own weights; texts are counted once and written out."""
    counted = stage(counted.select("doc_id", "terms"))
    return tfidf(counted, idf_weights(counted, min_df))
