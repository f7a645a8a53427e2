"""Text operators as column expressions.

Each function maps a column to a column, so a whole cleaning and counting
pipeline stays inside one narrow stage without a shuffle. Only stemming and the
counting of runs of tokens visit Python, in Arrow batches.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.functions.stem import stem_tokens
from lexitally.functions.words import matchable

# The 32 ASCII punctuation marks, and a word as two or more
# letters, digits or underscores of any script.
PUNCTUATION = string.punctuation
WORD = r"[\p{L}\p{N}_]{2,}"
NON_SPACE = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]+"
# What these leave out beyond ASCII: white space, and all but letters and digits.
WIDE_SPACE = r"[\x85\p{Z}&&[^ ]]"
WIDE_SIGN = r"[^\p{L}\p{N}\x00-\x7f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it in `body` any number of times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip_punctuation(text: Column) -> Column:
    """Lowercase, then every punctuation mark becomes one space."""
    return F.translate(F.lower(empty_if_null(text)), PUNCTUATION, " " * len(PUNCTUATION))


def split_words(text: Column) -> Column:
    """Whitespace split without empty tokens."""
    return F.regexp_extract_all(empty_if_null(text), F.lit(NON_SPACE), F.lit(0))


def remove_words(tokens: Column, words: Iterable[str]) -> Column:
    """Drop the tokens of a list, keeping repeats and order of the others."""
    words = list(words)
    if not words:
        return tokens
    return F.filter(tokens, lambda w: ~w.isin(words))


def clean_words(text: Column, stopwords: Iterable[str] = (), stem: bool = False) -> Column:
    """Lowercase, punctuation to space, split, stop words, optional stemming."""
    tokens = remove_words(split_words(strip_punctuation(text)), matchable(stopwords))
    return stem_tokens(tokens) if stem else tokens


def clean_text(text: Column, stopwords: Iterable[str] = (), stem: bool = False) -> Column:
    """Cleaned tokens joined by one space; null text gives the empty string."""
    return F.array_join(clean_words(text, stopwords, stem), " ")


def tokenize(text: Column) -> Column:
    """The vectoriser's tokens: lowercase runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(empty_if_null(text)), F.lit(WORD), F.lit(0))


def in_ascii_bounds(df: DataFrame, text: str = "text") -> DataFrame:
    """The text as `low` and `plain`, in which ASCII alone parts words.

    low: in small letters, other white space is a space, so words of `split_words`
    can be found by bytes. plain: other signs are spaces too, as for `tokenize`;
    null where that is low. A text in ASCII, told by its length, meets no pattern.
    """
    wide = lambda c: F.octet_length(c) > F.length(c)
    replaced = lambda c, pattern: F.when(wide(c), F.regexp_replace(c, pattern, " ")).otherwise(F.col(c))
    rest = [c for c in df.columns if c != text]
    lower = df.select(*rest, F.lower(empty_if_null(F.col(text))).alias("low"))
    low = lower.select(*rest, replaced("low", WIDE_SPACE).alias("low"))
    return low.select(*rest, "low", F.nullif(replaced("low", WIDE_SIGN), F.col("low")).alias("plain"))


def ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """All runs of `low` to `high` adjacent tokens, joined by a space."""

    def runs_of(n: int, t: Column) -> Column:
        if n == 1:
            return t
        # Walking over a shortened copy leaves an empty list for short texts.
        heads = F.slice(t, F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0)))
        return F.transform(
            heads, lambda head, i: F.concat_ws(" ", head, *[F.get(t, i + k) for k in range(1, n)])
        )

    if (low, high) == (1, 1):
        return tokens
    return let(tokens, lambda t: F.concat(*[runs_of(n, t) for n in range(low, high + 1)]))


def truncate_tokens(tokens: Column, limit: int = 128) -> Column:
    return F.slice(tokens, 1, limit)


def count_terms(terms: Column) -> Column:
    """Array of (term, tf) of one text, each distinct term once.

    A text is one row, so its counts need no shuffle: sort the array and
    measure the length of each run of equal terms.
    """

    def runs(ordered: Column) -> Column:
        placed = F.transform(ordered, lambda term, i: F.struct(term.alias("term"), i.alias("at")))
        starts = F.filter(
            placed, lambda p: (p["at"] == 0) | (p["term"] != F.get(ordered, p["at"] - 1))
        )

        def lengths(s: Column) -> Column:
            end = lambda i: F.coalesce(F.get(s, i + 1)["at"], F.size(ordered))
            return F.transform(
                s, lambda p, i: F.struct(p["term"].alias("term"), (end(i) - p["at"]).cast("long").alias("tf"))
            )

        return let(starts, lengths)

    return let(F.sort_array(terms), runs)


# Bytes of joined tokens that are counted at once, unless one text has more.
COUNTED_AT_ONCE = 4 << 20


def count_ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """Array of (term, tf) of one text: `count_terms` of its `ngrams`, in no set order.

    Tokens are those of `tokenize`: never empty or null, without spaces.
    """
    return count_joined(F.array_join(tokens, " "), low, high)


def count_joined(joined: Column, low: int = 1, high: int = 1) -> Column:
    """`count_ngrams` of tokens that are joined by one space; null and "" have none.

    Runs are counted as numbers, in Arrow, for many texts at once.
    """
    most = COUNTED_AT_ONCE

    def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key among the distinct ones, and those."""
        found = pa.array(keys).dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy()

    def counted(joined: pa.Array) -> pa.Array:
        words = pc.split_pattern(joined, " ")
        sizes = np.where(pc.binary_length(joined).to_numpy() > 0, pc.list_value_length(words).to_numpy(), 0)
        text_of = np.repeat(np.arange(len(joined)), sizes)
        flat = words.flatten()
        if len(flat) > len(text_of):
            flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
        coded = flat.dictionary_encode()
        word, n_words = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        # The run that starts at each place, as a number, and the distinct runs by number.
        run, runs = word, coded.dictionary
        texts, terms, counts = [], [], []
        for n in range(1, high + 1):
            if n > 1:
                left, right = run[: len(run) - 1], word[n - 1 :]
                inside = text_of[: len(left)] == text_of[n - 1 :]
                keys = np.where(inside & (left >= 0), left * n_words + right, -1)
                run, found = np.full(len(keys), -1, dtype=np.int64), np.zeros(0, dtype=np.int64)
                run[keys >= 0], found = numbered(keys[keys >= 0])
                if n_words:
                    runs = pc.binary_join_element_wise(runs.take(pa.array(found // n_words)), coded.dictionary.take(pa.array(found % n_words)), " ")
            if n >= low:
                whole = run >= 0
                # Distinct values keep the order of their first place, so texts stay together.
                seen = pc.value_counts(pa.array(text_of[: len(run)][whole] * max(1, len(runs)) + run[whole]))
                keys = seen.field("values").to_numpy()
                texts.append(keys // max(1, len(runs)))
                terms.append(runs.take(pa.array(keys % max(1, len(runs)))))
                counts.append(seen.field("counts").to_numpy())
        text, term, tf = np.concatenate(texts), pa.concat_arrays(terms), np.concatenate(counts)
        if len(texts) > 1:
            order = np.argsort(text, kind="stable")
            term, tf = term.take(pa.array(order)), tf[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(joined)))])
        pairs = pa.StructArray.from_arrays([term, pa.array(tf, pa.int64())], names=["term", "tf"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for joined in batches:
            joined = pc.fill_null(joined, "")
            sizes = np.cumsum(pc.binary_length(joined).to_numpy())
            at = 0
            while at < len(joined):
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
                yield counted(joined.slice(at, end - at))
                at = end

    # Given as objects: the annotations above are text, and this module need not be installed on the workers.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returnType="array<struct<term:string,tf:bigint>>")(joined)
