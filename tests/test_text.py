import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexitally.functions import stem
from lexitally.functions import text as tx
from lexitally.functions.stem import stem_words
from lexitally.functions.words import CUSTOM_STOPWORDS, ENGLISH_STOPWORDS, matchable

STOP = ("the", "don", "t")

# Golden words of the published algorithm; both modes agree on them.
STEMS = dict(
    pair.split("-")
    for pair in """
    caresses-caress ponies-poni cats-cat agreed-agre plastered-plaster motoring-motor hopping-hop falling-fall
    filing-file happy-happi sky-sky relational-relat conditional-condit triplicate-triplic hopefulness-hope
    revival-reviv adjustment-adjust probate-probat rate-rate controll-control roll-roll sing-sing bled-bled
    conflated-conflat troubled-troubl sized-size tanned-tan hissing-hiss fizzed-fizz failing-fail feed-feed
    generalizations-gener oscillators-oscil
    """.split()
)
EXTENDED = {
    "dies": "die", "died": "die", "spied": "spi", "flies": "fli", "dying": "die", "as": "as", "us": "us",
    "used": "use", "using": "use", "enjoy": "enjoy", "cry": "cri", "by": "by", "theology": "theolog",
    "possibly": "possibl", "carefully": "care", "news": "news", "proceed": "proceed", "syzygy": "syzygi",
}
PAPER = {"dies": "di", "as": "a", "enjoy": "enjoi", "ties": "ti"}


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_cleaning_edges(spark):
    cases = {
        None: ("", []),
        "": ("", []),
        "Don't STOP!!": ("stop", ["stop"]),
        "a_b  c": ("a b c", []),
        "über-große Tür": ("über große tür", ["über", "große", "tür"]),
        "“quoted” text": ("“quoted” text", ["quoted", "text"]),
        "the the cat": ("cat", ["cat"]),
        "one two three": ("one two three", ["one", "two", "three"]),
    }
    for value, (cleaned, tokens) in cases.items():
        got = one(spark, lambda c: tx.clean_text(c, STOP), value)
        assert got == cleaned
        assert one(spark, tx.tokenize, got) == tokens


def test_raw_tokens_keep_underscore(spark):
    assert one(spark, tx.tokenize, "a_b c DD") == ["a_b", "dd"]


def test_stop_lists():
    assert len(CUSTOM_STOPWORDS) == len(set(CUSTOM_STOPWORDS)) == 115
    kept = {"she", "her", "not", "no", "should", "can"}
    assert kept.isdisjoint(CUSTOM_STOPWORDS) and kept <= set(ENGLISH_STOPWORDS)
    assert not any("'" in w for w in matchable(ENGLISH_STOPWORDS))


def test_ngrams(spark):
    grams = lambda c: tx.ngrams(tx.tokenize(c), 1, 2)
    assert one(spark, grams, "a bb cc dd") == ["bb", "cc", "dd", "bb cc", "cc dd"]
    assert one(spark, grams, "cat cat") == ["cat", "cat", "cat cat"]
    assert one(spark, grams, "cat") == ["cat"]
    assert one(spark, grams, "") == []
    assert one(spark, lambda c: tx.ngrams(tx.tokenize(c), 2, 3), "aa bb cc dd") == [
        "aa bb", "bb cc", "cc dd", "aa bb cc", "bb cc dd",
    ]


def test_truncate(spark):
    assert one(spark, lambda c: tx.truncate_tokens(tx.tokenize(c), 2), "aa bb cc") == ["aa", "bb"]


def test_count_terms_against_counter(spark):
    random.seed(7)
    lists = [[random.choice("abcde") * random.randint(1, 2) for _ in range(n)] for n in (0, 1, 2, 5, 50, 400)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, t array<string>")
    for row in df.select("i", tx.count_terms(F.col("t")).alias("c")).collect():
        assert {c.term: c.tf for c in row.c} == Counter(lists[row.i])
        assert len(row.c) == len(set(lists[row.i]))


def test_stems(spark):
    for mode, wanted in (("extended", {**STEMS, **EXTENDED}), ("paper", {**STEMS, **PAPER})):
        words = list(wanted)
        df = spark.createDataFrame([(words,)], "w array<string>")
        assert df.select(stem_words(F.col("w"), mode).alias("s")).first().s == [wanted[w] for w in words]


@pytest.mark.parametrize("mode", ["extended", "paper"])
def test_batch_stemmer_is_the_native_one(spark, mode):
    """Words of the documents and made-up endings; stems of whole arrays by position."""
    rng = random.Random(5)
    endings = [s for s, _ in (*stem.STEP_2, *stem.STEP_3)] + [*stem.STEP_4, "s", "ies", "sses", "ed", "ing", "eed", "ied", "y", "e", "ll", ""]
    made = ["".join(rng.choices("abcdeilnorstuyzw", k=rng.randint(1, 7))) + rng.choice(endings) + rng.choice(endings) for _ in range(5000)]
    made += [*stem.IRREGULAR, "y", "yy", "ünïe", "s", "es", "", "sayyid"]
    lists = [made[i : i + 40] * 2 for i in range(0, len(made), 40)] + [[], None]
    df = spark.createDataFrame([(i, words) for i, words in enumerate(lists)], "i int, words array<string>").repartition(3)
    both = df.select("words", stem.stem_tokens(F.col("words"), mode).alias("a"), stem.stem_words(F.col("words"), mode).alias("b")).collect()
    assert len(both) == len(lists)
    for r in both:
        assert r.a == r.b and (r.a is None) == (r.words is None)


def test_runs_counted_in_batches_are_the_counts_of_ngrams(spark, monkeypatch):
    texts = [None, "", " . ", "ab", "ab ab ab cd ab cd", "İstanbul über_x 12 12", "cd ab cd ab ef " * 50, "ef"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    tokens = tx.tokenize(F.col("text"))
    for most in (1, 1 << 20):
        monkeypatch.setattr(tx, "COUNTED_AT_ONCE", most)
        for low, high in ((1, 1), (1, 2), (1, 4), (3, 3)):
            both = rows.select(
                F.sort_array(tx.count_terms(tx.ngrams(tokens, low, high))), F.sort_array(tx.count_ngrams(tokens, low, high))
            ).collect()
            assert len(both) == len(texts) and all(a == b for a, b in both)
