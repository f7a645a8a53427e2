"""Lexicons of words and phrases."""

import re

from lexitally.operators import lexical

TEXTS = [("a", 0, "Not good, not good at all! x"), ("a", 1, "very very VERY good"), (None, 0, None), ("b", 1, "don't shut up, shut up"), ("b", 1, "")]
ENTRIES = [
    ("negated", "not good"), ("negated", "not good at"), ("praise", "good"), ("praise", "Very, very"), ("praise", "good"),
    ("rude", "shut up"), ("rude", "x"), ("other", "never seen"), ("other", None), ("both", "good"), ("other", "!?"),
]


def by_hand(texts, entries, by):
    tokens = lambda t: re.findall(r"\w\w+", (t or "").lower())
    lexicon = {(c, tuple(tokens(p))) for c, p in entries if tokens(p)}
    out = {}
    for lang, label, text in texts:
        key = tuple({"lang": lang, "label": label}[b] for b in by)
        t = tokens(text)
        for category in {c for c, _ in lexicon}:
            row = out.setdefault((*key, category), [0, 0])
            row[0] += sum(tuple(t[i : i + len(p)]) == p for c, p in lexicon if c == category for i in range(len(t)))
            row[1] += len(t)
    return {k: (h, n, round(1000 * h / n, 6) if n else 0.0) for k, (h, n) in out.items()}


def test_phrases(spark):
    corpus = spark.createDataFrame(TEXTS, "lang string, label int, text string")
    lexicon = spark.createDataFrame(ENTRIES, "category string, phrase string")
    for by in (["label"], ["lang", "label"]):
        rows = lexical.lexicon_rates(corpus, lexicon, by).collect()
        assert {(*[r[b] for b in by], r.category): (r.hits, r.tokens, round(r.per_1000, 6)) for r in rows} == by_hand(TEXTS, ENTRIES, by)


def test_phrases_without_rows(spark):
    corpus = spark.createDataFrame(TEXTS, "lang string, label int, text string")
    lexicon = spark.createDataFrame(ENTRIES, "category string, phrase string")
    assert lexical.lexicon_rates(corpus, lexicon.limit(0)).collect() == []
    assert lexical.lexicon_rates(corpus.limit(0), lexicon).collect() == []


def test_runs_that_meet_a_small_lexicon_are_not_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(lexical, "stage", lambda df: written.append(df.columns) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    corpus = spark.createDataFrame([("good day good day", 1), (None, 0)], "text string, label int")
    lexicon = spark.createDataFrame([("x", "good day"), ("y", "day")], "category string, phrase string")
    rows = {(r.label, r.category): (r.hits, r.tokens) for r in lexical.lexicon_rates(corpus, lexicon).collect()}
    assert rows == {(1, "x"): (2, 4), (1, "y"): (2, 4), (0, "x"): (0, 0), (0, "y"): (0, 0)}
    assert written == [["term", "categories", "words"]]
