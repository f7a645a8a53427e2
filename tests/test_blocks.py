"""The variant grid in blocks of texts and buckets of terms."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lexitally.functions.text import in_ascii_bounds, tokenize
from lexitally.operators import blocks
from lexitally.plans import catalog
from lexitally.plans import variants as vs

SMALL = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "Don't STOP!!", "a_b  c __ d_ef", "über-große Tür", "“quoted” running “running” text", "one two three　four five",
    "next\x85line tab\tnew\nline\rfile\x1cgroup\x1dunit\x1fend", "été cafés", "ΣΊΣΥΦΟΣ ὈΔΥΣΣΕΎΣ Σ", "İstanbul IŞIK", "日本語テキスト 123 語",
    "١٢٣ ४५ ৭", "emoji😀word 😀 running😀", "ǅungla ﬁne ﬀ", "nul\x00in del\x7fhere \x01", "half½ x²y ½½", "zero​width mongol᠎vowel", "𝐀𝐁 𝟘𝟙 𐐀𐐁𐐂",
    "the THE they're flies dying sky skies generalizations", "é è à", "word" * 40, "naïve—dash… ellipsis", "soft­hyphen non‑breaking", "Kelvin ANGSTRÖM Å",
]


def corpus(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, label int")


def test_tokens_in_blocks_are_those_of_the_columns(spark):
    rows = corpus(spark, ODD).coalesce(1)
    kinds = vs.kinds_of(vs.VARIANTS)
    wanted = rows.orderBy("doc_id").select(*[tokenize(k[0].cleaned(F.col("text"))).alias(k[0].cleaning) for k in ([vs.variant(n)] for n in ("C1", "C4", "C7"))]).collect()
    table = in_ascii_bounds(rows).orderBy("doc_id").toArrow()
    low, plain = (table[c].combine_chunks().cast(pa.string()) for c in ("low", "plain"))
    assert 0 < plain.null_count < len(plain)
    for kind, token, tokens, text_of in blocks.tokenised(low, pc.coalesce(plain, low), kinds, {}):
        found = [[] for _ in ODD]
        for text, name in zip(text_of.tolist(), tokens.take(pa.array(token)).to_pylist(), strict=True):
            found[text].append(name)
        assert found == [r[kind.name] for r in wanted], kind.name


def by_text(rows):
    return {r.doc_id: (round(r.score_0, 6), round(r.score_1, 6), r.prediction) for r in rows}


def test_grid_in_many_blocks_equals_single_variants(spark, monkeypatch):
    # Long terms of one variant are none of another's of the same cleaning.
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 5_000)
    monkeypatch.setattr(vs, "LEAST_BUCKETS", 3)
    train, test = catalog.split_corpus(spark, SMALL)
    chosen = (*vs.VARIANTS, vs.Variant("long", high=3, min_df=2), vs.Variant("pairs", "custom", 2, 2, "tfidf"))
    grid = {}
    for r in vs.predict_variants(train, test, chosen).collect():
        grid.setdefault(r.variant, []).append(r)
    for v in chosen:
        assert by_text(grid[v.name]) == by_text(vs.predict_variant(train, test, v).collect()), v.name


def test_grid_of_odd_texts(spark):
    train, test = corpus(spark, ODD), corpus(spark, [*reversed(ODD), "none of these"], 100)
    grid = {}
    for r in vs.predict_variants(train, test).collect():
        grid.setdefault(r.variant, []).append(r)
    for v in vs.VARIANTS:
        assert by_text(grid[v.name]) == by_text(vs.predict_variant(train, test, v).collect()), v.name


def test_grid_moves_rows_of_blocks_not_of_terms(spark, monkeypatch):
    # The time of a row per term, in the shuffle and in each table, grew to most of the job's.
    written, staged = [], vs.stage
    monkeypatch.setattr(vs, "stage", lambda df: written.append(staged(df)) or written[-1])
    train, test = catalog.split_corpus(spark, SMALL)
    assert vs.variant_metrics(train, test).count() == len(vs.VARIANTS)
    n_blocks = written[1].where("block is not null").select("block").distinct().count()
    for table in written:
        assert "term" not in table.columns and "words" not in table.columns
        assert table.count() <= 3 * vs.LEAST_BUCKETS * (2 * n_blocks + 1)


def test_metrics_refuse_a_repeated_doc_id(spark):
    train, test = corpus(spark, ["good day", "bad day"]), corpus(spark, ["good", "bad"])
    with pytest.raises(Exception, match="more than one text has the doc_id 1"):
        vs.variant_metrics(train, test.union(test.where("doc_id = 1"))).collect()


def test_grouping_of_numbers_too_large_for_one_key():
    import numpy as np

    keys, text_of = np.array([2**61, 5, 2**61, 5, 5]), np.array([0, 0, 0, 1, 7])
    distinct, text, term, tf = blocks.grouped(keys, text_of)
    assert distinct.tolist() == [5, 2**61]
    assert list(zip(text.tolist(), term.tolist(), tf.tolist(), strict=True)) == [(0, 0, 1), (1, 0, 1), (7, 0, 1), (0, 1, 2)]
