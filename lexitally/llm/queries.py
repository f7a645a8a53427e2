"""One query per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lexitally.llm import (
    bit_sliced,
    bpe,
    collocations,
    packing,
    pieces,
    pseudonyms,
    quality,
    resampling,
    secrets,
    sharding,
    simhash,
    substrings,
    url_filter,
)
from lexitally.llm.common import Query, table

REGISTRY: dict[str, Query] = {}

SHARDS = 24
# A pseudonym key for the queries; a user passes a secret of their own.
KEY = "query key"
# Rules of the URL query as (host, path, verdict).
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# Pages whose host has one of these as a word of its name are on the list.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")
LISTED = r"(^|[.-])(" + "|".join(LISTED_WORDS) + r")([.-]|$)"


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def documents(spark, d):
    return table(spark, d, "documents")


@query
def op1_secret_scan(spark, d):
    return secrets.secret_report(documents(spark, d))


@query
def op2_shard_documents(spark, d):
    return sharding.shard_documents(documents(spark, d), SHARDS)


@query
def op3_quality_rules(spark, d):
    return quality.quality_report(documents(spark, d), table(spark, d, "labels"))


@query
def op4_pack_documents(spark, d):
    return packing.pack_documents(documents(spark, d), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_repeated_passages(spark, d):
    return substrings.repeat_report(documents(spark, d))


@query
def op6_bit_sliced_search(spark, d):
    return bit_sliced.top_k(table(spark, d, "embeddings"))


@query
def op7_pseudonyms(spark, d):
    rows = pseudonyms.pseudonymise(documents(spark, d).select("doc_id", "text"), KEY)
    return rows.select("doc_id", "text", *[f"n_{kind}" for kind in pseudonyms.PATTERNS])


@query
def op8_url_verdicts(spark, d):
    return url_filter.judge_urls(table(spark, d, "pages"), URL_RULES, F.col("host").rlike(LISTED))


@query
def op9_byte_bpe(spark, d):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(documents(spark, d), path, public_tokenizers.PATTERN)


@query
def op10_near_duplicates(spark, d):
    return simhash.near_duplicates(documents(spark, d))


@query
def op11_sentence_pieces(spark, d):
    return pieces.encode_documents(documents(spark, d), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_collocations(spark, d):
    return collocations.collocations(documents(spark, d))


@query
def op13_importance_resampling(spark, d):
    return resampling.resample(documents(spark, d), table(spark, d, "benchmark"))
