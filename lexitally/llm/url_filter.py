"""Exact membership of every URL of a corpus in a list, without a join.

A Bloom filter of the listed keys errs on some keys of the corpus. All keys of
the corpus are known, so these errors can be found and put into a second filter,
whose errors among the listed keys go into a third, and so on until none is
left. A key is listed if the first filter that does not contain it is one of
the even ones. Only bitmaps reach the executors that judge the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.llm.common import lower_ascii, ship, stage, whole_text

RATE = 1 / 16
# A pass over the rows holds bitmaps of about so many bits; a longer list is
# split by key hash and judged in as many passes.
PASS_BITS = 1 << 28
MAX_LEVELS = 60


def hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes of a key."""
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b")]


def positions(a: np.ndarray, b: np.ndarray, level: int, probes: int, bits: int) -> np.ndarray:
    """Bit positions of keys on one level, one column per probe."""
    with np.errstate(over="ignore"):
        seeds = (np.arange(probes, dtype=np.uint64) + np.uint64(level * 64 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (a.astype(np.uint64)[:, None] ^ seeds) + (b.astype(np.uint64)[:, None] | np.uint64(1)) * (seeds | np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) % np.uint64(bits)


def holds(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def _bitmap(keys: DataFrame, level: int, probes: int, bits: int) -> np.ndarray:
    """OR of the bits of all keys: made per task, then per word, then fetched."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            at = np.unique(positions(a, b, level, probes, bits))
            if not len(at):
                continue
            word, start = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"]
            )

    found = (
        keys.select("a", "b").mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    ).toPandas()
    out = np.zeros(-(-bits // 64), dtype=np.uint64)
    out[found["word"].to_numpy(dtype=np.int64)] = found["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _member(levels, a: Column, b: Column) -> Column:
    """Whether a key is listed; the levels travel as one broadcast of checked size."""

    @F.pandas_udf("boolean")
    def judge(left: pd.Series, right: pd.Series) -> pd.Series:
        x, y = left.to_numpy(dtype=np.int64), right.to_numpy(dtype=np.int64)
        listed = np.zeros(len(x), dtype=bool)
        live = np.arange(len(x))
        for level, (probes, bits, words) in enumerate(levels.value):
            inside = holds(words, positions(x[live], y[live], level, probes, bits))
            live = live[inside]
            # Whoever passes an even level counts as listed until an odd one claims it.
            listed[live] = level % 2 == 0
        return pd.Series(listed)

    return judge(a, b)


def fit_levels(keys: DataFrame, rate: float = RATE) -> list[tuple[int, int, np.ndarray]]:
    """Bitmaps for distinct keys (a, b, listed): each level encodes the errors of the one before."""
    spark = keys.sparkSession
    inside, outside = keys.where("listed"), keys.where("NOT listed")
    n_inside, n_outside = keys.agg(
        F.count_if(F.col("listed")), F.count_if(~F.col("listed"))
    ).first()
    levels: list[tuple[int, int, np.ndarray]] = []
    while n_inside:
        if len(levels) == MAX_LEVELS:
            raise ValueError("two different keys share 128 bits of hash")
        probes, bits = _shape(n_inside, n_outside, not levels, rate)
        level = len(levels)
        levels.append((probes, bits, _bitmap(inside, level, probes, bits)))
        sent = spark.sparkContext.broadcast(levels[-1:])
        wrong = stage(outside.where(_hits(sent, level)))
        inside, outside, n_inside, n_outside = wrong, inside, wrong.count(), n_inside
        sent.unpersist()
    return levels


def _shape(n_inside: int, n_outside: int, first: bool, rate: float) -> tuple[int, int]:
    """(probes, bits) of a level."""
    # The first level also has to thin out a rest that is far larger than the list.
    wanted = min(rate, rate * n_inside / max(n_outside, 1)) if first else rate
    probes = max(1, math.ceil(-math.log2(wanted)))
    return probes, max(64, math.ceil(n_inside * probes / math.log(2)))


def expected_bits(n_inside: int, n_outside: int, rate: float = RATE) -> int:
    """About how many bits all levels have together."""
    total, first = 0, True
    while n_inside >= 1:
        probes, bits = _shape(n_inside, n_outside, first, rate)
        total += bits
        n_inside, n_outside, first = math.ceil(n_outside * 0.5**probes) if n_outside >= 1 else 0, n_inside, False
        if bits == 64:
            break
    return total


def _hits(sent, level: int) -> Column:
    @F.pandas_udf("boolean")
    def hit(left: pd.Series, right: pd.Series) -> pd.Series:
        probes, bits, words = sent.value[0]
        at = positions(left.to_numpy(dtype=np.int64), right.to_numpy(dtype=np.int64), level, probes, bits)
        return pd.Series(holds(words, at))

    return hit(F.col("a"), F.col("b"))


def mark_listed(
    rows: DataFrame, key: Column, listed: Column, name: str = "listed", rate: float = RATE, pass_bits: int = PASS_BITS
) -> DataFrame:
    """Adds `name`: is the row's key one of the listed keys?

    `listed` says of a row of the corpus whether its key is on the list; a key is
    on it if any of its rows is. All keys of `rows` are the universe, so the
    answer is exact for each of them. Null keys count as empty.
    """
    ship(rows)
    a, b = hashes(F.coalesce(key, F.lit("")))
    keys = stage(rows.select(a, b, F.coalesce(listed, F.lit(False)).alias("listed")).groupBy("a", "b").agg(F.max("listed").alias("listed")))
    n_listed, n_rest = keys.agg(F.count_if(F.col("listed")), F.count_if(~F.col("listed"))).first()
    passes = max(1, math.ceil(expected_bits(n_listed, n_rest, rate) / pass_bits))
    out = None
    for turn in range(passes):
        mine = lambda column: F.pmod(column, F.lit(passes)) == turn
        levels = fit_levels(keys.where(mine(F.col("b"))), rate)
        sent = rows.sparkSession.sparkContext.broadcast(levels)
        part = rows.where(mine(b)) if passes > 1 else rows
        part = part.withColumn(name, _member(sent, a, b))
        out = part if out is None else out.unionByName(part)
    return out


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, in lower case."""
    return lower_ascii(F.regexp_extract(whole_text(url), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole_text(url), r"://[^/?#]*([^?#]*)", 1)


def rule_column(rules: Sequence[tuple[str, str, str]], what: str) -> Column:
    """What the longest fitting rule says: its own text or its verdict, else null.

    A rule (host, path, verdict) fits the host and its subdomains where the path
    starts with the rule's.
    """
    out = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, verdict if what == "verdict" else host + path).otherwise(out)
    return out


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: Column, rate: float = RATE, pass_bits: int = PASS_BITS
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    Where no rule fits, a page is blocked if its host and path are on the list.
    `listed` is an expression over `host` and `path`. A null url, or one without
    `://`, has an empty host and path. Repeated rows get the same verdict; an
    empty table gives no rows; further columns are ignored.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marked = mark_listed(split, F.concat_ws("", "host", "path"), listed, "_listed", rate, pass_bits)
    method = F.when(F.col("_listed"), "block").otherwise("allow")
    return marked.select(
        "page_id",
        "host",
        "path",
        rule_column(rules, "rule").alias("rule"),
        F.coalesce(rule_column(rules, "verdict"), method).alias("verdict"),
    )
