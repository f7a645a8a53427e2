"""Importance resampling of documents towards a target corpus, on hashed n-gram features.

A feature is a run of one to three words; its bucket is the CRC of its bytes.
Of a chunk of words, the distinct features are grouped by their length in bytes.
Each group is a two-dimensional array of bytes, one column per place in the
feature; the CRCs of a whole group advance together, column by column, and the
buckets are scattered back to the places where the features stand. Texts are
read twice: for the sums of the buckets, and for the weights. Nothing but
bucket sums and one short row per document is ever moved.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitally.llm.common import ASCII_LOWER, ship, stage

BUCKETS = 10_000
RUN = 3
SEED = 42
LEAST_WORDS = 20
SHARE = 5
# Words and bytes looked at together, and bytes of one two-dimensional array.
CHUNK = 1 << 18
CHUNK_BYTES = 1 << 23
CELLS = 1 << 22
# Longer features get their CRC one by one: a column of a few rows is not worth a step.
LONGEST = 1 << 10

# A-Z to a-z, and every byte that no word has to a space.
WORD_BYTES = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).translate(ASCII_LOWER)
)


def crc_table() -> np.ndarray:
    """The 256 steps of the CRC-32 of zlib, from its polynomial."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1).astype(np.uint32)
    return steps


STEPS = crc_table()


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice of `data`."""
    out = np.empty(len(starts), dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for bucket in np.split(order, edges) if len(order) else []:
        length = int(lengths[bucket[0]])
        if length > LONGEST:
            for i in bucket.tolist():
                out[i] = zlib.crc32(data[starts[i] : starts[i] + length])
            continue
        size = max(1, CELLS // max(1, length))
        for at in range(0, len(bucket), size):
            part = bucket[at : at + size]
            columns = data[starts[part] + np.arange(length)[:, None]]
            state = np.full(len(part), 0xFFFFFFFF, dtype=np.uint32)
            for column in columns:
                state = STEPS[(state ^ column) & 0xFF] ^ (state >> 8)
            out[part] = ~state
    return out


class Numbers(dict):
    """Words to numbers, in order of their first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def run_buckets(words: list[bytes], last: np.ndarray, wanted: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to RUN words: where they begin, among the first `wanted` words, and their buckets.

    `last` is the place of the last word of each word's document.
    """
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    numbers = Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    found, codes = [], ids
    for k in range(RUN):
        if k:
            codes = codes[: len(words) - k] * len(numbers) + ids[k:]
        at = np.flatnonzero(np.arange(len(codes)) + k <= last[: len(codes)])
        distinct, place, back = np.unique(codes[at], return_index=True, return_inverse=True)
        first = at[place]
        bucket = crcs(data, starts[first], ends[first + k] - starts[first]) % np.uint32(buckets)
        here = at < wanted
        found.append((at[here], bucket[back[here]].astype(np.int64)))
        # Numbers of the distinct runs, for the runs that are one word longer.
        codes = np.zeros(len(codes), dtype=np.int64)
        codes[at] = back
    return found


def features(texts: Iterable[str | None], buckets: int) -> Iterator[tuple[np.ndarray, list[int], list[tuple[np.ndarray, np.ndarray]]]]:
    """Chunks of texts: the text of each word, the words per text, and the runs with their buckets.

    A long text goes through several chunks; its words are counted in the first.
    """
    counts: list[int] = []
    words: list[bytes] = []
    owner: list[int] = []
    size = 0
    index = -1

    def chunk(final: bool):
        nonlocal words, owner
        of = np.array(owner, dtype=np.int64)
        last = np.searchsorted(of, of, side="right") - 1
        # The last words are looked at again, with the words behind them.
        wanted = len(words) if final else max(0, len(words) - RUN + 1)
        found = run_buckets(words, last, wanted, buckets) if words else []
        out = of, list(counts), found
        words, owner = words[wanted:], owner[wanted:]
        counts.clear()
        return out

    for index, text in enumerate(texts):
        split = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
        counts.append(len(split))
        for at in range(0, len(split), CHUNK):
            part = split[at : at + CHUNK]
            words += part
            owner += [index] * len(part)
            size += sum(map(len, part))
            if len(words) >= CHUNK or size >= CHUNK_BYTES:
                yield chunk(False)
                size = sum(map(len, words))
    yield chunk(True)


def bucket_sums(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, runs in features((t.as_py() for t in batch.column(0)), buckets):
                for _, bucket in runs:
                    sums += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["bucket", "n"])

    parts = ship(docs).select("text").mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How much more likely each bucket is in the target: 1000 ln of the ratio of smoothed shares, rounded down."""
    held = []
    for corpus in (docs, target):
        sums = [0] * buckets
        for row in bucket_sums(corpus, buckets).collect():
            sums[row.bucket] = row.n
        held.append(sums)
    s, t = held
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log(float(b + 1) * all_s / (float(a + 1) * all_t))) for a, b in zip(s, t, strict=True)]


def noise(doc_id: object, seed: int) -> int:
    """A Gumbel draw in thousandths, fixed by the seed and the id; a null id counts as an empty one."""
    name = "" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gains: list[int], seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row, in one narrow stage."""
    gain = np.array(gains, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = len(batch)
            n_features, weight, n_words = np.zeros(size, np.int64), np.zeros(size, np.int64), []
            for owner, counts, runs in features((t.as_py() for t in batch.column(1)), len(gain)):
                n_words += counts
                for at, bucket in runs:
                    np.add.at(n_features, owner[at], 1)
                    np.add.at(weight, owner[at], gain[bucket])
            score = weight + np.fromiter((noise(d.as_py(), seed) for d in batch.column(0)), np.int64, size)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (n_words, n_features, weight, score))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_features long, weight long, score long"
    return ship(docs).select("doc_id", "text").mapInArrow(run, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every row; `rank` of the rows that are drawn.

    Of the rows with `least_words` words, `share` percent are drawn without
    replacement, by highest score, then smallest doc_id. A null text has no words
    and is never drawn. Rows with a null id come last among equals; repeated rows
    are rows of their own. With an empty target, only the documents' own sums
    count; an empty table gives no rows.
    """
    scored = stage(weighed(docs, bucket_gains(docs, target, buckets), seed))
    able = scored.where(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Dealt out by ranges of the order; a last key splits rows that are equal in it.
    dealt = able.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie")
    placed = stage(dealt.sortWithinPartitions(*order, "tie").drop("tie").withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task of the sort.
    starts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    drawn = able.count() * share // 100
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + place + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(columns).unionByName(rest.select(columns))


def resampled(docs: DataFrame, target: DataFrame, **options: int) -> DataFrame:
    """The rows that are drawn, with all their columns; rows of one id are drawn together."""
    drawn = resample(docs, target, **options).where(F.col("rank").isNotNull()).select("doc_id").distinct()
    return docs.join(drawn, "doc_id", "left_semi").select(docs.columns)
