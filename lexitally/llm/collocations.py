"""Collocations by partitioned phrase mining (SON), exact counts, and cut scores.

A phrase with the wanted support in a whole language has the proportional share
of it in at least one shard of that language. So the tasks are dealt out to a
fixed number of shards, each shard is mined completely at its proportionally
lowered support, the shards' phrases are united, and one more reading counts all
of them exactly. A shard is mined by many tasks: each counts the runs in blocks of
words it holds as numbers, and the blocks of a shard meet in buckets of hashes of runs. So
neither memory nor the support of a shard depends on the size of the corpus, and
what is moved grows in proportion to it. Two such rounds are made, one for pairs and one for phrases of three to
five words, so that the second only looks at phrases all of whose pairs have
been counted and found frequent.

What moves is packed, a row for each block and bucket: runs to be mined as the
gaps between their places in a bitmap, runs to be counted as sorted text.

A united set of phrases goes to the tasks as a bitmap of fixed size over hashes
of phrases. It has every member; a phrase that is marked by chance is counted
like the others and falls at the support. So the broadcast does not grow with
the data, and no result depends on its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitally.llm.common import ASCII_LOWER, ship, stage

SUPPORT = 100
LONGEST = 5
TOP = 2_000
# Shards that are mined, by many tasks each.
SHARDS = 16
# Words a task holds at once, and bytes of text in a row of words.
BLOCK = 1_500_000
# Runs travel in buckets of hashes, of about so many words of text each; words in buckets of so many staged rows.
BUCKET, BUCKET_ROWS, LEAST_BUCKETS = 4_000_000, 40, 64
BYTES_AT_ONCE = 1 << 20
# Bits of a bitmap, a power of two.
BITS = 1 << 26
ROWS = 20_000
UNKNOWN = "und"

# These end a piece; a space or a tab ends a word. 0xFF is in no UTF-8 text.
ENDS_PIECE = b".,;:!?\n\x0b\x0c\r"
BREAK = b"\xff"
PIECES = bytes(0xFF if b in ENDS_PIECE else 0x20 if b == 9 else b for b in ASCII_LOWER)


class Numbers(dict):
    """Words to numbers in order of their first sight; 0 is the border of a piece."""

    def __init__(self):
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Block:
    """Words of one language as numbers."""

    def __init__(self, lang: str, words: list[bytes], ids: np.ndarray):
        self.lang, self.words, self.ids = lang, words, ids
        self.n = int(np.count_nonzero(ids))
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in words), dtype=np.uint64, count=len(words))

    def hash_at(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the runs of k words that begin at these places."""
        state = np.zeros(len(at), dtype=np.uint64)
        for i in range(k):
            state = (state ^ self.hashes[self.ids[at + i]]) * np.uint64(0x9E3779B97F4A7C15)
            state ^= state >> np.uint64(29)
        return state

    def phrase_at(self, at: int, k: int) -> bytes:
        return b" ".join([self.words[i] for i in self.ids[at : at + k].tolist()])


class Bitmap:
    """A set of hashes that may seem to hold more than it does, never less."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bit = hashes & np.uint64(64 * len(self.words) - 1)
        return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


def bitmap_of(hashes: DataFrame) -> Bitmap:
    """The set of a column `hash`; at most BITS / 64 rows visit the driver, however many hashes there are."""
    bit = F.col("hash").bitwiseAND(BITS - 1)
    one = F.expr(f"shiftleft(1L, cast(hash & {63} as int))")
    rows = hashes.select(F.shiftright(bit, 6).alias("slot"), one.alias("bits"))
    found = rows.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(BITS >> 6, dtype=np.uint64)
    words[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Bitmap(words)


def tokenised(docs: DataFrame) -> DataFrame:
    """(lang, words, ids): some texts of one language as their distinct words and the place of each word among them.

    Staged, so that texts are split into words once. The words are joined by
    spaces, the places packed; place 0 is the border of a piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def row(lang: str) -> pa.RecordBatch:
            size.pop(lang)
            data = BREAK.join(waiting.pop(lang)).translate(PIECES).replace(BREAK, b" \xff ")
            numbers = Numbers()
            ids = np.fromiter(map(numbers.__getitem__, data.split()), dtype=np.int32)
            columns = [[lang], [b" ".join(numbers)], [ids.tobytes()]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)],
                names=["lang", "words", "ids"],
            )

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, text = lang.as_py(), text.as_py()
                if not text:
                    continue
                data = text.encode("utf-8", "surrogatepass")
                waiting.setdefault(lang, []).append(data)
                size[lang] = size.get(lang, 0) + len(data)
                if size[lang] >= BYTES_AT_ONCE:
                    yield row(lang)
        for lang in list(waiting):
            yield row(lang)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")
    return stage(docs.select(lang, "text").mapInArrow(run, "lang string, words binary, ids binary"))


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Block]:
    """A task's words, per language, in blocks of about `size` words."""
    open_ids: dict[str, list[np.ndarray]] = {}
    numbers: dict[str, Numbers] = {}
    held: dict[str, int] = {}

    def close(lang: str) -> Block:
        ids = np.concatenate([*open_ids.pop(lang), np.zeros(LONGEST, dtype=np.int32)])
        held.pop(lang)
        return Block(lang, list(numbers.pop(lang)), ids)

    for batch in batches:
        for lang, words, ids in zip(*batch.columns, strict=True):
            lang, words, ids = lang.as_py(), words.as_py().split(b" "), np.frombuffer(ids.as_py(), dtype=np.int32)
            known = numbers.setdefault(lang, Numbers())
            place = np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))
            open_ids.setdefault(lang, []).append(np.append(place[ids], np.int32(0)))
            held[lang] = held.get(lang, 0) + len(ids) + 1
            # The largest go first, so that all languages together stay within one block.
            while sum(held.values()) >= size:
                yield close(max(held, key=held.get))
    for lang in list(held):
        yield close(lang)


def _per_block(texts: DataFrame, size: int, rows_of: Callable[[Block], Iterator[tuple]], fields: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """One narrow reading of all words: whatever `rows_of` yields for each block, as columns of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, size):
            for columns in rows_of(block):
                for at in range(0, len(columns[0]), ROWS):
                    arrays = [pa.array(c[at : at + ROWS], t) for c, (_, t) in zip(columns, fields.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=list(fields))

    return texts.mapInArrow(run, ", ".join(f"{name} {kind}" for name, (kind, _) in fields.items()))


MARKS = {
    "lang": ("string", pa.string()),
    "shard": ("int", pa.int32()),
    "bucket": ("long", pa.int64()),
    "block_words": ("long", pa.int64()),
    "n": ("int", pa.int32()),
    "runs": ("binary", pa.binary()),
}
NAMED = {
    "lang": ("string", pa.string()),
    "bucket": ("long", pa.int64()),
    "n": ("int", pa.int32()),
    "counts": ("binary", pa.binary()),
    "size": ("int", pa.int32()),
    "names": ("binary", pa.binary()),
}
COUNTS = {"lang": ("string", pa.string()), "phrase": ("string", pa.string()), "k": ("int", pa.int32()), "f": ("long", pa.int64())}


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, their lowest bytes first, then the next ones: those are mostly zero."""
    return pa.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _named(block: Block, hashes: np.ndarray, counts: np.ndarray, spell: Callable[[int], bytes], buckets: int) -> list[list]:
    """A row per bucket with the words or runs of a block that fall into it, in order of their text."""
    bucket = _bucket(hashes, buckets)
    order = np.argsort(bucket, kind="stable")
    columns: list[list] = [[] for _ in NAMED]
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        found = sorted(zip(map(spell, part.tolist()), counts[part].tolist(), strict=True))
        # No word holds a line feed.
        text = b"\n".join([name for name, _ in found])
        packed = pa.compress(text, codec="zstd", asbytes=True)
        row = block.lang, int(bucket[part[0]]), len(found), _pack(np.array([n for _, n in found])), len(text), packed
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    return columns


def _totals(named: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, k, f), staged: the sums over all blocks that are `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def close() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                found = [(name, n) for name, n in counts.items() if n >= least]
                for begin in range(0, len(found), ROWS):
                    part = found[begin : begin + ROWS]
                    columns = (
                        [lang] * len(part),
                        [name.decode("utf-8", "surrogatepass") for name, _ in part],
                        [name.count(b" ") + 1 for name, _ in part],
                        [n for _, n in part],
                    )
                    arrays = [pa.array(c, t) for c, (_, t) in zip(columns, COUNTS.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=list(COUNTS))
            held.clear()

        for batch in batches:
            for lang, bucket, n, counts, size, names in zip(*batch.columns, strict=True):
                if bucket.as_py() != at:
                    yield from close()
                    at = bucket.as_py()
                mine = held.setdefault(lang.as_py(), {})
                text = pa.decompress(names.as_py(), decompressed_size=size.as_py(), codec="zstd", asbytes=True)
                for name, count in zip(text.split(b"\n"), _unpack(counts.as_py(), n.as_py()).tolist(), strict=True):
                    mine[name] = mine.get(name, 0) + count
        yield from close()

    dealt = named.repartition("bucket").sortWithinPartitions("bucket")
    return stage(dealt.mapInArrow(run, ", ".join(f"{name} {kind}" for name, (kind, _) in COUNTS.items())))


def _word_counts(texts: DataFrame, size: int) -> DataFrame:
    """(lang, phrase, k, f) of every word, staged. Words travel in buckets of their hashes."""
    buckets = max(LEAST_BUCKETS, texts.count() // BUCKET_ROWS)

    def rows_of(block: Block) -> Iterator[list]:
        counts = np.bincount(block.ids, minlength=len(block.words))[1:]
        yield _named(block, block.hashes[1:], counts, lambda i: block.words[1 + i], buckets)

    return _totals(_per_block(texts, size, rows_of, NAMED), 1)


def _runs(block: Block, most: int, keep: Callable[[Block, int, np.ndarray, np.ndarray], np.ndarray], words: Bitmap, pairs: Bitmap | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Level by level (k, a place of each distinct run of k words, its count), for the runs `keep` keeps.

    A run is looked at if both runs of k - 1 words in it were kept.
    """
    ids = block.ids
    good = words.has(block.hashes)
    good[0] = False
    at = np.flatnonzero(good[ids])
    number = np.full(len(ids), -1, dtype=np.int64)
    number[at] = ids[at]
    for k in range(2, most + 1):
        at = at[(at + 1 < len(ids)) & (number[np.minimum(at + 1, len(ids) - 1)] >= 0)]
        if not len(at):
            return
        codes = number[at] * (int(number.max()) + 1) + number[at + 1]
        _, place, back, count = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
        del codes
        kept = keep(block, k, at[place], count)
        if k == 2 and pairs is not None:
            kept &= pairs.has(block.hash_at(at[place], 2))
        yield k, at[place][kept], count[kept]
        stays = kept[back]
        number = np.full(len(ids), -1, dtype=np.int64)
        number[at[stays]] = (np.cumsum(kept) - 1)[back[stays]]
        at = at[stays]


def _buckets(totals: dict[str, int]) -> int:
    return max(LEAST_BUCKETS, -(-sum(totals.values()) // BUCKET))


def _mined(texts: DataFrame, size: int, levels: tuple[int, int], totals: dict[str, int], support: int, words, pairs) -> Bitmap:
    """The phrases that some shard has at its proportional support, as far as they can reach the support in all.

    All shards' counts of a hash meet in one bucket, under its place in the
    bitmap. A phrase whose place stays below the support there is out; several
    phrases of one place can only have more, so none is missed.
    """
    buckets = _buckets(totals)

    def rows_of(block: Block) -> Iterator[list]:
        shard = TaskContext.get().partitionId() % SHARDS
        bucket, place, counts = ([np.zeros(0, dtype=np.int64)] for _ in range(3))
        for k, at, count in _runs(block, levels[1], lambda block, k, at, count: count > 0, words.value, pairs and pairs.value):
            if k >= levels[0]:
                hashes = block.hash_at(at, k)
                bucket.append(_bucket(hashes, buckets))
                place.append((hashes & np.uint64(BITS - 1)).astype(np.int64))
                counts.append(count)
        bucket, place, counts = (np.concatenate(x) for x in (bucket, place, counts))
        order = np.lexsort((place, bucket))
        place, counts = place[order], counts[order]
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        # Every bucket gets a row, so each knows how many words of the language a shard has.
        parts = [(place[a:b], counts[a:b]) for a, b in zip(ends, ends[1:])]
        yield [
            [block.lang] * buckets,
            [shard] * buckets,
            list(range(buckets)),
            [block.n] * buckets,
            [len(at) for at, _ in parts],
            [_pack(np.concatenate([np.diff(at, prepend=0), n])) for at, n in parts],
        ]

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The phrases that can reach the support, bucket by bucket."""
        at, held, words_in = None, {}, {}

        def close() -> pa.RecordBatch:
            often: dict[str, list[np.ndarray]] = {}
            counted: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for (lang, shard), parts in held.items():
                places, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                least = max(1, -(-support * words_in[lang, shard] // max(1, totals.get(lang, 1))))
                often.setdefault(lang, []).append(places[n >= least])
                counted.setdefault(lang, []).append((places, n))
            held.clear()
            words_in.clear()
            able = [np.zeros(0, dtype=np.int64)]
            for lang, parts in counted.items():
                places, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                able.append(np.intersect1d(np.concatenate(often[lang]), places[n >= support]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(able))], names=["hash"])

        for batch in batches:
            for lang, shard, bucket, block_words, n, runs in zip(*batch.columns, strict=True):
                if bucket.as_py() != at:
                    yield close()
                    at = bucket.as_py()
                key, n = (lang.as_py(), shard.as_py()), n.as_py()
                words_in[key] = words_in.get(key, 0) + block_words.as_py()
                if n:
                    numbers = _unpack(runs.as_py(), 2 * n)
                    held.setdefault(key, []).append((np.cumsum(numbers[:n]), numbers[n:]))
        yield close()

    dealt = _per_block(texts, size, rows_of, MARKS).repartition("bucket").sortWithinPartitions("bucket")
    return bitmap_of(dealt.mapInArrow(united, "hash long"))


def _summed(places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and the sums of their counts."""
    order = np.argsort(places)
    places = places[order]
    first = np.flatnonzero(np.diff(places, prepend=-1))
    return places[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _counted(texts: DataFrame, size: int, levels: tuple[int, int], totals: dict[str, int], support: int, candidates, words, pairs) -> DataFrame:
    """Exact counts (lang, phrase, k, f) of the candidates that reach the support. They travel as text, in buckets of their hashes."""
    buckets = _buckets(totals)

    def rows_of(block: Block) -> Iterator[list]:
        def keep(block, k, at, count):
            return candidates.value.has(block.hash_at(at, k)) if k >= levels[0] else np.ones(len(at), dtype=bool)

        for k, at, count in _runs(block, levels[1], keep, words.value, pairs and pairs.value):
            if k >= levels[0]:
                yield _named(block, block.hash_at(at, k), count, lambda i, k=k, at=at.tolist(): block.phrase_at(at[i], k), buckets)

    return _totals(_per_block(texts, size, rows_of, NAMED), support)


def _marked(counts: DataFrame) -> Bitmap:
    """The bitmap of counted phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: dict[str, int] = {}
        for batch in batches:
            hashes = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = seeds.get(lang)
                if seed is None:
                    seed = seeds[lang] = xxhash.xxh64_intdigest(lang.encode())
                hashes.append([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed) for w in phrase.split(" ")])
            if not hashes:
                continue
            # A single word is looked up by its own hash, a run by the hash of the run.
            columns = np.array(hashes, dtype=np.uint64).T
            state = columns[0]
            if len(columns) > 1:
                state = np.zeros(len(hashes), dtype=np.uint64)
                for column in columns:
                    state = (state ^ column) * np.uint64(0x9E3779B97F4A7C15)
                    state ^= state >> np.uint64(29)
            yield pa.RecordBatch.from_arrays([pa.array(state.view(np.int64))], names=["hash"])

    return bitmap_of(counts.select("lang", "phrase").mapInArrow(run, "hash long"))


def count_phrases(docs: DataFrame, support: int = SUPPORT, block: int = BLOCK) -> tuple[DataFrame, dict[str, int]]:
    """(lang, phrase, k, f) of all phrases of 1 to 5 words with that support, and the words of each language."""
    context = ship(docs).sparkSession.sparkContext
    texts = tokenised(docs)
    words = _word_counts(texts, block)
    # One row per language.
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("f").alias("n")).toLocalIterator()}
    words = words.where(F.col("f") >= support)
    known = context.broadcast(_marked(words))
    candidates = context.broadcast(_mined(texts, block, (2, 2), totals, support, known, None))
    pairs = _counted(texts, block, (2, 2), totals, support, candidates, known, None)
    known_pairs = context.broadcast(_marked(pairs))
    candidates = context.broadcast(_mined(texts, block, (3, LONGEST), totals, support, known, known_pairs))
    longer = _counted(texts, block, (3, LONGEST), totals, support, candidates, known, known_pairs)
    return words.unionByName(pairs).unionByName(longer), totals


def _words_between(words: Column, first: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def cut_score() -> Column:
    """floor(1000 * a * n / (l * r)) of columns with these names, in exact integers of up to 38 digits."""
    return F.expr(
        "(cast(a as decimal(18,0)) * 1000bd * cast(n as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    )


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, a, phrase.

    A null text has no words; a null language is "und". Repeated rows count as
    often as they stand there; ids play no part. An empty table gives no rows.
    """
    counts, totals = count_phrases(docs, support, block)
    counts = stage(counts)
    spark = docs.sparkSession
    candidates = counts.where("k > 1").withColumn("words", F.split("phrase", " "))
    # A phrase falls if one with a word more on either side is as frequent; by
    # the counts of the phrases between, that says the same as any longer one.
    wider = candidates.where("k > 2").select(
        "lang",
        "f",
        F.explode(F.array(*[_words_between(F.col("words"), i, F.col("k") - 1) for i in (1, 2)])).alias("phrase"),
    )
    wider = wider.groupBy("lang", "phrase").agg(F.max("f").alias("wider"))
    kept = candidates.join(wider, ["lang", "phrase"], "left").where("wider IS NULL OR wider < f")
    cuts = kept.select(
        "lang",
        "phrase",
        F.col("f").alias("a"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.col("k") - 1),
                lambda i: F.struct(
                    i.alias("cut"),
                    _words_between(F.col("words"), F.lit(1), i).alias("first"),
                    _words_between(F.col("words"), i + 1, F.col("k") - i).alias("rest"),
                ),
            )
        ).alias("c"),
    ).select("lang", "phrase", "a", "c.*")
    for side, name in (("first", "l"), ("rest", "r")):
        looked_up = counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(looked_up, ["lang", side])
    totals_table = spark.createDataFrame(list(totals.items()), "lang string, n long")
    # One row per language.
    scored = cuts.join(F.broadcast(totals_table), "lang").withColumn("score", cut_score())
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b"))
    best = best.select("lang", "phrase", "b.*")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
