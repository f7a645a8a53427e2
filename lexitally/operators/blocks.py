"""Terms of texts counted in blocks, and what all blocks together have of a term.

A block is some megabytes of texts, each text whole, of one side: texts of a fit
or texts to be scored. Its distinct terms go to buckets by hash, packed, a row
per block and bucket, with what the block has of each. A bucket adds up and
answers each block in the order of its terms. So a term travels as text once,
a frequent one at most once per block; numbers by place do the rest, and what
concerns a single text stays in its block.

Spark moves the rows; here is what is done with those of a block or a bucket.
"""

from __future__ import annotations

import string
import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# This module need not be installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of text in a block, unless one text has more.
BLOCK_BYTES = 8 << 20
# Words a worker keeps with their tokens, per kind of cleaning.
WORDS_KEPT = 300_000

# The bytes of ASCII that part words (the cleaner's, the vectoriser's); those of other characters stay.
CLEANED = bytes(32 if chr(b) in string.punctuation or 9 <= b <= 13 or 28 <= b <= 31 else b for b in range(256))
TOKENS = bytes(b if b > 127 or chr(b).isalnum() or b == 95 else 32 for b in range(256))

# Rows of blocks and buckets. request: terms of a block that fall into a bucket. texts: what stays of a block. The first
# `wanted` terms of a request are answered, the first `weighed` of these have to do with TF-IDF.
ROWS = {
    "what": ("string", pa.string()),
    "side": ("string", pa.string()),
    "cleaning": ("string", pa.string()),
    "bucket": ("int", pa.int32()),
    "block": ("string", pa.string()),
    "wanted": ("int", pa.int32()),
    "weighed": ("int", pa.int32()),
    "payload": ("binary", pa.binary()),
}
SCHEMA = ", ".join(f"{name} {kind}" for name, (kind, _) in ROWS.items())


@dataclass(frozen=True)
class Scheme:
    """One variant of a kind of cleaning, as workers need it."""

    name: str
    high: int
    min_df: int
    tfidf: bool

    def has(self, df: np.ndarray, order: np.ndarray) -> np.ndarray:
        return (df > 0) & (df >= self.min_df) & (order <= self.high)


@dataclass(frozen=True)
class Kind:
    """A kind of cleaning with its variants. stop: None if texts are not cleaned."""

    name: str
    stop: frozenset[str] | None
    stem: Callable[[str], str] | None
    schemes: tuple[Scheme, ...]

    @property
    def high(self) -> int:
        return max(s.high for s in self.schemes)

    @property
    def weighed(self) -> int:
        """The longest terms of TF-IDF variants, 0 without any."""
        return max((s.high for s in self.schemes if s.tfidf), default=0)


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Numbers of any kinds and lengths as bytes. There are many such rows, so a plain form that is quick to read and write."""
    head = ";".join([f"{name},{a.dtype.str},{a.nbytes}" for name, a in columns.items()])
    body = b"".join([head.encode(), b"\n", *[a.tobytes() for a in columns.values()]])
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    body = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    at = body.index(b"\n")
    columns, head = {}, body[:at].decode()
    at += 1
    for name, kind, size in (field.split(",") for field in head.split(";") if field):
        kind = np.dtype(kind)
        columns[name] = np.frombuffer(body, dtype=kind, count=int(size) // kind.itemsize, offset=at)
        at += int(size)
    return columns


def pack_texts(columns: dict[str, pa.Array]) -> bytes:
    """Arrays of any types and lengths as bytes."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in columns.values()]
    batch = pa.record_batch(lists, names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_texts(data: bytes) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    return {name: batch.column(i).flatten() for i, name in enumerate(batch.schema.names)}


def lines(names: pa.Array) -> np.ndarray:
    """Names as the bytes of one text, a line each: their places would take as much room as they do. No token holds a line feed."""
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), "\n")
    return np.frombuffer(text[0].as_buffer(), dtype=np.uint8)


def as_rows(rows: list[dict], fields: dict[str, tuple[str, pa.DataType]]) -> pa.RecordBatch:
    arrays = [pa.array([r.get(name) for r in rows], kind) for name, (_, kind) in fields.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(fields))


# Tokens


def split(texts: pa.Array, table: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of texts after bytes have changed by a table: (place among the distinct words, those, the text it is in)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    begin, end = int(offsets[0]), int(offsets[-1])
    data = texts.buffers()[2][begin:end].to_pybytes().translate(table) if end > begin else b""
    texts = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - np.int32(begin)), pa.py_buffer(data))
    words = pc.split_pattern(texts, " ")
    text_of = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
    words = words.flatten()
    whole = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(whole).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, text_of[whole.to_numpy(zero_copy_only=False)]


def listed(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def tokens_of(word: str, kind: Kind, letters: set[str]) -> tuple[str, ...]:
    """What becomes of a word of a text: none if it is a stop word, else the tokens of its stem."""
    if word in kind.stop:
        return ()
    stem = kind.stem(word) if kind.stem else word
    if letters.issuperset(stem):
        return (stem,) if len(stem) > 1 else ()
    parts = "".join([c if c in letters else " " for c in stem])
    return tuple(t for t in parts.split(" ") if len(t) > 1)


def tokenised(low: pa.Array, plain: pa.Array, kinds: Sequence[Kind], known: dict[str, dict]) -> Iterator[tuple[Kind, np.ndarray, pa.Array, np.ndarray]]:
    """Per kind (the kind, number of each token, distinct tokens, the text it is in); known: words met before.

    low: texts in small letters whose only white space beyond ASCII is a space.
    plain: the same where no character beyond ASCII is left but letters and
    digits, which is what tells these from others.
    """
    raw = split(plain, TOKENS)
    letters = set("".join(listed(raw[1]))).union(string.ascii_letters, string.digits, "_")
    cleaned = split(low, CLEANED) if any(k.stop is not None for k in kinds) else None
    for kind in kinds:
        if kind.stop is None:
            word, words, text_of = raw
            long = (pc.utf8_length(words).to_numpy() > 1)[word]
            yield kind, word[long], words, text_of[long]
            continue
        word, words, text_of = cleaned
        met, words = known.setdefault(kind.name, {}), listed(words)
        found = list(map(met.get, words))
        for i in [i for i, tokens in enumerate(found) if tokens is None]:
            if len(met) >= WORDS_KEPT:
                met.clear()
            found[i] = met[words[i]] = tokens_of(words[i], kind, letters)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        coded = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        n = sizes[word]
        # The place of each token: where its word's tokens begin, and so many on.
        at = np.repeat((np.cumsum(sizes) - sizes)[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield kind, coded.indices.to_numpy().astype(np.int64)[at], coded.dictionary, np.repeat(text_of, n)


# Blocks


def mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = hashes * np.uint64(0x9E3779B97F4A7C15)
    return hashes ^ (hashes >> np.uint64(29))


def hashed(words: pa.Array) -> np.ndarray:
    """A number for each word, which follows from its bytes alone; no word is empty."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    powers = np.cumprod(np.full(int(sizes.max()), 0x100000001B3, dtype=np.uint64))
    at = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    return mixed(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[at], offsets[:-1] - offsets[0]))


def grouped(keys: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, and (text, place of the key among these, count) of each key in a text, by key and text.

    One sort of numbers that hold the key and the text.
    """
    if not len(keys):
        return keys, text_of, keys, keys
    n_texts, distinct = int(text_of.max()) + 1, None
    if int(keys.max()) >= 2**62 // n_texts:
        distinct, keys = np.unique(keys, return_inverse=True)
    both = np.sort(keys * n_texts + text_of)
    begin = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    key, text = np.divmod(both[begin], n_texts)
    new = np.append(True, key[1:] != key[:-1])
    return key[new] if distinct is None else distinct, text, np.cumsum(new) - 1, np.diff(np.append(begin, len(both)))


def counted(word: np.ndarray, words: pa.Array, text_of: np.ndarray, high: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length up to `high`: the distinct runs of tokens, their hashes, and (text, run, count) of each run in a text."""
    n_words, single = max(1, len(words)), hashed(words)
    # The run that begins at each place, -1 where there is none.
    run, runs, hashes = word, words, single
    for n in range(1, high + 1):
        if n == 1:
            keys, whole = word, np.ones(len(word), dtype=bool)
        else:
            left = run[: max(0, len(run) - 1)]
            whole = (text_of[: len(left)] == text_of[n - 1 :]) & (left >= 0)
            keys = left[whole] * n_words + word[n - 1 :][whole]
        distinct, text, term, tf = grouped(keys, text_of[: len(whole)][whole])
        if n == 1:
            runs, hashes = words.take(pa.array(distinct)), single[distinct]
        else:
            first, last = np.divmod(distinct, n_words)
            runs = pc.binary_join_element_wise(runs.take(pa.array(first)), words.take(pa.array(last)), " ")
            hashes = mixed(hashes[first] + single[last] * np.uint64(3))
        if n < high:
            run = np.full(len(whole), -1, dtype=np.int64)
            run[whole] = np.searchsorted(distinct, keys) if n > 1 else np.cumsum(np.isin(np.arange(n_words), distinct))[keys] - 1
        yield runs, hashes, text, term, tf


def block_rows(side: str, doc_id: pa.Array, label: pa.Array, low: pa.Array, plain: pa.Array, kinds: Sequence[Kind], labels: Sequence[int], buckets: int, known: dict) -> Iterator[pa.RecordBatch]:
    """What a block asks of the buckets and what it keeps, a batch for each kind of cleaning."""
    block, fits = uuid.uuid4().hex, side == "train"
    is_label = {c: pc.fill_null(pc.equal(label, c), False).to_numpy(zero_copy_only=False) for c in labels}
    for kind, word, words, text_of in tokenised(low, plain, kinds, known):
        # New texts ask for all their terms, texts of the fit for those they have to weigh.
        most = kind.weighed if fits else kind.high
        names, hashes, orders, have, kept = [], [], [], [], []
        for n, (runs, hashes_of, text, term, tf) in enumerate(counted(word, words, text_of, kind.high), start=1):
            if fits:
                sums = [np.bincount(term, minlength=len(runs))]
                sums += [np.bincount(term, weights=tf * is_label[c][text], minlength=len(runs)) for c in labels]
                have.append(sums)
            if n <= most:
                kept.append((text, term + sum(map(len, names)), tf))
            names.append(runs)
            hashes.append(hashes_of)
            orders.append(np.full(len(runs), n, dtype=np.uint8))
        names, orders = pa.concat_arrays(names), np.concatenate(orders)
        bucket = ((np.concatenate(hashes) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        # Short terms stay first within a bucket, so those to be answered and those to be weighed do.
        place = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        names = names.take(pa.array(place))
        # No block has so many tokens that 32 bits are too few.
        columns = {name: np.concatenate(x).astype(np.int32)[place] for name, x in zip(["df", *[f"total_{c}" for c in labels]], zip(*have), strict=fits)}
        size, wanted, weighed = (np.bincount(bucket[orders <= h], minlength=buckets) for h in (kind.high, most, kind.weighed))
        begin = np.cumsum(size) - size
        rows = []
        for b in np.flatnonzero(size).tolist():
            at, n = int(begin[b]), int(size[b])
            payload = pack({"terms": lines(names.slice(at, n)), **{c: v[at : at + n] for c, v in columns.items()}})
            rows.append({"what": "request", "side": side, "cleaning": kind.name, "bucket": b, "block": block, "wanted": int(wanted[b]), "weighed": int(weighed[b]), "payload": payload})
        if most:
            # A term is now its place among the answers, bucket by bucket.
            number = np.empty(len(place), dtype=np.int64)
            number[place] = np.arange(len(place)) - np.repeat(begin - (np.cumsum(wanted) - wanted), size)
            text, term, tf = (np.concatenate(x) for x in zip(*kept, strict=True))
            answered = orders[place]
            texts = {
                "doc_id": doc_id,
                "label": label,
                "text": pa.array(text.astype(np.int32)),
                "term": pa.array(number[term].astype(np.int32)),
                "tf": pa.array(tf.astype(np.int32)),
                "order": pa.array(answered[answered <= most]),
            }
            rows.append({"what": "texts", "side": side, "cleaning": kind.name, "block": block, "payload": pack_texts(texts)})
        yield as_rows(rows, ROWS)


def block_counter(side: str, kinds: Sequence[Kind], labels: Sequence[int], buckets: int) -> Callable:
    """For mapInArrow over (doc_id, label, low, plain): ROWS of all blocks. plain is null where it equals low."""
    kinds, labels, most = tuple(kinds), tuple(labels), BLOCK_BYTES

    def run(batches):
        known, waiting, size = {}, [], 0

        def block():
            rows = pa.Table.from_batches(waiting).combine_chunks()
            doc_id, label, low, plain = (c.chunk(0) for c in rows.columns)
            low, plain = low.cast(pa.string()), plain.cast(pa.string())
            yield from block_rows(side, doc_id, label, low, pc.coalesce(plain, low), kinds, labels, buckets, known)

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy())
            at = 0
            while at < len(batch):
                before = int(ends[at - 1]) if at else 0
                end = int(np.searchsorted(ends, before + most - size, side="right"))
                end = max(end, at if waiting else at + 1)
                if end > at:
                    waiting.append(batch.slice(at, end - at))
                    size += int(ends[end - 1]) - before
                if end < len(batch):
                    yield from block()
                    waiting, size = [], 0
                at = end
        if waiting:
            yield from block()

    return run


# Buckets


def sums_fields(kinds: Sequence[Kind], labels: Sequence[int]) -> dict[str, tuple[str, pa.DataType]]:
    """Columns of what a bucket adds to a variant, by its place in its kind: n_<s> terms and mass_<s>_<class>."""
    places = range(max(len(k.schemes) for k in kinds))
    fields = {f"n_{s}": ("long", pa.int64()) for s in places}
    return fields | {f"mass_{s}_{c}": ("double", pa.float64()) for s in places for c in labels}


def settler(kinds: Sequence[Kind], labels: Sequence[int]) -> Callable:
    """For applyInArrow over the requests of a bucket: an answer to each, and what the bucket adds to each variant.

    A text of the fit gets df, one to be scored the totals of the classes too.
    `at` is the place of a term in its bucket, by which it is known from now on:
    an ask of new texts for TF-IDF sums names no more than that.
    """
    kinds, labels, fields = {k.name: k for k in kinds}, tuple(labels), ROWS | sums_fields(kinds, labels)

    def run(key, table):
        kind, bucket = kinds[key[0].as_py()], key[1].as_py()
        requests = [unpack(p) for p in table["payload"].to_pylist()]
        names = pc.split_pattern(pa.array([r["terms"].tobytes() for r in requests], pa.binary()).cast(pa.string()), "\n")
        coded = names.flatten().dictionary_encode()
        place, n = coded.indices.to_numpy(), len(coded.dictionary)
        have = {"df": np.zeros(n, dtype=np.int64)} | {f"total_{c}": np.zeros(n, dtype=np.int64) for c in labels}
        places = np.split(place, np.cumsum(pc.list_value_length(names).to_numpy())[:-1])
        for request, at in zip(requests, places, strict=True):
            if "df" in request:
                for name, total in have.items():
                    total[at] += request[name]
        order = pc.count_substring(coded.dictionary, " ").to_numpy() + 1
        sums = {"what": "mass", "cleaning": kind.name, "bucket": bucket}
        for s, scheme in enumerate(kind.schemes):
            has = scheme.has(have["df"], order)
            sums[f"n_{s}"] = int(np.count_nonzero(has))
            if not scheme.tfidf:
                sums |= {f"mass_{s}_{c}": float(have[f"total_{c}"][has].sum()) for c in labels}
        rows = [sums]
        sides, blocks, wanted, weighed = (table[c].to_pylist() for c in ("side", "block", "wanted", "weighed"))
        for side, block, n_wanted, n_weighed, at in zip(sides, blocks, wanted, weighed, places, strict=True):
            to = {"side": side, "cleaning": kind.name, "bucket": bucket, "block": block}
            known_by = {"at": at[:n_weighed]}
            if n_weighed and side == "test":
                rows.append({"what": "ask", **to, "payload": pack(known_by)})
            if n_wanted:
                answer = known_by if side == "train" else {}
                answer |= {name: total[at[:n_wanted]] for name, total in have.items() if side == "test" or name == "df"}
                rows.append({"what": "answer", **to, "payload": pack(answer)})
        return pa.Table.from_batches([as_rows(rows, fields)])

    return run


def answers_of(table: pa.Table, what: str) -> tuple[list[int], list[dict[str, np.ndarray]]]:
    """The buckets that sent rows of this sort to a block, in order, and what these say."""
    rows = sorted((b, p) for w, b, p in zip(*(table[c].to_pylist() for c in ("what", "bucket", "payload")), strict=True) if w == what)
    return [b for b, _ in rows], [unpack(p) for _, p in rows]


def texts_of(table: pa.Table) -> dict[str, pa.Array]:
    return unpack_texts(next(p for w, p in zip(table["what"].to_pylist(), table["payload"].to_pylist(), strict=True) if w == "texts"))


def joined(answers: list[dict[str, np.ndarray]], name: str, kind: type = np.int64) -> np.ndarray:
    return np.concatenate([a[name] for a in answers] or [np.zeros(0, dtype=kind)])


def idf(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def weigher(kinds: Sequence[Kind], labels: Sequence[int], n_docs: int) -> Callable:
    """For applyInArrow over the texts of a block of the fit and the answers to it: its part of the TF-IDF sums, by bucket."""
    kinds, labels = {k.name: k for k in kinds}, tuple(labels)

    def run(key, table):
        block, kind = key[0].as_py(), kinds[key[1].as_py()]
        texts = texts_of(table)
        buckets, answers = answers_of(table, "answer")
        df, order = joined(answers, "df"), texts["order"].to_numpy()
        text, term, tf = (texts[c].to_numpy() for c in ("text", "term", "tf"))
        label = texts["label"].to_numpy()[text]
        sums = {}
        for s, scheme in enumerate(kind.schemes):
            if not scheme.tfidf:
                continue
            value = tf * np.where(scheme.has(df, order), idf(n_docs, df), 0.0)[term]
            norm = np.sqrt(np.bincount(text, weights=value * value, minlength=len(texts["doc_id"])))
            share = value / np.where(norm > 0, norm, 1.0)[text]
            sums |= {f"sum_{s}_{c}": np.bincount(term[label == c], weights=share[label == c], minlength=len(df)) for c in labels}
        rows, begin = [], 0
        for bucket, answer in zip(buckets, answers, strict=True):
            end = begin + len(answer["df"])
            payload = pack({"at": answer["at"], **{name: v[begin:end] for name, v in sums.items()}})
            rows.append({"what": "sums", "cleaning": kind.name, "bucket": bucket, "block": block, "payload": payload})
            begin = end
        return pa.Table.from_batches([as_rows(rows, ROWS)])

    return run


def summer(kinds: Sequence[Kind], labels: Sequence[int]) -> Callable:
    """For applyInArrow over a bucket's parts of TF-IDF sums and what new texts ask of it: the sums of their terms."""
    kinds, labels, fields = {k.name: k for k in kinds}, tuple(labels), ROWS | sums_fields(kinds, labels)

    def run(key, table):
        kind, bucket = kinds[key[0].as_py()], key[1].as_py()
        rows = [(w, b, unpack(p)) for w, b, p in zip(*(table[c].to_pylist() for c in ("what", "block", "payload")), strict=True)]
        n = 1 + max(int(r["at"].max()) for _, _, r in rows)
        names = [f"{s}_{c}" for s, scheme in enumerate(kind.schemes) if scheme.tfidf for c in labels]
        sums = {name: np.zeros(n) for name in names}
        for what, _, row in rows:
            if what == "sums":
                for name, total in sums.items():
                    total[row["at"]] += row[f"sum_{name}"]
        out = [{"what": "mass", "cleaning": kind.name, "bucket": bucket} | {f"mass_{name}": float(total.sum()) for name, total in sums.items()}]
        for what, block, row in rows:
            if what == "ask":
                payload = pack({f"sum_{name}": total[row["at"]] for name, total in sums.items()})
                out.append({"what": "shares", "side": "test", "cleaning": kind.name, "bucket": bucket, "block": block, "payload": payload})
        return pa.Table.from_batches([as_rows(out, fields)])

    return run


def scorer(kinds: Sequence[Kind], labels: Sequence[int], n_docs: int, mass: dict[str, dict], doc_id: pa.DataType) -> Callable:
    """For applyInArrow over the new texts of a block and all answers to it: (variant, doc_id, label, part_<class>).

    The parts are what the terms of a text add to the log prior of a class. mass: by kind, the sums over all buckets.
    """
    kinds, labels = {k.name: k for k in kinds}, tuple(labels)

    def run(key, table):
        kind = kinds[key[1].as_py()]
        texts = texts_of(table)
        n, (_, answers), (_, shares) = len(texts["doc_id"]), answers_of(table, "answer"), answers_of(table, "shares")
        df, order = joined(answers, "df"), texts["order"].to_numpy()
        text, term, tf = (texts[c].to_numpy() for c in ("text", "term", "tf"))
        batches = []
        for s, scheme in enumerate(kind.schemes):
            has = scheme.has(df, order)
            value = tf * np.where(has, idf(n_docs, df) if scheme.tfidf else 1.0, 0.0)[term]
            norm = np.sqrt(np.bincount(text, weights=value * value, minlength=n)) if scheme.tfidf else np.ones(n)
            parts = []
            for c in labels:
                if scheme.tfidf:
                    mine = np.zeros(len(df))
                    mine[order <= kind.weighed] = joined(shares, f"sum_{s}_{c}", np.float64)
                else:
                    mine = joined(answers, f"total_{c}").astype(np.float64)
                sums = mass[kind.name]
                log_prob = np.where(has, np.log(mine + 1.0) - np.log(max(1.0, sums[f"mass_{s}_{c}"] + sums[f"n_{s}"])), 0.0)
                parts.append(np.bincount(text, weights=value * log_prob[term], minlength=n) / np.where(norm > 0, norm, 1.0))
            columns = [pa.array([scheme.name] * n, pa.string()), texts["doc_id"].cast(doc_id), texts["label"], *map(pa.array, parts)]
            batches.append(pa.RecordBatch.from_arrays(columns, names=["variant", "doc_id", "label", *[f"part_{c}" for c in labels]]))
        return pa.Table.from_batches(batches)

    return run
