"""Sequences of a fixed token limit, packed by the dot-product rule.

An example is a vector: its tokens, one segment, its loss-bearing tokens. The
open sequence has a vector of what it can still take. Of a buffer of waiting
examples, the one whose vector has the largest dot product with that remainder
goes in next. What no waiting example fits into is filled by cutting one.
Each task packs its own rows as they stream by; no row moves.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lexitally.llm.common import ship

BUFFER = 512
# Words kept lately, and as many older ones.
WORDS_KEPT = 300_000
# Below this code point, a letter stays one letter when normalised and lowered.
PLAIN_LETTERS = "İ"
# A full stop or comma after a small Latin-1 letter, before a space or the end.
STOP = re.compile(r"[.,](?<=[a-zß-öø-ÿ].)(?![^ ])")
# Without an apostrophe, these words are their runs of letters and of signs, and each digit.
OF_RUNS = re.compile(r"[!-&(-~ß-öø-ÿ]+")
RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


# The normaliser and the cutting of texts for which words stand alone.
WORDWISE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Words(dict):
    """Packed ids of the words met lately, from the tokenizer.

    When full, the words become the older ones, which are kept until it is full
    again; a word met meanwhile is taken over.

    A tokenizer of the known kind (see WORDWISE) never looks across white space,
    nor across the border between plain letters and a full stop or comma or other
    signs, so a text is its words one by one. Any other tokenizer gets whole texts.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.lookup = byte_letters()
        self.older: dict[str, bytes] = {}
        given = json.loads(tokenizer.to_str())
        self.wordwise = all(given[part] == known for part, known in WORDWISE.items()) and all(
            not t["normalized"] and not any(c.isspace() for c in t["content"]) for t in given["added_tokens"]
        )
        self.added = [t["content"].lower() for t in given["added_tokens"]]

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(word) <= 64:
            if len(self) >= WORDS_KEPT:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _ids(self, word: str) -> bytes:
        plain = word.isascii() or max(word) < PLAIN_LETTERS
        if plain and word.isalpha():
            # One word to the model too, which sees lower case, each byte as a letter.
            seen = word.lower()
            seen = seen if seen.isascii() else seen.encode().decode("latin-1").translate(self.lookup)
            return pack([token.id for token in self.model.tokenize(seen)])
        if plain and word[-1] in ".," and word[:-1].isalpha():
            return self[word[:-1]] + self[word[-1]]
        low = word.lower()
        if OF_RUNS.fullmatch(low) and not any(a in low for a in self.added):
            runs = RUNS.findall(low)
            if len(runs) > 1:
                return b"".join(map(self.__getitem__, runs))
        return pack(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def lowered(self, text: str) -> str:
        """The text as the tokenizer sees it, if that is one Latin-1 letter for another; else as it is.

        So words of other case meet the same entry, and so do those before a full
        stop or comma, which stand alone. An added token is told by its case: a
        text that may hold one stays.
        """
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        low = text.lower()
        return text if any(a in low for a in self.added) else STOP.sub(r" \g<0>", low)


def byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte: itself, or the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def words_of_file(name: str) -> Words:
    """One per Python worker, read from the file Spark sent along."""
    return Words(Tokenizer.from_file(SparkFiles.get(name)))


def tokens_of(text: str, words: Words, end: int) -> bytes:
    """Packed ids of a whole text and the closing id.

    Only spaces and line feeds cut here; other white space stays inside a word
    and is the tokenizer's business.
    """
    if not words.wordwise:
        return pack([*words.tokenizer.encode(text, add_special_tokens=False).ids, end])
    parts = words.lowered(text.replace("\n", " ")).split(" ")
    return b"".join([*map(words.__getitem__, filter(None, parts)), pack([end])])


class Packer:
    """Sequences of one task. `limits`: tokens, segments, loss-bearing tokens.

    Pieces are (key, start, length) and leave as (key, start, length, sequence,
    offset). With `cut`, examples may be cut anywhere; without, one that exceeds
    a limit is an error.
    """

    def __init__(self, limits: tuple[int, int, int], cut: bool = True, first_sequence: int = 0, buffer: int = BUFFER):
        self.limits = np.array(limits, dtype=np.float64)
        self.cut, self.sequence, self.size = cut, first_sequence, buffer
        self.vectors = np.zeros((buffer, 3))
        self.waiting: list[tuple] = []
        self._open()

    def _open(self) -> None:
        self.left = self.limits.copy()
        self.offset = 0
        self.members: list[tuple] = []

    def _place(self, key, start: int, length: int, loss: int) -> None:
        self.members.append((key, start, length, self.sequence, self.offset))
        self.offset += length
        self.left -= (length, 1, loss)

    def _close(self) -> list[tuple]:
        out = self.members
        self.sequence += 1
        self._open()
        return out

    def add(self, key, tokens: int, loss: int) -> Iterator[tuple]:
        """Take an example; its last `loss` tokens bear loss."""
        most = int(self.limits[0])
        start, prompt = 0, tokens - loss
        if not self.cut and (tokens > most or loss > self.limits[2]):
            raise ValueError("an example exceeds a limit and may not be cut")
        while tokens - start > most or self._loss(start, min(start + most, tokens), prompt) > self.limits[2]:
            # Whole sequences of one example need no partner.
            length = self._longest(start, tokens, prompt, self.limits[0], self.limits[2])
            kept = self.members, self.left, self.offset
            self._open()
            self._place(key, start, length, self._loss(start, start + length, prompt))
            yield from self.members
            self.sequence += 1
            self.members, self.left, self.offset = kept
            self.members = [(*m[:3], self.sequence, m[4]) for m in self.members]
            start += length
        if tokens > start:
            self._wait(key, start, tokens, prompt)
            if len(self.waiting) == self.size:
                yield from self._fill()

    @staticmethod
    def _loss(start: int, end: int, prompt: int) -> int:
        return max(0, end - max(start, prompt))

    def _longest(self, start: int, end: int, prompt: int, tokens: float, loss: float) -> int:
        """The longest piece from `start` within the limits."""
        length = min(end - start, int(tokens))
        over = self._loss(start, start + length, prompt) - int(loss)
        return length - max(0, over)

    def _wait(self, key, start: int, end: int, prompt: int) -> None:
        self.vectors[len(self.waiting)] = (end - start, 1, self._loss(start, end, prompt))
        self.waiting.append((key, start, end, prompt))

    def _take(self, i: int) -> tuple:
        item, last = self.waiting[i], len(self.waiting) - 1
        self.waiting[i], self.vectors[i] = self.waiting[last], self.vectors[last]
        self.waiting.pop()
        return item

    def _fill(self) -> Iterator[tuple]:
        """Place waiting examples until the open sequence is full."""
        while self.waiting:
            sizes = self.vectors[: len(self.waiting)]
            fits = (sizes <= self.left).all(axis=1)
            if fits.any():
                scores = (sizes / self.limits) @ (self.left / self.limits)
                i = int(np.where(fits, scores, -1.0).argmax())
                key, start, end, prompt = self._take(i)
                self._place(key, start, end - start, self._loss(start, end, prompt))
            elif self.cut and self.left[0] >= 1 and self.left[1] >= 1 and self.left[2] >= 1:
                key, start, end, prompt = self._take(int(sizes[:, 0].argmax()))
                length = self._longest(start, end, prompt, self.left[0], self.left[2])
                self._place(key, start, length, self._loss(start, start + length, prompt))
                self._wait(key, start + length, end, prompt)
            else:
                yield from self._close()
                return
            if self.left.min() < 1:
                yield from self._close()
                return

    def finish(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._fill()
        if self.members:
            yield from self._powers() if self.cut else self._close()

    def _powers(self) -> Iterator[tuple]:
        """The last sequence, dealt out to sequences whose lengths are powers of two: these are not padded."""
        members, total = self._close(), 0
        total = sum(m[2] for m in members)
        room, offset = 0, 0
        for key, start, length, _, _ in members:
            while length:
                if not room:
                    room, offset = 1 << (total.bit_length() - 1), 0
                    self.sequence += 1
                n = min(length, room)
                yield key, start, n, self.sequence - 1, offset
                start, length, room, offset, total = start + n, length - n, room - n, offset + n, total - n


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end: int = 2,
    limits: tuple[int, int, int] = (4096, 4096, 4096),
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document in a sequence, in one narrow stage.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).
    All tokens of a document bear loss. A null or empty text is the closing id
    alone. Repeated rows and null ids are packed like any other; an empty table
    gives no sequences. A lost task is packed again with the same result.
    """
    return _packed(docs.select("doc_id", "text"), tokenizer_path, end, limits, keep_ids, None)


def pack_examples(docs: DataFrame, tokenizer_path: str, prompt: Callable[[str], int], **options) -> DataFrame:
    """As `pack_documents`; `prompt` gives the number of leading tokens without loss from a text."""
    return _packed(docs.select("doc_id", "text"), tokenizer_path, options.pop("end", 2), options.pop("limits", (4096, 4096, 4096)), options.pop("keep_ids", False), prompt)


def _packed(docs: DataFrame, path: str, end: int, limits, keep_ids: bool, prompt) -> DataFrame:
    ship(docs).sparkSession.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    schema += ", ids binary" if keep_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of_file(name)
        packer = Packer(limits, first_sequence=TaskContext.get().partitionId() << 33)
        # Ids wait here, by a number of the row, until all their pieces are placed.
        held: dict[int, list] = {}
        number = 0

        def rows(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            found = []
            for key, start, length, sequence, offset in pieces:
                doc, ids, missing = held[key]
                part = ids[4 * start : 4 * (start + length)]
                found.append((doc, start, length, zlib.crc32(part), len(ids) // 4, sequence, offset, part))
                held[key][2] = missing - length
                if missing == length:
                    del held[key]
            if found:
                columns = list(zip(*found, strict=True))[: 8 if keep_ids else 7]
                names = schema.replace(",", "").split()[0::2]
                kinds = [doc_type] + [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        doc_type = pa.int64()
        for batch in batches:
            doc_type = batch.schema.field(0).type

            def pieces(batch=batch) -> Iterator[tuple]:
                nonlocal number
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    text = text.as_py() or ""
                    ids = tokens_of(text, words, end)
                    n = len(ids) // 4
                    held[number] = [doc, ids, n]
                    yield from packer.add(number, n, n - min(n, prompt(text)) if prompt else n)
                    number += 1

            yield from rows(pieces())
        yield from rows(packer.finish())

    return docs.mapInArrow(run, schema)
