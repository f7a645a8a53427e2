"""SentencePiece BPE that keeps, for every piece, the bytes of the text it came from.

Normalising takes the longest prefix the model's compiled character map knows,
again and again, and notes for each byte it writes where in the text that came
from. Pieces are merged on the normalised text; their byte ranges there are
projected through the notes onto the text itself. No piece of a model crosses
certain borders (before a space, around characters that only stand alone), so a
text is merged segment by segment, and segments seen before are looked up.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from lexitally.llm.common import ship

SPACE = "▁"
SEGMENTS_KEPT = 300_000
CHARACTERS_KEPT = 50_000
# Characters of a text normalised at once, and segments held at once.
WINDOW = 1 << 19
# Segments up to this length are searched pair by pair, longer ones with a heap.
SHORT = 48

# Kinds of pieces and of models in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one-by-one", _one_by_one)


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes, and the strings its keys turn into."""

    def __init__(self, data: bytes):
        size = struct.unpack_from("<I", data)[0] if data else 0
        self.units = struct.unpack_from(f"<{size // 4}I", data, 4) if data else ()
        self.strings = data[4 + size :]
        self.alone: dict[str, bool] = {}

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that begins here, and what it turns into."""
        units, node, found = self.units, 0, None
        node = _base(units[0])
        for end in range(at, len(data)):
            byte = data[end]
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= _base(unit)
            if unit >> 8 & 1:
                found = end + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]

    def starts_none(self, character: str) -> bool:
        """Does no key begin with the bytes of this character?"""
        known = self.alone.get(character)
        if known is None:
            node, known = _base(self.units[0]), False
            for byte in character.encode():
                node ^= byte
                if self.units[node] & 0x800000FF != byte:
                    known = True
                    break
                node ^= _base(self.units[node])
            if len(self.alone) >= CHARACTERS_KEPT:
                self.alone.clear()
            self.alone[character] = known
        return known


def _base(unit: int) -> int:
    return unit >> 10 << ((unit & 0x200) >> 6)


class Normalizer:
    def __init__(self, charsmap: bytes, prefix: bool, squeeze: bool, escape: bool):
        self.map = CharacterMap(charsmap)
        self.prefix, self.squeeze = prefix, squeeze
        self.space = SPACE if escape else " "
        # Spaces, as which a written sign for a space counts, and what is between them.
        self.parts = re.compile(rf" |{self.space}|(?:(?! |{self.space}).)+".encode(), re.DOTALL).findall

    def windows(self, text: str) -> Iterator[tuple[str, np.ndarray]]:
        """Normalised text in parts; of each byte, the place in the text where its source begins.

        The last array has one more entry: where the source of the last byte ends.
        """
        if not text:
            return
        if self.map.units or self.squeeze:
            yield from self._by_map(text)
            return
        done = 0
        wide = len(self.space.encode())
        for at in range(0, len(text), WINDOW):
            part = text[at : at + WINDOW]
            data = np.frombuffer(part.encode(), dtype=np.uint8)
            sources = np.repeat(np.arange(done, done + len(data)), np.where(data == 0x20, wide, 1))
            # A byte of a character belongs to the character's first byte.
            inside = (data & 0xC0) == 0x80
            if inside.any():
                first = np.maximum.accumulate(np.where(inside, 0, np.arange(len(data))))
                sources = done + first[sources - done]
            part = part.replace(" ", self.space)
            if at == 0 and self.prefix:
                part, sources = self.space + part, np.concatenate([np.zeros(wide, dtype=sources.dtype), sources])
            done += len(data)
            if at + WINDOW >= len(text):
                sources = np.append(sources, done)
            yield part, sources

    def _by_map(self, text: str) -> Iterator[tuple[str, np.ndarray]]:
        data, at, spaced = text.encode(), 0, self.squeeze
        out: list[bytes] = []
        sources: list[int] = []
        space, first, given = self.space.encode(), True, False
        # Spaces are written when something comes after them; those at the end may go.
        waiting: list[int] = []

        def write(value: bytes, source: int) -> None:
            out.append(value)
            sources.extend([source] * len(value))

        while at < len(data):
            size = _character(data[at])
            value = data[at : at + size]
            if self.map.units and not self.map.starts_none(value.decode()):
                size, value = self.map.longest(data, at) or (size, value)
            if self.squeeze and spaced:
                value = value.lstrip(b" ")
            if value:
                if first and self.prefix:
                    waiting.append(at)
                first = False
                for piece in self.parts(value):
                    if piece in (b" ", space):
                        waiting.append(at)
                        continue
                    for source in waiting:
                        write(space, source)
                    waiting.clear()
                    write(piece, at)
                spaced = value.endswith(b" ")
            at += size
            if not self.squeeze:
                spaced = False
            if len(sources) >= WINDOW:
                yield b"".join(out).decode(), np.array(sources, dtype=np.int64)
                given = True
                out.clear()
                sources.clear()
        end = len(data)
        if self.squeeze and waiting:
            end = waiting[0]
        else:
            for source in waiting:
                write(space, source)
        if sources or given:
            yield b"".join(out).decode(), np.array([*sources, end], dtype=np.int64)


def _character(lead: int) -> int:
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Segments(dict):
    """What segments turn into. When full, those not asked for since the last time go."""

    def __init__(self, make):
        self.make = make
        self.older: dict[str, tuple[bytes, bytes, str]] = {}

    def __missing__(self, segment: str) -> tuple[bytes, bytes, str]:
        made = self.older.get(segment) or self.make(segment)
        if len(segment) <= 64:
            if len(self) >= SEGMENTS_KEPT:
                self.older = dict(self)
                self.clear()
            self[segment] = made
        return made


class Pieces:
    """A BPE model file: its normaliser, its merges, encoding with spans, and decoding."""

    def __init__(self, model: bytes):
        pieces, trainer, rules = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        kinds = [p.get(3, NORMAL) for p in pieces]
        names = [p.get(1, b"").decode() for p in pieces]
        if trainer.get(3, 1) != BPE or trainer.get(24, 0) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models without user-defined or unused pieces and with spaces in front")
        self.escape = bool(rules.get(5, 1))
        self.prefix = bool(rules.get(3, 1))
        self.squeeze = bool(rules.get(4, 1))
        self.normalizer = Normalizer(rules.get(2, b""), self.prefix, self.squeeze, self.escape)
        self.unknown = kinds.index(UNKNOWN)
        self.unknown_packed = struct.pack("<I", self.unknown)
        self.by_bytes = bool(trainer.get(35, 0))
        self.byte_ids = [0] * 256
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        # Decoding: the bytes of every id.
        self.table: list[bytes] = []
        for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
            made = b""
            if kind == BYTE:
                byte = int(name[3:5], 16)
                self.byte_ids[byte] = i
                made = bytes([byte])
            elif kind == UNKNOWN:
                made = trainer.get(44, " ⁇ ".encode())
            elif kind == NORMAL:
                self.ids[name] = i
                self.score[name] = struct.unpack("<f", pieces[i][2])[0] if 2 in pieces[i] else 0.0
                made = name.replace(SPACE, " ").encode()
            self.table.append(made)
        self.silent = {i for i, made in enumerate(self.table) if not made}
        self.opens = [kind == NORMAL and name.startswith(SPACE) for name, kind in zip(names, kinds, strict=True)]
        self.pattern = re.compile(self._borders())
        self.entries = {name: self._entry(name) for name in self.ids}
        self.segments = Segments(self._segment)

    def _borders(self) -> str:
        """A pattern of segments: no piece reaches over the end of one."""
        long = [p for p in self.score if len(p) > 1]
        joined = set("".join(long))
        if any(SPACE in p.lstrip(SPACE) for p in long):
            return r"(?s).+"
        letters = {c for c in joined if c.isalpha()}
        signs = joined - letters - {SPACE}
        inner, letters, signs = ("".join(map(re.escape, sorted(c))) for c in (joined - {SPACE}, letters, signs))
        if not inner:
            return r"(?s)."
        if not signs or not letters or any(a.isalpha() and b != SPACE and not b.isalpha() for p in long for a, b in zip(p, p[1:])):
            return rf"(?s){SPACE}*[{inner}]+|{SPACE}+|."
        # In this model, no piece goes on with a sign after a letter.
        return rf"(?s){SPACE}*[{signs}]*[{letters}]+|{SPACE}*[{signs}]+|{SPACE}+|."

    def _merge(self, segment: str) -> list[str]:
        """Join the neighbours that make the piece of highest score, leftmost first, while any do."""
        score = self.score
        if len(segment) > SHORT:
            return self._merge_long(segment)
        parts = list(segment)
        get, none = score.get, float("-inf")
        # The score of each pair of neighbours.
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == none:
                break
            at = scores.index(best)
            parts[at] += parts.pop(at + 1)
            del scores[at]
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], none)
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], none)
        return parts

    def _merge_long(self, segment: str) -> list[str]:
        score, n = self.score, len(segment)
        parts: list[str | None] = list(segment)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n:
                whole = parts[left] + parts[right]
                if whole in score:
                    heapq.heappush(heap, (-score[whole], left, whole))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, left, whole = heapq.heappop(heap)
            if parts[left] is None or after[left] >= n or parts[left] + parts[after[left]] != whole:
                continue
            right = after[left]
            parts[left], parts[right] = whole, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [p for p in parts if p is not None]

    def _segment(self, segment: str) -> tuple[bytes, bytes, str]:
        """Packed ids, packed lengths in normalised bytes, and the ids as text."""
        packed, sizes, names = zip(*[self.entries.get(part) or self._entry(part) for part in self._merge(segment)], strict=True)
        return b"".join(packed), b"".join(sizes), ",".join(names)

    def _entry(self, part: str) -> tuple[bytes, bytes, str]:
        """The same of one piece, or of a character that is none."""
        data, found = part.encode(), self.ids.get(part)
        if found is None and self.by_bytes:
            # The character's bytes one by one; the last one answers for all of it.
            ids, sizes = [self.byte_ids[b] for b in data], [0] * (len(data) - 1) + [len(data)]
        else:
            ids, sizes = [self.unknown if found is None else found], [len(data)]
        return struct.pack(f"<{len(ids)}I", *ids), struct.pack(f"<{len(sizes)}I", *sizes), ",".join(map(str, ids))

    def encode(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """Parts of a text: ids, where each piece begins and ends in the text's bytes, and the ids as text."""
        rest, known = "", np.zeros(0, dtype=np.int64)
        windows = self.normalizer.windows(text)
        ahead = next(windows, None)
        while ahead is not None:
            part, sources = ahead
            ahead = next(windows, None)
            part, sources = rest + part, np.concatenate([known, sources])
            found = self.pattern.findall(part)
            rest, known = "", sources[:0]
            if ahead is not None:
                # The last segment may go on.
                rest = found.pop()
                # Nor may a run of unknown characters end here, which are one piece.
                while found and not self.by_bytes and self.segments[found[-1]][0] == self.unknown_packed:
                    rest = found.pop() + rest
                known = sources[len(sources) - len(rest.encode()) :]
            if not found:
                continue
            packed, sizes, names = zip(*map(self.segments.__getitem__, found), strict=True)
            ids = np.frombuffer(b"".join(packed), dtype="<u4")
            ends = np.cumsum(np.frombuffer(b"".join(sizes), dtype="<u4"), dtype=np.int64)
            names = ",".join(names)
            begins = np.concatenate([ends[:1] * 0, ends[:-1]])
            if not self.by_bytes and (ids == self.unknown).any():
                # Unknown characters side by side are one piece.
                first = np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown))
                final = np.append(first[1:], True)
                ids, begins, ends = ids[first], begins[first], ends[final]
                names = ",".join(map(str, ids.tolist()))
            # Where the source of the next byte begins, this one ends.
            close = np.append(sources, known[:1]) if len(known) else sources
            yield ids, close[begins], close[ends], names

    def decode(self, ids: Iterable[int], opening: bool = True) -> str:
        """The text of ids; `opening` tells whether they open a text, whose added space goes."""
        ids = list(ids)
        # A piece without text ends a run of bytes.
        edges = [at for at, i in enumerate(ids) if not self.table[i]] if self.silent.intersection(ids) else []
        runs = [ids[a:b] for a, b in zip([0, *edges], [*edges, len(ids)], strict=True)]
        data = "".join(b"".join(map(self.table.__getitem__, run)).decode("utf-8", "one-by-one") for run in runs)
        drop = 0
        if opening and (self.prefix or self.squeeze):
            for i in ids:
                drop += self.opens[i]
                # A model that drops extra spaces goes on past a piece that is nothing else.
                if not (self.squeeze and self.opens[i] and len(self.table[i]) == 1):
                    break
        return data[drop:]


@lru_cache(maxsize=2)
def reader(name: str) -> Pieces:
    """One per Python worker, read from the file Spark sent along."""
    with open(SparkFiles.get(name), "rb") as file:
        return Pieces(file.read())


def encode_documents(docs: DataFrame, model_path: str, keep: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256[, ids, spans]) of every row, in one narrow stage.

    `spans` are begin and end of each piece in bytes of the text, two by two; ids
    and spans are packed as little-endian 32-bit numbers. Of a character written
    as byte pieces, the last one has the span. A null or empty text has no pieces;
    repeated rows and null ids are rows like any other; an empty table gives no
    rows. The model file is sent to every executor by Spark.
    """
    ship(docs).sparkSession.sparkContext.addFile(model_path)
    name = model_path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = reader(name)
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(1):
                rows.append(_document(own, text.as_py() or "", keep))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * 2 * keep
            arrays = [batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"] + ["ids", "spans"] * keep
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + (", ids binary, spans binary" if keep else ""))


def _document(own: Pieces, text: str, keep: bool) -> tuple:
    n, ids_sha, out_sha, spans_sha, kept = 0, hashlib.sha256(), hashlib.sha256(), hashlib.sha256(), ([], [])
    for ids, begins, ends, names in own.encode(text):
        ids_sha.update(names.encode() if n == 0 else b"," + names.encode())
        # Segments hold whole characters, so parts decode one by one.
        out_sha.update(own.decode(ids.tolist(), opening=n == 0).encode())
        spans = np.stack([begins, ends], axis=1).astype("<u4").tobytes()
        spans_sha.update(spans)
        if keep:
            kept[0].append(ids.tobytes())
            kept[1].append(spans)
        n += len(ids)
    return n, ids_sha.hexdigest(), out_sha.hexdigest(), spans_sha.hexdigest(), b"".join(kept[0]), b"".join(kept[1])
