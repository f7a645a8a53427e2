"""Byte-level BPE as a transducer that is built while it runs.

Merging by rank gives the one sequence of tokens in which every two neighbours
would also come out of merging their own bytes. So an automaton can read the
bytes from left to right and keep every token that may be under way, with the
token before it. Such a set of possibilities is a state. Tokens on which all of
them agree are certain, which bounds the lookahead. States and steps are
computed when first met and kept in a table that is cleared when it is full.

Decoding reads ids and keeps the bytes of an unfinished UTF-8 character as its
only state.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from lexitally.llm.common import ship

PIECES_KEPT = 800_000
STATES_KEPT = 100_000
PAIRS_KEPT = 1_000_000
PIECES_AT_ONCE = 65_536
SHORT = 1_000_000


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_by_rank(ranks: dict[bytes, int], data: bytes, below: int = 1 << 60) -> list[int]:
    """Tokens of a short byte string: join the adjacent pair of lowest rank, leftmost first.

    Only pairs of a rank less than `below` are joined.
    """
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] >= below:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes of one piece to token ids.

    A possibility is (trie node, token before it): the bytes since that token
    began and are not finished. A state is the tuple of all of them. A step reads
    one byte; exactly one possibility then completes a token that may follow the
    one before, so the step also tells the last token of the text read so far.
    Tokens are certain, and emitted, where the chains of last tokens of all
    possibilities have met.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        # The trie as one table: node and byte to node, and the token of a node or -1.
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        self.depth = [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    self.token_at.append(-1)
                node = self.child[key]
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, int] | None] = {}
        self._clear(((0, -1),))

    def _clear(self, state: tuple) -> None:
        """An empty table, but for the start and the state to go on from."""
        start = ((0, -1),)
        self.states = [start]
        self.numbers = {start: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]
        if state != start:
            self._number(state)

    def _number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return found

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; None for a byte, (-1, -1) if merging never makes it."""
        if token in self.splits:
            return self.splits[token]
        data = self.token_bytes[token]
        if len(data) == 1:
            found = None
        else:
            # Merged without the token itself, two parts are left: the ones of its last merge.
            parts = merge_by_rank(self.ranks, data, below=token)
            grows = len(parts) == 2 and merge_by_rank(self.ranks, data) == [token] and max(parts) < token
            found = tuple(parts) if grows else (-1, -1)
        self.splits[token] = found
        return found

    def _fits(self, left: int, right: int) -> bool:
        """Walk back through the merges next to the border: did one across it come first?"""
        names, ranks, until_left, until_right = self.token_bytes, self.ranks, 1 << 60, 1 << 60
        while True:
            across = ranks.get(names[left] + names[right])
            if across is not None and across < until_left and across <= until_right:
                return False
            one, two = self._split(left), self._split(right)
            if (-1, -1) in (one, two):
                return False
            if one is None and two is None:
                return True
            if two is None or (one is not None and left > right):
                until_left, left = left, one[1]
            else:
                until_right, right = right, two[0]

    def _adjacent(self, left: int, right: int) -> bool:
        """Does merging the bytes of both give just these two? For -1 on the left: the token itself?"""
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        fits = self._split(right) != (-1, -1) if left < 0 else self._fits(left, right)
        self.pairs[left << 32 | right] = fits
        return fits

    def _step(self, number: int, byte: int) -> tuple[int, int]:
        child, token_at, pairs = self.child, self.token_at, self.pairs.get
        after, completed = [], None
        for node, last in self.states[number]:
            key = node << 8 | byte
            if key not in child:
                continue
            node = child[key]
            after.append((node, last))
            if completed is None:
                token = token_at[node]
                if token >= 0:
                    fits = pairs(last << 32 | token)
                    if self._adjacent(last, token) if fits is None else fits:
                        completed = token
        after.append((0, completed))
        step = self.steps[number][byte] = (self._number(tuple(after)), completed)
        return step

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > STATES_KEPT:
            self._clear(((0, -1),))
        out: list[int] = []
        at, steps, lasts = 0, self.steps, []
        for byte in piece:
            step = steps[at].get(byte)
            if step is None:
                if len(self.states) > 2 * STATES_KEPT:
                    self._clear(self.states[at])
                    at, steps = len(self.states) - 1, self.steps
                step = self._step(at, byte)
            at, last = step
            lasts.append(last)
            if len(lasts) >= 8192:
                certain = self._met(lasts, self.states[at])
                out += self._tokens(lasts, certain)
                del lasts[:certain]
        return out + self._tokens(lasts, len(lasts))

    def _met(self, lasts: list[int], state: tuple) -> int:
        """The last position through which the chains of all possibilities go."""
        ends = {len(lasts) - self.depth[node] for node, _ in state}
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(max(0, far - self.length[lasts[far - 1]]))
        return ends.pop()

    def _tokens(self, lasts: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(lasts[end - 1])
            end -= self.length[out[-1]]
        return out[::-1]


class Pieces(dict):
    """Packed ids of the pieces met so far; cleared when full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        packed = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= PIECES_KEPT:
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    """Encodes and decodes whole texts with one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.pieces = Pieces(self._piece)
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.whole = np.array([_is_whole(token) for token in self.table])
        self.strings = [t.decode() if w else "" for t, w in zip(self.table, self.whole, strict=True)]

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian 32-bit numbers; a piece that is a token is that token."""
        data = piece.encode()
        rank = self.ranks.get(data)
        ids = [rank] if rank is not None else self.transducer.encode(data)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids in chunks, so that a long text is never a list of its pieces."""
        ids = self.pieces.__getitem__
        if len(text) <= SHORT:
            yield b"".join(map(ids, self.pattern.findall(text)))
            return
        found = (ids(match.group()) for match in self.pattern.finditer(text))
        while chunk := b"".join(islice(found, PIECES_AT_ONCE)):
            yield chunk

    def decode(self, chunks: Iterable[bytes]) -> Iterator[str]:
        """Text of packed ids as a stream; only unfinished characters wait for the next id."""
        waiting = b""
        for chunk in chunks:
            ids = np.frombuffer(chunk, dtype="<u4")
            # Runs of whole tokens are looked up; the rest goes through the byte machine.
            edges = np.flatnonzero(np.diff(self.whole[ids].astype(np.int8))) + 1 if len(ids) else []
            for run in np.split(ids, edges) if len(ids) else []:
                if not waiting and self.whole[run[0]]:
                    yield "".join(map(self.strings.__getitem__, run.tolist()))
                    continue
                text, waiting = finish_characters(waiting + b"".join(map(self.table.__getitem__, run.tolist())))
                yield text
        if waiting:
            yield waiting.decode("utf-8", "replace")


def _is_whole(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def finish_characters(data: bytes) -> tuple[str, bytes]:
    """The finished characters, and the bytes of the one that is not.

    The machine's state is how many continuation bytes the last lead byte still
    lacks: 1, 2 or 3 at most.
    """
    for back in range(1, min(3, len(data)) + 1):
        byte = data[-back]
        if byte & 0xC0 == 0x80:
            continue
        need = 2 if byte >> 5 == 6 else 3 if byte >> 4 == 14 else 4 if byte >> 3 == 30 else 1
        if need > back:
            return data[:-back].decode("utf-8", "replace"), data[-back:]
        break
    return data.decode("utf-8", "replace"), b""


@lru_cache(maxsize=2)
def codec(name: str, pattern: str) -> Codec:
    """One per Python worker, read from the file Spark sent along."""
    with open(SparkFiles.get(name), "rb") as lines:
        return Codec(read_ranks(lines), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row, in one narrow stage.

    `ids` are packed as little-endian 32-bit numbers. A null or empty text has no
    tokens; repeated rows and null ids are rows like any other; an empty table
    gives no rows. The rank file is sent to every executor by Spark.
    """
    ship(docs).sparkSession.sparkContext.addFile(ranks_path)
    name = ranks_path.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(1):
                ids_sha, out_sha, n, parts = hashlib.sha256(), hashlib.sha256(), 0, []

                def encoded(text=text.as_py() or "", ids_sha=ids_sha, parts=parts):
                    nonlocal n
                    for chunk in own.encode(text):
                        ids_sha.update(chunk)
                        n += len(chunk) // 4
                        if keep_ids:
                            parts.append(chunk)
                        yield chunk

                for piece in own.decode(encoded()):
                    out_sha.update(piece.encode())
                rows.append((n, ids_sha.hexdigest(), out_sha.hexdigest(), b"".join(parts)))
            n, ids, out, packed = zip(*rows, strict=True) if rows else ((), (), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(packed, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
