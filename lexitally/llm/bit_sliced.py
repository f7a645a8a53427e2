"""Exact top-k inner products over bit slices.

Every component is quantised to an integer and cut into bits. For a block of
rows, one bitmap holds one bit of one component of all its rows. A query adds
up the bitmaps of its components, each as often and as far shifted as the bits
of its own value say, with bitwise carry-save adders: the scores of all rows
appear as slices, without being computed row by row. Going from the top slice
down, rows are chosen until k are sure; rows that tie at the border are resolved
by their ids. The bitmaps are built once and staged. Each block moves once, to
the task where the query chunks stream past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitally.llm.common import ship, stage

SCALE = 256
# Rows of a block: at least so many that bitmaps are worth it, at most so many that a block is some megabytes.
LEAST_BLOCK, BLOCK = 512, 16_384
QUERIES = 128


def usable(vector: Column) -> Column:
    """A vector without nulls, infinities or other non-numbers."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd)


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _planes(column: np.ndarray, bits: int) -> list[np.ndarray]:
    return [np.packbits((column >> np.uint64(s)).astype(np.uint8) & 1, bitorder="little").view(np.uint64) for s in range(bits)]


class Slices:
    """Bitmaps of a block: `plain[d][s]` is bit s of component d less its smallest value, `turned` the same of the largest less it."""

    def __init__(self, rows: int, top: np.ndarray, plain: list[list[np.ndarray]], turned: list[list[np.ndarray]]):
        self.rows, self.top, self.plain, self.turned = rows, top, plain, turned
        self.words = -(-rows // 64)

    @classmethod
    def of(cls, values: np.ndarray) -> Slices:
        rows, width = values.shape
        spread = (values - values.min(axis=0)).astype(np.uint64)
        top = spread.max(axis=0)
        padded = np.zeros((-(-rows // 64) * 64, width), dtype=np.uint64)
        padded[:rows] = spread
        bits = [int(t).bit_length() for t in top]
        plain = [_planes(padded[:, d], bits[d]) for d in range(width)]
        # For negative weights.
        turned = [_planes(top[d] - padded[:, d], bits[d]) for d in range(width)]
        return cls(rows, top, plain, turned)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """(top, plain, turned) as bytes."""
        joined = [b"".join(plane.tobytes() for planes in side for plane in planes) for side in (self.plain, self.turned)]
        return self.top.tobytes(), *joined

    @classmethod
    def unpacked(cls, rows: int, top: bytes, plain: bytes, turned: bytes) -> Slices:
        top = np.frombuffer(top, dtype=np.uint64)
        words = -(-rows // 64)
        sides = []
        for data in (plain, turned):
            flat = iter(np.frombuffer(data, dtype=np.uint64).reshape(-1, words) if data else ())
            sides.append([[next(flat) for _ in range(int(t).bit_length())] for t in top])
        return cls(rows, top, *sides)

    def weighted(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of (score + a constant of the query), least significant first."""
        columns: list[list[np.ndarray]] = []
        for d, weight in enumerate(query.tolist()):
            planes = self.plain[d] if weight > 0 else self.turned[d]
            weight, shift = abs(weight), 0
            while weight:
                if weight & 1:
                    for s, plane in enumerate(planes):
                        while len(columns) <= s + shift:
                            columns.append([])
                        columns[s + shift].append(plane)
                weight >>= 1
                shift += 1
        return self._added(columns)

    def _added(self, columns: list[list[np.ndarray]]) -> list[np.ndarray]:
        """Carry-save addition: three bitmaps of one weight become one of it and one of twice it."""
        out, at = [], 0
        while at < len(columns):
            column = columns[at]
            carries = columns[at + 1] if at + 1 < len(columns) else []
            head = 0
            while len(column) - head >= 3:
                a, b, c = column[head : head + 3]
                head += 3
                ab = a ^ b
                carry = a & b
                carry |= ab & c
                ab ^= c
                column.append(ab)
                carries.append(carry)
            if len(column) - head == 2:
                a, b = column[head:]
                carries.append(a & b)
                out.append(a ^ b)
            else:
                out.append(column[head] if len(column) > head else np.zeros(self.words, dtype=np.uint64))
            if at + 1 == len(columns) and carries:
                columns.append(carries)
            at += 1
        return out

    def best(self, slices: list[np.ndarray], candidates: np.ndarray, k: int) -> np.ndarray:
        """Row numbers of the k best candidates; ties at the border go to the first rows."""
        sure, maybe = np.zeros(self.words, dtype=np.uint64), candidates
        n_sure = 0
        for plane in reversed(slices):
            high = maybe & plane
            n = int(np.bitwise_count(high).sum())
            if n_sure + n > k:
                maybe = high
            else:
                sure |= high
                n_sure += n
                maybe = maybe & ~plane
                if n_sure == k:
                    break
        chosen = _rows(sure)
        if n_sure < k:
            chosen = np.concatenate([chosen, _rows(maybe)[: k - n_sure]])
        return chosen


def _rows(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(-1, 64)
    at, bit = np.nonzero(bits)
    return words[at] * 64 + bit


def _packed_rows(size: int):
    """Rows of a task, `size` at a time, as (vec_ids, row numbers, width, components)."""

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held: list[pd.DataFrame] = []
        n = 0

        def block(frame: pd.DataFrame):
            frame = frame.sort_values("vec_id", kind="stable")
            width = int(frame["values"].map(len).max())
            values = np.zeros((len(frame), width), dtype=np.int64)
            for i, v in enumerate(frame["values"]):
                values[i, : len(v)] = v
            return frame["vec_id"].to_numpy(dtype=np.int64), frame["uid"].to_numpy(dtype=np.int64), values

        for frame in batches:
            held.append(frame)
            n += len(frame)
            while n >= size:
                both = pd.concat(held, ignore_index=True)
                yield block(both[:size])
                held, n = [both[size:]], n - size
        if n:
            yield block(pd.concat(held, ignore_index=True))

    return frames


def _bytes_of(values: np.ndarray) -> bytes:
    return (values.astype(np.int16) if np.abs(values).max(initial=0) < 1 << 15 else values).tobytes()


def _array(rows: int, width: int, values: bytes) -> np.ndarray:
    kind = np.int16 if len(values) == 2 * rows * width else np.int64
    return np.frombuffer(values, dtype=kind).reshape(rows, width).astype(np.int64)


ROW = "ids binary, uids binary, width int, values binary"
INDEX = f"{ROW}, top binary, plain binary, turned binary"


def _index(vectors: DataFrame, size: int) -> DataFrame:
    """One row per block, with its bitmaps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, uids, values in _packed_rows(size)(batches):
            row = ids.tobytes(), uids.tobytes(), values.shape[1], _bytes_of(values), *Slices.of(values).packed()
            yield pd.DataFrame([row], columns=INDEX.replace(",", "").split()[0::2])

    return vectors.mapInPandas(run, INDEX).withColumn("block", F.monotonically_increasing_id())


def _chunks(vectors: DataFrame, size: int) -> DataFrame:
    """One row per chunk of queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, uids, values in _packed_rows(size)(batches):
            row = ids.tobytes(), uids.tobytes(), values.shape[1], _bytes_of(values)
            yield pd.DataFrame([row], columns=ROW.replace(",", "").split()[0::2])

    return vectors.mapInPandas(run, ROW)


def _search(k: int):
    """Reads blocks, each followed by the chunks of queries that are to be answered from it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices, ids, uids, values, everyone = None, None, None, None, None
        for frame in batches:
            for row in frame.itertuples(index=False):
                row_ids, row_uids = (np.frombuffer(x, dtype=np.int64) for x in (row.ids, row.uids))
                row_values = _array(len(row_ids), row.width, row.values)
                if row.plain is not None:
                    slices = Slices.unpacked(len(row_ids), row.top, row.plain, row.turned)
                    ids, uids, values = row_ids, row_uids, row_values
                    everyone = np.packbits(np.arange(slices.words * 64) < slices.rows, bitorder="little").view(np.uint64)
                    continue
                found = []
                width = min(values.shape[1], row_values.shape[1])
                own_place = {u: i for i, u in enumerate(uids.tolist())} if np.isin(row_uids, uids).any() else {}
                for own, uid, query in zip(row_ids.tolist(), row_uids.tolist(), row_values, strict=True):
                    candidates, at = everyone, own_place.get(uid)
                    if at is not None:
                        # A query's own row is no candidate; others of the same id are.
                        candidates = everyone.copy()
                        candidates[at // 64] &= ~np.uint64(1 << (at % 64))
                    weights = np.zeros(values.shape[1], dtype=np.int64)
                    weights[:width] = query[:width]
                    rows = slices.best(slices.weighted(weights), candidates, k)
                    found.append((np.full(len(rows), uid), np.full(len(rows), own), ids[rows], values[rows] @ weights))
                if found:
                    uid, own, near, score = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pd.DataFrame({"uid": uid, "query_id": own, "vec_id": near, "score": score})

    return run


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK, chunk: int = QUERIES, scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest inner product for each query row.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all
    rows but the query's own, so rows that share an id are candidates for each
    other. Ties go to the smaller vec_id. Vectors that are null or hold nulls or
    non-finite components, and rows without an id, take no part; a missing
    component counts as zero. An empty table gives no rows.

    The index is a table of blocks with their bitmaps. Blocks and the chunks that
    visit them go to one place by the block's number and stream through in order:
    a task holds one block and one chunk at a time. Each visit yields the k best
    per query, and only these meet in the last step.
    """
    spark = vectors.sparkSession
    rows = stage(
        ship(vectors)
        .where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
        .select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("values"))
        .withColumn("uid", F.monotonically_increasing_id())
    )
    asked = rows.where(F.col("vec_id") % every == 0)
    n, n_asked = rows.count(), asked.count()
    # All cores get a block, unless blocks would be very short.
    size = min(block, max(LEAST_BLOCK, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    # Neighbouring files go into one block, so that bitmaps are long.
    index = stage(_index(rows.coalesce(max(1, n // size)), size))
    chunks = stage(_chunks(asked.coalesce(max(1, n_asked // (8 * chunk))), chunk))
    none = [F.lit(None).cast("binary").alias(c) for c in ("top", "plain", "turned")]
    numbers = index.select("block").agg(F.collect_list("block").alias("all")).scalar()
    visits = chunks.select("*", *none, F.explode(numbers).alias("block"))
    met = index.unionByName(visits).repartition("block")
    stream = met.sortWithinPartitions("block", F.col("plain").isNull()).drop("block")
    best = stream.mapInPandas(_search(k), "uid long, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
