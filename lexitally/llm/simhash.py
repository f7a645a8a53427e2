"""Near duplicates by SimHash: fingerprints that differ in few bits are linked.

Two fingerprints within r bits agree closely in some segment: of m segments, one
differs by r // m bits at most. Each fingerprint is filed under its segments and
asks for all values in the small Hamming ball around them; what meets is compared
whole. Equal fingerprints are one entry from the start. Where very many distinct
fingerprints share a segment, pairs are not enumerated: two of them within r bits
meet at a point halfway, so all file themselves under the points near them, and
one link to the smallest at each point connects them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.llm.common import ASCII_LOWER, join_split, plain, ship, stage
from lexitally.llm.components import components

BITS = 64
SEED = 42
SHINGLE = 4
DISTANCE = 4
# More entries than this under one segment value meet halfway.
CROWD = 256
SHINGLES_AT_ONCE = 65_536


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is set where over half of the shingle hashes have it."""
    words = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return 0
    data = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    digest, seed = xxhash.xxh64_intdigest, SEED
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        hashes = [digest(data[s:e], seed) for s, e in zip(starts[part].tolist(), ends[part].tolist())]
        found = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        # Per byte value, how often it occurs; then its bits, that many times.
        for k in range(8):
            seen = np.bincount(found[:, k], minlength=256)
            counts[8 * k : 8 * k + 8] += seen @ BYTE_BITS
    bits = counts * 2 > len(starts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row: the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or "", shingle) for t in batch.column(1)]
            signed = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def segments(count: int, distance: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of each segment, for so many distinct fingerprints.

    Wider segments for larger tables, so that few others share a value, but two
    at least: a single segment of all bits would be asked for 679,121 values per
    fingerprint, two of 32 bits for 562. Where even these have many members, the
    crowds of `links` take over. Of m segments, the first distance % m + 1 are searched within distance // m bits
    and the rest one bit closer; a radius below 0 needs no search.
    """
    wanted = max(8.0, math.log2(max(count, 2)))
    m = max(min(2, distance + 1), min(distance + 1, int(BITS / wanted)))
    radius, rest = divmod(distance, m)
    out, at = [], 0
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        if (mine := radius if i <= rest else radius - 1) >= 0:
            out.append((at, width, mine))
        at += width
    return out


def _ball(width: int, radius: int) -> np.ndarray:
    """Masks of up to `radius` bits."""
    return np.array(
        [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)], dtype=np.uint64
    )


def _file(fps: DataFrame, layout: list[tuple[int, int, int]], asks: bool) -> DataFrame:
    """(segment, value, fp): under its own values, or under all it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [_ball(width, radius if asks else 0) for _, width, radius in layout]
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(part, 4096).to_numpy()
                for s, (at, width, _) in enumerate(layout):
                    value = (fp.view(np.uint64) >> np.uint64(at)) & np.uint64((1 << width) - 1)
                    near = (value[:, None] ^ balls[s]).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(near), s, dtype=np.int32)), pa.array(near), pa.array(np.repeat(fp, len(balls[s])))],
                        names=["segment", "value", "fp"],
                    )

    return fps.select("fp").mapInArrow(run, "segment int, value long, fp long")


def _halfway(fps: DataFrame, distance: int) -> DataFrame:
    """(point, fp): all points within half the distance, rounded up."""
    radius = -(-distance // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball = _ball(BITS, radius)
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                fp = batch.column(0).slice(part, 64).to_numpy()
                point = (fp.view(np.uint64)[:, None] ^ ball).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(np.repeat(fp, len(ball)))], names=["point", "fp"])

    return fps.select("fp").mapInArrow(run, "point long, fp long")


def links(fps: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect exactly what lies within `distance` bits.

    Not every pair within the distance gets an edge of its own, but each such
    pair is connected, and no edge joins two that are farther apart.
    """
    count = fps.count()
    layout = segments(count, distance)
    own, asked = _file(fps, layout, asks=False), _file(fps, layout, asks=True)
    keys = ["segment", "value"]
    crowded = stage(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).drop("n"))
    # As many crowded values as the table has rows for, at most: count x segments / crowd.
    few = own.join(crowded, keys, "left_anti")
    # Nor are crowded values asked for here: all those rows would go to one task for nothing.
    apart = asked.join(crowded, keys, "left_anti")
    # Both sides are many times larger in memory than as shuffled bytes, by which Spark would choose
    # to send one of them through the driver; so they always meet by a shuffle.
    pairs = few.join(apart.withColumnRenamed("fp", "other").hint("merge"), keys)
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
    pairs = pairs.where((F.col("fp") != F.col("other")) & close)
    edges = pairs.select(F.greatest("fp", "other").alias("u"), F.least("fp", "other").alias("v"))
    if not crowded.isEmpty():
        members = stage(asked.join(crowded, keys, "left_semi").select("fp").distinct())
        edges = edges.unionByName(_meet(members, distance))
    return edges.distinct()


def _meet(members: DataFrame, distance: int) -> DataFrame:
    """Edges for crowds: everyone at a point is linked to the smallest there.

    All at one point are within twice the radius of each other; for an odd
    distance that is one too many, so the link is to the smallest at that exact
    distance from the point or nearer, checked per pair of distances.
    """
    points = _halfway(members, distance)
    away = F.bit_count(F.col("point").bitwiseXOR(F.col("fp")))
    if distance % 2:
        inner = points.where(away < -(-distance // 2))
        lowest = inner.groupBy("point").agg(F.min("fp").alias("v"))
    else:
        lowest = points.groupBy("point").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).where("v <> w").drop("w")
    met = points.join(lowest.hint("merge"), "point").where("fp <> v")
    return met.select(F.greatest("fp", "v").alias("u"), F.least("fp", "v").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, crowd: int = CROWD
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the smallest doc_id that can be reached over links of at most
    `distance` differing bits, the row's own included. A text without words has
    fingerprint zero and links like any other. Null texts count as empty; rows
    with a null id get the smallest id of their component, or null if there is
    none. Repeated rows are rows of their own; an empty table gives no rows.
    """
    marked = stage(fingerprints(ship(docs), shingle))
    entries = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    roots = components(links(entries.select("fp"), distance, crowd))
    classes = stage(
        entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "first_id", "n", F.coalesce("root", "fp").alias("root")
        )
    )
    # Large components, and fingerprints that very many texts share, meet their rows where these are.
    lowest = stage(classes.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("rows")))
    named = stage(join_split(classes, lowest, "root", "rows").select("fp", "component_id", "n"))
    return join_split(marked, named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest id, ids that are null last.

    Of rows with equal ids, one stays. The texts are written once with their
    fingerprints; only the ids of rows travel until the last join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column(at)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found.view(np.int64))], names=[*batch.schema.names, "_fp"]
            )

    docs, restored = plain(docs, ("doc_id", "text"))
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    marked = ship(docs).mapInArrow(run, ", ".join([*names, "_fp long"]))
    marked = stage(marked.withColumn("_uid", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_uid"))
    entries = stage(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min(order).alias("first")))
    roots = components(links(entries.select("fp"), distance, crowd)).withColumnRenamed("node", "fp")
    classes = entries.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    kept = classes.select(F.col("first._uid").alias("_uid"))
    return restored(marked.join(kept, "_uid", "left_semi"))
