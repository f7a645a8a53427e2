"""Contiguous shards of nearly equal bytes that never split a group of equal texts.

The documents are put in one order, copies of a text side by side. The smallest
capacity for which a greedy sweep needs no more than the wanted shards is found
by binary search, and the shards are cut there. The sweep looks at group ends
only, and never at all of them at once: the driver sees one end per cell of the
byte line, and in each later round only cells of the short windows in which the
cuts can still lie. The windows are as wide as a few cells, also where a group
is larger than a shard, so every round fetches as many ends as the one before
and looks closer; the last round sees every end that matters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitally.llm.common import join_split, stage, whole_text

CELLS = 100_000
OVERHEAD = 8


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, digest): what sharding has to know of a document."""
    text = whole_text()
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )


def in_order(sized: DataFrame) -> DataFrame:
    """Adds `cum` (bytes up to and with the row) and `row` (from 1) in group order.

    A group stands where its smallest doc_id stands. The rows are dealt out by
    ranges of the order itself, so a group of any size is spread over tasks; each
    task sums its own rows, and one number per task is carried over.
    """
    keys = ["first_id", "digest", "doc_id"]
    first = stage(sized.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    dealt = join_split(sized, first, "digest").repartitionByRange(*keys)
    dealt = stage(dealt.withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        dealt.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        )
    )
    within = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    # One row per task of the job above: as many as shuffle partitions were set.
    return dealt.join(F.broadcast(carried), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        "first_id",
        "digest",
        (F.sum("size").over(within) + F.col("bytes_before")).alias("cum"),
        (F.count(F.lit(1)).over(within) + F.col("rows_before")).alias("row"),
    )


def greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """The last end within reach, again and again: `shards` positions."""
    at, cuts = 0, []
    for _ in range(shards):
        k = int(np.searchsorted(ends, at + capacity, side="right")) - 1
        at = max(at, int(ends[k])) if k >= 0 else at
        cuts.append(at)
    return cuts


def smallest_capacity(ends: np.ndarray, shards: int, low: int, high: int) -> int:
    """Binary search over capacities; `high` is known to be enough."""
    total = int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy(ends, middle, shards)[-1] == total:
            high = middle
        else:
            low = middle + 1
    return high


def _reachable(ends: np.ndarray, low: int, high: int, shards: int, width: int, total: int) -> list[tuple[int, int]]:
    """Where cuts can lie for any capacity from low to high, when only the last end of each cell is known.

    A cut is the last end within reach of the cut before. That is the last known
    end below the shortest reach, or an end in the cell of the next known one or
    beyond, up to the longest reach. The two may lie far apart, with a group
    larger than a shard between them, so they are kept as two places.
    """
    at, found = [(0, 0)], []
    for _ in range(shards):
        after = []
        for first, last in at:
            near, far = min(total, first + low), min(total, last + high)
            k = int(np.searchsorted(ends, near, side="right"))
            before = int(ends[k - 1]) if k else 0
            after.append((before, before))
            if k < len(ends):
                opens = max(before, int(ends[k]) // width * width)
                m = int(np.searchsorted(ends, far, side="right"))
                unknown = m < len(ends) and int(ends[m]) // width == far // width
                closes = far if unknown else int(ends[m - 1]) if m else 0
                if opens <= closes:
                    after.append((opens, closes))
        at = _merged(after)
        found += at
    return found


def _merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(windows):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _fetch(ends: DataFrame, windows: list[tuple[int, int]], width: int) -> np.ndarray:
    """The last (cum, row) of each cell of `width` bytes inside the windows."""
    inside = F.lit(False)
    for low, high in windows:
        inside = inside | F.col("cum").between(low, high)
    found = (
        ends.where(inside)
        .groupBy(F.expr(f"cum div {width}").alias("cell"))
        .agg(F.max(F.struct("cum", "row")).alias("last"))
        .select("last.cum", "last.row")
        .toPandas()
    )
    return found.sort_values("cum").to_numpy(dtype=np.int64).reshape(-1, 2)


def find_cuts(ends: DataFrame, total: int, shards: int, cells: int = CELLS, largest: int = 0) -> list[tuple[int, int]]:
    """(cum, row) after each shard, for the smallest largest shard; `largest` is the size of the largest group.

    Below that capacity the cuts are moved as near to equal shares as the ends
    that were fetched allow, so that one large group does not starve the rest.
    """
    windows = [(0, total)]
    low, seen = max(-(-total // shards), largest), None
    while True:
        width = max(1, -(-sum(b - a for a, b in windows) // cells))
        last = np.array([[total, -1]], dtype=np.int64)
        found = np.unique(np.vstack([_fetch(ends, windows, width), last]), axis=0)
        found = found[np.append(found[1:, 0] != found[:-1, 0], True)] if len(found) > 1 else found
        seen = found if seen is None else seen
        high = smallest_capacity(found[:, 0], shards, low, total)
        if width == 1:
            break
        # A cut moves up by less than a cell when it is put on its cell's last end.
        low = max(low, high - width)
        narrowed = _merged(_reachable(found[:, 0], low, high, shards, width, total))
        windows = narrowed if sum(b - a for a, b in narrowed) < sum(b - a for a, b in windows) else windows
        if narrowed is not windows or not narrowed:
            cells *= 4
    exact = greedy(found[:, 0], high, shards)
    rows = dict(map(tuple, np.vstack([seen, found]).tolist()))
    return _balanced(np.array(sorted({*seen[:, 0].tolist(), *exact})), exact, high, shards, rows)


def _balanced(allowed: np.ndarray, exact: list[int], capacity: int, shards: int, rows: dict) -> list[tuple[int, int]]:
    total = exact[-1]
    earliest = [total]
    for _ in range(shards - 1):
        k = int(np.searchsorted(allowed, earliest[0] - capacity, side="left"))
        earliest.insert(0, int(allowed[k]) if earliest[0] > capacity else 0)
    at, cuts = 0, []
    for i in range(shards):
        ideal = at + (total - at) / (shards - i)
        fits = allowed[(allowed >= max(at, earliest[i])) & (allowed <= at + capacity)]
        if len(fits):
            at = int(fits[np.abs(fits - ideal).argmin()])
        cuts.append((at, rows.get(at, 0)))
    return cuts


def shard_documents(docs: DataFrame, shards: int = 24, cells: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    A null text counts as empty and equal to an empty one. Null ids come first
    in the order; repeated rows are rows of their own and stay together, as do
    all equal texts. An empty table gives no rows; shards may stay empty when
    there are fewer groups than shards.
    """
    placed = stage(in_order(stage(measured(docs))))
    ends = stage(
        placed.groupBy("first_id", "digest")
        .agg(F.max("cum").alias("cum"), F.max("row").alias("row"), F.sum("size").alias("group"))
        .select("cum", "row", "group")
    )
    total, rows, largest = ends.agg(F.max("cum"), F.max("row"), F.max("group")).first()
    cuts = find_cuts(ends, total, shards, cells, largest) if total else [(0, 0)] * shards
    cuts = [(c, rows if c == total else r) for c, r in cuts]
    shard = sum(((F.col("cum") > c).cast("int") for c, _ in cuts[:-1]), F.lit(0))
    starts = F.array(*[F.lit(r).cast("long") for r in (0, *[r for _, r in cuts[:-1]])])
    return placed.select("doc_id", "size", "text_crc32", "row", shard.alias("shard")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - 1 - F.get(starts, F.col("shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
