"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.llm.common import HEAVY, stage

# Each round at least halves the depth of a tree, so this is far beyond any graph.
MOST_ROUNDS = 200
# Edges a task contracts at once.
CHUNK = 65_536


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v); root is the component's smallest node.

    First the edges that a task holds are contracted to stars where they are. Then
    every round hangs each node's larger neighbours, then its smaller ones, on its
    smallest neighbour, until nothing changes. A node with very
    many neighbours is summed up by partial minima and met again in a join that
    splits it; its neighbours are never gathered. Rows meet by shuffle in every
    round, so nothing passes through the driver.
    """
    pairs = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    pairs = stage(_contracted(pairs))
    state = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = pairs.agg(*state).first()
    for _ in range(MOST_ROUNDS):
        # The large star is written, as the small one reads it three times.
        pairs = stage(_small_star(stage(_large_star(pairs, before[0])), before[0]))
        now = pairs.agg(*state).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
    raise RuntimeError("components did not settle")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as edges from each node to the smallest node of its component."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    hung = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[hung], nodes[low[hung]]


def _contracted(pairs: DataFrame) -> DataFrame:
    """Stars of the edges of neighbouring files, CHUNK edges at a time; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def closed() -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(u, v)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield closed()
        if held:
            yield closed()

    return pairs.coalesce(max(1, -(-pairs.count() // CHUNK))).mapInArrow(run, "u long, v long")


def _met(pairs: DataFrame, lowest: DataFrame, key: str, total: int) -> DataFrame:
    """`pairs` with `m` of `lowest` (key, m) where there is one, also for keys that hold a large share of the pairs.

    These few keys are broadcast with what they get, so their pairs stay where
    they are; all other keys meet by a shuffle that is even.
    """
    counts = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HEAVY >= total)
    heavy = lowest.join(F.broadcast(counts.drop("n")), key, "right")
    near = pairs.join(F.broadcast(heavy), key)
    far = pairs.join(F.broadcast(counts.select(key)), key, "left_anti").join(lowest.hint("merge"), key, "left")
    return near.unionByName(far)


def _large_star(pairs: DataFrame, total: int) -> DataFrame:
    """Larger neighbours of a node move to the smallest of the node and its neighbours."""
    lowest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    # (u, v) has u > v: u is a larger neighbour of v, whose lowest is v itself or below.
    moved = _met(pairs, lowest.withColumnRenamed("u", "v"), "v", total)
    # Equal edges that come of this go with those of the small star.
    return moved.select("u", F.coalesce("m", "v").alias("v"))


def _small_star(pairs: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    lowest = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = _met(pairs, lowest, "u", total)
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .unionByName(lowest.select("u", F.col("m").alias("v")))
        .distinct()
    )
