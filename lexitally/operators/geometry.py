"""PCA coordinates and how far classes lie apart in a vector space."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitally.operators.sampling import numbered
from lexitally.operators.terms import BROADCAST_BYTES, attach, long_rows, lookup, term_stats
from lexitally.sources.stage import stage

# Centroids of one block.
BLOCK = 256


def _matrix(rows: DataFrame) -> RowMatrix:
    """A distributed matrix from one array column."""
    vectors = rows.select(array_to_vector("row").alias("row"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "row"))


def _signs(columns: np.ndarray) -> np.ndarray:
    """The sign of the largest entry of each column."""
    largest = columns[np.abs(columns).argmax(axis=0), np.arange(columns.shape[1])]
    return np.where(largest < 0, -1.0, 1.0)


def pca(df: DataFrame, k: int, vector: str = "embedding", keep=("vec_id", "label")) -> DataFrame:
    """Centred principal component scores as an array column `scores`.

    For vectors of a fixed modest width: the fit aggregates one width x width
    matrix, whatever the number of rows. Component signs are arbitrary; each is
    flipped so that its largest loading is positive.
    """
    rows = df.select(*keep, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    stages = [
        StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False),
        PCA(k=k, inputCol="centred", outputCol="pc"),
    ]
    model = Pipeline(stages=stages).fit(rows)
    flip = F.array(*[F.lit(s) for s in _signs(model.stages[-1].pc.toArray()).tolist()])
    scores = F.zip_with(vector_to_array("pc"), flip, lambda a, s: a * s)
    return model.transform(rows).select(*keep, scores.alias("scores"))


def points_2d(df: DataFrame, vector: str = "embedding", keep=("vec_id", "label")) -> DataFrame:
    """(keep, x, y): the first two components, with the class of each point."""
    scores = pca(df, 2, vector, keep)
    return scores.select(*keep, F.get("scores", F.lit(0)).alias("x"), F.get("scores", F.lit(1)).alias("y"))


def _random_rows(terms: DataFrame, width: int, seed: int) -> DataFrame:
    """A normal random vector per term, drawn from hashes, so that a task run again draws the same."""

    def uniform(term: Column, i: Column, part: int) -> Column:
        return (F.pmod(F.xxhash64(term, i, F.lit(part), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)

    normal = F.transform(
        F.sequence(F.lit(1), F.lit(width)),
        lambda i: F.sqrt(-2.0 * F.ln(uniform(F.col("term"), i, 0))) * F.cos(2 * math.pi * uniform(F.col("term"), i, 1)),
    )
    return terms.select("term", normal.alias("vector"))


def _weighted_sums(rows: DataFrame, key: str) -> DataFrame:
    """(key, vector): the sum of tf x vector per key, added up in each task before the shuffle."""
    total = Summarizer.sum(F.col("v"), F.col("tf"))
    return rows.select(key, "tf", array_to_vector("vector").alias("v")).groupBy(key).agg(vector_to_array(total).alias("vector"))


def _gram(rows: DataFrame) -> np.ndarray:
    """width x width products of the columns, one block per task."""
    return _matrix(rows.select(F.col("vector").alias("row"))).computeGramianMatrix().toArray()


def _turned(rows: DataFrame, turn: np.ndarray, key: str) -> DataFrame:
    """Every vector times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy().reshape(-1, turn.shape[0]) @ turn
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), turn.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[key, "vector"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "vector").mapInArrow(run, f"{key} {kind}, vector array<double>")


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """The matrix that makes columns with these products orthonormal; directions of no length go to zero."""
    values, vectors = np.linalg.eigh(gram)
    lengths = np.where(values > values.max(initial=0.0) * 1e-14, np.sqrt(np.maximum(values, 0.0)), np.inf)
    return (vectors / lengths)[:, ::-1]


def text_components(
    counted: DataFrame, k: int, min_df: int = 3, passes: int = 6, extra: int = 10, seed: int = 42
) -> DataFrame:
    """Principal component scores of texts over their whole vocabulary, as an array column `scores`.

    Randomised subspace iteration on the centred matrix of counts. Texts and terms
    are both rows of distributed tables, in any number: one side's vectors of
    k + extra numbers are joined to the cells and summed for the other side, and
    only products of the columns, (k + extra) squared, visit the driver. Centring
    takes one vector off all texts, so the cells stay sparse. Every pass shrinks
    what the leading components still lack by (s[k + extra + 1] / s[i]) squared:
    the first components are exact to many digits, the last ones approximate.

    Rows are told apart by themselves, so ids may be of any kind, null or
    repeated. Signs are such that the largest score of a component is positive.
    """
    width = k + extra
    counted = stage(counted.withColumn("_row", F.monotonically_increasing_id()))
    n = counted.count()
    known = term_stats(counted, (), min_df).select("term", F.col("df").alias("uses"))
    cells = attach(long_rows(counted.select("_row", "terms")), known, known)
    cells = stage(cells.select("_row", "term", F.col("tf").cast("double").alias("tf")))
    terms = stage(cells.groupBy("term").agg((F.sum("tf") / max(n, 1)).alias("mean"), F.count(F.lit(1)).alias("uses")))
    uses = terms.select("term", "uses")
    rows, size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if not rows:
        zero = F.array_repeat(F.lit(0.0), min(k, n))
        return counted.withColumn("scores", zero).drop("terms", "_row")
    # Broadcast only after its size is known.
    small = rows * width * 8 + size <= BROADCAST_BYTES
    basis = stage(_random_rows(terms, width, seed))
    basis = stage(_turned(basis, _orthonormal(_gram(basis)), "term"))

    def texts(basis: DataFrame) -> tuple[DataFrame, Column]:
        """Products of the texts with the basis, and what centring takes off each of them."""
        sums = _weighted_sums(lookup(cells, basis, small, ("term",), uses), "_row")
        mean = terms.join(basis, "term").select(F.col("mean").alias("tf"), array_to_vector("vector").alias("v"))
        mean = mean.agg(vector_to_array(Summarizer.sum(F.col("v"), F.col("tf")))).first()[0]
        return sums, F.array(*[F.lit(x) for x in mean])

    for _ in range(passes):
        sums, mean = texts(basis)
        products = sums.select("_row", F.zip_with("vector", mean, lambda a, b: a - b).alias("vector"))
        # The products of all texts add up to nothing, so terms need no centring here.
        back = stage(_weighted_sums(cells.join(products, "_row"), "term"))
        basis = stage(_turned(back, _orthonormal(_gram(back)), "term"))
    sums, mean = texts(basis)
    none = F.array_repeat(F.lit(0.0), width)
    every = counted.select("_row").join(sums, "_row", "left")
    every = stage(every.select("_row", F.zip_with(F.coalesce("vector", none), mean, lambda a, b: a - b).alias("vector")))
    values, vectors = np.linalg.eigh(_gram(every))
    scores = stage(_turned(every, vectors[:, ::-1][:, : min(k, n)], "_row"))
    ends = scores.select(F.posexplode("vector").alias("i", "s")).groupBy("i").agg(F.max_by("s", F.abs("s")).alias("s"))
    signs = F.array(*[F.lit(-1.0 if r.s < 0 else 1.0) for r in ends.orderBy("i").collect()])
    signed = scores.select("_row", F.zip_with("vector", signs, lambda a, b: a * b).alias("scores"))
    return counted.drop("terms").join(signed, "_row").drop("_row")


def covariance(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(i, j, value) for i <= j, the sample covariance of the vector's entries.

    Each task adds up one width x width block, so neither the rows nor the
    result grow with anything but the width of the vectors.
    """
    matrix = _matrix(df.select(F.col(vector).cast("array<double>").alias("row")))
    values = matrix.computeCovariance().toArray()
    cells = [(i, j, float(values[i, j])) for i in range(len(values)) for j in range(i, len(values))]
    return df.sparkSession.createDataFrame(cells, "i int, j int, value double")


def embedding_profile(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per class: number of vectors, width range and mean Euclidean norm."""
    squares = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = df.select(label, F.size(vector).alias("width"), F.sqrt(squares).alias("norm"))
    return rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("width").alias("min_width"),
        F.max("width").alias("max_width"),
        F.avg("norm").alias("mean_norm"),
    )


def centroids(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(label, n, centroid): one row per class, vectors averaged without exploding them."""
    rows = df.select(label, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    return rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.mean(F.col("v"))).alias("centroid")
    )


def class_centroids(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Long form (label, dim, value)."""
    return centroids(df, vector, label).select(label, F.posexplode("centroid").alias("dim", "value"))


def distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def _own_distances(df: DataFrame, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(label, v, d) of every row with a class, d to its own centroid; and the staged centroids.

    How the centroids come to the rows is left to Spark, which knows the size of
    their table.
    """
    known = stage(centroids(df.where(F.col(label).isNotNull()), vector, label).select(F.col(label).alias("label"), "centroid"))
    rows = df.select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).join(known, "label")
    return rows.select("label", "v", distance(F.col("v"), F.col("centroid")).alias("d")), known


def _blocks(known: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(block, members) of centroids in class order, and how many blocks there are."""
    placed = numbered(known, [F.col("label").asc()])
    block = F.floor((F.col("number") - 1) / size).cast("int").alias("block")
    members = F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("members")
    blocks = stage(placed.groupBy(block).agg(members))
    return blocks, blocks.count()


def _between_centroids(blocks: DataFrame, n: int) -> DataFrame:
    """(label_a, block_b, label_b, distance) of all pairs of classes; a task holds two blocks at a time."""
    left = blocks.select(F.col("members").alias("left"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("block"))
    pairs = F.flatten(
        F.transform(
            "left",
            lambda a: F.transform(
                F.filter("members", lambda b: b["label"] != a["label"]),
                lambda b: F.struct(
                    a["label"].alias("label_a"), b["label"].alias("label_b"), distance(a["centroid"], b["centroid"]).alias("distance")
                ),
            ),
        )
    )
    return left.join(blocks, "block").select(F.col("block").alias("block_b"), F.inline(pairs))


def class_dispersion(df: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(label, n, mean_distance, max_distance) to the own centroid: small means dense."""
    rows, _ = _own_distances(df, vector, label)
    found = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_distance"), F.max("d").alias("max_distance")
    )
    return found.withColumnRenamed("label", label)


def mixed_region(df: DataFrame, vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """(label, n, n_mixed, share): rows that lie nearer to the centroid of another class.

    By the triangle inequality a centroid is no nearer than the own one if it lies
    at least twice the row's distance from it. So a row only visits the blocks of
    centroids of which one is closer to its own than that; most rows of dense
    classes visit none. There may be any number of classes.
    """
    rows, known = _own_distances(df, vector, label)
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()))
    blocks, n = _blocks(known, block)
    reach = _between_centroids(blocks, n).groupBy(F.col("label_a").alias("label"), F.col("block_b").alias("block"))
    reach = stage(reach.agg(F.min("distance").alias("near")))
    visits = rows.join(reach, "label").where(F.col("near") < 2 * F.col("d"))
    nearer = F.exists("members", lambda m: (m["label"] != F.col("label")) & (distance(F.col("v"), m["centroid"]) < F.col("d")))
    mixed = visits.join(blocks, "block").where(nearer).select("row", "label").distinct()
    counts = mixed.groupBy("label").agg(F.count(F.lit(1)).alias("n_mixed"))
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.join(counts, "label", "left").withColumn("n_mixed", F.coalesce("n_mixed", F.lit(0)))
    return found.select(F.col("label").alias(label), "n", "n_mixed", (F.col("n_mixed") / F.col("n")).alias("share"))


def centroid_distances(df: DataFrame, vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """(label_a, label_b, distance) for label_a < label_b."""
    known = stage(centroids(df.where(F.col(label).isNotNull()), vector, label).select(F.col(label).alias("label"), "centroid"))
    pairs = _between_centroids(*_blocks(known, block)).where(F.col("label_a") < F.col("label_b"))
    return pairs.select("label_a", "label_b", "distance")
