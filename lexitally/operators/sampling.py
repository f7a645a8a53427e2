"""Seeded samples of an exact size.

Rows are ranked by a hash of their key, so a sample depends only on the keys
and the seed, never on how the data is partitioned. Sampling means finding the
highest rank that still belongs to the sample:

1. a histogram of hash prefixes says in which bucket the cut lies,
2. only that bucket, 1/65,536 of a class, is put in order,
3. the table is filtered by the cut.

Steps 1 and 2 read the key and the class alone. Step 3 compares each row with the
cut of its class: texts are neither shuffled nor sorted, however large a class
is, while the table of cuts is small enough for Spark to broadcast. There may be
any number of classes: what is one row per class stays a distributed table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexitally.sources.stage import stage

PREFIX = 4  # hex digits of the hash, 65,536 buckets


def hash_rank(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """The rows with their place in a total order, from 1.

    Rows are dealt out by ranges of the order and sorted there; only the sizes of
    the ranges, one row each, are summed up in one place.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return rows.select(*df.columns, (F.col("_before") + place + 1).alias(name))


def _below_cut(df: DataFrame, quotas: DataFrame, group: Column, key: str, seed: int) -> DataFrame:
    """Rows up to the cut of their group. `quotas` holds (group, quota), quota <= group size."""
    rank = hash_rank(key, seed)
    ranks = df.select(group.alias("group"), rank.alias("rank"), F.col(key).alias("key"))
    bucket = F.substring("rank", 1, PREFIX)
    counts = ranks.groupBy("group", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(quotas, "group")
    edge = counts.where((F.col("before") < F.col("quota")) & (F.col("quota") <= F.col("before") + F.col("n")))
    # One bucket per group, and one cut; both are staged, so that Spark knows how large they are.
    edge = stage(edge.select("group", "bucket", (F.col("quota") - F.col("before")).alias("take")))
    order = Window.partitionBy("group").orderBy("rank", "key")
    cuts = (
        ranks.withColumn("bucket", bucket)
        .join(edge, ["group", "bucket"])
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") == F.col("take"))
    )
    cuts = stage(cuts.select(F.col("group").alias("_group"), F.struct("rank", "key").alias("_cut")))
    own = F.struct(rank.alias("rank"), F.col(key).alias("key"))
    return df.join(cuts, (group == F.col("_group")) & (own <= F.col("_cut"))).select(df.columns)


def sample_fixed(df: DataFrame, n: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """n rows without replacement; the whole table when it has no more than n."""
    quotas = df.agg(F.lit(0).alias("group"), F.least(F.lit(n), F.count(F.lit(1))).alias("quota"))
    return _below_cut(df, quotas, F.lit(0), key, seed)


def stratified_quotas(df: DataFrame, n: int, label: str = "label") -> DataFrame:
    """(label, quota): floor of the proportional share, then one more for the
    largest remainders, ties to the lower class. Never more than the class has."""
    sizes = stage(df.groupBy(F.col(label).alias("group")).agg(F.count(F.lit(1)).alias("size")))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    wanted = min(n, total)
    # Whole numbers: what is left over of the share is compared exactly.
    share = F.col("size").cast("decimal(18,0)") * F.lit(wanted).cast("decimal(18,0)")
    rest = share - F.col("whole") * F.lit(total).cast("decimal(18,0)")
    shares = sizes.withColumn("whole", F.expr(f"(cast(size as decimal(18,0)) * {wanted}bd) div {max(total, 1)}bd"))
    shares = shares.withColumn("rest", rest)
    spare = wanted - shares.agg(F.coalesce(F.sum("whole"), F.lit(0))).first()[0]
    ranked = numbered(shares, [F.col("rest").desc(), F.col("group").asc()])
    extra = (F.col("number") <= spare).cast("long")
    return ranked.select(F.col("group").alias(label), F.least(F.col("whole") + extra, F.col("size")).alias("quota"))


def sample_stratified(
    df: DataFrame, n: int, label: str = "label", key: str = "doc_id", seed: int = 42
) -> DataFrame:
    """n rows with the class proportions of the table; rows without a class are left out."""
    df = df.where(F.col(label).isNotNull())
    quotas = stratified_quotas(df, n, label).where(F.col("quota") > 0).withColumnRenamed(label, "group")
    return _below_cut(df, quotas, F.col(label), key, seed)
