"""Cutting lineage through storage every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in spark.checkpoint.dir. Only a local session without
    one falls back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="lexitally-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Compute `df` once into a table in the staging folder and read it from there.

    Parquet rather than a checkpoint of rows: later jobs read only the columns
    and variants they use, and Spark knows the size of the table. Packed by zstd,
    as texts and terms take most of it.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


# Tables this process has staged and not yet released.
_STAGED: list[str] = []


def release(spark: SparkSession, keep: DataFrame | None = None) -> int:
    """Delete the tables staged so far, but for those that `keep` still reads; how many went.

    To be called between jobs, when results that came from staged tables have
    been written or are no longer wanted.
    """
    used = "\n".join(keep.inputFiles()) if keep is not None else ""
    gone = [path for path in _STAGED if path.rpartition("/")[2] not in used]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _STAGED.remove(path)
    return len(gone)
