"""CSV whose quoted fields span lines, read by many tasks per file.

A line break ends a record only where the quotes before it are even in number;
a doubled quote inside a field changes nothing about that. So every block of a
file is first reduced to the parity of its quotes, a running sum over the blocks
tells which of them begin inside a field, and then each block is cut into
records on its own. What a record has on both sides of a block's border is put
together afterwards; only these pieces are shuffled.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

from lexitally.sources.stage import stage

# Lines in one piece of a batch, while a record is open.
CONTINUES, OPENS = 0, 1


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, block): lines in their order within each block of a file."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def quoted_blocks(lines: DataFrame, quote: str = '"') -> dict[str, list[int]]:
    """The blocks that begin inside a quoted field: eight bytes for each such block of a file."""
    count = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    parity = lines.groupBy("file", "block").agg((F.sum(count) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = parity.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).where("inside")
    found: dict[str, list[int]] = {}
    for row in inside.select("file", "block").toLocalIterator():
        found.setdefault(row.file, []).append(row.block)
    return found


def _records(lines: DataFrame, inside: dict[str, list[int]], names: list[str] | None, quote: str) -> DataFrame:
    """(file, block, part, record): whole records have no part, pieces of those that cross a border have one."""
    begins_quoted = lines.sparkSession.sparkContext.broadcast({f: frozenset(b) for f, b in inside.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        # The block being read, the lines of the record that is open, and what it began as.
        file, block, waiting, part = None, None, [], None
        header = False

        def emit(record: str, kind: int | None) -> None:
            nonlocal header
            if kind is None:
                record = record.removesuffix("\r")
                if header:
                    header = False
                    found = next(csv.reader([record.removeprefix("﻿")], quotechar=quote), [])
                    if found != names:
                        raise ValueError(f"the header of {file} is {found}, not {names}")
                    return
                if not record:
                    return
            out.append((file, block, kind, record))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            out.clear()
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["file", "block", "part", "record"])

        def finish() -> None:
            """A record still open at the end of a block goes on in the next one."""
            nonlocal waiting, part
            if part is not None:
                emit("\n".join(waiting), part)
            waiting, part = [], None

        for batch in batches:
            values, files, blocks = (batch.column(i) for i in range(3))
            odd = np.asarray(pc.count_substring(values, quote)) % 2
            place = list(zip(files.to_pylist(), blocks.to_pylist(), strict=True))
            for i, line in enumerate(values.to_pylist()):
                if place[i] != (file, block):
                    finish()
                    file, block = place[i]
                    if block in begins_quoted.value.get(file, ()):
                        part = CONTINUES
                    header = names is not None and block == 0
                if part is None:
                    if odd[i]:
                        waiting, part = [line], OPENS
                    else:
                        emit(line, None)
                    continue
                waiting.append(line)
                if odd[i]:
                    # The field ends here; a record that came from the block before is a piece.
                    emit("\n".join(waiting), None if part == OPENS else CONTINUES)
                    waiting, part = [], None
            yield batch_of()
        finish()
        yield batch_of()

    return lines.mapInArrow(run, "file string, block long, part int, record string")


def _stitched(pieces: DataFrame) -> DataFrame:
    """Records put together from their pieces, in order of the blocks."""
    order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
    # Numbers only: two short rows per block at most go through this window.
    numbered = pieces.select("file", "block", "part").withColumn("number", F.sum("part").over(order))
    whole = pieces.join(numbered, ["file", "block", "part"]).groupBy("file", "number")
    ordered = F.array_sort(F.collect_list(F.struct("block", "part", "record")))
    record = F.array_join(F.transform(ordered, lambda p: p["record"]), "\n")
    return whole.agg(F.regexp_replace(record, "\r$", "").alias("record")).select("record")


def read_csv_split(
    spark: SparkSession,
    path: str | list[str],
    schema: str | StructType,
    header: bool = True,
    quote: str = '"',
    null: str = "",
) -> DataFrame:
    """CSV with quoted fields that may span lines and double their quotes.

    Files are cut into blocks as Spark cuts any text file
    (spark.sql.files.maxPartitionBytes), so one file keeps many tasks busy. Line
    breaks inside fields stay as they are; a record ends with \\n or \\r\\n. Empty
    lines between records are skipped. With `header`, the first line of each file
    has to hold the names of the schema. A file whose quotes do not close is read
    to its end as one record. A field that is `null` is null; with the default, as
    for Spark's own reader, that is an empty one. The records are staged once.
    """
    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = _lines(spark, path)
    names = schema.fieldNames() if header else None
    records = stage(_records(lines, quoted_blocks(lines, quote), names, quote))
    whole = records.where("part IS NULL").select("record")
    every = whole.unionByName(_stitched(records.where("part IS NOT NULL")))
    options = {"quote": quote, "escape": quote, "multiLine": "true", "maxCharsPerColumn": "-1", "nullValue": null}
    parsed = F.from_csv("record", F.lit(schema.simpleString()[7:-1].replace(":", " ")), options)
    return every.select(parsed.alias("r")).select("r.*")
