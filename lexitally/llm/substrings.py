"""Repeated passages of many words, found by suffix trees over groups of suffixes.

Suffixes that begin alike are put into one group, small enough for a task's
memory, and the group's tree is built there: its suffixes are sorted, and where
neighbours share enough words lies a deep inner node. To have few suffixes, they
start at anchors only: the smallest hash of a run of words among all runs in a
passage. Equal passages have their anchor at the same place, so a passage is
looked at from its anchor: rightwards along the tree, leftwards along the words
before it. The prefix of a group is the anchor's run of words. Where so many
share it that a group would be too large, the prefix grows to the whole passage;
such a node has no tree below it and is reduced to its smallest document. The few
passages that hold a large share of all such rows are looked up where the rows
are; only rows of the others meet by a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.llm.common import join_split, plain, ship, stage

WINDOW = 50
PREFIX = 16
# A larger group of suffixes is not built in one task.
GROUP = 1_000
CHUNK = 65_536
# A passage is heavy from 1/HEAVY of all crowded rows on, so at most HEAVY of them are.
HEAVY = 10_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_in(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def anchors(words: list[bytes], window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of each window, and the hash of each run of `prefix` words."""
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))
    n = len(words) - prefix + 1
    with np.errstate(over="ignore"):
        runs = np.zeros(n, dtype=np.uint64)
        for i in range(prefix):
            runs = (runs + hashes[i : i + n]) * MULTIPLIER
        runs = (runs ^ (runs >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        runs ^= runs >> np.uint64(29)
    span = window - prefix + 1
    places = []
    for at in range(0, n - span + 1, CHUNK):
        part = np.lib.stride_tricks.sliding_window_view(runs[at : at + CHUNK + span - 1], span)
        places.append(part.argmin(axis=1) + np.arange(at, at + len(part)))
    return np.concatenate(places), runs


def _sketched(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """All columns but the text, which is packed, and what is needed to find repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            found = []
            for text in batch.column(batch.schema.get_field_index("text")):
                text = text.as_py()
                words = words_in(text or "")
                joined = b" ".join(words)
                runs, places = [], []
                if len(words) >= window:
                    owner, hashes = anchors(words, window, prefix)
                    places = np.unique(owner)
                    runs = hashes[places].view(np.int64)
                blob = None if text is None else pack(text.encode("utf-8", "surrogatepass"))
                digest = xxhash.xxh3_128_hexdigest(joined)
                found.append((blob, len(words), digest, hashlib.sha256(joined).hexdigest(), runs, places))
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = ["_blob", "_n", "_digest", "_sha", "_runs", "_places"]
            kept = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[batch.schema.names[i] for i in kept] + names,
            )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    schema = ", ".join([*kept, "_blob binary, _n long, _digest string, _sha string, _runs array<long>, _places array<int>"])
    return docs.mapInArrow(run, schema).withColumn("_uid", F.monotonically_increasing_id())


def _contexts(rows: DataFrame, window: int, prefix: int, group: int) -> DataFrame:
    """One row per anchor with the words around it; windows of crowded anchors as their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names = ["key", "uid", "doc_id", "at", "low", "high", "before", "after", "h1", "h2"]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()] * 2 + [pa.list_(pa.int64())] * 2
        for batch in batches:
            for uid, doc_id, blob, live in zip(*(batch.column(i) for i in range(4)), strict=True):
                uid, doc_id, words = uid.as_py(), doc_id.as_py(), unpack(blob.as_py()).split()
                owner, _ = anchors(words, window, prefix)
                out = []
                for entry in live.as_py():
                    at, run_, n = entry["at"], entry["run"], entry["n"]
                    first, last = np.searchsorted(owner, at, "left"), np.searchsorted(owner, at, "right") - 1
                    first, last = int(first), int(last)
                    if n <= group:
                        before, after = b" ".join(words[first:at]), b" ".join(words[at : last + window])
                        out.append((run_, uid, doc_id, at, at - last, at - first, before, after, None, None))
                        continue
                    digests = b"".join(
                        xxhash.xxh3_128_digest(b" ".join(words[start : start + window])) for start in range(first, last + 1)
                    )
                    halves = np.frombuffer(digests, dtype=">i8").reshape(-1, 2).T.tolist()
                    # The key deals these rows out evenly; their windows meet by their hashes later.
                    out.append((hash((uid, at)), uid, doc_id, first, None, None, None, None, *halves))
                for begin in range(0, len(out), 20_000):
                    columns = zip(*out[begin : begin + 20_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.select("_uid", "doc_id", "_blob", "live").mapInArrow(
        run,
        "key long, uid long, doc_id long, at int, low int, high int, before binary, after binary, h1 array<long>, h2 array<long>",
    )


def tree_repeats(members: list[tuple], window: int = WINDOW) -> list[tuple[int, int]]:
    """(uid, start) of windows that also stand in a document of smaller id, for one group of suffixes.

    Members are (uid, doc_id, at, low, high, before, after): a member answers for
    the windows that begin `low` to `high` words before its anchor.
    """
    after = [m[6].split() for m in members]
    before = [m[5].split() for m in members]
    order = sorted(range(len(members)), key=after.__getitem__)
    # Words that neighbours in this order share: the depth of the node above both.
    depth = [0]
    for x, y in zip(order, order[1:]):
        n = 0
        for a, b in zip(after[x], after[y]):
            if a != b:
                break
            n += 1
        depth.append(n)
    found = []
    for back in range(min(m[3] for m in members), max(m[4] for m in members) + 1):
        need = window - back
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and depth[end] >= need:
                end += 1
            if end - at > 1:
                # The leaves below one node of that depth, told apart by the words to the left.
                least: dict[tuple, int] = {}
                asking = []
                for i in order[at:end]:
                    uid, doc_id, place, low, high, _, _ = members[i]
                    if low <= back <= high:
                        left = tuple(before[i][len(before[i]) - back :])
                        asking.append((uid, doc_id, place, left))
                        if doc_id < least.get(left, doc_id + 1):
                            least[left] = doc_id
                found += [(uid, place - back) for uid, doc_id, place, left in asking if doc_id > least[left]]
            at = end
    return found


def _group_repeats(dealt: DataFrame, window: int) -> DataFrame:
    """Runs (uid, first, last) of repeated windows; runs at crowded anchors pass through with their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "first", "last", "doc_id", "h1", "h2"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        key, members = None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def closed() -> list[tuple]:
            if len(members) < 2:
                return []
            out: list[list] = []
            for uid, start in sorted(tree_repeats(members, window)):
                if out and out[-1][0] == uid and out[-1][2] >= start - 1:
                    out[-1][2] = start
                else:
                    out.append([uid, start, start, None, None, None])
            return [tuple(x) for x in out]

        for batch in batches:
            rows: list[tuple] = []
            for k, uid, doc_id, at, low, high, before, after, h1, h2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if before is None:
                    rows.append((uid, at, at + len(h1) - 1, doc_id, h1, h2))
                    continue
                if k != key:
                    rows += closed()
                    key, members = k, []
                members.append((uid, doc_id, at, low, high, before, after))
            yield batch_of(rows)
        yield batch_of(closed())

    return dealt.mapInArrow(run, "uid long, first int, last int, doc_id long, h1 array<long>, h2 array<long>")


def _split_crowded(crowded: DataFrame, heavy: dict[tuple[int, int], int]) -> DataFrame:
    """Runs (uid, first, last) of repeated heavy windows; every other window as a row with its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "first", "last", "doc_id", "h1", "h2"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            out: list[tuple] = []
            for uid, first, doc_id, h1, h2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begin = None
                for start, pair in enumerate(zip(h1, h2, strict=True), first):
                    least = heavy.get(pair)
                    if least is None:
                        out.append((uid, start, start, doc_id, *pair))
                    repeated = least is not None and doc_id > least
                    if repeated and begin is None:
                        begin = start
                    elif not repeated and begin is not None:
                        out.append((uid, begin, start - 1, None, None, None))
                        begin = None
                if begin is not None:
                    out.append((uid, begin, first + len(h1) - 1, None, None, None))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = crowded.select("uid", "first", "doc_id", "h1", "h2")
    return rows.mapInArrow(run, "uid long, first int, last int, doc_id long, h1 long, h2 long")


def _crowded_repeats(crowded: DataFrame) -> DataFrame:
    """Runs (uid, first, last) of windows at crowded anchors that a smaller document has too.

    Each hash is summed up by partial counts and minima. At most HEAVY hashes
    reach 1/HEAVY of the rows, so those visit the driver and go to the rows; the
    rows of the rest meet by hash, where no hash has many.
    """
    windows = crowded.select("doc_id", F.inline(F.arrays_zip("h1", "h2")))
    counts = windows.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    )
    counts = stage(counts.where("least < most").drop("most"))
    total = crowded.agg(F.coalesce(F.sum(F.size("h1")), F.lit(0))).first()[0]
    heavy = {(r.h1, r.h2): r.least for r in counts.where(F.col("n") * HEAVY >= total).toLocalIterator()}
    split = stage(_split_crowded(crowded, heavy))
    light = counts.where(F.col("n") * HEAVY < total).select("h1", "h2", "least")
    behind = split.where(F.col("h1").isNotNull()).join(light, ["h1", "h2"]).where(F.col("doc_id") > F.col("least"))
    runs = split.where(F.col("h1").isNull())
    return runs.select("uid", "first", "last").unionByName(behind.select("uid", "first", "last"))


def _cut(rows: DataFrame, window: int, columns: list[str], schema: str) -> DataFrame:
    """The rows without their repeated windows: the wanted `columns`, of which text, n_removed and kept_sha256 are made here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            given = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            found = []
            for blob, copy, runs, n, sha in zip(*(given[c] for c in ("_blob", "_copy", "_cuts", "_n", "_sha")), strict=True):
                blob, n, sha = blob.as_py(), n.as_py(), sha.as_py()
                if copy.as_py():
                    found.append(("", n, EMPTY_SHA))
                elif not runs.is_valid:
                    text = unpack(blob).decode("utf-8", "surrogatepass") if blob is not None and "text" in columns else None
                    found.append((text, 0, sha))
                else:
                    words = unpack(blob).split()
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    for entry in runs.as_py():
                        edges[entry["first"]] += 1
                        edges[min(len(words), entry["last"] + window)] -= 1
                    gone = np.cumsum(edges[:-1]) > 0
                    kept = b" ".join(words[i] for i in np.flatnonzero(~gone).tolist())
                    found.append((kept.decode("utf-8", "surrogatepass"), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            texts, removed, shas = zip(*found, strict=True) if found else ((), (), ())
            given |= {
                "text": pa.array(texts, pa.string()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array(shas, pa.string()),
            }
            given["n_words"] = given["_n"]
            yield pa.RecordBatch.from_arrays([given[c] for c in columns], names=columns)

    return rows.mapInArrow(run, schema)


def find_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """The sketched rows with `_copy` (goes as a whole) and `_cuts` (runs of repeated windows, or null).

    Texts of equal words are one text from the start: all but those of the
    smallest id are repeats as a whole, if they are long enough for a window.
    Packed texts move twice: to their anchors, and to their cuts.
    """
    rows = stage(_sketched(ship(docs), window, prefix))
    known = rows.where(F.col("doc_id").isNotNull() & (F.col("_n") >= window))
    first = known.groupBy("_digest").agg(F.min(F.struct("doc_id", "_uid")).alias("first"))
    first = stage(first.select("_digest", F.col("first.doc_id").alias("_first_id"), F.col("first._uid").alias("_rep")))
    reps = first.select(F.col("_rep").alias("_uid"))
    starts = rows.join(reps, "_uid", "left_semi").select(
        "_uid", F.explode(F.arrays_zip(F.col("_runs").alias("run"), F.col("_places").alias("at"))).alias("a")
    )
    starts = stage(starts.select("_uid", "a.run", "a.at"))
    shared = (
        starts.groupBy("run")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("_uid").alias("lo"), F.max("_uid").alias("hi"))
        .where("lo < hi")
        .select("run", "rows", F.col("rows").alias("n"))
    )
    # A run that very many texts share meets its rows where they are.
    live = join_split(starts, stage(shared), "run", "rows").groupBy("_uid").agg(F.collect_list(F.struct("at", "run", "n")).alias("live"))
    dealt = _contexts(rows.select("_uid", "doc_id", "_blob").join(live, "_uid"), window, prefix, group)
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    judged = stage(_group_repeats(dealt, window))
    crowded = judged.where(F.col("h1").isNotNull())
    runs = judged.where(F.col("h1").isNull()).select("uid", "first", "last").unionByName(_crowded_repeats(crowded))
    covered = runs.groupBy(F.col("uid").alias("_rep")).agg(F.collect_list(F.struct("first", "last")).alias("_cuts"))
    # Rows without an id compare with nothing.
    known = rows.where(F.col("doc_id").isNotNull() & (F.col("_n") >= window)).select("_uid", "doc_id", "_digest")
    placed = known.join(first, "_digest").withColumn("_copy", F.col("doc_id") > F.col("_first_id"))
    whole = placed.where("_copy").select("_uid", "_copy", F.lit(None).cast(covered.schema["_cuts"].dataType).alias("_cuts"))
    parts = placed.where("NOT _copy").join(covered, "_rep").select("_uid", "_copy", "_cuts")
    cuts = whole.unionByName(parts)
    return rows.join(cuts, "_uid", "left").withColumn("_copy", F.coalesce("_copy", F.lit(False)))


def repeat_report(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row.

    Null texts have no words. Rows with a null id lose nothing and cause no loss.
    Rows of equal id are no repeats of each other. An empty table gives no rows.
    """
    marked = find_repeats(docs.select("doc_id", "text"), window, prefix, group)
    # A text that loses nothing is not needed again.
    blob = F.when(F.col("_cuts").isNotNull(), F.col("_blob")).alias("_blob")
    marked = marked.select("doc_id", "_n", "_sha", "_copy", "_cuts", blob)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _cut(
        marked,
        window,
        ["doc_id", "n_words", "n_removed", "kept_sha256"],
        f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string",
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """All rows and columns; texts without repeats as they were, others as their kept words, joined by spaces."""
    docs, restored = plain(docs, ("doc_id", "text"))
    marked = find_repeats(docs, window, prefix, group).drop("_runs", "_places", "_digest", "_uid")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return restored(_cut(marked, window, docs.columns, schema))
