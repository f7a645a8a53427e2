"""Files with line breaks inside fields, read in many blocks."""

import csv
import random

import pytest

from lexitally.plans import catalog
from lexitally.sources import corpus as src
from lexitally.sources import split_csv

NAMES = ["id", "text", "label"]
SCHEMA = "id string, text string, label int"
WORDS = ["plain", "two words", 'a "quoted" one', "line\nbreak", "\n\n", 'say ""', ",", "\r\n", "ünï", "", '"', "end\n", " x "]


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few hundred bytes, so that fields cross many borders."""
    names = {"spark.sql.files.maxPartitionBytes": "256", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def written(path, rows, end="\r\n", quoting=csv.QUOTE_MINIMAL):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end, quoting=quoting)
        out.writerow(NAMES)
        out.writerows(rows)
    return str(path)


def some_rows(n, seed):
    rng = random.Random(seed)
    return [(f"r{i}", " ".join(rng.choices(WORDS, k=rng.choice([1, 2, 5, 60]))), i % 3) for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_blocks(spark, small_blocks, tmp_path, end):
    rows = some_rows(200, 7)
    path = written(tmp_path / "a.csv", rows, end, csv.QUOTE_ALL)
    found = split_csv.read_csv_split(spark, path, SCHEMA)
    assert sorted((r.id, r.text or "", r.label) for r in found.collect()) == sorted(rows)
    assert split_csv._lines(spark, path).rdd.getNumPartitions() > 20
    assert split_csv.quoted_blocks(split_csv._lines(spark, path))


def test_field_longer_than_blocks(spark, small_blocks, tmp_path):
    rows = [("a", "x\n" * 2000 + '"', 1), ("b", "short", 2), ("c", "\n" * 900, 3), ("d", "", 4)]
    path = written(tmp_path / "a.csv", rows)
    found = split_csv.read_csv_split(spark, path, SCHEMA)
    assert sorted((r.id, r.text or "", r.label) for r in found.collect()) == sorted(rows)


def test_many_files(spark, small_blocks, tmp_path):
    every = []
    for k in range(4):
        rows = [(f"f{k}{i}", t, n) for i, t, n in some_rows(30, k)]
        written(tmp_path / f"part{k}.csv", rows, "\n", csv.QUOTE_ALL)
        every += rows
    found = split_csv.read_csv_split(spark, str(tmp_path), SCHEMA)
    assert sorted((r.id, r.text or "", r.label) for r in found.collect()) == sorted(every)


def test_same_as_the_unsplit_reader(spark, small_blocks, tmp_path):
    rows = [r for r in some_rows(100, 3) if "\r" not in r[1]]
    path = written(tmp_path / "a.csv", rows, "\n")
    one = src.read_csv(spark, path, SCHEMA)
    many = src.read_csv(spark, path, SCHEMA, split=True)
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
    assert many.schema == one.schema


def test_header(spark, tmp_path):
    path = written(tmp_path / "a.csv", [("a", "b", 1)])
    with pytest.raises(Exception, match="the header of"):
        split_csv.read_csv_split(spark, path, "id string, other string, label int").collect()
    empty = written(tmp_path / "b.csv", [])
    assert split_csv.read_csv_split(spark, empty, SCHEMA).collect() == []
    (tmp_path / "c.csv").write_text("a,b,1\n\n\nb,,\n")
    found = split_csv.read_csv_split(spark, str(tmp_path / "c.csv"), SCHEMA, header=False)
    assert sorted(map(tuple, found.collect()), key=str) == [("a", "b", 1), ("b", None, None)]


def test_documents_round_trip(spark):
    """The catalog query reads documents it has written as one CSV file with line breaks in texts."""
    folder = "/root/testdata/sf0.001"
    found = catalog.csv_round_trip(spark, folder)
    assert sorted(map(tuple, found.collect())) == sorted(
        (r.doc_id, r.text) for r in catalog.documents(spark, folder).select("doc_id", "text").collect()
    )
