import hashlib

from pyspark.sql import functions as F

from lexitally.operators import sampling


def place(key, seed=42):
    return hashlib.md5(f"{key}-{seed}".encode()).hexdigest(), key


def skewed(spark, n=4_000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, 1).otherwise(0).alias("label"))


def test_fixed(spark):
    df = skewed(spark)
    for n in (1, 600, 3_999, 4_000, 5_000):
        got = {r.doc_id for r in sampling.sample_fixed(df, n).collect()}
        assert got == set(sorted(range(4_000), key=place)[:n])


def test_fixed_ignores_partitioning(spark):
    df = skewed(spark)
    one, two = (sampling.sample_fixed(df.repartition(p), 50, seed=7) for p in (1, 13))
    assert sorted(one.collect()) == sorted(two.collect())


def test_quotas(spark):
    df = skewed(spark, 100)
    assert {r.label: r.quota for r in sampling.stratified_quotas(df, 10).collect()} == {0: 8, 1: 2}


def test_stratified(spark):
    df = skewed(spark)
    for n, quotas in ((10, {0: 8, 1: 2}), (1_500, {0: 1_125, 1: 375}), (9_999, {0: 3_000, 1: 1_000})):
        got = sampling.sample_stratified(df, n).collect()
        for label, quota in quotas.items():
            members = [k for k in range(4_000) if (k % 4 == 0) == (label == 1)]
            wanted = sorted(members, key=place)[:quota]
            assert {r.doc_id for r in got if r.label == label} == set(wanted)


def test_rows_without_class(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 1)], "doc_id long, label int")
    assert {r.doc_id for r in sampling.sample_stratified(df, 5).collect()} == {1, 3}


def test_many_classes(spark):
    """Thousands of classes, of which many have equal remainders."""
    sizes = {c: 1 + c % 7 for c in range(3000)}
    rows = [(f"{c}-{i}", c) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, label int").repartition(6)
    n, total = 2500, len(rows)
    whole = {c: n * s // total for c, s in sizes.items()}
    order = sorted(sizes, key=lambda c: (-(n * sizes[c] % total), c))
    for c in order[: n - sum(whole.values())]:
        whole[c] += 1
    assert {r.label: r.quota for r in sampling.stratified_quotas(df, n).collect()} == whole
    got = sampling.sample_stratified(df, n).collect()
    assert len(got) == n and df.columns == list(got[0].asDict())
    for c in range(0, 3000, 97):
        wanted = sorted((k for k, label in rows if label == c), key=place)[: whole[c]]
        assert {r.doc_id for r in got if r.label == c} == set(wanted)
    assert sampling.sample_stratified(df.limit(0), n).collect() == []


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("a"), "id")
    found = sampling.numbered(df, [F.col("a").desc(), F.col("id").asc()]).collect()
    assert [(r.a, r.id) for r in sorted(found, key=lambda r: r.number)] == sorted(((i % 10, i) for i in range(1000)), key=lambda t: (-t[0], t[1]))
    assert sorted(r.number for r in found) == list(range(1, 1001))
