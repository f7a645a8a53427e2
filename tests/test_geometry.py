from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitally.operators import geometry
from lexitally.plans import catalog
from lexitally.plans import variants as vs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return catalog.table(spark, SMALL, "embeddings")


@pytest.fixture(scope="module")
def local(vectors):
    rows = vectors.orderBy("vec_id").collect()
    return np.array([r.embedding for r in rows]), np.array([r.label for r in rows])


def test_pca(vectors, local):
    x, _ = local
    rows = geometry.pca(vectors, 5).orderBy("vec_id").collect()
    scores = np.array([r.scores for r in rows])
    assert np.abs(scores.mean(axis=0)).max() < 1e-9
    spread = np.cov(scores.T)
    assert np.abs(spread - np.diag(np.diag(spread))).max() < 1e-9
    values = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:5]
    assert np.sqrt((scores**2).sum(axis=0)) == pytest.approx(values)


def components_by_svd(rows, min_df):
    """Scores by a dense decomposition; rows are lists of (term, tf)."""
    df = Counter(t for terms_ in rows for t, _ in terms_)
    kept = {t: i for i, t in enumerate(sorted(t for t, n in df.items() if n >= min_df))}
    x = np.zeros((len(rows), len(kept)))
    for i, terms_ in enumerate(rows):
        for t, tf in terms_:
            if t in kept:
                x[i, kept[t]] = tf
    u, s, _ = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    scores = u * s
    return scores * np.where(scores[np.abs(scores).argmax(axis=0), np.arange(scores.shape[1])] < 0, -1, 1)


@pytest.mark.parametrize("limit", [geometry.BROADCAST_BYTES, 0])
def test_text_components(spark, monkeypatch, limit):
    """Against a dense decomposition, with terms broadcast and with terms joined."""
    monkeypatch.setattr(geometry, "BROADCAST_BYTES", limit)
    grams = vs.counted(catalog.corpus(spark, SMALL), vs.Variant("p", high=2)).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    rows = geometry.text_components(grams, 4, passes=12).orderBy("doc_id").collect()
    given = [r.terms for r in grams.orderBy("doc_id").collect()]
    wanted = components_by_svd(given, 3)[:, :4]
    assert np.array([r.scores for r in rows]) == pytest.approx(wanted, abs=1e-6)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in grams.collect())


def test_text_components_of_awkward_rows(spark):
    """Repeated and null ids, texts without terms, fewer texts than components, no texts at all."""
    cell = lambda *ws: [(w, n) for w, n in ws]
    rows = [("a", cell(("x", 2), ("y", 1))), ("a", cell(("x", 1))), (None, []), ("b", cell(("y", 3), ("z", 1))), ("c", None)]
    schema = "doc_id string, terms array<struct<term: string, tf: bigint>>"
    frame = spark.createDataFrame(rows, schema)
    found = geometry.text_components(frame, 3, min_df=1).collect()
    wanted = components_by_svd([t or [] for _, t in rows], 1)[:, :3]
    assert sorted(map(tuple, np.round([r.scores for r in found], 6))) == sorted(map(tuple, np.round(wanted, 6)))
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in rows)
    assert geometry.text_components(frame.limit(0), 3).collect() == []
    assert [r.scores for r in geometry.text_components(frame, 2, min_df=9).collect()] == [[0.0, 0.0]] * 5


def test_class_geometry(vectors, local):
    x, y = local
    centres = {c: x[y == c].mean(axis=0) for c in sorted(set(y))}
    far = {c: np.linalg.norm(x - m, axis=1) for c, m in centres.items()}
    for r in geometry.class_dispersion(vectors).collect():
        assert r.mean_distance == pytest.approx(far[r.label][y == r.label].mean())
    nearest = np.min(np.array([far[c] for c in centres]), axis=0)
    for r in geometry.mixed_region(vectors).collect():
        assert r.n_mixed == (nearest < far[r.label])[y == r.label].sum()
    for r in geometry.centroid_distances(vectors).collect():
        assert r.distance == pytest.approx(np.linalg.norm(centres[r.label_a] - centres[r.label_b]))


@pytest.mark.parametrize("block", [geometry.BLOCK, 7])
def test_many_classes(spark, block):
    """More classes than one block holds, some of one row, some that overlap, rows without a class."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 60, 700)
    x = rng.normal(size=(700, 4)) + y[:, None] * 0.3
    rows = [(int(c), v.tolist()) for c, v in zip(y, x)] + [(1000, [50.0] * 4), (None, [0.0] * 4)]
    frame = spark.createDataFrame(rows, "kind int, embedding array<double>").repartition(5)
    y, x = np.append(y, 1000), np.vstack([x, [50.0] * 4])
    centres = {c: x[y == c].mean(axis=0) for c in sorted(set(y))}
    far = np.array([np.linalg.norm(x - m, axis=1) for m in centres.values()])
    own = np.array([far[list(centres).index(c), i] for i, c in enumerate(y)])
    mixed = {r.kind: (r.n, r.n_mixed) for r in geometry.mixed_region(frame, label="kind", block=block).collect()}
    assert mixed == {c: (int((y == c).sum()), int((far.min(axis=0) < own - 1e-12)[y == c].sum())) for c in centres}
    pairs = {(r.label_a, r.label_b): r.distance for r in geometry.centroid_distances(frame, label="kind", block=block).collect()}
    names = list(centres)
    assert len(pairs) == len(names) * (len(names) - 1) // 2
    for (a, b), d in pairs.items():
        assert a < b and d == pytest.approx(np.linalg.norm(centres[a] - centres[b]))
    for r in geometry.class_dispersion(frame, label="kind").collect():
        assert r.max_distance == pytest.approx(own[y == r.kind].max())
    assert geometry.mixed_region(frame.limit(0), label="kind").collect() == []
    assert geometry.centroid_distances(frame.limit(0), label="kind").collect() == []


def test_covariance(vectors, local):
    x, _ = local
    wanted = np.cov(x.T)
    for r in geometry.covariance(vectors).collect():
        assert r.value == pytest.approx(wanted[r.i, r.j], abs=1e-12)
