"""Networks over padded batches of token ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lexitally.operators import scoring

IDS = [[1, 5, 9], [1], [], None, [1, 2, 3, 4, 5, 6, 7], [4] * 50, [1, 5, 9]]
DOUBLES = ArrayType(DoubleType())


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, ids, f"text {i}") for i, ids in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id int, ids array<bigint>, scores_given string").repartition(2)


def shapes():
    """The sum of the ids, how many are not padding, and the width of the batch."""
    return lambda: lambda ids, mask: np.stack([(ids * mask).sum(axis=1), mask.sum(axis=1), np.full(len(ids), ids.shape[1])], axis=1)


@pytest.mark.parametrize("size", [1, 2, 16])
def test_rows_keep_their_result(frame, size):
    found = scoring.score_tokens(frame, F.col("ids"), shapes(), batch_size=size).collect()
    assert len(found) == len(IDS)
    for r in found:
        ids = IDS[r.doc_id] or []
        assert r.scores[:2] == [sum(ids), len(ids)] and r.scores_given == f"text {r.doc_id}"
        assert r.scores[2] >= len(ids) and (size > 1 or r.scores[2] == max(1, len(ids)))


def test_batches_are_of_like_length(frame):
    """Of rows that come together, short ones are not padded to the length of the longest."""
    found = scoring.score_tokens(frame.coalesce(1), F.col("ids"), shapes(), batch_size=3).collect()
    assert sorted(int(r.scores[2]) for r in found) == [1, 1, 1, 7, 7, 7, 50]


def test_pooling_leaves_padding_out(frame):
    tokens = lambda: lambda ids, mask: np.stack([ids, ids * 2 + 100], axis=2)
    mean = {r.doc_id: r.embedding for r in scoring.embed_tokens(frame, F.col("ids"), tokens, "mean").collect()}
    first = {r.doc_id: r.embedding for r in scoring.embed_tokens(frame, F.col("ids"), tokens, "first").collect()}
    for i, ids in enumerate(IDS):
        if ids:
            assert mean[i] == pytest.approx([np.mean(ids), np.mean(ids) * 2 + 100])
            assert first[i] == [ids[0], ids[0] * 2 + 100]
        else:
            assert mean[i] == [0, 0] and first[i] == [0, 100]
    with pytest.raises(ValueError):
        scoring.embed_tokens(frame, F.col("ids"), tokens, "max")


def test_hashed_ids(spark):
    rows = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,), (["w"] * 500,)], "t array<string>")
    found = [r[0] for r in rows.select(scoring.hashed_ids(F.col("t"), 1000)).collect()]
    assert found[0][0] == 1 and found[0][1] == found[0][3] and len(found[0]) == 4
    assert found[1] == found[2] == [1] and len(found[3]) == 128
    assert all(2 <= i < 1002 for ids in found for i in ids[1:])


def test_only_ids_visit_python(frame):
    plan = scoring.score_tokens(frame, F.col("ids"), shapes())._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapIn" not in plan
