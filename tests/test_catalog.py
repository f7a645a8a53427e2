"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry
from lexitally.plans import catalog, oracle

SMALL = "/root/testdata/sf0.001"
ROWS_ONLY = {"pca_embeddings", "text_points"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, con, name):
    equal, message = compare(spark, con, SMALL, name)
    assert equal, message


def test_twins_cover_the_catalog():
    assert set(catalog.REGISTRY) - set(oracle.statements()) == ROWS_ONLY


def test_entry(spark):
    assert entry.entry(spark).count() == 2
