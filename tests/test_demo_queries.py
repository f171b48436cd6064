"""Every demo query against its SQL, with blocks far smaller than a run."""

import os

import pytest

from seqmine.demo import catalog, conventions
from compare import database, difference

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return database(DATA)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(conventions, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(conventions, "POSITIONS_PER_BLOCK", 32)
    monkeypatch.setattr(conventions, "ITEMS_PER_BLOCK", 150)
    monkeypatch.setattr(conventions, "FEW", 2)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    assert difference(catalog.queries()[name](spark, DATA), con, catalog.oracles()[name]) is None


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracles())
