"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import lexiloom.catalog.all  # noqa: F401
import oracle
from lexiloom.catalog.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert oracle.compare(frame, con, ORACLES[name]) == []
    else:
        assert len(frame.collect()) > 0


def test_names_are_plain():
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op")]
    assert set(ORACLES) <= set(QUERIES)
