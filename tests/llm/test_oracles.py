"""Queries of this subpackage that SQL can express."""

import pytest

from quillspan.llm import registry
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf_dir, name):
    same(connect(sf_dir), registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name])
