"""Every registered query of the engine against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import assert_same  # noqa: E402

from millrace.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
    assert registry.FLAGSHIP in registry.QUERIES


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SF), registry.ORACLE[name], SF)
