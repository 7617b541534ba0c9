"""Wide answers are rounded where they are worked out, and segments are dealt by the hour."""

import numpy as np
import pytest

from millrace.operators import screen
from millrace.plans import cycles

SF = "/root/testdata/sf0.001"


def test_rounds_halves_away_from_zero():
    values = np.array([0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -1e-9, np.nan, 1e300, -7e15, np.inf])
    got = screen.rounded(values, 0)
    assert got[:7].tolist() == [1.0, -1.0, 2.0, 3.0, -3.0, 0.0, 0.0] and np.isnan(got[7]) and got[8:].tolist() == [1e300, -7e15, np.inf]
    assert not np.signbit(got[6])
    assert screen.rounded(np.array([0.1234565, -2.0000004]), 6).tolist() == [0.123457, -2.0]


@pytest.mark.parametrize("name", ["cycle_edges", "touch_capacity"])
def test_rounded_in_batches(spark, name):
    plan = cycles.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and "3.6E9" in plan
