"""Every query against the SQL that says the same, on the smallest tables."""

import pytest

from tests.compare import rows_of, rows_of_sql
from tests.conftest import SF
from voxlake.plans.registry import ORACLES, PLANS


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    assert rows_of(PLANS[name](spark, SF)) == rows_of_sql(duck, ORACLES[name])


#: Registrations of all pairs take minutes; tests/test_pairs.py runs them on a few.
LONG = {"w_affine_pairs", "w_spline_pairs"}


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(ORACLES) - LONG))
def test_others_run(spark, name):
    assert PLANS[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
