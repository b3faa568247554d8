import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

"""Every registered query against its SQL on the smallest tables."""

import pytest

import oracle
from braidwork.plans import catalogue

SF = "/root/testdata/sf0.001"



@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    if name in catalogue.oracle_sql():
        oracle.same(df, con, catalogue.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
