"""Registered queries against their SQL on the smallest driver data."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import canonical, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["measure_cells", "analyze_particles", "threshold_triangle", "cleanup_labels", "compute_phasor", "discover_flat"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver data absent")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = connect(SF).sql(entry.oracle_sql()[name]).df()
    assert len(got) > 0 and canonical(got) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
