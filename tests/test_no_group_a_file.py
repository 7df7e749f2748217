"""The merge queries hand no file to Python as a group of its own: at 90,000 files the groups took the time."""

import os

import pytest

from lodestone.plans.registry import load
from tests.oracle import agree, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["h17_chain_records", "h32_appended_records"])
def test_merge_without_groups(spark, monkeypatch, name):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps, PandasGroupedOpsMixin

    def refused(*_, **__):
        raise AssertionError("a group a file")

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", refused)
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", refused)
    agree(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
