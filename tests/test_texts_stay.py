"""Texts are read where they lie: few candidates and few results travel to them."""

import pytest

from lodestone.plans import retrieval_queries as Q
from lodestone.plans.registry import load

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_small_tables(spark):
    """Only what is marked is broadcast, as with tables past the threshold."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_labels_are_found_once(spark, no_small_tables):
    found = Q.relevant(spark, SF)
    assert "parquet" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert found.count() > 0


def test_snippets_shuffle_no_text(spark, no_small_tables):
    plan = load()[0]["g8_hybrid_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
