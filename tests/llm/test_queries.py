"""The registered training-data queries over the smallest tables."""

import os
import zlib

import pytest

from lodestone.llm.queries import ORACLES, QUERIES
from tests.llm.test_secrets import brute
from tests.oracle import agree, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    agree(QUERIES[name](spark, SF), connect(SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_every_row(spark, name):
    out = QUERIES[name](spark, SF)
    table = "pages" if name.startswith("op4") else "documents"
    if name.startswith("op2"):
        texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
        assert out.count() == sum(len(brute(t)) for t in texts)
    else:
        assert out.count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_checksums(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in QUERIES["op3_stratified_interleave"](spark, SF).collect())
