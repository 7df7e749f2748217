"""Embedding in several runs with a budget gives what one run without gives."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.streaming import embedding as E


def letters(texts):
    return np.array([[len(t), t.count("a"), t.count("e")] for t in texts], dtype=np.float64)


def put(spark, folder, rows):
    spark.createDataFrame(rows, "id string, digest string, text string").coalesce(1).write.mode("append").parquet(folder)


def test_runs_with_a_budget_equal_one_without(spark, tmp_path):
    asked, grants, target, checkpoint = (str(tmp_path / x) for x in ("asked", "grants", "target", "checkpoint"))
    texts = {f"c{i}": "a" * (i % 5) + "e" * (i % 3) + "x" for i in range(40)}
    put(spark, asked, [(i, "1", t) for i, t in texts.items()])
    stream = lambda: spark.readStream.schema("id string, digest string, text string").parquet(asked)
    run = lambda budget: (E.grant(spark, grants, 3, budget), E.run(stream(), grants, letters, target, checkpoint, shards=3, texts_at_once=4), E.vectors(spark, target).count())[2]
    first = run(15)
    assert 10 <= first <= 15  # a shard with less to do leaves some of its grant
    put(spark, asked, [("c1", "1", texts["c1"]), ("c2", "2", "a new text"), ("c39", "2", "another")])  # repeated; revised, waiting or not
    second = run(9)
    assert first < second <= first + 9
    assert run(1000) == 40
    got = {r.id: (r.digest, list(r.vector)) for r in E.vectors(spark, target).collect()}
    texts |= {"c2": "a new text", "c39": "another"}
    assert got == {i: ("2" if i in ("c2", "c39") else "1", letters([t])[0].tolist()) for i, t in texts.items()}
    written = spark.read.parquet(*[f"{target}/{n:09d}" for n in __import__("lodestone.streaming.tail", fromlist=["versions"]).versions(spark, target)])
    again = written.groupBy("id", "digest").count().where("count > 1")
    assert again.count() == 0 and written.where(F.col("id") == "c1").count() == 1
