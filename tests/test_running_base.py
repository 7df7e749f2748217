"""Running sums over more rows than Spark samples whole when it cuts ranges."""

from pyspark.sql import functions as F

from lodestone.operators.branches import session_ranges
from lodestone.operators.store import running_base

ROWS = 200_003


def shuffled(spark):
    return spark.range(ROWS).select((F.col("id") * 7919 % ROWS).alias("k"), F.lit(1).alias("one"), F.lit("x").alias("wide"))


def test_base_is_the_rows_before(spark):
    assert running_base(shuffled(spark), "one", ["k"]).where("base <> k or wide <> 'x'").count() == 0


def test_session_range_counts_all_between(spark):
    commits = shuffled(spark).select(F.col("k").alias("pos"), (F.col("k") % 50).alias("session"))
    assert session_ranges(commits).where("inside <> last - first + 1").count() == 0
