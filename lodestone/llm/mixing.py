"""Mixing sources to target weights.

Words are summed for each source; each source's target is its weight's share of all words, but
never above ``most`` times what the source has: the excess is reshared by weight until no target
is above its limit (water-filling, solved in closed form over the sources in the order of
limit / weight). The repetition rate of a source is target / words. A document is emitted
floor(rate) times, and once more when its own hash-seeded number in [0, 1) is under the rate's
fraction. Runs agree: the number depends on seed, ``doc_id`` and text, and for rows that repeat
both within a source on their number among these, so that a thousand equal rows draw a thousand
times. How many of them get a copy follows from how many there are; where they differ in other
columns, which of them do follows from where they lie in the table.

The table of sources and that of repeated rows are joined to documents; documents are not shuffled
when these were counted to be small, and a shuffled join splits a hot source (adaptive skew join).
Equal rows are numbered within the part of the table that they lie in, on top of how many lie in
the parts before, so that no task holds all rows of a hot group. Rows that repeat nothing stay in place.

Defined cases: a null source is a source of its own and comes last; a null text has no words and
is emitted by the same rule with 0 words; a source without words has target 0 and rate 0, and a
table without words gives targets 0; repeated rows draw each for itself. Sources are in code point order. An empty table gives an empty result. Other columns are
kept by :func:`mixed`, whatever their names, and ignored otherwise. The table of sources (a few numbers each) is put
in order in one task; nothing else is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD_PATTERN, cut, n_rows, small_or_shuffled

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def row_key(seed: str) -> Column:
    """md5 over seed, id and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(seed), text("doc_id"), text("text")))


def draw(key: Column, place: Column) -> Column:
    """A number in [0, 1) from 32 bits of the key, or of the key and the place of a row that is not the first of its kind."""
    own = F.when(place == 0, key).otherwise(F.md5(F.concat_ws(":", key, place.cast("string"))))
    return F.conv(F.substring(own, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def numbered(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` (_key, _of, _part and others) and ``_place``: their number, from 0, among the rows of equal _key and _of, which ``facts`` has too."""
    same = ["_key", "_of"]
    again = cut(facts.groupBy(*same).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(c).alias(c + "_") for c in same]))
    if not n_rows(again):
        return rows.withColumn("_place", F.lit(0).cast("long")).drop("_part")
    is_same = lambda end, *more: [F.col(c).eqNullSafe(F.col(c + end)) for c in (*same, *more)]
    marked = rows.join(small_or_shuffled(again), is_same("_"), "left")
    repeated = cut(marked.where("_key_ is not null").drop("_key_", "_of_"))
    in_part = repeated.groupBy(*same, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = in_part.select(*[F.col(c).alias(c + "__") for c in (*same, "_part")], before.alias("_before"))
    nth = F.row_number().over(Window.partitionBy(*same, "_part").orderBy(F.lit(0)))
    placed = repeated.withColumn("_nth", nth).join(starts, is_same("__", "_part")).withColumn("_place", F.col("_before") + F.col("_nth") - 1)
    once = marked.where("_key_ is null").withColumn("_place", F.lit(0).cast("long")).drop("_key_", "_of_", "_part")
    return once.unionByName(placed.select(*once.columns))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target from rows with ``source`` and ``size``."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("_limit", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    t = (
        per_source.withColumn("_nth", F.row_number().over(in_order))
        .withColumn("_w", F.element_at(cycle, ((F.col("_nth") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_limit", F.col("_cap") / F.col("_w"))
        .withColumn("_k", F.row_number().over(Window.orderBy("_limit", F.col("source").asc_nulls_last())))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_all_w", F.sum("_w").over(everything))
        # the level that all from here on would share if everything before were at its limit
        .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0))))
        .withColumn("_free", F.when(F.col("_limit") > F.col("_level"), F.struct("_k", "_level")))
        .withColumn("_share", F.min("_free").over(everything)["_level"])  # of the first that stays below its limit
    )
    target = F.when(F.col("_share").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_w") * F.col("_share")))
    return t.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: str = "mix", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document: the kept columns, _size, _source_size, _target, _rate, _copies."""
    size, key = n_words(F.col("text")).alias("_size"), row_key(seed).alias("_key")
    facts = cut(docs.select(key, F.col("source").alias("_of"), size))  # the text is read once for targets and repeated rows
    targets = cut(source_targets(facts.select(F.col("_of").alias("source"), F.col("_size").alias("size")), weights, most))
    targets = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    narrow = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("source").alias("_of"), size, key, F.spark_partition_id().alias("_part"))
    return (
        numbered(narrow, facts)
        .join(small_or_shuffled(targets), F.col("_of").eqNullSafe(F.col("_source")))
        .withColumn("_rate", rate)
        .withColumn("_copies", (F.floor("_rate") + F.when(draw(F.col("_key"), F.col("_place")) < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)).cast("long"))
        .drop("_source", "_of", "_key", "_place")
    )


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS, seed: str = "mix") -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as many times as its plan says."""
    whole = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    plan = mix_plan(whole, weights, most, seed, keep=["_row"]).where("_copies > 0")
    # ``most`` copies and one at most, so the repeated rows stay in their task
    return plan.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).select("_row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    plan = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


OP7_SQL = r"""
WITH e AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY key, source) - 1 AS place FROM e),
d AS (SELECT doc_id, source, size, ('0x' || substr(CASE WHEN place = 0 THEN key ELSE md5(key || ':' || place) END, 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM n),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / w AS lim, sum(source_size) OVER () AS alls, sum(w) OVER () AS allw, row_number() OVER (ORDER BY 3 * source_size / w, source) AS k,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capb,
         coalesce(sum(w) OVER (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb
  FROM s),
v AS (SELECT *, (min(CASE WHEN lim > (alls - capb)::DOUBLE / (allw - wb) THEN {'k': k, 'level': (alls - capb)::DOUBLE / (allw - wb)} END) OVER ()).level AS share FROM l),
t AS (SELECT source, source_size, CASE WHEN share IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, w * share) END AS target FROM v)
SELECT d.doc_id, d.size, t.source_size, t.target,
       (d.size * (CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) + CASE WHEN d.u < t.target / t.source_size - floor(t.target / t.source_size) THEN 1 ELSE 0 END ELSE 0 END))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
