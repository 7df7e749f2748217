"""A board of epics, milestones and tickets: filters, search, facets, progress, columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import PRIORITIES, SEARCH_WEIGHTS, STATUSES


def count_by_status(tickets: DataFrame, by: list[str], statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """A column for each status, 0 where there is none."""
    return tickets.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def with_archive(items: DataFrame) -> DataFrame:
    """``archived_via``: own, milestone or epic, the nearest mark of an item, its milestone and its epic."""
    marks = items.where("archived").select(F.col("id").alias("_id"))
    has = lambda name, c: marks.withColumnRenamed("_id", f"_{name}")
    out = items.join(has("m", "milestone"), F.col("milestone") == F.col("_m"), "left").join(has("e", "epic"), F.col("epic") == F.col("_e"), "left")
    via = F.when(F.col("archived"), "own").when(F.col("_m").isNotNull(), "milestone").when(F.col("_e").isNotNull(), "epic")
    return out.withColumn("archived_via", via).drop("_m", "_e")


def closure(items: DataFrame, matched: DataFrame) -> DataFrame:
    """ids of matches, their ancestors and their descendants (id, milestone, epic)."""
    m = items.join(matched.select("id"), "id", "left_semi")
    up = m.select("id").union(m.select("milestone")).union(m.select("epic"))
    down = items.join(matched.select(F.col("id").alias("_p")), (F.col("milestone") == F.col("_p")), "left_semi").select("id")
    down2 = items.join(matched.select(F.col("id").alias("_p")), (F.col("epic") == F.col("_p")), "left_semi").select("id")
    return up.union(down).union(down2).where("id is not null").distinct()


def facet_counts(rows: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """field, value, n: counts for each field under the choices of all other fields, its own left out."""
    out = None
    for f in chosen:
        keep = F.lit(True)
        for other, values in chosen.items():
            if other != f and values:
                keep = keep & F.col(other).isin(*values)
        part = rows.where(keep).groupBy(F.col(f).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f).alias("field"), "value", "n")
        out = part if out is None else out.union(part)
    return out


def search_score(query: str, fields: dict[str, Column], id_field: Column, weights: dict[str, int] = SEARCH_WEIGHTS) -> Column:
    """Every word of the query must be in some field, or the query is the id itself; null for no match."""
    q = query.strip().lower()
    exact = F.lower(id_field) == q
    all_found, score = F.lit(True), F.when(exact, F.lit(weights["id_exact"])).otherwise(F.lit(0))
    for w in q.split():
        found = [F.contains(F.lower(c), F.lit(w)) for c in fields.values()]
        some = F.lit(False)
        for f in found:
            some = some | F.coalesce(f, F.lit(False))
        all_found = all_found & some
        for name, f in zip(fields, found, strict=True):
            score = score + F.when(f, F.lit(weights[name])).otherwise(F.lit(0))
    return F.when(exact | all_found, score)


def snippet(text: Column, term: str) -> Column:
    """Sixty characters before the first hit and a hundred after it, one line, with ellipses where cut."""
    at = F.instr(F.lower(text), F.lit(term.lower()))
    begin, end = F.greatest(at - 60, F.lit(1)), at + 100
    body = F.trim(F.regexp_replace(F.substr(text, begin, end - begin), r"\s+", " "))
    return F.when(at > 0, F.concat(F.when(begin > 1, "…").otherwise(""), body, F.when(end <= F.length(text), "…").otherwise("")))


def kanban(tickets: DataFrame, statuses: tuple[str, ...] = STATUSES, priorities: tuple[str, ...] = PRIORITIES) -> DataFrame:
    """column_no, place: status order, then the highest priority, then the id's number."""
    from pyspark.sql import Window

    rank = F.array_position(F.array(*map(F.lit, priorities)), F.col("priority"))
    column = F.array_position(F.array(*map(F.lit, statuses)), F.col("status"))
    w = Window.partitionBy("status").orderBy(rank.desc(), "id")
    return tickets.where(column > 0).withColumn("column_no", column.cast("int")).withColumn("place", F.row_number().over(w))
