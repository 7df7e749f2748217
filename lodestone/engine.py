"""One entry for each of the call surfaces: retrieval, board, pages. Methods return DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULT_K, STALE_DEFAULT
from lodestone.functions.chunks import chunks
from lodestone.functions.text import UNITS
from lodestone.operators import board as _board
from lodestone.operators import store as _store
from lodestone.plans.search import hybrid_search


class EngineError(Exception):
    """An error with a fixed code, a message and details."""

    def __init__(self, code: str, message: str, **details):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.details = code, message, details

    def envelope(self) -> dict:
        return {"ok": False, "error": {"code": self.code, "message": self.message, **({"details": self.details} if self.details else {})}}


def checked(arguments: dict, allowed: dict[str, type | tuple[type, ...]], required: tuple[str, ...] = ()) -> dict:
    """The arguments, if all are known, of their types, and none is missing."""
    for k in arguments:
        if k not in allowed:
            raise EngineError("unknown_argument", k, allowed=sorted(allowed))
    for k in required:
        if arguments.get(k) in (None, ""):
            raise EngineError("missing_argument", k)
    for k, v in arguments.items():
        if v is not None and not isinstance(v, allowed[k]):
            raise EngineError("bad_argument", k)
    return arguments


def seconds_of(spec: str) -> int:
    if len(spec) < 2 or not spec[:-1].isdigit() or spec[-1] not in UNITS:
        raise EngineError("bad_duration", spec)
    return int(spec[:-1]) * UNITS[spec[-1]]


class Retrieval:
    """Over documents (id, title, text, collection, source, locator, mime, fetched_at, meta, bytes), links (from, rel, to) and vectors (id, vector)."""

    def __init__(self, documents: DataFrame, links: DataFrame | None = None, vectors: DataFrame | None = None):
        self.documents, self.links_table, self.vectors = documents, links, vectors

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    def search(self, text: str, vector: list[float] | None = None, k: int = DEFAULT_K, fusion: str = "score", **filters) -> DataFrame:
        checked(filters, {n: str for n in ("collection", "source", "mime", "since", "q")} | {"meta": dict})
        if fusion not in ("score", "rrf"):
            raise EngineError("bad_argument", "fusion")
        q = self.spark.createDataFrame([(1, text, vector)], "query long, text string, qv array<double>")
        keep = _store.document_filter(**filters) if filters else None
        docs = self.documents if keep is None else self.documents.withColumn("_kept", keep)
        return hybrid_search(docs, "id", "text", self.vectors if vector is not None else None, "vector", q, k, fusion=fusion, keep=None if keep is None else F.col("_kept")).drop("query").orderBy("rank")

    def list(self, limit: int | None = None, after: int = 0, reverse: bool = False, **filters) -> DataFrame:
        from lodestone.functions.text import id_number

        rows = self.documents.where(_store.document_filter(**filters)) if filters else self.documents
        return _store.page_after(rows, id_number("id"), after, limit if limit is not None else 2**31 - 1, reverse)

    def get(self, id: str) -> DataFrame:
        found = self.documents.where(F.col("id") == id)
        if found.isEmpty():
            raise EngineError("not_found", id)
        return found

    def chunk_list(self, id: str, lang: str = "text") -> DataFrame:
        return chunks(self.get(id), "id", "text", lang).orderBy("ordinal")

    def collections(self) -> DataFrame:
        return self.documents.groupBy("collection").agg(F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes"), F.min("fetched_at").alias("oldest")).orderBy("collection")

    def links(self, id: str) -> DataFrame:
        if self.links_table is None:
            raise EngineError("no_links", id)
        own = self.links_table.where((F.col("from") == id) | (F.col("to") == id))
        return _store.resolved_links(own, self.documents.select("id")).withColumn("direction", F.when(F.col("from") == id, "outgoing").otherwise("incoming"))

    def stale(self, as_of: str, older_than: str = STALE_DEFAULT) -> DataFrame:
        return self.documents.where(_store.stale(F.col("fetched_at"), F.lit(as_of).cast("timestamp"), seconds_of(older_than)))


class Board:
    """Over items (id, kind, title, description, status, epic, milestone, priority, assignee, labels, archived)."""

    def __init__(self, items: DataFrame):
        self.items = items

    def view(self) -> DataFrame:
        return _board.with_archive(self.items)

    def search(self, query: str, keep: Column | None = None) -> DataFrame:
        text = lambda c: F.coalesce(F.col(c), F.lit(""))
        fields = {"id": F.col("id"), "title": text("title"), "description": text("description"), "assignee": text("assignee"), "labels": F.concat_ws(" ", "labels")}
        rows = self.items if keep is None else self.items.where(keep)
        return rows.withColumn("score", _board.search_score(query, fields, F.col("id"))).where("score is not null").orderBy(F.desc("score"), F.regexp_extract("id", "([0-9]+)$", 1).try_cast("long"))

    def facets(self, chosen: dict[str, list[str]]) -> DataFrame:
        return _board.facet_counts(self.items.where("kind = 'ticket'"), chosen)

    def kanban(self) -> DataFrame:
        return _board.kanban(self.items.where("kind = 'ticket'"))

    def progress(self) -> DataFrame:
        return _board.count_by_status(self.items.where("kind = 'ticket'"), ["epic"])
