import pytest

from lodestone.engine import Board, EngineError, Retrieval, checked, seconds_of


@pytest.fixture(scope="module")
def store(spark):
    docs = [("D-1", "Alpha", "alpha beta rings", "en", "S-1", "a/1", "text/plain", "2024-01-01 00:00:00", '{"tags": ["x"]}', 10), ("D-2", "Beta", "beta gamma", "de", "S-1", "a/2", "text/plain", "bad", "{}", 20), ("D-10", "Ring", "ring buffers and rings", "en", "S-2", "b/1", "text/plain", "2024-05-01 00:00:00", None, 30)]
    links = [("D-1", "cites", "D-2"), ("D-3", "cites", "D-1")]
    return Retrieval(
        spark.createDataFrame(docs, "id string, title string, text string, collection string, source string, locator string, mime string, fetched_at string, meta string, bytes long"),
        spark.createDataFrame(links, "`from` string, rel string, `to` string"),
        spark.createDataFrame([("D-1", [1.0, 0.0]), ("D-2", [0.0, 1.0]), ("D-10", [0.6, 0.8])], "id string, vector array<double>"),
    )


def test_search(store):
    assert [r.id for r in store.search("rings").collect()] == ["D-1", "D-10"]
    got = store.search("rings", vector=[0.0, 1.0], fusion="rrf").collect()
    assert {r.id for r in got} == {"D-1", "D-2", "D-10"} and got[0].id == "D-1" and got[0].matched == "keyword,semantic"
    assert [r.id for r in store.search("beta", collection="de").collect()] == ["D-2"]
    with pytest.raises(EngineError, match="unknown_argument"):
        store.search("x", colour="red")


def test_reads(store):
    assert [r.id for r in store.list(limit=1, after=1).collect()] == ["D-2"]
    assert {r.id for r in store.stale("2024-05-02 00:00:00").collect()} == {"D-1", "D-2"}
    assert {(r["from"], r.direction, r.from_resolved) for r in store.links("D-1").collect()} == {("D-1", "outgoing", True), ("D-3", "incoming", False)}
    assert {r.collection: r.documents for r in store.collections().collect()} == {"en": 2, "de": 1}
    assert store.chunk_list("D-1").count() == 1
    with pytest.raises(EngineError) as e:
        store.get("D-99")
    assert e.value.envelope()["error"]["code"] == "not_found"


def test_arguments():
    assert seconds_of("2w") == 1209600
    for bad in ("90", "", "1y"):
        with pytest.raises(EngineError, match="bad_duration"):
            seconds_of(bad)
    with pytest.raises(EngineError, match="missing_argument"):
        checked({}, {"q": str}, ("q",))


def test_board(spark):
    rows = [("E-1", "epic", "Store", None, None, None, None, None, None, [], True), ("T-1", "ticket", "Ring buffer", "grow it", "doing", "E-1", None, "high", "ann", ["io"], False), ("T-2", "ticket", "Docs", "ring of pages", "todo", None, None, "low", "bob", ["docs"], False)]
    board = Board(spark.createDataFrame(rows, "id string, kind string, title string, description string, status string, epic string, milestone string, priority string, assignee string, labels array<string>, archived boolean"))
    assert [(r.id, r.score) for r in board.search("ring").collect()] == [("T-1", 4), ("T-2", 1)]
    assert [r.id for r in board.search("t-2").collect()] == ["T-2"]
    assert {r.id: r.archived_via for r in board.view().collect()} == {"E-1": "own", "T-1": "epic", "T-2": None}
    assert board.kanban().count() == 2 and board.facets({"status": ["todo"], "priority": []}).count() == 3
