"""Fixed values of the retrieval, history and board semantics."""

# chunks
TARGET_TOKENS, OVERLAP_TOKENS, BYTES_PER_TOKEN = 400, 60, 4
# keyword index
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 3, "context": 2, "heading": 2, "symbols": 3, "body": 1}
MAX_TERM_BYTES, MAX_PARTS, MAX_QUERY_TERMS = 64, 16, 64
# fusion
RRF_K, SEMANTIC_WEIGHT, SEMANTIC_WEIGHT_IDENTIFIER = 60, 0.60, 0.30
DEFAULT_K, MAX_K, MAX_EXPAND, SNIPPET_BYTES, RERANK_DEPTH = 10, 100, 3, 240, 10
STALE_DEFAULT = "90d"
# history
DIFF_COST_LIMIT, LEAST_WORDS, TOO_SIMILAR = 1024, 3, 0.8
# board
STATUSES = ("backlog", "todo", "doing", "review", "done")
PRIORITIES = ("low", "medium", "high", "urgent")
SEARCH_WEIGHTS = {"id_exact": 100, "id": 8, "title": 4, "labels": 2, "assignee": 2, "description": 1, "comments": 1}
GAP_SECONDS = 300
DECIMALS = 6
