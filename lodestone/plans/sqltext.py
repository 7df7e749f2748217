"""Pieces of DuckDB SQL for the oracle: terms and folding as in ``lodestone.functions.text``."""


def fold(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def primaries(x: str) -> str:
    return rf"regexp_extract_all({x}, '[A-Za-z0-9_\x{{80}}-\x{{10FFFF}}]+')"


def _separated(p: str) -> str:
    for pattern in (r"([^A-Z ])([A-Z])", r"([^0-9 ])([0-9])", r"([0-9])([^0-9 ])", r"([A-Z])([A-Z][a-z])"):
        p = rf"regexp_replace({p}, '{pattern}', '\1 \2', 'g')"
    return p


def terms(x: str) -> str:
    """Every term and its parts; terms of more than 64 bytes do not occur in the tables."""
    parts = f"list_filter(list_distinct(list_transform(regexp_split_to_array({_separated('p')}, '[_ ]+'), lambda s: {fold('s')})), lambda s: strlen(s) >= 2 AND s <> {fold('p')})"
    return f"flatten(list_transform({primaries(x)}, lambda p: list_concat([{fold('p')}], {parts})))"


def bm25(doc_terms: str = "", asked: str = "") -> str:
    """CTEs ending in bm(query, doc_id, score): benchmark items as queries over documents' texts, unless expressions for either are given."""
    return f"""
d AS (SELECT doc_id, {doc_terms or terms('text')} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id AS query, unnest({terms(asked or 'text')}) AS term FROM benchmark),
bm AS (SELECT query, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN p USING (term) JOIN dfs USING (term) CROSS JOIN st GROUP BY query, doc_id)"""


def ranked(cte: str, k: int, key: str = "doc_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, {key}) AS rank FROM {cte} QUALIFY rank <= {k}"
