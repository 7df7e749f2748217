"""Registered query of chunks along the nesting of source text, over code written from the parts of a brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import nesting as N
from lodestone.plans.registry import query, table

TARGET = 600
FUNCTION = "'  int f' || p_partkey || '(int x) {' || chr(10) || '    if (x > ' || p_size || ') { // ' || p_name || ' }' || chr(10) || repeat('      x += 1; /* { */' || chr(10), p_size % 9) || '    }' || chr(10) || '    return g(\"}{\", x);' || chr(10) || '  }' || chr(10)"
LEVELS = range(N.DEEPEST + 1)


def _levels() -> str:
    """A CTE for each depth: where units begin, how large they are, their first lines."""
    out = "v0 AS (SELECT *, true AS open0, false AS b0 FROM x)"
    for d in LEVELS:
        out += f""",
w{d} AS (SELECT *, (before <= {d} AND NOT goes_on) AS st{d}, sum((before <= {d} AND NOT goes_on)::INT) OVER (PARTITION BY key ORDER BY n) AS u{d} FROM v{d}),
v{d + 1} AS (SELECT *, b{d} OR (st{d} AND open{d}) AS b{d + 1}, open{d} AND sum(size) OVER (PARTITION BY key, u{d}) > {TARGET} AS open{d + 1},
  CASE WHEN open{d} AND sum(size) OVER (PARTITION BY key, u{d}) > {TARGET} AND NOT st{d} THEN substr(first_value(trim(line)) OVER (PARTITION BY key, u{d} ORDER BY n), 1, {N.HEADING}) END AS h{d} FROM w{d})"""
    return out


LAST = N.DEEPEST + 1
SQL = f"""WITH RECURSIVE src AS (SELECT p_brand AS key, 'struct all {{' || chr(10) || string_agg({FUNCTION}, '' ORDER BY p_partkey) || '}};' || chr(10) AS text FROM part GROUP BY p_brand),
l AS (SELECT key, unnest(range(len(ls))) AS n, unnest(ls) AS line, len(ls) AS k FROM (SELECT key, string_split(text, chr(10)) AS ls FROM src)),
c AS (SELECT *, strlen(line) + (n < k - 1)::INT AS size, regexp_replace(regexp_replace(regexp_replace(line, '"[^"]*"', '_', 'g'), '/\\*.*?\\*/', '', 'g'), '//.*$', '') AS code FROM l WHERE line <> '' OR n < k - 1),
e AS (SELECT *, length(regexp_replace(code, '[^{{(\\[]', '', 'g')) - length(regexp_replace(code, '[^}})\\]]', '', 'g')) AS delta FROM c),
x AS (SELECT key, n, line, size, sum(size) OVER w - size AS at_, sum(delta) OVER w - delta AS before, regexp_matches(trim(code), '^[{{}})\\]]|^(else|catch|finally)\\b') OR trim(line) = '' AS goes_on FROM e WINDOW w AS (PARTITION BY key ORDER BY n)),
{_levels()},
un AS (SELECT *, array_to_string(list_filter([{', '.join(f'h{d}' for d in LEVELS)}], lambda h: h IS NOT NULL), ' > ') AS path, sum((b{LAST} OR open{LAST} OR n = 0)::INT) OVER (PARTITION BY key ORDER BY n) AS unit FROM v{LAST}),
pu AS (SELECT key, unit::INT AS unit, sum(size)::BIGINT AS size, min(at_)::BIGINT AS start, arg_min(path, n) AS path, arg_min(substr(trim(line), 1, {N.HEADING}), n) AS own FROM un GROUP BY key, unit),
gr AS (SELECT key, unit, size AS held, true AS cut FROM pu WHERE unit = 1
  UNION ALL SELECT p.key, p.unit, CASE WHEN g.held + p.size <= {TARGET} THEN g.held + p.size ELSE p.size END, g.held + p.size > {TARGET} FROM gr g JOIN pu p ON p.key = g.key AND p.unit = g.unit + 1),
ck AS (SELECT pu.*, sum(size) OVER (PARTITION BY pu.key) AS whole, cut FROM pu JOIN gr ON gr.key = pu.key AND gr.unit = pu.unit)
SELECT key, (row_number() OVER w - 1)::INT AS ordinal, start, coalesce(lead(start) OVER w, whole)::BIGINT AS end, CASE WHEN path <> '' THEN path || ' > ' || own ELSE own END AS heading
FROM ck WHERE cut WINDOW w AS (PARTITION BY key ORDER BY unit)"""


@query("t9_nested_chunks", sql=SQL)
def t9(spark, sf):
    """A struct of all functions of a brand, cut along functions and blocks."""
    one = F.expr(FUNCTION.replace("chr(10)", "'\\n'").replace('\\"', '"'))
    part = table(spark, sf, "part").withColumnRenamed("p_brand", "key")
    # no text is put together: its functions are pieces of whole lines, in order
    edge = lambda place, line: part.select("key").distinct().select("key", F.lit(place).alias("place"), F.lit(None).cast(part.schema["p_partkey"].dataType).alias("p_partkey"), F.lit(line).alias("text"))
    functions = part.select("key", F.lit(1).alias("place"), "p_partkey", one.alias("text"))
    return N.nested_chunks(edge(0, "struct all {\n").union(functions).union(edge(2, "};\n")), "key", "text", TARGET, "place", "p_partkey")
