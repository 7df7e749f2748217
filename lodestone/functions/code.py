"""Source code without grammars: symbols, imports, display tokens; section files; metadata typing."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOL = {
    "c": r"^[A-Za-z_][\w\s\*]*?\b(?P<name>[A-Za-z_]\w*)\s*\([^;{]*\)\s*\{|^(?:typedef\s+)?(?:struct|enum|union)\s+(?P<name2>\w+)",
    "go": r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)|^type\s+(?P<name2>\w+)",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(?P<name>\w+)|^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait|mod|type)\s+(?P<name2>\w+)",
    "js": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(?P<name>\w+)|^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|type|enum)\s+(?P<name2>\w+)|^\s*export\s+(?:const|let|var)\s+(?P<name3>\w+)",
}
SYMBOL["ts"] = SYMBOL["js"]
IMPORT = {
    "c": [r"^\s*#\s*include\s*(?P<open>[<\"])(?P<spec>[^>\"]+)"],
    "js": [r"\bfrom\s*[\"'](?P<spec>[^\"']+)[\"']", r"^\s*import\s*[\"'](?P<spec>[^\"']+)[\"']", r"\b(?:require|import)\(\s*[\"'](?P<spec>[^\"']+)[\"']\s*\)"],
}
IMPORT["ts"] = IMPORT["js"]
KEYWORDS = frozenset("and as assert async await break case class const continue def default do else enum except export extends false finally fn for from func function go if impl import in interface is let match mod mut new nil none not null or package pass pub raise return static struct switch this throw trait true try type typedef use var void while with yield".split())


def symbols(text: str, lang: str) -> list[tuple[str, str, int]]:
    """(name, kind, line) of declarations; Python by its own parser, others by patterns (less exact)."""
    if lang == "python":
        try:
            tree = ast.parse(text)
        except SyntaxError:
            return []
        kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
        return sorted(((n.name, kinds[type(n)], n.lineno) for n in ast.walk(tree) if type(n) in kinds), key=lambda s: s[2])
    out = []
    for m in re.finditer(SYMBOL.get(lang, r"(?!)"), text, re.M):
        k = next(i for i, g in enumerate(m.groups()) if g)
        out.append((m.groups()[k], "function" if k == 0 else "type" if k == 1 else "value", text.count("\n", 0, m.start(m.lastindex)) + 1))
    return out


def imports(text: str, lang: str) -> list[tuple[str, bool]]:
    """(what is imported, whether it is a system header), in order, once each."""
    if lang == "python":
        try:
            tree = ast.parse(text)
        except SyntaxError:
            return []
        found = [(n.lineno, a.name) for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
        found += [(n.lineno, "." * n.level + (n.module or "")) for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)]
        return list(dict.fromkeys((s, False) for _, s in sorted(found)))
    found = [(m.start(), m["spec"], m.groupdict().get("open") == "<") for p in IMPORT.get(lang, []) for m in re.finditer(p, text, re.M)]
    return list(dict.fromkeys((s, system) for _, s, system in sorted(found)))


_LEX = re.compile(r"(?P<comment>//[^\n]*|#[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<number>\b\d[\w.]*)|(?P<word>[^\W\d]\w*)|(?P<other>\s+|.)", re.S)


def display_tokens(source: str) -> list[tuple[str, str]]:
    """(kind, text) whose texts join to the source: comment, string, number, keyword, plain."""
    out: list[list[str]] = []
    for m in _LEX.finditer(source):
        kind = m.lastgroup or "other"
        kind = ("keyword" if m[0].lower() in KEYWORDS else "plain") if kind == "word" else "plain" if kind == "other" else kind
        if out and out[-1][0] == kind == "plain":
            out[-1][1] += m[0]
        else:
            out.append([kind, m[0]])
    return [(k, t) for k, t in out]


def section_file(text: str, names: tuple[str, ...]) -> dict[str, str]:
    """``Name:`` headers with their text; text before the first, a repeated or an empty section is an error."""
    out: dict[str, list[str]] = {}
    current = None
    for line in text.splitlines():
        m = re.match(rf"({'|'.join(map(re.escape, names))}):\s*(.*)$", line)
        if m:
            if m[1] in out:
                raise ValueError(f"section_repeated: {m[1]}")
            current, out[m[1]] = m[1], [m[2]]
        elif current is None:
            if line.strip():
                raise ValueError("text_before_section")
        else:
            out[current].append(line)
    done = {k: "\n".join(v).strip() for k, v in out.items()}
    for k, v in done.items():
        if not v:
            raise ValueError(f"section_empty: {k}")
    return done


def typed_metadata(pair: str) -> tuple[str, object]:
    """``key=value`` with a JSON number, true, false or null typed, anything else text."""
    key, sep, value = pair.partition("=")
    if not sep or not key:
        raise ValueError("bad_metadata")
    if re.fullmatch(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", value) or value in ("true", "false", "null"):
        return key, json.loads(value)
    return key, value


def hash01(s: str) -> float:
    """FNV-1a of UTF-16 code units as a number in [0, 1)."""
    h = 0x811C9DC5
    raw = s.encode("utf-16-le")
    for unit in memoryview(raw).cast("H"):
        h = ((h ^ unit) * 0x01000193) & 0xFFFFFFFF
    return h / 2**32


def _arrow(f, kind: str):
    """A column function that calls ``f`` on every value of Arrow batches; null for null."""
    return F.pandas_udf(lambda s: pd.Series([None if v is None else f(v) for v in s]), kind)


def symbols_of(text: Column | str, lang: str) -> Column:
    """Declarations of a column of sources."""
    names = ("name", "kind", "line")
    return _arrow(lambda t: [dict(zip(names, x, strict=True)) for x in symbols(t, lang)], "array<struct<name:string,kind:string,line:int>>")(text)


def imports_of(text: Column | str, lang: str) -> Column:
    """Imports of a column of sources."""
    return _arrow(lambda t: [{"spec": s, "system": y} for s, y in imports(t, lang)], "array<struct<spec:string,system:boolean>>")(text)


#: Symbols that a file's meta lists at most.
META_SYMBOLS = 500


def code_meta(text: Column | str, lang: str) -> Column:
    """language and the first symbols, as a file's meta has them."""
    names = F.transform(symbols_of(text, lang), lambda s: s["name"])
    return F.struct(F.lit(lang).alias("language"), F.slice(names, 1, META_SYMBOLS).alias("symbols"))


def display_tokens_of(text: Column | str) -> Column:
    return _arrow(lambda t: [{"kind": k, "text": x} for k, x in display_tokens(t)], "array<struct<kind:string,text:string>>")(text)


def sections_of(text: Column | str, names: tuple[str, ...]) -> Column:
    """(error, sections) of a column of section files."""

    def of(t: str) -> dict:
        try:
            return {"error": None, "sections": section_file(t, names)}
        except ValueError as e:
            return {"error": str(e), "sections": None}

    kind = "error string, sections map<string,string>"
    return F.pandas_udf(lambda s: pd.DataFrame([of(v or "") for v in s], columns=["error", "sections"]), kind)(text)


def metadata_kind(value: Column) -> Column:
    """number, bool, null or string, by the rule of :func:`typed_metadata`."""
    return F.when(value.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number").when(value.isin("true", "false"), "bool").when(value == "null", "null").otherwise("string")
