"""Column expressions on text: ASCII folding, terms, ids, durations, headers, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.config import BYTES_PER_TOKEN, MAX_PARTS, MAX_QUERY_TERMS, MAX_TERM_BYTES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[A-Za-z0-9_\x{80}-\x{10FFFF}]+"
#: Terms that may have parts: a capital, digit or underscore after a letter, or a digit or underscore at the beginning.
COMPOUND = r"(?:[A-Za-z\x{80}-\x{10FFFF}][a-z\x{80}-\x{10FFFF}]*+[A-Z0-9_]|[0-9_])[A-Za-z0-9_\x{80}-\x{10FFFF}]*"
#: A text without this holds no term of more than 64 bytes.
LONG = r"[A-Za-z0-9_\x{80}-\x{10FFFF}]{17}"
#: Boundaries of compound terms: underscores, a rise to a capital, a digit edge, the last capital of a run.
BOUNDARY = r"_+|(?<=[^A-Z])(?=[A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])|(?<=[A-Z])(?=[A-Z][a-z])"
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def fold(c: Column | str) -> Column:
    """ASCII letters in lower case; everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def contains_folded(text: Column | str, needle: Column) -> Column:
    return F.contains(fold(text), fold(needle))


def clip_term(c: Column) -> Column:
    """At most 64 bytes, cut between characters."""
    return F.when(F.octet_length(c) <= MAX_TERM_BYTES, c).otherwise(
        F.aggregate(F.split(c, ""), F.lit(""), lambda a, x: F.when(F.octet_length(F.concat(a, x)) <= MAX_TERM_BYTES, F.concat(a, x)).otherwise(a))
    )


def primary_terms(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def parts_of(term: Column) -> Column:
    """Distinct folded parts of a compound term, of two bytes at least and other than the whole."""
    parts = F.transform(F.split(term, BOUNDARY), lambda p: clip_term(fold(p)))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: (F.octet_length(p) >= 2) & (p != clip_term(fold(term))))), 1, MAX_PARTS)


def all_terms(text: Column | str) -> Column:
    """Every term and its parts, in order, with repeats: what the keyword index counts."""
    split = lambda t: F.when(t.rlike("[A-Z0-9_]"), F.concat(F.array(clip_term(fold(t))), parts_of(t))).otherwise(F.array(clip_term(t)))
    return F.flatten(F.transform(primary_terms(text), split))


def counted_terms(text: Column | str) -> Column:
    """The same terms as ``all_terms`` in any order: whole terms from one pass over the folded text, parts only of terms that have any."""
    folded = primary_terms(fold(text))
    whole = F.when(F.col(text).rlike(LONG) if isinstance(text, str) else text.rlike(LONG), F.transform(folded, clip_term)).otherwise(folded)
    return F.concat(whole, F.flatten(F.transform(F.regexp_extract_all(text, F.lit(COMPOUND), F.lit(0)), parts_of)))


def query_terms(text: Column | str) -> Column:
    return F.slice(F.array_distinct(all_terms(text)), 1, MAX_QUERY_TERMS)


def marked(text: Column | str, terms: Column | str) -> Column:
    """The text with every occurrence of a term, in any case, in brackets; as it is without terms."""
    kept = F.filter(terms, lambda t: t != "")
    longest = F.reverse(F.array_sort(F.transform(kept, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))))
    pattern = F.concat(F.lit("(?i)("), F.array_join(F.transform(longest, lambda x: F.concat(F.lit("\\Q"), x["t"], F.lit("\\E"))), "|"), F.lit(")"))
    return F.when(F.size(kept) > 0, F.regexp_replace(text, pattern, F.lit("[$1]"))).otherwise(F.col(text) if isinstance(text, str) else text)


def node_hash(c: Column | str) -> Column:
    """FNV-1a over the UTF-16 units of a text as a number in [0, 1)."""
    raw = F.hex(F.encode(c, "UTF-16BE"))
    unit = lambda i: F.conv(F.substr(raw, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
    units = F.when(F.length(raw) > 0, F.transform(F.sequence(F.lit(0), (F.length(raw) / 4).cast("int") - 1), unit)).otherwise(F.array().cast("array<long>"))
    step = lambda h, u: ((h.bitwiseXOR(u)) * 0x01000193).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(raw.isNotNull(), F.aggregate(units, F.lit(0x811C9DC5).cast("long"), step) / 2**32)


def id_number(c: Column | str, kind: str = "[A-Z]") -> Column:
    """12 of ``D-12``; 0 if it is not an id."""
    return F.coalesce(F.regexp_extract(c, rf"^{kind}-([0-9]{{1,18}})$", 1).try_cast("long"), F.lit(0).cast("long"))


def make_id(kind: str, number: Column) -> Column:
    return F.concat(F.lit(f"{kind}-"), number.cast("string"))


def duration_seconds(c: Column | str) -> Column:
    """Seconds of 90d, 36h and the like; null for anything else."""
    unit = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.regexp_extract(c, "^([0-9]{1,9})[smhdw]$", 1).try_cast("long") * unit[F.regexp_extract(c, "^[0-9]{1,9}([smhdw])$", 1)]


def token_estimate(c: Column | str) -> Column:
    return F.ceil(F.octet_length(c) / BYTES_PER_TOKEN).cast("long")


def one_line(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(c, r"[\x20\x09-\x0D]+", " "))


def first_line(c: Column | str) -> Column:
    return F.trim(F.substring_index(c, "\n", 1))


def word_set(c: Column | str) -> Column:
    """Distinct folded runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(fold(c), F.lit(r"[a-z0-9\x{80}-\x{10FFFF}]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; two empty ones have 0."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def chunk_header(title: Column, context: Column, heading: Column) -> Column:
    """``title > context > heading`` without empty and repeated parts; a context loses the title it begins with."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    inner = F.when(F.startswith(context, F.concat(title, F.lit(" > "))), F.substr(context, F.length(title) + 4)).otherwise(context)
    use_context = ~empty(context) & (empty(title) | (context != title))
    last = F.when(use_context, context).otherwise(F.when(~empty(title), title))
    return F.concat_ws(
        " > ",
        F.when(~empty(title), title),
        F.when(use_context, inner),
        F.when(~empty(heading) & (last.isNull() | (heading != last)), heading),
    )


def format_bytes(n: Column) -> Column:
    unit = lambda size, name: F.concat(F.format_string("%.1f", n / size), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, unit(1 << 10, "KB")).when(n < 1 << 30, unit(1 << 20, "MB")).otherwise(unit(1 << 30, "GB"))


def slug(c: Column | str) -> Column:
    words = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s_-]", "")
    return F.regexp_replace(F.trim(words), r"\s", "-")


def address_key(c: Column | str) -> Column:
    """An address without scheme's case, fragment, index.html and closing slashes; the query stays."""
    no_fragment = F.substring_index(c, "#", 1)
    path, query = F.regexp_extract(no_fragment, r"^([^?]*)(.*)$", 1), F.regexp_extract(no_fragment, r"^([^?]*)(.*)$", 2)
    return F.concat(F.regexp_replace(F.regexp_replace(path, r"/index\.html$", "/"), r"/+$", ""), query)


def identifier_shaped(c: Column | str) -> Column:
    """Whether a query looks like a name in code: one word with an underscore, digits in letters or a capital inside."""
    one = F.trim(c)
    return ~one.rlike(r"\s") & one.rlike(r"_|::|[a-z][A-Z]|[A-Za-z][0-9]|^[A-Z][A-Z0-9]{2,}$|\(\)$")


def area_of(path: Column | str) -> Column:
    parts = F.split(path, "/")
    two = F.get(parts, F.lit(0)).isin("packages", "cli") & (F.size(parts) > 2)
    return F.when(two, F.concat_ws("/", F.slice(parts, 1, 2))).when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit(""))


def join_path(base: Column, rel: Column) -> Column:
    """``rel`` seen from folder ``base``, dots resolved; null where it leads above the root."""
    steps = F.filter(F.split(F.concat_ws("/", base, rel), "/"), lambda s: (s != "") & (s != "."))
    start = F.array().cast("array<string>")
    out = F.aggregate(
        steps,
        F.struct(start.alias("at"), F.lit(True).alias("ok")),
        lambda a, s: F.when(s != "..", F.struct(F.concat(a["at"], F.array(s)).alias("at"), a["ok"].alias("ok"))).otherwise(
            F.struct(F.slice(a["at"], 1, F.greatest(F.size(a["at"]) - 1, F.lit(0))).alias("at"), (a["ok"] & (F.size(a["at"]) > 0)).alias("ok"))
        ),
    )
    return F.when(out["ok"], F.concat_ws("/", out["at"]))


def utf8_clip(c: Column | str, n: int) -> Column:
    """The longest prefix of at most ``n`` bytes that ends between characters."""
    c = F.col(c) if isinstance(c, str) else c
    raw = F.encode(c, "UTF-8")
    cut = F.substring(raw, 1, n)
    ends = [F.substring(raw, 1, n - k) for k in range(4)]
    out = F.lit("")
    for e in reversed(ends):
        out = F.when(F.is_valid_utf8(e.cast("string")), e.cast("string")).otherwise(out)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.when(cut.isNotNull(), out))


def decode_entities(c: Column | str) -> Column:
    out = c if isinstance(c, Column) else F.col(c)
    for name, char in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def relative_age(then: Column, now: Column) -> Column:
    """``5 min ago``, ``yesterday``, and the date after seven days."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    n = lambda k, unit: F.concat(F.floor(s / k).cast("string"), F.lit(unit))
    return (
        F.when(s < 60, F.lit("just now"))
        .when(s < 3600, n(60, " min ago"))
        .when(s < 86400, n(3600, " h ago"))
        .when(s < 2 * 86400, F.lit("yesterday"))
        .when(s < 7 * 86400, n(86400, " days ago"))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )
