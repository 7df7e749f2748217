"""Benchmark decontamination by spaced-seed hashing.

A mask of fixed shape marks the token positions that count and those that are ignored. Every
benchmark item is hashed under each mask at each of its positions; so is every position of every
document; equal hashes are hits, each on a diagonal (document position less item position). On
each diagonal that was hit the document is laid against the whole item, and the pair is kept where
some ``WINDOW`` neighbouring tokens of the item (all of them, in shorter items) agree in at least
``PERCENT`` of a hundred. Substituted words thus neither hide a passage from the masks nor from the
check.

Built-in expressions only. The hashes of items are broadcast when they were counted to be few, and
joined by shuffle else; texts stay in place for that. Documents with hits are read again for the
check; a passage that very many documents share gives one row for each of them and nothing more.

Tokens are runs of letters and digits, lower-cased; of scripts that set no spaces between words, each letter
is a token, so that masks and windows there lie over single letters.
Items of fewer than ``WINDOW`` tokens have masks by their length, so that those of one token can be hit
too. Defined cases: null and empty texts on either side have no tokens; a null
``doc_id`` or ``item_id`` is kept as it is; repeated documents and repeated items give the same rows
once; of several diagonals of a pair the one with most agreeing tokens counts, then the earliest.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, small_or_shuffled, without

#: 1: the token at this offset counts; 0: it is ignored.
MASKS = ("111010011", "1100101101")
#: With these, whatever two of twelve neighbouring tokens differ, some mask meets the others alone.
MORE_MASKS = ("1110111",)
WINDOW, PERCENT = 12, 80
#: Hashes of items (three numbers each, some 60 MB in all) that are broadcast at most; beyond that the join is by shuffle.
BROADCAST_SEEDS = 1_000_000
#: Scripts without spaces between words.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
#: None of their letters lies before this range, which is looked at first: asking a letter's script is slow.
BEYOND = r"[\x{0E00}-\x{10FFFF}]"


def masks_of(size: int) -> tuple[str, ...]:
    """Masks that meet every accepted passage of an item of so many tokens.

    A short item is cut into two blocks more than it may have differing tokens; any two blocks make a mask.
    """
    if size >= WINDOW:
        return MASKS + MORE_MASKS
    differ = size * (100 - PERCENT) // 100
    blocks = [range(size * k // (differ + 2), size * (k + 1) // (differ + 2)) for k in range(differ + 2)]
    marks = ["".join("1" if i in a or i in b else "0" for i in range(size)).strip("0") for a, b in combinations(blocks, 2)]
    return tuple(dict.fromkeys(marks)) if differ else ("1" * size,)


def token_hashes(text: str) -> Column:
    letter, low = "[" + "".join(rf"\p{{Is{s}}}" for s in UNSPACED) + "]", F.lower(text)
    apart = F.when(low.rlike(BEYOND), F.regexp_replace(low, f"(?={BEYOND})({letter})", " $1 ")).otherwise(low)
    words = F.filter(F.split(apart, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds(h: str, mask: str, number: int) -> Column:
    """The hashes of all places of an array of token hashes under one mask; null where the mask passes the end."""
    last = len(mask) - 1
    at = lambda i, k: F.get(h, i + k)
    return F.transform(
        h,
        lambda x, i: F.when(at(i, last).isNotNull(), F.xxhash64(F.lit(number), x, *[at(i, k) for k in _offsets(mask)[1:]])),
    )


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Diagonals (doc_id, text_hash, item, shift, seeds), and the items with their token hashes."""
    items = benchmark.select("item_id", token_hashes("text").alias("ih")).where(F.size("ih") > 0).distinct()
    items = cut(items.withColumn("item", F.xxhash64("item_id", "ih")))
    sizes = sorted(r[0] for r in items.select(F.least(F.size("ih"), F.lit(WINDOW))).distinct().collect())  # WINDOW at most
    masks = [(size, m) for size in sizes for m in masks_of(size)]
    at_most = F.least(F.size("ih"), F.lit(WINDOW))
    sides = []  # outer generators: for the others a filter on the whole expression would be inferred below them
    for side, h in ((items.select("item", "ih"), "ih"), (docs.select("doc_id", F.xxhash64("text").alias("text_hash"), token_hashes("text").alias("dh")), "dh")):
        rest = [c for c in side.columns if c != h]
        both = side.select(*rest, F.array(*[seeds(h, m, k) if h == "dh" else F.when(at_most == size, seeds(h, m, k)) for k, (size, m) in enumerate(masks)]).cast("array<array<bigint>>").alias("_s")).select(*rest, F.explode_outer("_s").alias("_s"))
        sides.append(both.select(*rest, F.posexplode_outer("_s").alias(f"{h}_at", "seed")).where("seed is not null"))
    known = small_or_shuffled(cut(sides[0].withColumnRenamed("seed", "_seed")), BROADCAST_SEEDS)
    found = sides[1].join(known, F.col("seed") == F.col("_seed"))
    return found.groupBy("doc_id", "text_hash", "item", (F.col("dh_at") - F.col("ih_at")).alias("shift")).agg(F.count(F.lit(1)).alias("seeds")), items


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, item_id, doc_start, item_tokens, matched, best_window of each document that shares a passage with an item."""
    diagonals, items = hits(docs, benchmark)
    diagonals = cut(diagonals)
    # all diagonals of a pair in one row, so that a text is tokenised once for each item it meets, however often they meet
    wanted = diagonals.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "item").agg(F.collect_list("shift").alias("shifts"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    pairs = texts.join(small_or_shuffled(wanted, at_most=diagonals), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    # tokens are taken below the join with items: above it the optimiser would write them into the comparison of each token
    pairs = pairs.select("doc_id", "text_hash", "item", "shifts", token_hashes("text").alias("dh"))
    laid = pairs.join(small_or_shuffled(items), "item")
    width = F.least(F.size("ih"), F.lit(window))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda x, y: x + y)

    def judged(shift: Column) -> Column:
        same = F.transform("ih", lambda x, i: F.coalesce((F.when(i + shift >= 0, F.get("dh", i + shift)) == x).cast("int"), F.lit(0)))

        def of(s: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(1), F.size(s) - width + 1), lambda j: total(F.slice(s, j, width)))
            return F.struct(total(s).alias("matched"), (-F.greatest(shift, F.lit(0))).alias("_back"), F.array_max(sums).alias("best_window"), F.size(s).alias("item_tokens"))

        return F.get(F.transform(F.array(same), of), F.lit(0))  # ``same`` is worked out once and let go of

    accepted = F.filter(F.transform("shifts", judged), lambda x: x["best_window"] * 100 >= width * percent)
    checked = laid.select("doc_id", "text_hash", "item_id", F.array_max(accepted).alias("_one")).where("_one is not null")
    chosen = checked.groupBy("doc_id", "text_hash", "item_id").agg(F.max("_one").alias("_best"))
    return chosen.select("doc_id", "text_hash", "item_id", (-F.col("_best._back")).cast("int").alias("doc_start"), "_best.item_tokens", "_best.matched", "_best.best_window")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that share no passage with the benchmark, with their columns."""
    return without(docs, contaminated(docs, benchmark))


def op6(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark).drop("text_hash")


def oracle_sql() -> str:
    """The same pairs by laying every document against every item on all diagonals with enough equal tokens; it knows nothing of masks."""
    scripts = "".join(rf"\p{{{s}}}" for s in UNSPACED)
    tokens = f"list_filter(regexp_split_to_array(regexp_replace(lower(text), '([{scripts}])', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
WITH d AS (SELECT doc_id, {tokens} AS w FROM documents), i AS (SELECT DISTINCT item_id, {tokens} AS w FROM benchmark),
dt AS (SELECT doc_id, len(w)::INT AS doc_tokens, unnest(w) AS t, unnest(range(len(w)))::INT AS p FROM d),
it AS (SELECT item_id, len(w)::INT AS item_tokens, unnest(w) AS t, unnest(range(len(w)))::INT AS p FROM i),
g AS (
  SELECT doc_id, item_id, dt.p - it.p AS shift, any_value(item_tokens) AS item_tokens, any_value(doc_tokens) AS doc_tokens, list_sort(list(it.p)) AS ps
  FROM dt JOIN it ON dt.t = it.t GROUP BY ALL HAVING count(*) * 100 >= least(any_value(item_tokens), {WINDOW}) * {PERCENT}),
v AS (
  SELECT *, least(item_tokens, {WINDOW}) AS width,
         list_max(list_transform(range(item_tokens - least(item_tokens, {WINDOW}) + 1), lambda j: len(list_filter(ps, lambda p: p >= j AND p < j + least(item_tokens, {WINDOW})))))::INT AS best_window
  FROM g),
k AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY len(ps) DESC, greatest(shift, 0), best_window DESC) AS n
  FROM v WHERE best_window * 100 >= width * {PERCENT})
SELECT doc_id, item_id, greatest(shift, 0)::INT AS doc_start, item_tokens, len(ps)::INT AS matched, best_window FROM k WHERE n = 1
"""
