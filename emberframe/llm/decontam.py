"""Benchmark decontamination by spaced-seed hashing (DataFrame functions only).

A text's tokens are its lower-cased runs of letters and digits.  A mask picks
some positions of a stretch of tokens and ignores the others; training and test
positions whose picked tokens hash alike are joined, which gives hits (document,
item, diagonal).  Around every hit the two token sequences are laid along the
diagonal: an overlap counts if some stretch of ``WINDOW`` tokens of the item has
at most ``MISMATCHES`` substitutions.  The mask was chosen so that each such
stretch holds at least one hit, whichever tokens are substituted (a test tries
all patterns), so the result is exact for this definition.

An item shorter than that is found whole and unchanged, by the hash of its first
``LEAST`` tokens; with fewer than ``LEAST`` it tells nothing and takes no part.

Defined cases: null or empty texts and items take no part; rows with the same doc_id are told apart by their text and
reported once; ties between stretches go to the first one; other columns play
no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import fresh_names, text_key

WINDOW = 13
MISMATCHES = 2
#: Tokens that a shorter item needs at least.
LEAST = 5
#: Token positions that the seed looks at; position 2, 4 and 5 may hold anything.
MASKS = ((0, 1, 3, 6, 7),)
#: Largest number of benchmark seeds that is broadcast (32 bytes each); beyond it the hits come from a shuffled join.
BROADCAST_SEEDS = 500_000


def tokens(column: Column) -> Column:
    """Hashes of the lower-cased letter and digit runs; null and empty give an empty array."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(plain, " "), lambda w: F.xxhash64(w)))


def seeds(words: Column) -> Column:
    """Array of (position, hash) of every mask at every position where a whole window fits around it."""
    def of(nth: int, mask: tuple[int, ...]) -> Column:
        at = F.sequence(F.lit(0), F.size(words) - mask[-1] - 1)
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(nth), *(F.get(words, i + off) for off in mask)).alias("seed")))

    per_mask = [of(nth, mask) for nth, mask in enumerate(MASKS)]
    return F.when(F.size(words) >= WINDOW, F.concat(*per_mask)).otherwise(F.array().cast("array<struct<at:int,seed:bigint>>"))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _best(doc: Column, item: str, diagonal: str) -> Column:
    """(matches, minus first item position) of the best window along a diagonal; null if no window fits."""
    first = F.greatest(F.lit(0), -F.col(diagonal))

    def over(words: Column) -> Column:
        length = F.least(F.size(item), F.size(words) - F.col(diagonal)) - first
        same = F.zip_with(F.slice(item, first + 1, length), F.slice(words, first + F.col(diagonal) + 1, length), lambda a, b: F.when(a == b, 1).otherwise(0))
        sums = lambda s: F.transform(
            F.sequence(F.lit(0), F.size(s) - WINDOW),
            lambda i: F.struct(F.aggregate(F.slice(s, i + 1, WINDOW), F.lit(0), lambda t, x: t + x).alias("matched"), (-(i + first)).alias("at")),
        )
        return F.when(length >= WINDOW, _once(same, lambda s: F.array_max(sums(s))))

    return _once(doc, over)


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Verified overlaps: doc_id, text_key, item_id, matched, doc_at, item_at (token positions), best one per document and item."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("item")).where(F.size("item") >= WINDOW).distinct()
    item_seeds = items.select("item_id", F.explode(seeds(F.col("item"))).alias("s")).select("item_id", F.col("s.at").alias("item_at"), F.col("s.seed").alias("seed"))
    words = docs.select("doc_id", text_key().alias("text_key"), tokens(F.col("text")).alias("doc"))
    # explode_outer: explode would add a filter that computes all seeds a second time
    doc_seeds = words.select("doc_id", "text_key", F.explode_outer(seeds(F.col("doc"))).alias("s")).select("doc_id", "text_key", F.col("s.at").alias("doc_at"), F.col("s.seed").alias("seed"))
    small = item_seeds.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    hits = doc_seeds.join(F.broadcast(item_seeds) if small else item_seeds, "seed")
    lines = hits.select("doc_id", "text_key", "item_id", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).distinct()
    near = lines.join(F.broadcast(items) if small else items, "item_id")
    near = near.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), "item_id", "diagonal", "item")
    texts = docs.select("doc_id", "text", text_key().alias("text_key"))
    laid = texts.join(near, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text")))
    best = laid.select("doc_id", "text_key", "item_id", "diagonal", _best(tokens(F.col("text")), "item", "diagonal").alias("best"))
    found = best.groupBy("doc_id", "text_key", "item_id").agg(
        F.max(F.struct(F.col("best.matched").alias("matched"), (F.col("best.at") - F.col("diagonal")).alias("at"), F.col("best.at").alias("item_at"))).alias("b")
    )
    found = found.where(F.col("b.matched") >= WINDOW - MISMATCHES)
    found = found.select("doc_id", "text_key", "item_id", F.col("b.matched").alias("matched"), (-F.col("b.at")).alias("doc_at"), (-F.col("b.item_at")).alias("item_at"))
    short = benchmark.select("item_id", tokens(F.col("text")).alias("item")).where(F.size("item").between(LEAST, WINDOW - 1)).distinct()
    n = short.count()
    return found.unionByName(_whole(docs, short, n <= broadcast_seeds)) if n else found


def _whole(docs: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """Where a text holds all tokens of a short item in a row, the first such place."""
    first = lambda words, i: F.xxhash64(*(F.get(words, i + k) for k in range(LEAST)))
    keyed = items.withColumn("seed", first(F.col("item"), F.lit(0)))
    words = docs.select("doc_id", text_key().alias("text_key"), tokens(F.col("text")).alias("doc"))
    at = F.when(F.size("doc") >= LEAST, F.sequence(F.lit(0), F.size("doc") - LEAST))
    spots = words.select("doc_id", "text_key", F.explode(F.transform(at, lambda i: F.struct(i.alias("at"), first(F.col("doc"), i).alias("seed")))).alias("s"))
    hits = spots.select("doc_id", "text_key", F.col("s.at").alias("at"), F.col("s.seed").alias("seed")).join(F.broadcast(keyed) if small else keyed, "seed").drop("seed")
    texts = docs.select(F.col("doc_id").alias("_id"), text_key().alias("_text"), "text").distinct()
    laid = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text")))
    same = laid.where(F.slice(tokens(F.col("text")), F.col("at") + 1, F.size("item")) == F.col("item"))
    return same.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.size("item")).alias("matched"), F.min("at").alias("doc_at"), F.lit(0).alias("item_at"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a verified overlap, with all their columns."""
    key, id_, text = fresh_names(docs, "key", "id", "text")
    bad = overlaps(docs, benchmark, **options).select(F.col("doc_id").alias(id_), F.col("text_key").alias(text)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(text))
    return docs.withColumn(key, text_key()).join(bad, same, "left_anti").select(*docs.columns)


#: Every diagonal that shares four adjacent tokens is laid out in full: a window of 13 with two substitutions always has four in a row.
ORACLE = f"""
WITH doc_words AS (
  SELECT doc_id, string_split(w, ' ') AS doc FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS w FROM documents WHERE text IS NOT NULL)
), item_words AS (
  SELECT item_id, string_split(w, ' ') AS item FROM (SELECT item_id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS w FROM benchmark WHERE text IS NOT NULL)
), doc_grams AS (
  SELECT doc_id, i, doc[i] || ' ' || doc[i + 1] || ' ' || doc[i + 2] || ' ' || doc[i + 3] AS gram FROM (SELECT *, unnest(range(1, len(doc) - 2)) AS i FROM doc_words WHERE len(doc) >= {WINDOW})
), item_grams AS (
  SELECT item_id, i, item[i] || ' ' || item[i + 1] || ' ' || item[i + 2] || ' ' || item[i + 3] AS gram FROM (SELECT *, unnest(range(1, len(item) - 2)) AS i FROM item_words WHERE len(item) >= {WINDOW})
), lines AS (
  SELECT DISTINCT d.doc_id, b.item_id, d.i - b.i AS diagonal FROM doc_grams d JOIN item_grams b USING (gram)
), laid AS (
  SELECT doc_id, item_id, diagonal, unnest(range(1, len(item) - {WINDOW} + 2)) AS j, doc, item
  FROM lines JOIN doc_words USING (doc_id) JOIN item_words USING (item_id)
), counted AS (
  SELECT doc_id, item_id, diagonal, j,
         list_sum([CASE WHEN doc[j + k + diagonal] = item[j + k] THEN 1 ELSE 0 END FOR k IN range(0, {WINDOW})]) AS matched
  FROM laid WHERE j + diagonal >= 1 AND j + diagonal + {WINDOW} - 1 <= len(doc)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, j + diagonal, j) AS nth FROM counted WHERE matched >= {WINDOW - MISMATCHES}
)
SELECT doc_id, item_id, matched::INTEGER AS matched, (j + diagonal - 1)::INTEGER AS doc_at, (j - 1)::INTEGER AS item_at FROM ranked WHERE nth = 1
UNION ALL
SELECT doc_id, item_id, len(item)::INTEGER, min(i - 1)::INTEGER, 0 FROM (
  SELECT d.*, b.*, unnest(range(1, len(doc) - len(item) + 2)) AS i FROM doc_words d, (SELECT DISTINCT item_id, item FROM item_words WHERE len(item) BETWEEN {LEAST} AND {WINDOW - 1}) b WHERE len(doc) >= len(item)
) WHERE doc[i:i + len(item) - 1] = item GROUP BY doc_id, item_id, item
"""
