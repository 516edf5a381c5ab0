"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Sources are ordered by code point, null last, and take the ``weights`` in turn.
They share ``share`` times all words in proportion to their weights; a source
stops at ``cap`` times its own size and the excess goes to the others by weight.
Every document of a source then expects ``target / source_size`` copies.  The
documents of a source stand in one fixed order (size class, block, size, doc_id,
text), the expected copies are summed along it, one offset drawn from the
source's name is added, and a document is emitted once for each integer
boundary that its stretch crosses.  Ordering by size class spreads the draw
evenly over long and short documents, so the words taken stay near the target.

The prefix sum is built from three levels of counts (size class, block, row),
so no task holds a whole source: a source with a third of all rows is spread by
hashed id over the blocks of each of its size classes, whose number grows with
the table.

Defined cases: null or empty text has size 0 and is taken with 0 words; null
source is a source of its own; a source without words has target 0 and no
copies; null doc_ids are told apart by their text; identical rows share their
copies in any order; an empty table gives an empty result; other columns play
no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberframe.llm.common import cut, fresh_names, text_key, WORD

#: Blocks that each size class of a source is dealt to: so many at least, and one for so many rows of the table.
BLOCKS, BLOCK_ROWS = 251, 65_536


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with ``target``; one row per source in and out.

    Water filling in closed form: in the order of cap / weight, the first level
    that no longer exceeds a source's own cap is the level of all after it.
    """
    if share > cap:
        raise ValueError("the sources can't give more than their caps")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "nth")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("nth", F.row_number().over(by_name)).select(
        "source",
        "source_size",
        "nth",
        F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).alias("weight"),
    )
    everything = Window.partitionBy(F.lit(0))
    levels = (
        ranked.withColumn("ratio", F.col("source_size") * F.lit(cap) / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(cap))
        .withColumn("spent", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.col("capped")) / (F.sum("weight").over(everything) - F.col("spent")))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth", "level"))).over(everything)["level"])
    )
    return levels.select("source", "source_size", F.least(F.col("source_size") * F.lit(cap), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def size_class(size: Column) -> Column:
    """Eight classes to the octave, in whole numbers: bit length and the three leading bits."""
    bits = F.length(F.bin(size))
    return (bits * 8 + F.call_function("shiftright", size, F.greatest(bits - 3, F.lit(0)))).cast("int")


def block_of(key: Column, blocks: int) -> Column:
    """A block by multiplicative hashing in whole numbers."""
    return F.pmod(F.call_function("shiftright", F.pmod(key, F.lit((1 << 31) - 1)) * F.lit(2654435761), F.lit(20)), F.lit(blocks)).cast("int")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, text_key, size, source_size, target, copies, taken."""
    base = cut(
        docs.select("doc_id", "source", text_key().alias("text_key"), word_count("text").alias("size"))
        .withColumn("class", size_class(F.col("size")))
    )
    blocks = max(BLOCKS, -(-base.count() // BLOCK_ROWS))
    base = base.withColumn("block", block_of(F.coalesce(F.col("doc_id").cast("long"), F.col("text_key")), blocks))
    counts = base.groupBy("source", "class", "block").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    classes = counts.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    classes = classes.withColumn("class_from", F.coalesce(F.sum("n").over(before(Window.partitionBy("source").orderBy("class"))), F.lit(0)))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 4), 16, 10).cast("double") / 65536.0
    rates = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("offset", offset)

    def on(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
        right = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
        same = None
        for k in keys:
            one = F.col(k).eqNullSafe(F.col(f"_{k}"))
            same = one if same is None else same & one
        return left.join(right, same, how).drop(*(f"_{k}" for k in keys))

    starts = counts.withColumn("block_from", F.coalesce(F.sum("n").over(before(Window.partitionBy("source", "class").orderBy("block"))), F.lit(0)))
    starts = on(starts.drop("n", "words"), on(classes.drop("n", "words"), rates, ("source",)), ("source", "class"))
    starts = starts.select("source", "class", "block", "source_size", "target", "rate", "offset", (F.col("class_from") + F.col("block_from")).alias("start"))
    order = Window.partitionBy("source", "class", "block").orderBy("size", "doc_id", "text_key")
    placed = on(base.withColumn("place", F.row_number().over(order) - 1), starts, ("source", "class", "block")).withColumn("place", F.col("place") + F.col("start"))
    crossed = F.floor(F.col("offset") + F.col("rate") * (F.col("place") + 1)) - F.floor(F.col("offset") + F.col("rate") * F.col("place"))
    copies = F.least(crossed, F.lit(int(cap))).cast("long")
    return placed.withColumn("copies", copies).select("doc_id", "source", "text_key", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all columns of ``docs``."""
    key, id_, of, text, rows, copies, own, copy = fresh_names(docs, "key", "id", "source", "text", "rows", "copies", "own", "copy")
    # identical rows are merged into one with the sum of their copies, so that the join doesn't multiply them
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias(id_), F.col("source").alias(of), F.col("text_key").alias(text)).agg(
        F.count("*").alias(rows), F.sum("copies").alias(copies)
    ).where(F.col(copies) > 0)
    keyed = docs.withColumn(key, text_key())
    joined = keyed.join(taken, F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(of)) & (F.col(key) == F.col(text)))
    alike = Window.partitionBy(id_, of, text).orderBy(F.lit(0))
    nth = F.when(F.col(rows) > 1, F.row_number().over(alike)).otherwise(1)
    share = F.floor(F.col(copies) * nth / F.col(rows)) - F.floor(F.col(copies) * (nth - 1) / F.col(rows))
    repeated = joined.withColumn(own, share.cast("int")).where(F.col(own) > 0)
    return repeated.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(own)))).select(*docs.columns)


ORACLE = f"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, (((doc_id % 2147483647 + 2147483647) % 2147483647 * 2654435761) >> 20) % (SELECT greatest({BLOCKS}, ceil(count(*) / {BLOCK_ROWS}))::BIGINT FROM documents) AS block FROM documents
), classed AS (
  SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS class FROM base
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM sizes
), weighed AS (
  SELECT *, [3, 1, 2][(nth - 1) % 3 + 1] AS weight FROM ranked
), ratios AS (
  SELECT *, source_size * 2.0::DOUBLE / weight AS ratio FROM weighed
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER w, 0) * 2.0::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM ratios WINDOW w AS (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, nth LIMIT 1
), targets AS (
  SELECT source, source_size, least(source_size * 2.0::DOUBLE, (SELECT level FROM chosen) * weight) AS target FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('7:' || coalesce(source, '')), 1, 4))::BIGINT / 65536.0::DOUBLE AS start FROM targets
), placed AS (
  SELECT c.*, r.source_size, r.target, r.rate, r.start,
         row_number() OVER (PARTITION BY c.source ORDER BY class, block, size, doc_id) - 1 AS place
  FROM classed c JOIN rates r ON c.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       size * least(floor(start + rate * (place + 1)) - floor(start + rate * place), 2)::BIGINT AS taken
FROM placed
"""
