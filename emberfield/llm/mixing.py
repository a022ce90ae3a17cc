"""Mixing sources to target weights without sorting: thresholds on a hash of each document.

Documents get a 60-bit position from a hash of their id and text. Tokens are summed by source and
the leading 12 bits; from these sums follows the bucket in which the source's budget
ends. Only that bucket is summed again by its next 12 bits, and so on, until the
last position to take is known. Thresholds are nested: a larger budget takes the same
documents and more. Budgets above the source's size take every document once, and the
excess by threshold a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CHARS, durable, forget, join_small

BITS, LEVELS = 12, 5


def source_key() -> Column:
    """The source, told apart from null and sorted before it."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))


def position(salt: str = "") -> Column:
    # with the text, so that many rows of one id, or of none, are not one block
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(salt), text).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, salt: str = "") -> DataFrame:
    """doc_id, key (of the source), size in words, and position of every document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_CHARS)), F.lit(0)).cast("long")
    return docs.select("doc_id", source_key().alias("key"), size.alias("size"), position(salt).alias("position"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """key, source_size, target for each source.

    Sources in code point order, null last, have the weights in turn. `percent` of all sizes is shared by
    weight; a source stops at `most` times its size and the excess is shared again. In
    order of size by weight the sources that stop come first, so the level that the others
    reach is found with running sums. The table has one row a source.
    """
    by = sizes.groupBy("key").agg(F.sum("size").cast("double").alias("source_size"))
    order = Window.orderBy("key")
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("double"))
    full = Window.orderBy(F.col("source_size") / F.col("weight"), "key")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    by = by.withColumn("budget", F.sum("source_size").over(everything) * percent / 100)
    by = by.withColumn("level", (F.col("budget") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    by = by.withColumn("reached", F.min(F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.struct(F.col("source_size") / F.col("weight"), F.col("key"), F.col("level")))).over(everything))
    target = F.when(F.col("reached").isNull(), most * F.col("source_size")).otherwise(F.least(F.col("reached")["level"] * F.col("weight"), most * F.col("source_size")))
    return by.select("key", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """key, source_size, target, base (whole copies of the source), last (the last position taken once more).

    A position is taken once more if half of its documents' words fit in what is left of the budget,
    so each source ends within half a document of its target.
    """
    shift = BITS * (LEVELS - 1)
    base = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    state = durable(goals.withColumn("base", base.cast("int")).withColumn("left", F.col("target") - F.col("base") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")))
    rows, scratch_rows = sizes.select("key", "size", "position"), []
    for level in range(LEVELS):
        at = shift - BITS * level
        sums = rows.groupBy("key", F.shiftright("position", at).alias("bucket")).agg(F.sum("size").alias("n"))
        running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = join_small(sums.withColumn("end", F.sum("n").over(running)), state.select("key", "left"), "key")
        # the first bucket that does not fit as a whole; on the last level, as a half
        over = 2 * F.col("end") - F.col("n") > 2 * F.col("left") if level == LEVELS - 1 else F.col("end") > F.col("left")
        edge = sums.where(over).groupBy("key").agg(F.min(F.struct("bucket", (F.col("end") - F.col("n")).alias("before"))).alias("edge"))
        met = join_small(state, edge, "key", "left")
        # nothing is over: all of the rest fits, and no bucket is left to look into
        prefix = F.when(F.col("edge").isNull(), F.shiftleft(F.shiftright("prefix", at) + (1 << BITS) if level else F.lit(1 << BITS).cast("long"), at)).otherwise(F.shiftleft(F.col("edge")["bucket"], at))
        then = durable(met.select("key", "source_size", "target", "base", (F.col("left") - F.coalesce(F.col("edge")["before"], F.lit(0))).alias("left"), prefix.alias("prefix"), F.col("edge").isNotNull().alias("open")))
        forget(state)
        state = then
        if level < LEVELS - 1:
            rows = join_small(rows, state.where("open").select("key", F.col("prefix").alias("edge_prefix")), "key")
            inner = durable(rows.where(F.shiftright("position", at) == F.shiftright("edge_prefix", at)).select("key", "size", "position"))
            forget(*scratch_rows)
            rows, scratch_rows = inner, [inner]
    forget(*scratch_rows)
    return state.select("key", "source_size", "target", "base", (F.col("prefix") - 1).alias("last"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, salt: str = "") -> DataFrame:
    """How often the mix takes each document.

    docs: doc_id, text, source; other columns are ignored. Returns one row for each row: doc_id,
    size, source_size, target, taken (words), copies. A null text has size 0 and takes no words; a null
    source is a source of its own. Rows with equal doc_id and text have one position and are taken alike. Where exactly half of a
    position's words fit, it is taken. Texts are read whole, however long. An empty table gives an empty table.
    """
    sizes = durable(sized(docs, salt))
    goals = durable(targets(sizes, weights, percent, most))
    limits = thresholds(sizes, goals)
    forget(goals)
    out = join_small(sizes, limits, "key")
    copies = F.least(F.col("base") + (F.col("position") <= F.col("last")).cast("int"), F.lit(most)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, salt: str = "") -> DataFrame:
    """The mix itself: every document as often as the mix takes it, with the columns of docs, whatever their names.

    docs: doc_id, text, source and any others. Nulls, repeated rows, ties and empty tables: as in mix(). Documents of which the
    mix takes no copy are left out. Texts are read whole, however long, and not shuffled.
    """
    sizes = durable(sized(docs, salt))
    goals = durable(targets(sizes, weights, percent, most))
    limits = thresholds(sizes, goals)
    forget(sizes, goals)
    rows = docs.select(F.struct("*").alias("row"), source_key().alias("key"), position(salt).alias("position"))
    out = join_small(rows, limits.select("key", "base", "last"), "key")
    copies = F.least(F.col("base") + (F.col("position") <= F.col("last")).cast("int"), F.lit(most))
    return out.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


ORACLE = """
WITH s AS (
  SELECT doc_id, coalesce('=' || source, '~') AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS position
  FROM documents),
g AS (SELECT key, CAST(sum(size) AS DOUBLE) AS source_size, row_number() OVER (ORDER BY key) - 1 AS i FROM s GROUP BY key),
w AS (SELECT key, source_size, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             sum(source_size) OVER () * 150 / 100 AS budget FROM g),
l AS (SELECT *, (budget - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY source_size / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
r AS (SELECT *, (SELECT arg_min(level, (source_size / weight, key)) FROM l WHERE level * weight <= 2 * source_size) AS reached FROM l),
t AS (SELECT key, CAST(source_size AS BIGINT) AS source_size,
             CASE WHEN reached IS NULL THEN 2 * source_size ELSE least(reached * weight, 2 * source_size) END AS target FROM r),
b AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS base FROM t),
c AS (SELECT s.doc_id, s.size, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS rest,
             sum(s.size) OVER (PARTITION BY s.key ORDER BY s.position RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             sum(s.size) OVER (PARTITION BY s.key, s.position) AS unit
      FROM s JOIN b USING (key))
SELECT doc_id, size, source_size, target,
       CAST(size * least(base + CASE WHEN 2 * cum - unit <= 2 * rest THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken,
       CAST(least(base + CASE WHEN 2 * cum - unit <= 2 * rest THEN 1 ELSE 0 END, 2) AS BIGINT) AS copies
FROM c
"""
