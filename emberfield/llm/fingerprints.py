"""Homomorphic multiset hashes of documents.

A paragraph (a line) is hashed to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors, each lane modulo 2^62. Sums don't depend on order, and a paragraph is
inserted or deleted by adding or subtracting its vector. Two groups of lanes:

* identity: four independent hashes of the paragraph;
* likeness: the number of pairs of neighbouring words, and how many of them fall into each of 64 hash buckets, two
  counts of 31 bits a lane. The counts, centred, are a random projection of the multiset of pairs, so their cosine
  estimates how alike two documents are. A text has fewer than 2^30 pairs, so no count overflows.

An edit that replaces the end of a text leaves its first paragraphs alone: the edited fingerprint is the sum of their
vector and that of the new last paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

BUCKETS, WIDTH, IDENTITY = 64, 31, 4
MASK = (1 << 2 * WIDTH) - 1


def with_vector(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the vector of a text column: array<long> of identity lanes, number of pairs, likeness lanes."""
    df = df.withColumn("_lines", F.expr(rf"filter(transform(split({text}, '\n'), l -> trim(l)), l -> l <> '')"))
    df = df.withColumn("_words", F.expr("transform(_lines, l -> split(l, '[\\\\x20\\\\x09-\\\\x0D]+'))"))
    bucket = f"cast(xxhash64({{}}) & {BUCKETS - 1}L as int)"
    pair = f"flatten(transform(_words, w -> if(size(w) = 1, array({bucket.format('w[0]')}), transform(slice(w, 2, size(w) - 1), (y, i) -> {bucket.format('w[i], y')}))))"
    # sorted, with one mark for each bucket before its pairs: a count is the distance of two marks
    df = df.withColumn("_sorted", F.expr(f"sort_array(concat(sequence(0, {BUCKETS - 1}), {pair}))"))
    df = df.withColumn("_at", F.array(*[F.array_position("_sorted", F.lit(k)) for k in range(BUCKETS)], F.size("_sorted") + F.lit(1).cast("long")))
    count = [F.col("_at")[k + 1] - F.col("_at")[k] - 1 for k in range(BUCKETS)]
    lanes = [F.expr(f"aggregate(_lines, 0L, (s, x) -> (s + (xxhash64(x, {seed}) & {MASK}L)) & {MASK}L)") for seed in range(IDENTITY)]
    lanes += [F.col("_at")[BUCKETS] - 1 - BUCKETS]
    lanes += [count[k] + F.shiftleft(count[k + 1], WIDTH) for k in range(0, BUCKETS, 2)]
    return df.withColumn(name, F.array(*lanes)).drop("_lines", "_words", "_sorted", "_at")


def add(a: str, b: str, sign: int = 1) -> Column:
    """The vector of the union (sign 1) or the difference (-1) of two multisets of paragraphs."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(MASK))


def text_of(vector: str) -> Column:
    """A vector as a hexadecimal string of fixed width."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def product(a: str, b: str) -> Column:
    """The inner product of two vectors' counts, each less its mean."""
    low = (1 << WIDTH) - 1
    lanes = f"zip_with(slice({{0}}, {IDENTITY + 2}, {BUCKETS // 2}), slice({{1}}, {IDENTITY + 2}, {BUCKETS // 2}), (x, y) -> double(x & {low}L) * (y & {low}L) + double(shiftright(x, {WIDTH})) * shiftright(y, {WIDTH}))"
    return F.expr(f"aggregate({lanes}, 0D, (s, x) -> s + x) - double({{0}}[{IDENTITY}]) * {{1}}[{IDENTITY}] / {BUCKETS}".format(a, b))


def likeness(a: str, b: str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 to 1: the cosine of two vectors' centred counts, 1 for equal vectors, 0 if only one has pairs.

    norm_a, norm_b: the products of a and of b with themselves, where they are at hand.
    """
    norm = F.sqrt((product(a, a) if norm_a is None else norm_a) * (product(b, b) if norm_b is None else norm_b))
    return F.when(F.col(a) == F.col(b), 1.0).when(norm == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), product(a, b) / norm)))


def _longs(values: list[int]) -> Column:
    """A constant array, as one literal whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _rank(bounds: list[int], key: str) -> Column:
    """How many of the ascending bounds are at most the key, by halving."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    array, n = _longs(bounds), len(bounds)
    least = lambda at: F.coalesce(F.try_element_at(array, at), F.lit((1 << 63) - 1))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when((lo + s <= n) & (least(lo + s) <= F.col(key)), lo + s).otherwise(lo))


def _starts(docs: DataFrame, ranges: int) -> list[int]:
    """The least key of each of about `ranges` ranges of like numbers of rows, ascending; every one is a key of the table."""
    cuts = docs.select("_key").approxQuantile("_key", [i / ranges for i in range(ranges)], 0.25 / ranges)
    bounds = sorted({min(int(x), (1 << 63) - 1) for x in cuts[1:]} | {-(1 << 63)})
    return sorted(r["first"] for r in docs.groupBy(_rank(bounds, "_key").alias("r")).agg(F.min("_key").alias("first")).collect())


def _ending(text: str, n_chars: str = "n_chars") -> tuple[Column, Column, Column]:
    """(whole paragraphs before the last quarter, the part of a paragraph that follows them, the last quarter)."""
    kept = F.expr(f"substring({text}, 1, cast({n_chars} - {n_chars} div 4 as int))")
    part = F.substring_index(kept, "\n", -1)
    return F.substring(kept, F.lit(1), F.length(kept) - F.length(part)), part, F.expr(f"substring({text}, cast({n_chars} - {n_chars} div 4 + 1 as int))")


def fingerprints(docs: DataFrame, bucket_chars: int = 128_000_000) -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    docs: doc_id and text; other columns are ignored. The next document is the next in ascending
    (doc_id, text), after the last the first; a null doc_id comes first, a null text is empty. With
    one row, the next document is the row itself; repeated rows follow each other. An empty table gives an empty table. A very long text is
    one row's work: its word pairs are one sorted array, some ten times its bytes, in one task.
    The table is cut into ranges of doc_id, whose bounds the driver holds as Spark's own range partitioning would; the rows
    at the start of a range are also read at the end of the range before, so neighbours meet in one shuffle. Rows that
    share a doc_id are sorted in one task.
    Returns one row for each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.expr("-9223372036854775807L - 1L"))).withColumn("n_chars", F.length("text").cast("long"))
    total = docs.agg(F.coalesce(F.sum("n_chars"), F.lit(0))).first()[0]
    starts = _starts(docs, max(4 * shuffle_partitions(docs.sparkSession), total // bucket_chars)) or [0]
    head, part, last = _ending("text")
    keyed = with_vector(docs.withColumn("_head", head).withColumn("_tail", F.concat(part, last)), "_head", "_before")
    keyed = with_vector(keyed, "_tail", "_after").withColumn("_vector", add("_before", "_after")).withColumn("_range", _rank(starts, "_key"))
    keyed = keyed.withColumn("_norm", product("_vector", "_vector"))
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("halo"))
    halo = F.struct(F.when(F.col("_range") == 1, len(starts)).otherwise(F.col("_range") - 1).alias("r"), F.lit(True).alias("halo"))
    dealt = keyed.withColumn("_place", F.explode(F.when(F.element_at(_longs(starts), F.col("_range")) == F.col("_key"), F.array(own, halo)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", "_key", "n_chars", "_vector", "_before", "_norm", "_place.r", "_place.halo")
    order = Window.partitionBy("r").orderBy("halo", "_key", "text")
    dealt = dealt.withColumn("_next", F.lead(F.struct("text", F.col("_vector").alias("v"), F.col("_norm").alias("n"))).over(order)).where("NOT halo")
    head, part, _ = _ending("text")
    out = dealt.select("doc_id", "n_chars", "_vector", "_before", "_norm", F.col("_next.v").alias("_next_vector"), F.col("_next.n").alias("_next_norm"), head.alias("_head"), F.concat(part, F.expr("substring(_next.text, 1, cast(n_chars div 4 as int))")).alias("_tail"))
    out = with_vector(out, "_tail", "_after").withColumn("_edited_vector", add("_before", "_after"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.concat("_head", "_tail").cast("binary"), 256).alias("edited_sha256"),
        text_of("_vector").alias("fingerprint"),
        text_of("_edited_vector").alias("edited_fingerprint"),
        likeness("_vector", "_edited_vector", F.col("_norm")).alias("near_edited"),
        likeness("_vector", "_next_vector", F.col("_norm"), F.col("_next_norm")).alias("near_next"),
    )
