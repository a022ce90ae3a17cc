"""Integer vectors dealt into shards that a task can hold, and the queries that pass through each shard."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import shuffle_partitions

WIDEST = (1 << 63) - 1


def integers(vectors: DataFrame, scale: int, *others: Column) -> DataFrame:
    """vec_id, n (length), v (array<bigint> of floor(scale * x)) and other columns; rows without vec_id, with a null vector or with null or
    non-finite components are left out. Components beyond 64 bits become the nearest 64-bit integer."""
    ok = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    v = F.expr(f"transform(embedding, x -> cast(floor({scale} * cast(x as double)) as bigint))")
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("n"), v.alias("v"), *others)


def told_apart() -> list[Column]:
    """h1 and h2: 96 bits of hash that tell the vectors of one id apart."""
    return [F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")]


def search_shards(rows: DataFrame, queries: DataFrame, search: Callable, schema: str, shard_bytes: int, least_rows: int = 4096) -> DataFrame:
    """Bring every query row to every shard of the candidates of its length n and run `search(candidates, queries)` there.

    rows: n and other columns; queries: n and other columns. Both reach `search` as pandas frames, the candidates of a shard
    once, the queries in batches; it gives frames of `schema`. A shard has about `shard_bytes` of components, or fewer if that
    keeps all tasks busy with `least_rows` each. Candidates are shuffled once.
    """
    spark = rows.sparkSession
    total, size = rows.agg(F.count("*"), F.sum(F.col("n") * 8)).first()
    shards = max(math.ceil((size or 0) / shard_bytes), min(shuffle_partitions(spark), math.ceil(total / least_rows)), 1)
    own, asked = [c for c in rows.columns if c != "n"], [c for c in queries.columns if c != "n"]
    # the number of the input's partition spreads rows that are all alike
    spread = F.pmod(F.xxhash64(*own, F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    # zeros, as nulls would turn integers to doubles on the way to pandas
    none = lambda df, c: F.lit(0 if isinstance(df.schema[c].dataType, NumericType) else None).cast(df.schema[c].dataType)
    left = rows.select("n", spread.alias("shard"), F.lit(False).alias("query"), *[F.col(c).alias(f"r_{c}") for c in own], *[none(queries, c).alias(f"q_{c}") for c in asked])
    right = queries.select("n", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), *[none(rows, c).alias(f"r_{c}") for c in own], *[F.col(c).alias(f"q_{c}") for c in asked])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, shard = [], None
        for pdf in batches:
            query = pdf["query"].to_numpy(bool)
            if not query.all():
                parts.append({c: _column(pdf[f"r_{c}"][~query], c == "v") for c in own})
            if query.any() and parts:
                if shard is None:
                    shard = {c: np.concatenate([p[c] for p in parts]) for c in own}
                asked_here = {c: pdf[f"q_{c}"][query].reset_index(drop=True) for c in asked}
                yield from search(shard, asked_here)

    # sorted within a shard: its candidates come before the queries
    # more partitions than shards, so that few shards share one
    dealt = left.union(right).repartition(max(4 * shards, shuffle_partitions(spark)), "n", "shard").sortWithinPartitions("n", "shard", "query")
    return dealt.groupBy("n", "shard").applyInPandas(task, schema)


def _column(values: pd.Series, narrow: bool) -> np.ndarray:
    """Arrays become the rows of a matrix, in 32 bits where asked and enough."""
    if values.dtype != object or not len(values) or not isinstance(values.iloc[0], np.ndarray):
        return values.to_numpy()
    out = np.stack(values.to_numpy())
    if narrow and out.size and -(1 << 31) < out.min() and out.max() < 1 << 31:
        return out.astype(np.int32)
    return out


def exact_kind(most: float, widest: float, length: int) -> type:
    """In which numbers inner products of so large components are exact."""
    largest = most * widest * max(length, 1)
    return np.float64 if largest < 2**52 else np.int64 if largest < 2**62 else object


def products(vectors: np.ndarray, q: np.ndarray, most: float | None = None) -> np.ndarray:
    """Inner products in 64-bit integers; what is beyond 64 bits counts as the nearest integer of 64 bits. most: the largest component, if known."""
    kind = exact_kind(_widest(vectors) if most is None else most, _widest(q), len(q))
    out = vectors.astype(kind) @ q.astype(kind) if len(q) else np.zeros(len(vectors), kind)
    if kind is object:
        out = np.clip(out, -WIDEST - 1, WIDEST)
    return np.array(out.tolist() if kind is object else out).astype(np.int64)


def _widest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(float)).max(initial=0))


def best_without_own(found: DataFrame, keys: list[str], own_id: str, own_score: str, k: int) -> DataFrame:
    """The k best rows (vec_id, score) of each query, with their rank, leaving out one that equals the query's own id and score: rows of
    equal id and score cannot be told apart in the result, so it does not matter which of them is the query itself."""
    group = Window.partitionBy(*keys)
    out = found.withColumn("at", F.row_number().over(group.orderBy(F.desc("score"), "vec_id"))).where(F.col("at") <= k + 1)
    own = F.min(F.when((F.col("vec_id") == F.col(own_id)) & (F.col("score") == F.col(own_score)), F.col("at"))).over(group)
    out = out.withColumn("own", F.coalesce(own, F.lit(k + 2))).where("at <> own")
    return out.withColumn("rank", F.col("at") - F.when(F.col("own") < F.col("at"), 1).otherwise(0)).where(F.col("rank") <= k).drop("at", "own")
