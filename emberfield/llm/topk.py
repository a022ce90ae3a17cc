"""Exact top-k inner products by MaxScore.

A vector is a bag of weighted terms: component d is a posting (d, weight). Vectors are dealt into shards, and a shard is kept as
posting lists. The terms of a query are taken from the heaviest on, and two bounds say what the terms after a
point can add together: the sum of their largest additions, and the length of that part of the query times the length that a vector has left.
Terms before the point where the bound of the rest falls to the k-th best score are essential: their postings are traversed.
Only vectors that are still competitive are probed for the others, some terms at a time. The k-th score starts from a sample of
all vectors that is sent with the query, and rises early, as the most promising vectors are completed first. Shards' lists are
merged by rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shards import best_without_own, exact_kind, integers, products, search_shards, told_apart


class Shard:
    """Posting lists of the vectors of one length. `products` counts the products of weights that searches have made."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.products = ids, 0
        self.most = float(np.abs(vectors.astype(float)).max(initial=0))
        # doubles hold the weights exactly unless they are very large
        self.kinds = {np.float64 if self.most < 2**53 else np.int64: np.ascontiguousarray(vectors.T).astype(np.float64 if self.most < 2**53 else np.int64)}
        base = next(iter(self.kinds.values()))
        self.high, self.low = (base.max(1, initial=0), base.min(1, initial=0)) if base.size else (np.zeros(len(base)), np.zeros(len(base)))
        self.square = np.zeros(len(ids))
        for row in base:
            self.square += row.astype(float) ** 2

    def _postings(self, kind: type) -> np.ndarray:
        if kind not in self.kinds:
            self.kinds[kind] = next(iter(self.kinds.values())).astype(kind)
        return self.kinds[kind]

    def search(self, q: np.ndarray, k: int, floor: float = -math.inf, steps: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best for one query, ties to the smaller id; of those below `floor` any may be missing. Exact: products
        too large for doubles, or for 64 bits, are made in integers, or in Python's; a score beyond 64 bits counts as the nearest of 64 bits."""
        widest = float(np.abs(q.astype(float)).max(initial=0))
        kind = exact_kind(self.most, widest, len(q))
        if kind is object or not len(q):
            score = products(self._postings(np.int64 if np.int64 in self.kinds else np.float64).T.astype(object if kind is object else np.int64), q)
            self.products += len(q) * len(self.ids)
            return self._best(np.arange(len(self.ids)), score, k)
        postings, q = self._postings(kind), q.astype(kind)
        adds = np.maximum(q * self.high.astype(float), q * self.low.astype(float))
        terms = np.argsort(-np.abs(q), kind="stable")
        rest = np.append(np.cumsum(adds[terms][::-1])[::-1], 0)
        length = np.append(np.cumsum(q[terms].astype(float)[::-1] ** 2)[::-1], 0)  # squares of the query from each term on
        slack = 1e-9 * math.sqrt(length[0] * self.square.max(initial=0)) + 1e-9
        at, score, square, all_rows = np.arange(len(self.ids)), np.zeros(len(self.ids), kind), self.square, True
        step, raise_at = -(-len(q) // steps), [0.4, 0.15]
        for a in range(0, len(q), step):
            b = min(a + step, len(q))
            part = terms[a:b]
            score = score + q[part] @ (postings[part] if all_rows else postings[np.ix_(part, at)])
            self.products += len(part) * len(at)
            if raise_at and length[b] <= raise_at[0] * length[0] and k < len(at):
                raise_at.pop(0)
                ahead = np.argpartition(-score, k - 1)[: 2 * k]
                whole = score[ahead] + q[terms[b:]] @ postings[np.ix_(terms[b:], at[ahead])]
                self.products += (len(q) - b) * len(ahead)
                floor = max(floor, float(np.partition(whole, -k)[-k]))
            if b < len(q) and floor > -math.inf:
                so_far = score.astype(float)
                # a vector whose first terms have given so much has no more length left than this
                left = np.sqrt(length[b] * np.maximum(square - so_far**2 / max(length[0] - length[b], 1e-300), 0))
                keep = so_far + np.minimum(left + slack, rest[b]) >= floor
                if len(keep) and keep.mean() < 0.97:
                    at, score, square, all_rows = at[keep], score[keep], square[keep], False
        return self._best(at, score.astype(np.int64), k)

    def _best(self, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[at], ~score))[:k]  # ~ turns the order round and has no overflow
        return self.ids[at][order], score[order]


def with_floors(queries: DataFrame, rows: DataFrame, total: int, k: int, sample_rows: int, sample_bytes: int) -> DataFrame:
    """Adds `floor`, the k-th best score among a sample of the rows, at most about `sample_rows` of them or `sample_bytes` of components and a sixteenth of all."""
    size = rows.agg(F.sum(F.col("n") * 8)).first()[0] or 0
    share = min(1 / 16, sample_rows / max(total, 1), sample_bytes / max(size, 1))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(8)), F.lit(1 << 30)) < int(share * (1 << 30))).select("n", "v").toPandas()
    sample = {n: np.stack(g["v"].to_numpy()) for n, g in picked.groupby("n")}

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            floors = []
            for n, v in zip(pdf["n"], pdf["v"], strict=True):
                score = products(sample[n], np.asarray(v, np.int64)) if n in sample else []
                floors.append(float(np.partition(score, -k)[-k]) if len(score) >= k else -math.inf)
            yield pdf.assign(floor=floors)

    schema = StructType([*queries.schema.fields, StructField("floor", DoubleType())])
    return queries.mapInPandas(task, schema)


def top_k(vectors: DataFrame, k: int = 10, modulus: int = 100, scale: int = 1024, shard_bytes: int = 64 << 20, sample_rows: int = 2048, sample_bytes: int = 16 << 20) -> DataFrame:
    """The k best vectors, by integer inner product, for each row whose vec_id is divisible by `modulus`.

    vectors: vec_id and embedding; other columns are ignored. Returns query_id, rank (from 1), vec_id, score, ties
    to the smaller vec_id. Rows left out by integers() take no part. Rows that repeat a vec_id are queries and candidates
    of their own: only the row itself is no candidate of its query, and a query_id has as many lists as rows.
    Vectors of another length than the query have no product with it and are no candidates. Scores beyond 64 bits count
    as the nearest 64-bit integer. An empty table gives an empty table.
    A task holds one shard of vectors, `shard_bytes` or so; queries pass through it in batches. Vectors are shuffled once, queries to
    every shard.
    """
    rows = integers(vectors, scale)
    total = rows.count()
    key = ["query_id", "h1", "h2"]
    asked = rows.where(F.col("vec_id") % modulus == 0).groupBy("n", F.col("vec_id").alias("query_id"), "v").agg(F.count("*").alias("copies"))
    asked = with_floors(asked.select("n", "query_id", "v", "copies", *told_apart()), rows, total, k + 1, sample_rows, sample_bytes)

    def search(shard: dict, asked: dict) -> Iterator[pd.DataFrame]:
        # the lists are kept from batch to batch
        held = shard.get("held") or Shard(shard["vec_id"], shard.pop("v"))
        shard["held"] = held
        queries = [np.asarray(v, np.int64) for v in asked["v"]]
        found = [held.search(q, k + 1, floor) for q, floor in zip(queries, asked["floor"], strict=True)]
        sizes = [len(i) for i, _ in found]
        frame = pd.DataFrame({c: np.repeat(asked[c].to_numpy(), sizes) for c in [*key, "copies"]})
        own = np.array([products(q[None], q)[0] for q in queries], np.int64)
        yield frame.assign(own=np.repeat(own, sizes), vec_id=np.concatenate([i for i, _ in found]), score=np.concatenate([s for _, s in found]))

    found = search_shards(rows, asked, search, "query_id long, h1 long, h2 int, copies long, own long, vec_id long, score long", shard_bytes)
    best = best_without_own(found, key, "query_id", "own", k)
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.i AS q, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.i <> c.i AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
