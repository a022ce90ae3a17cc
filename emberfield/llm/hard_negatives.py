"""Hard negatives by rotated one-bit codes.

A vector is brought to unit length and rotated (sign flips and Hadamard transforms), and the signs of its components are its code. What the
code leaves over is rotated and coded again, a few times. Stored with each code are its alignment with what it codes, its inner product
with it, and the norm of the rest. A query is rotated alike and cut into bit planes, so that its inner product with a code is a sum of
popcounts. Alignments times these products estimate the score, and by Cauchy-Schwarz the rest adds no more than its norm
times the part of the query across the code: an interval that holds for certain. Candidates whose interval is out of reach go, code
after code; those that survive all codes are scored in integers.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, forget
from .shards import best_without_own, integers, products, search_shards, told_apart

CODES, PLANES = 6, 8


def widen(x: np.ndarray) -> np.ndarray:
    """Rows with zeros to a power of two of at least 64 components."""
    out = np.zeros((len(x), max(64, 1 << max(x.shape[1] - 1, 0).bit_length())))
    out[:, : x.shape[1]] = x
    return out


@functools.cache
def _flips(number: int, size: int) -> np.ndarray:
    return np.random.default_rng(20 + number).choice([-1.0, 1.0], (2, size))


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    """Rows after the rotation of this number."""
    out, size = x.copy(), x.shape[1]
    for flip in _flips(number, size):
        out *= flip / np.sqrt(size)
        half = 1
        while half < size:
            pair = out.reshape(len(x), -1, 2, half)
            pair[:, :, 0], pair[:, :, 1] = pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]
            half *= 2
    return out


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length one, their lengths before); a zero row stays zero."""
    x = x.astype(float)
    norm = np.sqrt((x * x).sum(1)) if x.size else np.zeros(len(x))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def encode(x: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as 64-bit words [row, code, word], alignments [row, code], norms of the rest [row, code]) of widened unit rows."""
    rest, size = x, x.shape[1]
    bits = np.zeros((len(x), codes, size // 64), np.uint64)
    aligned, left = np.zeros((len(x), codes)), np.zeros((len(x), codes))
    for k in range(codes):
        rest = rotate(rest, k)
        positive = rest > 0
        bits[:, k] = np.packbits(positive, axis=1, bitorder="little").view("<u8")
        aligned[:, k] = np.abs(rest).sum(1) / np.sqrt(size)
        rest -= np.where(positive, 1, -1) * (aligned[:, k] / np.sqrt(size))[:, None]
        left[:, k] = np.sqrt((rest * rest).sum(1))
    return bits, aligned, left


class Planes:
    """A rotated query, rounded to 2^PLANES levels, in bit planes; `error` is the norm of what rounding took away."""

    def __init__(self, low: float, step: float, total: float, error: float, size: int, planes: np.ndarray):
        self.low, self.step, self.sum, self.error, self.size, self.planes = low, step, total, error, size, planes

    @classmethod
    def of(cls, x: np.ndarray) -> list[Planes]:
        """One for each row."""
        low, high = x.min(1), x.max(1)
        step = (high - low) / ((1 << PLANES) - 1)
        step[step == 0] = 1.0
        level = np.rint((x - low[:, None]) / step[:, None]).astype(np.uint8)
        rounded = low[:, None] + step[:, None] * level
        error, total = np.sqrt(((x - rounded) ** 2).sum(1)), rounded.sum(1)
        planes = np.stack([np.packbits((level >> j) & 1, axis=1, bitorder="little").view("<u8") for j in range(PLANES)], axis=1)
        return [cls(*row, x.shape[1], bits) for *row, bits in zip(low, step, total, error, planes, strict=True)]

    def products(self, bits: list[np.ndarray]) -> np.ndarray:
        """Inner products of the rounded query with unit code vectors, given as columns of 64-bit words, by popcounts."""
        total, ones = np.zeros(len(bits[0]), np.uint32), np.zeros(len(bits[0]), np.uint32)
        for w, column in enumerate(bits):
            ones += np.bitwise_count(column)
            for j, plane in enumerate(self.planes):
                total += np.bitwise_count(column & plane[w]).astype(np.uint32) << np.uint32(j)
        return (2 * (self.low * ones + self.step * total) - self.sum) / np.sqrt(self.size)


class Query:
    """A query of length one under the rotations of all codes, and its length before."""

    def __init__(self, norm: float, codes: list[Planes]):
        self.norm, self.codes = norm, codes

    @classmethod
    def of(cls, rows: np.ndarray, codes: int = CODES) -> list[Query]:
        """One for each row; all are rotated together."""
        one, norm = unit(rows)
        x, planes = widen(one), []
        for k in range(codes):
            x = rotate(x, k)
            planes.append(Planes.of(x))
        return [cls(float(n), list(p)) for n, *p in zip(norm, *planes, strict=True)]


class Shard:
    """Coded vectors of one length. `scored` counts the inner products in integers, `met` the candidates that searches looked at."""

    def __init__(self, rows: dict[str, np.ndarray]):
        order = np.argsort(rows["label"], kind="stable")
        self.ids, self.labels, self.vectors = rows["vec_id"][order], rows["label"][order], rows["v"][order]
        words = rows["codes"][order].view(np.uint64)
        self.aligned, self.left, self.norm = rows["aligned"][order], rows["left"][order], rows["norm"][order]
        # [code][word][row], so that a search reads whole columns
        self.bits = np.ascontiguousarray(words.reshape(len(words), self.aligned.shape[1], -1).transpose(1, 2, 0))
        self.aligned, self.left = np.ascontiguousarray(self.aligned.T), np.ascontiguousarray(self.left.T)
        self.widest = float(np.abs(self.vectors.astype(float)).max(initial=0))
        self.scored = self.met = 0

    @classmethod
    def of(cls, rows: dict) -> Shard:
        """The shard of these rows, made once and kept with them from batch to batch."""
        if "held" not in rows:
            held = cls(rows)
            rows.clear()
            rows["held"] = held
        return rows["held"]

    def intervals(self, q: Query, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, lower, upper) after each code; send a mask to go on with a part of the rows."""
        estimate, rounding = np.zeros(len(at)), np.zeros(len(at))
        for k, planes in enumerate(q.codes):
            c = planes.products([column[at] for column in self.bits[k]])
            aligned = self.aligned[k][at]
            estimate, rounding = estimate + aligned * c, rounding + aligned * planes.error
            # the rest lies across its code, so it meets only the query's part across it
            across = np.sqrt(1 - np.clip(np.abs(c) - planes.error, 0, 1) ** 2)
            reach = self.left[k][at] * across + rounding + 1e-9
            scale = self.norm[at] * q.norm
            keep = yield at, scale * (estimate - reach), scale * (estimate + reach)
            at, estimate, rounding = at[keep], estimate[keep], rounding[keep]
        yield at, np.zeros(0), np.zeros(0)

    def survivors(self, q: Query, at: np.ndarray, wanted) -> np.ndarray:
        """Rows of `at` that `wanted(lower, upper)` keeps after every code."""
        self.met += len(at)
        steps = self.intervals(q, at)
        at, lower, upper = next(steps)
        for _ in range(len(self.bits)):
            at, lower, upper = steps.send(wanted(lower, upper))
        self.scored += len(at)
        return at

    def positives(self, v: np.ndarray, query: Query, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of the same label."""

        def wanted(lower, upper):
            return upper >= (np.partition(lower, -k)[-k] if len(lower) > k else -np.inf)

        a, b = np.searchsorted(self.labels, label), np.searchsorted(self.labels, label, "right")
        at = self.survivors(query, np.arange(a, b), wanted)
        return self._best(at, products(self.vectors[at], v, self.widest), k)

    def negatives(self, v: np.ndarray, query: Query, label: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k best of other labels whose score lies in each window (both ends count)."""

        floors = [low for low, _ in windows]

        def wanted(lower, upper):
            for p, (low, high) in enumerate(windows):
                sure = lower[(lower >= floors[p]) & (upper <= high)]
                if len(sure) >= k:
                    floors[p] = max(low, np.partition(sure, -k)[-k])
            keep = (upper >= min(floors)) & (lower <= max(high for _, high in windows))
            at = np.flatnonzero(keep)
            low_, up_, some = lower[at], upper[at], np.zeros(len(at), bool)
            for floor, (_, high) in zip(floors, windows, strict=True):
                some |= (up_ >= floor) & (low_ <= high)
            keep[at] = some
            return keep

        a, b = np.searchsorted(self.labels, label), np.searchsorted(self.labels, label, "right")
        at = self.survivors(query, np.concatenate([np.arange(a), np.arange(b, len(self.ids))]), wanted)
        score = products(self.vectors[at], v, self.widest)
        inside = [(score >= low) & (score <= high) for low, high in windows]
        return [self._best(at[i], score[i], k) for i in inside]

    def _best(self, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[at], ~score))[:k]  # ~ turns the order round and has no overflow
        return self.ids[at][order], score[order]


def coded(rows: DataFrame) -> DataFrame:
    """Adds codes (binary), aligned, left (arrays of CODES doubles) and norm to the columns n, vec_id, label, v."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby("n"):
                for a in range(0, len(part), 2000):
                    some = part.iloc[a : a + 2000]
                    one, norm = unit(np.stack(some["v"].to_numpy()))
                    bits, aligned, left = encode(widen(one))
                    words = bits.reshape(len(bits), -1).view(np.int64)
                    yield some.assign(codes=list(words), aligned=list(aligned), left=list(left), norm=norm)

    return rows.mapInPandas(task, "vec_id long, n int, v array<long>, label long, codes array<long>, aligned array<double>, left array<double>, norm double")


def mine(vectors: DataFrame, modulus: int = 100, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, shard_bytes: int = 32 << 20) -> DataFrame:
    """Hard negatives of each positive of each anchor.

    vectors: vec_id, embedding, label (an integer); other columns are ignored. Rows without label or vec_id and rows that integers() leaves out take
    no part. Anchors are the rows whose vec_id is divisible by `modulus`; a row's score is its integer inner product with the
    anchor, beyond 64 bits the nearest 64-bit integer. An anchor's positives are its best other rows of the same label; for each,
    the best rows of another label are returned that have low * positive_score <= 100 * negative_score <= high * positive_score. Ties go to the smaller vec_id.
    Rows that repeat an id are rows of their own, anchors, positives and negatives alike, and only a row itself is not its positive; so result rows
    may repeat. Rows of another length than the anchor have no product with it and are not met. An empty table gives an empty table.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = integers(vectors, scale, F.col("label").cast("long").alias("label")).where("label IS NOT NULL")
    index = durable(coded(rows))
    anchors = index.where(F.col("vec_id") % modulus == 0).groupBy("n", F.col("vec_id").alias("anchor_id"), "label", "v").agg(F.count("*").alias("copies"))
    anchors = durable(anchors.select("n", "anchor_id", "label", "v", "copies", *told_apart()))
    key, names = ["anchor_id", "label", "h1", "h2"], "anchor_id long, label long, h1 long, h2 int"

    def find_positives(shard: dict, asked: dict) -> Iterator[pd.DataFrame]:
        held = Shard.of(shard)
        given = np.stack(asked["v"].to_numpy()).astype(np.int64)
        got = [held.positives(v, q, y, positives + 1) for v, q, y in zip(given, Query.of(given), asked["label"], strict=True)]
        frame = _repeated(asked, key, [len(i) for i, _ in got])
        own = products_own(asked["v"])
        yield frame.assign(own=np.repeat(own, [len(i) for i, _ in got]), vec_id=_joined([i for i, _ in got]), score=_joined([s for _, s in got]))

    near = search_shards(index, anchors.drop("copies"), find_positives, f"{names}, own long, vec_id long, score long", shard_bytes)
    chosen = best_without_own(near, key, "anchor_id", "own", positives)
    # at most `positives` short rows an anchor
    lists = chosen.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("p"))
    lists = durable(anchors.join(lists, key).select("n", *key, "v", "copies", F.transform("p", lambda p: p["id"]).alias("p_id"), F.transform("p", lambda p: p["score"]).alias("p_score")))

    def find_negatives(shard: dict, asked: dict) -> Iterator[pd.DataFrame]:
        held = Shard.of(shard)
        given = np.stack(asked["v"].to_numpy()).astype(np.int64)
        at, place, positive, own, ids, score = [], [], [], [], [], []
        for i, (v, q, y) in enumerate(zip(given, Query.of(given), asked["label"], strict=True)):
            scores = [int(s) for s in asked["p_score"][i]]
            windows = [(-(-low * s // 100), high * s // 100) for s in scores]
            got = held.negatives(v, q, y, windows, negatives) if any(a <= b for a, b in windows) else []
            for p, (found, points) in enumerate(got):
                at.append(np.full(len(found), i))
                place.append(np.full(len(found), p))
                positive.append(np.full(len(found), asked["p_id"][i][p]))
                own.append(np.full(len(found), scores[p]))
                ids.append(found)
                score.append(points)
        frame = pd.DataFrame({c: asked[c].to_numpy()[_joined(at)] for c in [*key, "copies"]})
        yield frame.assign(place=_joined(place), positive_id=_joined(positive), positive_score=_joined(own), vec_id=_joined(ids), score=_joined(score))

    schema = f"{names}, copies long, place int, positive_id long, positive_score long, vec_id long, score long"
    hard = durable(search_shards(index, lists, find_negatives, schema, shard_bytes))
    forget(index, anchors, lists)
    best = Window.partitionBy(*key, "place").orderBy(F.desc("score"), "vec_id")
    out = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def products_own(vectors: pd.Series) -> np.ndarray:
    """Each vector's inner product with itself."""
    return np.array([products(np.asarray(v, np.int64)[None], np.asarray(v, np.int64))[0] for v in vectors], np.int64)


def _repeated(asked: dict, columns: list[str], times: list[int]) -> pd.DataFrame:
    return pd.DataFrame({c: np.repeat(asked[c].to_numpy(), times) for c in columns})


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS i, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.i AS a, a.vec_id AS anchor_id, c.i, c.vec_id, a.label = c.label AS same,
             CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM e a JOIN e c ON a.vec_id % 100 = 0 AND a.i <> c.i AND len(a.v) = len(c.v)),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON p.place <= 5 AND s.a = p.a AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
