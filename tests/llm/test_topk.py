import math
import os

import numpy as np
import pytest

from emberfield.llm.shards import integers
from emberfield.llm.topk import Shard, top_k, with_floors

DATA = "/root/testdata/sf0.1"


def brute(rows, k=10):
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(good):
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for other, (i, w) in enumerate(good) if other != at and len(w) == len(v))
            out += [(q, r, i, -t) for r, (t, i) in enumerate(s[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [1 << 25, 20_000])
def test_equals_brute_force(spark, shard_bytes):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 24))
    rows = [(i, [float(np.float32(x)) for x in base[i % 6] + 0.3 * rng.normal(size=24)]) for i in range(400)]
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (3000, None), (3100, []), (3200, [1.0, None]), (3300, [float("nan")] * 24), (3400, [float("inf")] * 24), (3500, [1.0, 2.0]), (3501, [0.5, -2.0]), (None, rows[0][1])]
    rows += [(5000, [0.0] * 24), (5100, []), (7, rows[9][1]), (100, rows[11][1]), (100, rows[100][1]), (100, rows[100][1])]
    out = top_k(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int"), shard_bytes=shard_bytes)
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_few_and_none(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    rows = [(0, [1.0]), (0, [1.0]), (7, [2.0]), (8, [2.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_rows_of_one_id_are_queries_of_their_own(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [0.5, 0.25]), (2, [0.25, 0.5])]
    got = sorted(map(tuple, top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    assert got == brute(rows) and len(got) == 6


def test_wide_components_are_exact(spark):
    rows = [(0, [4e6, 1e16]), (1, [4e6, 1e16]), (2, [-4e6, -1e16]), (3, [1.0, 1.0]), (4, [4e6, 1e15]), (100, [2.0, 1.0]), (5, [1e300, 0.0])]
    got = [tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).orderBy("query_id", "rank").collect()]
    top = (1 << 63) - 1
    assert got == [(0, 1, 1, top), (0, 2, 3, top), (0, 3, 4, top), (100, 1, 0, top), (100, 2, 1, top), (100, 3, 4, top)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_the_query_saves_products(spark):
    rows = integers(spark.read.parquet(f"{DATA}/embeddings.parquet"), 1024)
    asked = with_floors(rows.where("vec_id % 100 = 0"), rows, rows.count(), 11, 2048, 16 << 20).toPandas()
    held = rows.orderBy("vec_id").toPandas()
    ids, vectors = held["vec_id"].to_numpy(), np.stack(held["v"].to_numpy())
    shard = Shard(ids, vectors)  # at the query's own settings this table is one shard
    for own, q, floor in zip(asked["vec_id"], asked["v"], asked["floor"], strict=True):
        got, score = shard.search(np.asarray(q), 11, floor)
        want = sorted((-int(s), int(j)) for s, j in zip(vectors @ q, ids, strict=True))[:11]
        assert list(zip(-score, got, strict=True)) == want and own in got
    assert shard.products < 0.53 * len(asked) * vectors.size


def test_clustered_vectors_need_a_part_of_the_products():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    vectors = np.floor(1024 * (centres[rng.integers(0, 40, 20_000)] + 0.2 * rng.normal(size=(20_000, 64)))).astype(np.int64)
    shard = Shard(np.arange(20_000), vectors)
    for i in range(0, 20_000, 1000):
        ids, score = shard.search(vectors[i], 10)
        want = np.sort(vectors @ vectors[i])[::-1][:10]
        assert list(score) == list(want)
    assert shard.products < 0.4 * 20 * vectors.size
