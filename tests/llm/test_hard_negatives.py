import math

import numpy as np
import pytest

from emberfield.llm.hard_negatives import Query, Shard, encode, mine, rotate, unit, widen


def brute(rows, modulus=100):
    good = [(i, y, [math.floor(256 * float(x)) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (anchor, label, v) in enumerate(good):
        if anchor % modulus:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), i, y) for other, (i, y, w) in enumerate(good) if other != at and len(w) == len(v)]
        for minus, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            inside = sorted((s, i) for s, i, y in scored if y != label and 30 * -minus <= 100 * -s <= 90 * -minus)
            out += [(anchor, positive, r, i, -minus, -s) for r, (s, i) in enumerate(inside[:10], 1)]
    return sorted(out)


def cases():
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=20) / 4 + (i % 3) / 8], int(rng.integers(0, 4))) for i in range(500)]
    rows += [(600, rows[5][1], 1), (601, rows[5][1], 1), (602, rows[5][1], 2), (600, rows[5][1], 1), (600, rows[6][1], 3)]  # repeated ids and vectors
    rows += [(700, None, 1), (800, [1.0, None], 1), (900, [float("nan")] * 20, 0), (1000, rows[7][1], None), (None, rows[7][1], 1)]
    rows += [(1100, [0.0] * 20, 2), (1200, [1.0, 2.0], 0), (1201, [0.5, 2.0], 0), (1202, [0.25, 1.0], 1), (1300, [], 0), (1301, [], 0), (1302, [], 1)]
    return rows


@pytest.mark.parametrize("shard_bytes", [1 << 25, 15_000])
def test_equals_brute_force(spark, shard_bytes):
    rows = cases()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, codes string, rank int")
    got = sorted(map(tuple, mine(table, shard_bytes=shard_bytes).collect()))
    assert got == brute(rows)


def test_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert mine(spark.createDataFrame([], schema)).collect() == []
    assert mine(spark.createDataFrame([(1, [1.0], 0), (100, [1.0], 0)], schema)).collect() == []


def test_wide_components(spark):
    rows = [(0, [1e17, 1.0], 0), (1, [1e17, 2.0], 0), (2, [0.5, 7.0], 1), (3, [3e16, 1.0], 1), (100, [1.0, 1.0], 1), (101, [2.0, 2.0], 1), (102, [1.0, 2.0], 0)]
    got = sorted(map(tuple, mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()))
    top = (1 << 63) - 1
    clipped = [(a, p, r, n, min(ps, top), min(ns, top)) for a, p, r, n, ps, ns in brute(rows) if ps <= top]
    assert [x for x in got if x[0] == 100] == [x for x in clipped if x[0] == 100]


@pytest.mark.parametrize("length", [3, 64, 100])
def test_intervals_hold_and_shrink(length):
    rng = np.random.default_rng(length)
    x = rng.integers(-500, 500, (300, length))
    one, norm = unit(x)
    assert np.allclose(rotate(widen(one), 0) @ rotate(widen(one), 0).T, one @ one.T)
    bits, aligned, left = encode(widen(one))
    shard = Shard({"vec_id": np.arange(300), "label": np.zeros(300, int), "v": x, "codes": bits.reshape(300, -1).view(np.int64), "aligned": aligned, "left": left, "norm": norm})
    for q in rng.integers(-500, 500, (5, length)):
        score, widths = x @ q, []
        steps = shard.intervals(Query.of(q[None])[0], np.arange(300))
        at, lower, upper = next(steps)
        while len(lower):
            assert (lower <= score).all() and (score <= upper).all()
            widths.append((upper - lower).mean())
            at, lower, upper = steps.send(np.ones(300, bool))
        assert widths[-1] < 0.12 * widths[0]


def test_few_vectors_are_scored():
    rng = np.random.default_rng(9)
    x = np.floor(256 * unit(rng.normal(size=(20_000, 64)))[0]).astype(np.int64)
    one, norm = unit(x)
    bits, aligned, left = encode(widen(one))
    shard = Shard({"vec_id": np.arange(len(x)), "label": np.arange(len(x)) % 10, "v": x, "codes": bits.reshape(len(x), -1).view(np.int64), "aligned": aligned, "left": left, "norm": norm})
    for i in range(0, 2000, 100):
        ids, score = shard.positives(x[i], Query.of(x[i : i + 1])[0], i % 10, 6)
        assert list(score) == sorted(x[np.arange(len(x)) % 10 == i % 10] @ x[i])[::-1][:6]
    assert shard.scored < 0.1 * shard.met
