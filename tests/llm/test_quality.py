import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield.llm.queries import op12_quality_classifier
from emberfield.llm.quality import STATISTICS, RuleEnsemble, Trees, fit, holds, rate_quality, statistics

DATA = "/root/testdata/sf0.1"


def plain(text):
    """The statistics of one text, word by word and line by line."""
    letters = lambda b: [c for c in b if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128]
    data = (text or "").encode()
    white = bytes([32, *range(9, 14)])
    split = lambda b: [w for w in b.translate(bytes.maketrans(white, b" " * 6)).split(b" ") if w]
    mark = lambda c: not (c in white or c >= 128 or chr(c).isalnum())
    words = split(data)
    if not words:
        return [0.0] * len(STATISTICS)
    body = [c for c in data if c not in white]
    lines = [split(x) for x in data.split(b"\n")]
    lines = [x for x in lines if x]
    low = [w.lower() for w in words]
    doubled = lambda w: any(mark(a) and a == b for a, b in zip(w, w[1:], strict=False))
    only = lambda w: not letters(w)
    same = lambda ws: sum(a == b for a, b in zip(ws, ws[1:], strict=False))
    upper = lambda b: sum(65 <= c <= 90 for c in b) / max(1, len(letters(b)))
    n, at = len(words), 0
    far, repeats = [x for x in lines if len(x) >= 4], []
    for x in lines:
        mine = [w.lower() for w in x]
        before = low[at - 1] if at else None
        at += len(x)
        if len(x) >= 4:
            repeats.append((same(mine) + (mine[0] == before)) / len(x))
    most = lambda f: max((sum(map(f, x)) / len(x) for x in far), default=0.0)
    return [
        np.log1p(n), len(body) / n, n / len(lines), upper(data), sum(48 <= c <= 57 for c in body) / len(body), sum(map(mark, body)) / len(body), sum(map(doubled, words)) / n,
        sum(mark(w[-1]) and not only(w) for w in words) / n, sum(map(only, words)) / n, sum(len(w) <= 3 for w in words) / n, sum(len(w) >= 10 for w in words) / n,
        len(set(low)) / n, same(low) / n, max(map(low.count, low)) / n, len({b" ".join(x).lower() for x in lines}) / len(lines),
        max((upper(b"".join(x)) for x in far), default=0.0), most(doubled), most(only), max(repeats, default=0.0), most(lambda w: len(w) <= 3),
    ]


def test_statistics_equal_plain_counting():
    rng = np.random.default_rng(2)
    parts = ["a", "The", "the", "WORD!!", "x##", "|", "12", "été", "\n", "\n\n", "  ", "longerthanten", "..", "\t"]
    texts = [None, "", " \n ", "one", "A B\nA B\n"] + [" ".join(rng.choice(parts, rng.integers(1, 60))) for _ in range(60)]
    got = statistics(texts)
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, plain(t)), (t, dict(zip(STATISTICS, zip(row, plain(t), strict=True), strict=True)))


def test_rules_compile_to_the_same_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.random((600, len(STATISTICS)))
    y = ((x[:, 3] > 0.4) & (x[:, 5] <= 0.7)).astype(float)
    ensemble = RuleEnsemble.fit(x, y, np.arange(600) % 3)
    assert 0 < len(ensemble.rules) < len(Trees(x, y).rules)  # the penalty drops rules
    assert ((ensemble.probability(x) >= 0.5) == y).mean() > 0.98
    assert holds([((3, True, 0.4), (5, False, 0.7))], x)[:, 0].tolist() == y.tolist()
    table = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{c} double" for c in STATISTICS)).select(F.struct(*STATISTICS).alias("s"))
    got = [r[0] for r in table.select(ensemble.column(F.col("s"))).collect()]
    assert np.allclose(sorted(got), sorted(ensemble.probability(x[:50])))


def test_odd_rows(spark):
    never = F.lit(False)
    docs = spark.createDataFrame([(1, "fine words stand here", 9), (1, "fine words stand here", 9), (None, "x!! y!!", 9), (3, None, 9), (4, "", 9), (5, "ß" * 200_000 + " a" * 200_000, 9)], "doc_id long, text string, score int")
    labels = "doc_id long, quality int, toxic int"
    for given in ([], [(1, 1, 0), (None, 0, 0), (4, None, 0), (99, 0, 0)], [(1, 1, 0), (1, 0, 0), (4, 1, 0)]):
        got = rate_quality(docs, spark.createDataFrame(given, labels), never).collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert {r["score"] for r in rate_quality(docs, spark.createDataFrame([], labels), never).collect()} == {0.5}
    assert rate_quality(docs.limit(0), spark.createDataFrame([(1, 1, 0)], labels), never).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_labels_are_met_and_not_read(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = op12_quality_classifier(spark, DATA).join(labels, "doc_id").toPandas()
    out = got[got["held_out"]]
    assert (out["predicted"] == out["quality"]).mean() > 0.98
    rank, good = out["score"].rank().to_numpy(), out["quality"].to_numpy() == 1
    assert (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()) > 0.99
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (fit(docs, x.where(~held), F.col("quality") == 1) for x in (labels, turned))
    assert one.rules == two.rules and np.array_equal(one.weights, two.weights)
