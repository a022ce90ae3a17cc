import random
import re
import tracemalloc

import numpy as np
import pytest

from emberfield.llm.ngram_join import jaccard_join, link, product


def brute(rows, width=4, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset([tuple(w[i : i + width]) for i in range(len(w) - width + 1)] or ([tuple(w)] if w else [])))
    group, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    low = {}
    for g, (i, _) in zip(group, rows, strict=True):
        low[g] = min(low.get(g, i), i)
    return sorted((i, len(s), low[g], n) for (i, _), s, g, n in zip(rows, sets, group, links, strict=True))


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    rows, texts = [], []
    for i in range(n):
        if texts and r.random() < 0.6:
            words = list(r.choice(texts[-40:]))
            for _ in range(r.choice([0, 0, 1, 1, 2, 4, 8])):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 5, 12, 40, 90, 200]))] + passage * r.randrange(2)
        texts.append(words)
        rows.append((i * 7 + 3, "  ".join(words).title() if r.random() < 0.3 else "\n".join(words)))
    return [*rows, (5, None), (6, ""), (8, " \t ")]


@pytest.mark.parametrize(("seed", "cell"), [(1, 1_500_000), (2, 400)])
def test_equals_brute_force(spark, seed, cell):
    rows = corpus(seed, 260)
    out = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), cell_shingles=cell, broadcast_rows=500_000 if seed == 1 else 1)
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_empty_extra_columns_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, node long, k int")
    assert jaccard_join(empty).collect() == []
    rows = [(1, "a b c d e", 4, 4), (1, "a b c d e", 4, 4), (2, "A b c D e", 4, 4), (None, "q r s t u", 1, 1)]
    out = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, node long, k int"))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 2, 1, 2), (1, 2, 1, 2), (2, 2, 1, 2), (None, 2, None, 0)]


def test_classes_without_ids_still_link(spark):
    words = [f"w{k}" for k in range(100)]
    change = lambda *at: " ".join("x" if k in at else w for k, w in enumerate(words))
    # the middle text has no id, and the two others link through it alone
    rows = [(1, change()), (None, change(20)), (2, change(20, 60)), (None, "one two"), (None, None)]
    out = jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=91)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 97, 1, 1), (None, 97, 1, 2), (2, 97, 1, 1), (None, 1, None, 0), (None, 0, None, 0)], key=str)


def test_very_long_text(spark):
    long = " ".join(str(k) for k in range(400_000))
    out = jaccard_join(spark.createDataFrame([(4, long), (3, f"{long} more"), (9, "short")], "doc_id long, text string"))
    assert sorted(map(tuple, out.collect())) == [(3, 399_998, 3, 1), (4, 399_997, 3, 1), (9, 1, 9, 0)]


def test_a_full_block_of_near_copies_in_bounded_memory():
    rng = np.random.default_rng(0)
    base = rng.integers(1, 1 << 60, 90).astype(np.uint64)
    sets = []
    for k in range(16_384):
        own = base.copy()
        own[k % 90] = k + 1  # any two share 88 of 92
        sets.append(np.sort(own))
    tracemalloc.start()
    label, links = link(product(sets, np.full(len(sets), 2), 85), np.ones(len(sets), np.int64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (label == 0).all() and (links == len(sets) - 1).all()
    assert most < 700e6
