import re
import zlib
from collections import Counter

import numpy as np
import pytest

from emberfield.llm.spelling import affected, decompose, longest_gram, near_words, roots, spelling_variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def brute(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for doc, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def texts():
    rng = np.random.default_rng(8)
    parts = ["er", "tion", "en", "th", "sch", "é", "ß", "a", "Ing", "Ü", "o"]
    stock = ["".join(rng.choice(parts, rng.integers(2, 5))) for _ in range(150)]
    stock += [w[:i] + "x" + w[i + k :] for w in stock[:60] for i in (0, 2, len(w)) for k in (0, 1)]
    rows = [(i, " ".join(rng.choice(stock, 120, p=None)) + " 12-" + "·".join(rng.choice(stock, 5))) for i in range(60)]
    rows.append((61, "karlix " * 3 + "karlax " * 7 + "marlax " * 20))  # a form that has a form
    long = "abcdefgh" * 4000
    return [*rows, rows[0], (None, rows[1][1]), (70, None), (71, ""), (72, "÷×÷×÷ " * 3), (73, f"{long} {long} {long} {long[:-1]} {long[:-1]}_{long[:-1]}")]


def test_equals_brute_force(spark):
    docs = texts()
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, word int")
    got = sorted(map(tuple, spelling_variants(table).select("word", "n", "n_near", "form", "form_n", "root").collect()))
    want = brute(docs)
    assert got == want
    assert any(r[5] not in (r[0], r[3]) for r in want) and any(r[2] == 0 for r in want)


def test_no_words(spark):
    for rows in ([], [(1, "a b c"), (2, None)]):
        assert spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("entries", [50, 100_000])
def test_small_and_large_dictionaries_find_the_same(spark, entries):
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(5, 9))) for _ in range(1500)})
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = sorted((r["word"], r["other"]) for r in near_words(table, entries).collect())
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_an_edit_affects_no_more_grams_than_the_bound():
    rng = np.random.default_rng(6)
    for _ in range(400):
        word = "".join(rng.choice(list("abc"), rng.integers(5, 12)))
        frequent = {word[i : i + k] for i in range(len(word)) for k in (2, 3, 4, 5, 6) if rng.random() < 0.7} | {"^" + word[:k] for k in range(1, 6)}
        i, kind = int(rng.integers(0, len(word))), rng.integers(0, 3)
        other = word[:i] + ("" if kind == 0 else "b" if kind == 1 else "b" + word[i]) + word[i + 1 :]
        if other == word or len(other) < 5:
            continue
        longest = longest_gram(min(len(word), len(other)))
        mine, theirs = decompose(word, longest, frequent), decompose(other, longest, frequent)
        shared = Counter(g for g, _ in mine) & Counter(g for g, _ in theirs)
        for grams, w in ((mine, word), (theirs, other)):
            assert 1 <= len(grams) - affected(grams, len(w)) <= shared.total()


def test_roots(spark):
    steps = [(str(i), str(i + 1)) for i in range(40)] + [("a", "b"), ("c", "b")]
    got = dict(map(tuple, roots(spark.createDataFrame(steps, "word string, form string")).collect()))
    assert got == {str(i): "40" for i in range(40)} | {"a": "b", "c": "b"}
