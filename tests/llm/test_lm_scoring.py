import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from emberfield.llm import lm_scoring


KEEP, POWER = (0.98, 0.95), (0.04, 0.25)


def brute(rows, keep=KEEP, power=POWER):
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    learnt = [split(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(w for t in learnt for w in t)
    pairs = collections.Counter(p for t in learnt for p in zip(["<", *t], t))  # noqa: B905
    triples = collections.Counter(p for t in learnt for p in zip(["<", *t], t, t[1:]))  # noqa: B905
    n, v, once = sum(c.values()), len(c), sum(x == 1 for x in c.values())
    u = min(0.5, max(once, 1) / n)
    fail = lambda count, k: keep[k] / (1 + count) ** power[k] if count else 1

    def p(w, h=None, g=None):
        """Of w after h, after g and h."""
        if h is None:
            return (1 - u) * c[w] / n if c[w] else u
        if g is None:
            ch = c[None] if h == "<" else c[h]
            return fail(ch, 0) * p(w) + ((1 - fail(ch, 0)) * pairs[h, w] / ch if ch else 0)
        return fail(pairs[g, h], 1) * p(w, h) + ((1 - fail(pairs[g, h], 1)) * triples[g, h, w] / pairs[g, h] if pairs[g, h] else 0)

    out = []
    for i, t in rows:
        t, base, score = split(t), 0, 0
        for k, w in enumerate(t):
            base += math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))
            score += math.log10(p(w, "<") if not k else p(w, t[k - 1], t[k - 2] if k > 1 else "<"))
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return sorted(out, key=str)


@pytest.mark.parametrize("chars", [12_000_000, 500])
def test_equals_brute_force(spark, chars):
    r = random.Random(5)
    words = [f"Wörd{i}" for i in range(300)]
    rows = [(i, " ".join(r.choice(words[: r.choice([5, 50, 300])]) for _ in range(r.randrange(0, 60)))) for i in range(300)]
    rows += [(None, "a b"), (1000, None), (1001, ""), (1002, "same text"), (1002, "same text"), (1003, "q " * 3000), (1004, "w x y " * 100_000)]
    got = lm_scoring.score(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, block int"), block_chars=chars, shard_keys=chars // 10).collect()
    for a, b in zip(sorted(map(tuple, got), key=str), brute(rows), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6)


def test_empty_and_untrained(spark):
    assert lm_scoring.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = lm_scoring.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert row["score"] == 0 and row["base_score"] == 0 and row["held_out"] and row["train_tokens"] == 0


def automaton(texts, probe, keep=(0.9, 0.8), power=(0.1, 0.2)):
    grams, probe = lm_scoring.Grams(texts), lm_scoring.Grams(probe)
    counts = grams.counts(np.ones(len(texts), bool))
    look = [dict(zip(k.tolist(), c.tolist(), strict=True)) for k, c in zip(grams.keys, counts, strict=True)]
    return lm_scoring.Automaton(probe, [np.array([d.get(x, 0) for x in k.tolist()]) for d, k in zip(look, probe.keys, strict=True)], int(counts[0].sum()), 0.1, keep, power)


def test_states_sum_to_one():
    texts = ["a b a c", "a b", "b a b c a"]
    for history in ("a b ", "b a ", "a ", "c a ", "c c ", ""):
        # the probability of a word is that of the text less that of its end; "unseen" stands for all other words together
        ends = lambda t: 10 ** automaton(texts, [t]).traverse()[0]
        total = sum(ends(history + w) / 10 ** last(texts, history + w) for w in ("a", "b", "c", "unseen")) + ends(history.strip())
        start = ends(history.strip()) / 10 ** last(texts, history.strip())
        assert total == pytest.approx(start)


def last(texts, text):
    """log10 probability of the end after a text: the text's less that of its steps before."""
    machine = automaton(texts, [text])
    whole = machine.traverse()[0]
    machine.grams.size = machine.grams.size - 1
    return whole - machine.traverse()[0]


def test_failure_arcs_are_followed_twice():
    texts = ["a b c", "b d", "e"]
    machine = automaton(texts, ["a b e"])
    machine.grams.size = np.array([3])
    before = automaton(texts, ["a b"])
    before.grams.size = np.array([2])
    f2, f1 = 0.8 / 2**0.2, 0.9 / 3**0.1  # (a, b) once, b twice; e after neither
    assert machine.traverse()[0] - before.traverse()[0] == pytest.approx(math.log10(f2 * f1 * 0.9 * 1 / 9))


@pytest.mark.parametrize("stretch", [1, 2, 3, 7])
def test_stretches_do_not_matter(monkeypatch, stretch):
    r = random.Random(2)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(0, 40))) for _ in range(30)]
    whole = automaton(texts[:20], texts).traverse()
    monkeypatch.setattr(lm_scoring, "STRETCH", stretch)
    assert automaton(texts[:20], texts).traverse() == pytest.approx(whole)
