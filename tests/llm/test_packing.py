import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberfield.llm.packing import Windows, WordTokens, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("window", [8, 64, 4096])
def test_round_trip(spark, window):
    texts = [None, "", "One two,three!  Fünf ΣΑΣ.", "x" * 700, "a\x1cb <|endoftext|> c", "word " * 5000, "it's 12345   café", "same", "same"] + [f"doc {i} " * (i % 23) for i in range(200)]
    rows = [(i * 5, t, 7) for i, t in enumerate(texts)] + [(None, "null id", 7)]
    out = [r.asDict() for r in pack(spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3), PATH, window).collect()]
    coder = Tokenizer.from_file(PATH)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    assert set(pieces) == {r[0] for r in rows}
    for i, t, _ in rows:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or at < window and at & (at - 1) == 0


def test_tokens_equal_the_tokenizer():
    rng = np.random.default_rng(1)
    marks = list("abcXYZäßéÉñΣσİıﬁ’'.,!?-_123²½٣́ \t\n\u00a0\u2003\u200b中文😀") + ["'s", "n't", "...", ".\"", "</w>", "e\u0301.", "Ⅷ."]
    texts = ["".join(rng.choice(marks, rng.integers(0, 80))) for _ in range(400)] + ["It's. The END, the end! www.x.y 3.5, a.,b"]
    coder, fast = Tokenizer.from_file(PATH), WordTokens(PATH, most=50)
    for a in range(0, len(texts), 40):
        for t, ids in zip(texts[a : a + 40], fast(texts[a : a + 40]), strict=True):
            assert ids.tolist() == coder.encode(t, add_special_tokens=False).ids, t


def test_level_choice_is_the_least_sum_of_squares():
    rng, size, windows = np.random.default_rng(0), 50, Windows(50)
    for d in range(2000):
        n = int(rng.integers(1, 50))
        before = windows.count.copy()
        windows.place((d, 0, n))
        best = []
        for h in [0, *np.flatnonzero(before[:size] > 0)]:
            if h + n <= size:
                c = before.copy()
                c[h] -= h > 0
                c[h + n] += h + n < size
                best.append(int((c[1:size] ** 2).sum()))
        assert int((windows.count[1:size] ** 2).sum()) == min(best)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_most_pieces_stay_where_the_levels_put_them():
    rng = np.random.default_rng(4)
    for documents, share in ((1000, 0.03), (10_000, 0.01), (80_000, 0.005)):
        windows, sizes = Windows(4096), np.minimum(rng.lognormal(6, 1.2, documents).astype(int) + 1, 30_000)
        total = dict.fromkeys(range(documents), 0)
        done = [windows.place((d, 0, int(n % 4096))) for d, n in enumerate(sizes) if n % 4096]
        for w in [*filter(None, done), *windows.rest()]:
            n = sum(p[2] for p in w)
            assert n == 4096 or n & (n - 1) == 0
            for d, _, part in w:
                total[d] += part
        assert total == {d: int(n % 4096) for d, n in enumerate(sizes)}
        assert windows.moved < share * documents
