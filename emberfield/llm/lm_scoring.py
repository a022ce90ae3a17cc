"""Scoring texts with a smoothed n-gram model run as a weighted backoff automaton.

States are the histories that training documents contain: pairs of words, single words (the start of a text is one),
and the root for any other history. An arc (state, word) exists if training documents have the word after the state. It weighs log10 of

    p(word | state) = (1 - f) * count(state, word) / count(state) + f * p(word | the state without its first word)

and leads to the longest suffix of history and word that is a state. A state's failure arc weighs log10 f and leads to the state
without its first word, in the end to the root, whose arcs weigh log10 p(word). The share f that a state leaves to words not
seen after it falls with the state's count, so each state's probabilities sum to one. p(word) = (1 - u) * count / N for known words, and u for
the rest together, where u is the share of tokens that occurred once (Good-Turing).

The model is as large as the corpus, so no task ever holds it. Documents are dealt into
blocks. A block asks for the n-grams that it contains, as sorted hashes cut into shards, and tells how often its training documents
contain them. A shard adds the counts of all blocks up and answers each in the
order of its question, so answers carry counts only. With them a block has all states and arcs that its texts can visit. A
message has one key at least, so messages never outnumber the n-grams of the blocks. Each text is walked from left to right once, a state being carried from step to
step; long texts are cut into stretches that are walked side by side. A stretch starts two words early, at the root: after two steps
the state depends on these words alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as N
from .common import shuffle_partitions

END, START = np.uint64(0x51A7E0FE9D), np.uint64(0x5EED0FA7EC)
SLICE_CHARS = 2_000_000
ORDER, STRETCH = 3, 1024


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, tokens of each text): the words of a text, then one end."""
    parts, sizes = [], []
    for a, b in N.slices([len(t) if t else 0 for t in texts], SLICE_CHARS):
        hashes, first = N.words(texts[a:b])
        parts.append(np.insert(hashes, first[1:], END))
        sizes.append(np.diff(first) + 1)
    return np.concatenate([np.zeros(0, N.U64), *parts]), np.concatenate([np.zeros(0, np.int64), *sizes])


class Grams:
    """The distinct words, pairs and triples of a block (kinds 0 to 2), with the number of each token's among them.

    Words are hashed to 64 bits, pairs and triples to `bits`. `where` has a place of each. A text's first pair begins with its start; its first triple stands for nothing.
    """

    def __init__(self, texts: list, bits: int = 56):
        token, self.size = tokens(texts)
        self.first = np.cumsum(self.size) - self.size
        self.keys, self.at, self.where = [], [], []
        gram = before = token
        for kind in range(ORDER):
            if kind and len(token):
                before = np.concatenate([[START], before[:-1]]).astype(N.U64)
                before[self.first] = START
                with np.errstate(over="ignore"):
                    gram = N.mix(before * N.U64(0x9E3779B97F4A7C15) + gram, 40 + kind)
            keys, where, at = np.unique(gram >> N.U64(64 - bits) if kind else gram, return_index=True, return_inverse=True)
            self.keys.append(keys)
            self.where.append(where.astype(np.int32))
            self.at.append(at.astype(np.int32))

    def counts(self, train: np.ndarray) -> list[np.ndarray]:
        weight = np.repeat(train, self.size).astype(np.float64)
        return [np.bincount(at, weight, len(k)).astype(np.uint32) for at, k in zip(self.at, self.keys, strict=True)]


class Automaton:
    """The states and arcs that the texts of a block can visit.

    States are numbered: 0 is the root, then come words, then pairs, in the order of the block's keys.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, unknown: float, keep: tuple, power: tuple):
        self.grams = grams
        words, pairs, triples = (c.astype(float) for c in counts)
        end = np.searchsorted(grams.keys[0], END)
        first = np.zeros(len(grams.at[0]), bool)
        first[grams.first] = True
        root = np.where(words > 0, (1 - unknown) * words / max(1, total), unknown)

        def fail(count: np.ndarray, level: int) -> np.ndarray:
            """The share that a state leaves to the shorter history; a history that is no state leaves it all."""
            return np.where(count > 0, keep[level] / (1 + np.maximum(count, 1)) ** power[level], 1.0)

        # the word before a pair's last word, and the pair before a triple's last word; as many texts start as end
        word_before = np.where(first[grams.where[1]], end, grams.at[0][grams.where[1] - 1])
        word_fail, pair_fail = fail(words, 0), fail(pairs, 1)
        last, history = grams.at[0][grams.where[1]], words[word_before]
        low = word_fail[word_before] * root[last] + np.where(pairs > 0, (1 - word_fail[word_before]) * pairs / np.maximum(history, 1), 0)
        before, pair = grams.at[1][grams.where[2] - 1], grams.at[1][grams.where[2]]
        high = pair_fail[before] * low[pair] + (1 - pair_fail[before]) * triples / np.maximum(pairs[before], 1)
        with np.errstate(divide="ignore"):
            #: log10 weights of arcs from the root, from words and from pairs, and of failure arcs by state
            self.arcs = [np.log10(root), np.log10(low), np.log10(high)]
        self.fail = np.log10(np.concatenate([[1.0], word_fail, pair_fail]))
        self.known = [words > 0, pairs > 0, triples > 0]
        self.words = len(words)
        self.shorter = np.concatenate([[0], np.zeros(len(words), np.int64), np.where(words[last] > 0, 1 + last, 0)])  # where failure arcs lead
        self.start = 1 + end if end < len(words) and words[end] > 0 else 0

    def traverse(self) -> np.ndarray:
        """log10 probability of every text."""
        g = self.grams
        text = np.repeat(np.arange(len(g.size)), -(-g.size // STRETCH))
        begin = np.arange(len(text)) - np.repeat(np.cumsum(-(-g.size // STRETCH)) + g.size // -STRETCH, -(-g.size // STRETCH))
        begin = begin * STRETCH
        early = np.where(begin > 0, 2, 0)  # steps that are walked for the state alone
        place, steps = g.first[text] + begin - early, np.minimum(g.size[text] - begin, STRETCH) + early
        order = np.argsort(-steps, kind="stable")
        text, early, place, steps = text[order], early[order], place[order], steps[order]
        state, total = np.where(early > 0, 0, self.start), np.zeros(len(text))
        for t in range(int(steps.max(initial=0))):
            n = int(np.searchsorted(-steps, -t, "left"))  # stretches that have this step
            state, at = state[:n], place[:n] + t
            weight, level = np.zeros(n), (state > 0).astype(np.int8) + (state > self.words)
            gram = [a[at] for a in g.at]
            open_ = np.ones(n, bool)
            for k in (2, 1, 0):  # from the state, arcs or else failure arcs
                here = open_ & (level == k)
                arc = here & self.known[k][gram[k]] if k else here
                weight[arc] += self.arcs[k][gram[k][arc]]
                open_ &= ~arc
                failed = here & ~arc
                weight[failed] += self.fail[state[failed]]
                state[failed] = self.shorter[state[failed]]
                level[failed] = (state[failed] > 0).astype(np.int8)
            total[:n] += np.where(t >= early[:n], weight, 0)
            state = np.where(self.known[1][gram[1]], 1 + self.words + gram[1], np.where(self.known[0][gram[0]], 1 + gram[0], 0))
        return np.bincount(text, total, len(g.size))


def score(docs: DataFrame, parts: int = 5, keep: tuple = (0.98, 0.95), power: tuple = (0.04, 0.25), block_chars: int = 12_000_000, shard_keys: int = 3_000_000) -> DataFrame:
    """Log10 probabilities of all documents under a model of those whose crc32 of doc_id, modulo `parts`, is not 1.

    docs: doc_id and text; other columns are ignored. A null text is empty: its end alone. A null doc_id is neither learnt
    from nor held out. Repeated rows are learnt from and scored as often as they occur. Without training documents all
    probabilities are 1; an empty table gives an empty table. A very long text is a block of its own, in memory linear in its length.
    keep, power: a word state (then a pair state) that occurred c times leaves the share keep / (1 + c) ** power to shorter
    histories. The defaults gave the held-out rows of a table of 5,000 documents the largest probability among some twenty
    choices; other texts may want others.
    Returns one row for each row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    check = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(check == 1, F.lit(False)).alias("held_out"), F.coalesce(check != 1, F.lit(False)).alias("train"))
    floor = shuffle_partitions(docs.sparkSession)

    def wide(bits: int) -> int:
        """Bytes for the distance of a key to the one before it: a block has a million pairs or triples or two, and some ten thousand words."""
        return 7 if bits == 64 else -(-(bits - 17) // 8)

    # vocabulary: distinct words of each batch, added up by shards
    def vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            token, size = tokens(list(pdf["text"]))
            keys, count = np.unique(token[np.repeat(pdf["train"].to_numpy(), size)], return_counts=True)
            cut = N.cuts(keys, 64, floor)
            chars = sum(len(t) for t in pdf["text"] if t is not None)
            yield pd.DataFrame([(s, N.packed_keys(keys[cut[s] : cut[s + 1]], wide(64)), N.packed(count[cut[s] : cut[s + 1]]), 0 if s else chars, 0 if s else len(token)) for s in range(floor)], columns=["shard", "keys", "counts", "chars", "tokens"])
            N.release()

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, at = np.unique(np.concatenate([N.unpacked_keys(k, wide(64)) for k in pdf["keys"]]), return_inverse=True)
        total = np.bincount(at, np.concatenate([N.unpacked(c) for c in pdf["counts"]]), len(keys))
        return pd.DataFrame([(int(total.sum()), len(keys), int((total == 1).sum()), int(pdf["chars"].sum()), int(pdf["tokens"].sum()))], columns=["n", "v", "once", "chars", "tokens"])

    words = docs.select("text", "train").mapInPandas(vocabulary, "shard int, keys binary, counts binary, chars long, tokens long")
    words = words.groupBy("shard").applyInPandas(summed, "n long, v long, once long, chars long, tokens long")
    n, v, once, chars, seen = (int(x or 0) for x in words.agg(F.sum("n"), F.sum("v"), F.sum("once"), F.sum("chars"), F.sum("tokens")).first())
    unknown = min(0.5, max(once, 1) / n) if n else 1.0
    blocks = max(floor, math.ceil(chars / block_chars))
    shards = max(floor, math.ceil(seen * 0.9 / shard_keys))
    # of pairs and triples, about one in ten thousand shares its count with another, whatever the size of the corpus
    short = max(40, min(62, math.ceil(math.log2(seen + 1)) + 13))
    bits = (64, short, short)
    # the number of the input's partition spreads repeated rows over blocks
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int"))

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = Grams(list(pdf["text"]), short)
        rows = []
        for kind, (keys, count) in enumerate(zip(grams.keys, grams.counts(pdf["train"].to_numpy()), strict=True)):
            cut = N.cuts(keys, bits[kind], shards)
            rows += [(kind, s, int(pdf["block"].iat[0]), N.packed_keys(keys[cut[s] : cut[s + 1]], wide(bits[kind])), N.packed(count[cut[s] : cut[s + 1]])) for s in np.flatnonzero(np.diff(cut)).tolist()]
        N.release()
        return pd.DataFrame(rows, columns=["kind", "shard", "block", "keys", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = int(pdf["kind"].iat[0])
        keys = [N.unpacked_keys(k, wide(bits[kind])) for k in pdf["keys"]]
        cut = np.cumsum([0, *map(len, keys)])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate([N.unpacked(c) for c in pdf["counts"]]))
        counts = total[at].astype(np.int64)
        out = pd.DataFrame({"block": pdf["block"], "kind": kind, "shard": pdf["shard"], "counts": [N.packed(counts[cut[i] : cut[i + 1]]) for i in range(len(keys))]})
        N.release()
        return out

    def run(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        grams = Grams(list(pdf["text"]), short)
        answers = answers.sort_values("shard")
        counts = [np.concatenate([np.zeros(0, np.uint64), *[N.unpacked(c) for c in answers.loc[answers["kind"] == kind, "counts"]]]) for kind in range(ORDER)]
        if [len(c) for c in counts] != [len(k) for k in grams.keys]:
            raise RuntimeError("a block of texts changed between its question and the answer: write the table before scoring it")
        steps = Automaton(grams, counts, n, unknown, keep, power).traverse() if n else np.zeros(len(pdf))
        of = np.repeat(np.arange(len(pdf)), grams.size)
        count = counts[0][grams.at[0]]
        base = np.bincount(of, np.log10(count + 0.5) - math.log10(n + 0.5 * (v + 1)), len(pdf))
        out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "n_tokens": grams.size, "n_known": np.bincount(of, count > 0, len(pdf)).astype(np.int64), "train_tokens": n, "base_score": base, "score": steps})
        N.release()
        return out

    asked = dealt.groupBy("block").applyInPandas(ask, "kind int, shard int, block int, keys binary, counts binary")
    answered = asked.groupBy("kind", "shard").applyInPandas(answer, "block int, kind int, shard int, counts binary")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(run, out)
