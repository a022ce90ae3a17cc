"""N-gram Jaccard join: which documents share nearly all their word shingles.

The join is a sparse matrix product of the document by n-gram incidence with its own
transpose, cut into blocks of documents that may be similar:

1. *Classes.* Documents with equal shingle sets become one node (a hash of the set).
2. *Shared shingles.* Texts are dealt into groups, each of which asks shards of the hash range which of its shingles
   any other set has. A set of which less than t is shared is similar to none and goes no further; of the others only the
   shared shingles are looked at, for a pair differs in these by no more than it does in all.
3. *Blocks.* For Jaccard >= t, two sets of sizes a and b differ in at most
   (1-t)/(1+t) * (a+b) shingles. The shingles of a set are dealt by hash into one part
   more than that bound, so two sets that can be similar agree in a whole part. Equal
   parts give edges, and the connected components of these edges are the blocks: no
   similar pair crosses two of them. A part without shingles says nothing; a set with
   more empty parts than the spare ones is dealt again with other hashes, and at last
   meets the others of its kind under a common mark, so that no pair is lost.
4. *Product.* In each block, overlap counts are accumulated over chunks of n-gram columns;
   only row ranges whose sizes allow the threshold are multiplied, and counts below
   the size-derived bound are discarded. Blocks above a size are cut into cells, and each pair of
   cells with compatible sizes is one task. Only links inside the task's cells leave it, as a spanning forest.

Nothing is sampled or capped. Rows that leave a task are linear in its documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as N
from .common import components, durable, forget, shuffle_partitions

CHUNK_CHARS = 700_000


def _node(values: np.ndarray) -> int:
    """A 63-bit hash of a set of shingles: the identity of a class of documents."""
    with np.errstate(over="ignore"):
        total = N.mix(values, 11).sum(dtype=N.U64) + N.U64(len(values)) * N.U64(0x9E3779B97F4A7C15)
    return int(N.mix(np.array([total], N.U64), 12)[0] >> N.U64(1))


def _sets(texts, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle set) of every text, in bounded slices."""
    texts = list(texts)
    for a, b in N.slices([len(t) if t else 0 for t in texts], CHUNK_CHARS):
        hashes, first = N.words(texts[a:b])
        for i in range(a, b):
            yield i, N.shingles(hashes[first[i - a] : first[i - a + 1]], width)


class Bounds:
    """Size intervals and the largest difference of sets that may still be similar."""

    def __init__(self, percent: int, most: int = 1 << 40):
        self.percent = percent
        high, at = [], 1
        while at < most:
            high.append(max(at, at * 100 // percent))
            at = high[-1] + 1
        self.high = np.array(high, np.int64)
        top = self.high + self.high * 100 // percent
        self.low = np.concatenate([[1], self.high[:-1] + 1])
        self.differ = [(100 - percent) * int(x) // (100 + percent) for x in top]

    def interval(self, size: int) -> int:
        return int(np.searchsorted(self.high, size))

    def parts(self, k: int) -> int:
        """Parts for sets that meet in interval k: one more than may differ, and spare ones for empty parts, as many as the
        smallest set with the least share of shared shingles may have."""
        d, n = self.differ[k], self.differ[k] + 1
        for _ in range(6):
            empty = n * math.exp(-self.percent / 100 * float(self.low[k]) / n)
            n = d + 1 + (int(empty + 4 * math.sqrt(empty)) if empty > 1 else 0)
        return n


def _signatures(values: np.ndarray, size: int, bounds: Bounds, tries: int = 4) -> np.ndarray:
    """Hashes of the parts of one set's shared shingles, for the interval of its whole size and the one below."""
    out = []
    own = bounds.interval(size)
    for k in (own, own - 1):
        if k < 0 or not bounds.differ[k]:
            continue  # only equal sets can be similar, and those are one class
        n, d = bounds.parts(k), bounds.differ[k]
        for t in range(tries):
            mixed = N.mix(values, 1000 + k * 8 + t)
            part = ((mixed >> N.U64(32)) % N.U64(n)).astype(np.int64)
            filled = np.bincount(part, minlength=n)
            low = np.bincount(part, (mixed & N.U64(0xFFFFFFFF)).astype(np.float64), n).astype(N.U64)
            other = np.bincount(part, (N.mix(values, 77) >> N.U64(34)).astype(np.float64), n).astype(N.U64)
            with np.errstate(over="ignore"):
                sign = N.mix(low * N.U64(0x9E3779B97F4A7C15) + other, 2000 + k * 8 + t) + np.arange(n).astype(N.U64) * N.U64(0xC2B2AE3D27D4EB4F)
            out.append(N.mix(sign, 5)[filled > 0])
            if n - np.count_nonzero(filled) < n - d:
                break
        else:
            out.append(N.mix(np.array([k], N.U64), 9))
    return np.concatenate(out) if out else np.zeros(0, N.U64)


def _local_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index of each connected component of edges (a, b) over n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
    return label


def _forest(nodes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node of its component) for index edges over sorted distinct nodes."""
    label = _local_labels(a, b, len(nodes))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _equal_signs(signs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sign, node) with one node for each sign, and the edges that this merging stands for."""
    order = np.lexsort((nodes, signs))
    signs, nodes = signs[order], nodes[order]
    first = np.concatenate([[True], signs[1:] != signs[:-1]]) if len(signs) else np.zeros(0, bool)
    lead = nodes[np.flatnonzero(first)][np.cumsum(first) - 1] if len(signs) else nodes
    other = lead != nodes
    keys, back = np.unique(np.concatenate([lead[other], nodes[other]]), return_inverse=True)
    half = len(back) // 2
    ea, eb = _forest(keys, back[:half], back[half:])
    return signs[first], nodes[first], ea, eb


def row_key() -> Column:
    """A hash of doc_id and text: rows that share it are repetitions of one row."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def jaccard_join(
    docs: DataFrame,
    width: int = 4,
    percent: int = 85,
    cell_shingles: int = 1_500_000,
    shard_keys: int = 3_000_000,
    group_chars: int = 8_000_000,
    broadcast_rows: int = 500_000,
    keyed: bool = False,
) -> DataFrame:
    """Link documents whose shingle sets have 100 * |A and B| >= percent * |A or B|.

    docs: doc_id (integer) and text; other columns are ignored. Returns one row for each
    input row: doc_id, n_shingles, component_id, n_links (other documents that link directly,
    copies included). A null or wordless text has no shingle, no link, and its own doc_id as
    component; repeated rows are documents of their own with the same doc_id; a null doc_id stays null and never
    names a component that has another. A text with fewer words than `width` is one shingle. Texts are read whole, however long,
    in memory linear in the longest. An empty table gives an empty table. Of rows that share the least doc_id of a component the
    least row_key counts as first.
    keyed: also row_key, the row_key() of the row, and first_key, that of the row with the least doc_id in its component.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), row_key().alias("row_key"))
    bounds = Bounds(percent)

    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    floor = shuffle_partitions(spark)
    groups = max(floor, math.ceil(chars / group_chars))
    # most words have five letters and a space
    shards = max(floor, math.ceil(chars / 6 / shard_keys))
    bits = max(32, min(62, math.ceil(math.log2(chars + 2)) + 4))  # one shingle in some hundred has the hash of another
    gap = 2 if bits < 35 else 3 if bits < 43 else 4
    # the number of the input's partition spreads repeated rows
    dealt = docs.withColumn("dealt", F.pmod(F.xxhash64("row_key", F.spark_partition_id()), F.lit(groups)).cast("int"))

    def distinct(texts) -> tuple[list, list, np.ndarray, np.ndarray, np.ndarray]:
        """(node and size of each text, distinct sets with their nodes, their shingles' hashes, places of these, counts)."""
        rows, sets = [], {}
        for _, values in _sets(texts, width):
            rows.append((_node(values) if len(values) else None, len(values)))
            if len(values):
                sets.setdefault(rows[-1][0], values)
        short = np.concatenate([np.zeros(0, N.U64), *sets.values()]) >> N.U64(64 - bits)
        keys, at, count = np.unique(short, return_inverse=True, return_counts=True)
        return rows, sets, keys, at.astype(np.int32), count

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, keys, _, count = distinct(pdf["text"])
        cut = N.cuts(keys, bits, shards)
        parts = [slice(cut[s], cut[s + 1]) for s in range(shards)]
        out = pd.DataFrame([(s, int(pdf["dealt"].iat[0]), N.packed_keys(keys[p], gap), np.packbits(count[p] > 1).tobytes()) for s, p in enumerate(parts) if p.stop > p.start], columns=["shard", "dealt", "keys", "often"])
        N.release()
        return out

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [N.unpacked_keys(k, gap) for k in pdf["keys"]]
        often = [np.unpackbits(np.frombuffer(o, np.uint8), count=len(k)) for o, k in zip(pdf["often"], keys, strict=True)]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        shared = np.bincount(at, 1.0 + np.concatenate(often)) > 1
        cut = np.cumsum([0, *map(len, keys)])
        out = pd.DataFrame({"dealt": pdf["dealt"], "shard": pdf["shard"], "shared": [np.packbits(shared[at[cut[i] : cut[i + 1]]]).tobytes() for i in range(len(keys))], "n": np.diff(cut)})
        N.release()
        return out

    def sign(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows, sets, keys, at, _ = distinct(pdf["text"])
        answers = answers.sort_values("shard")
        shared = np.concatenate([np.zeros(0, np.uint8), *[np.unpackbits(np.frombuffer(s, np.uint8), count=n) for s, n in zip(answers["shared"], answers["n"], strict=True)]]).astype(bool)
        if len(shared) != len(keys):
            raise RuntimeError("a group of texts changed between its question and the answer: write the table before joining it")
        shared = shared[at]
        signs, nodes, first = [np.zeros(0, N.U64)], [np.zeros(0, np.int64)], 0
        for node, values in sets.items():
            own = values[shared[first : first + len(values)]]
            first += len(values)
            if 100 * len(own) >= percent * len(values):
                signs.append(_signatures(own, len(values), bounds))
                nodes.append(np.full(len(signs[-1]), node, np.int64))
        signs, nodes, ea, eb = _equal_signs(np.concatenate(signs), np.concatenate(nodes))
        # signs are sorted, so the high bits deal them to shards in runs
        cut = N.cuts(signs, 64, shards)
        messages = [{"shard": s, "signs": signs[cut[s] : cut[s + 1]].tobytes(), "nodes": nodes[cut[s] : cut[s + 1]].tobytes(), "ea": ea[s::shards].tobytes(), "eb": eb[s::shards].tobytes()} for s in range(shards) if cut[s + 1] > cut[s] or len(ea[s::shards])]
        described = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "row_key": pdf["row_key"].astype("Int64"), "node": pd.array([r[0] for r in rows], "Int64"), "n_shingles": [r[1] for r in rows]})
        N.release()
        return pd.concat([described, pd.DataFrame(messages, columns=["shard", "signs", "nodes", "ea", "eb"])]).astype({"shard": "Int32", "doc_id": "Int64", "row_key": "Int64", "node": "Int64", "n_shingles": "Int64"})

    # all columns of dealt, so that the texts are shuffled once for this and for the next step
    asked = dealt.groupBy("dealt").applyInPandas(ask, "shard int, dealt int, keys binary, often binary")
    answered = asked.groupBy("shard").applyInPandas(answer, "dealt int, shard int, shared binary, n int")
    signed = durable(dealt.groupBy("dealt").cogroup(answered.groupBy("dealt")).applyInPandas(sign, "doc_id long, row_key long, node long, n_shingles long, shard int, signs binary, nodes binary, ea binary, eb binary"))
    rows = signed.where("shard IS NULL").select("doc_id", "row_key", "node", "n_shingles")
    # a class is read again by the key of one of its rows, which is never null
    lead = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row_key"))).alias("lead")
    classes = durable(rows.where("node is not null").groupBy("node").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("rep"), lead, F.first("n_shingles").alias("n"), F.count("*").alias("copies")))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        joined = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in pdf[c]])
        _, _, ea, eb = _equal_signs(joined("signs", N.U64), joined("nodes", np.int64))
        pairs = np.unique(np.stack([np.concatenate([ea, joined("ea", np.int64)]), np.concatenate([eb, joined("eb", np.int64)])], 1), axis=0)
        N.release()
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    signed = signed.where("shard IS NOT NULL").select("shard", "signs", "nodes", "ea", "eb")
    near = components(signed.groupBy("shard").applyInPandas(meet, "a long, b long"))

    # every node of a block, with its class; blocks are sums, not lists
    member = near.select("node", F.col("component").alias("block")).union(near.select("component", "component").distinct())
    member = joined = durable(member.join(classes, "node"))
    forget(near)
    small = member.groupBy("block").agg(F.sum("n").alias("all_n"), F.count("*").alias("all_nodes")).withColumn("whole", (F.col("all_n") <= cell_shingles) & (F.col("all_nodes") <= 8192))
    # k: the size interval, so that similar sets are in the same or in neighbouring ones
    interval = F.expr(f"size(filter(array({', '.join(f'{h}L' for h in bounds.high)}), h -> h < n))")
    small = durable(small)
    member = member.join(small, "block").withColumn("k", F.when(F.col("whole"), F.lit(0)).otherwise(interval).cast("int"))
    cells = member.groupBy("block", "k").agg(F.sum("n").alias("cell_n"), F.count("*").alias("cell_nodes"))
    cells = durable(cells.withColumn("cells", F.greatest(F.ceil(F.col("cell_n") / cell_shingles), F.ceil(F.col("cell_nodes") / 8192)).cast("int")))
    member = member.join(cells.select("block", "k", "cells"), ["block", "k"]).withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    # a task for each pair of cells whose sizes may be similar; a cell's product with itself joins its task with the next interval, if there is one
    sides = cells.select("block", "k", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    following = cells.select("block", (F.col("k") - 1).alias("k1"), F.lit(True).alias("followed"))
    left = sides.select("block", F.col("k").alias("k1"), F.col("cell").alias("c1")).join(following, ["block", "k1"], "left")
    left = left.withColumn("k", F.explode(F.array(F.col("k1"), F.col("k1") + 1)))
    pairs = left.join(sides, ["block", "k"]).where("k > k1 OR cell > c1 OR (cell = c1 AND followed IS NULL)")
    pairs = pairs.select("block", "k1", "c1", F.col("k").alias("k2"), F.col("cell").alias("c2"))
    pairs = durable(pairs.withColumn("task", F.xxhash64("block", "k1", "c1", "k2", "c2")))
    same = "k1 = k2 AND c1 = c2"
    own = F.when(F.expr(f"({same}) OR (k2 > k1 AND c2 = 0)"), F.lit(2)).otherwise(F.lit(0))
    seats = pairs.select("task", "block", F.col("k1").alias("k"), F.col("c1").alias("cell"), own.alias("side"))
    seats = seats.union(pairs.where(f"NOT ({same})").select("task", "block", F.col("k2").alias("k"), F.col("c2").alias("cell"), F.lit(1).alias("side")))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # of repeated rows, one in a task is enough
        for pdf in batches:
            ok, values = np.zeros(len(pdf), bool), [b""] * len(pdf)
            nodes = pdf["node"].tolist()
            for i, v in _sets(pdf["text"], width):
                if len(v) and nodes[i] not in seen and _node(v) == nodes[i]:
                    ok[i], values[i] = True, v.tobytes()
                    seen.add(nodes[i])
            yield pdf.drop(columns="text").assign(values=values)[ok]
        N.release()

    # few members are broadcast, behind a count; more are joined by shuffling the texts
    members = durable(member.select("row_key", "node", "copies", "block", "k", "cell"))
    few = members.limit(broadcast_rows + 1).count() <= broadcast_rows
    sets = docs.select("row_key", "text").join(F.broadcast(members) if few else members, "row_key")
    sets = sets.select("node", "copies", "block", "k", "cell", "text").mapInPandas(encode, "node long, copies long, block long, k int, cell int, values binary")
    seated = sets.join(seats, ["block", "k", "cell"]).select("task", "side", "node", "copies", "values")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        nodes = pdf["node"].to_numpy()
        label, links = link(product([np.frombuffer(x, N.U64) for x in pdf["values"]], pdf["side"].to_numpy(), percent), pdf["copies"].to_numpy())
        N.release()
        linked = np.flatnonzero(links)
        return pd.DataFrame({"a": nodes[linked], "b": nodes[label[linked]], "links": links[linked]})

    found = durable(seated.groupBy("task").applyInPandas(multiply, "a long, b long, links long"))
    stars = components(found.select("a", "b"))
    group = stars.union(stars.select("component", "component").distinct())
    group = group.join(classes, "node").select("node", "component", "rep", "lead")
    group = durable(group)
    least = durable(group.groupBy("component").agg(F.min("rep").alias("component_id"), F.min("lead").alias("first")))
    by_node = group.join(least, "component").select("node", "component_id", "first")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    by_node = by_node.join(links, "node", "left")
    by_node = durable(classes.join(by_node, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("first.row_key", "lead.row_key").alias("first_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    forget(classes, joined, members, small, cells, pairs, found, stars, group, least)
    out = rows.join(by_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *(["row_key", F.coalesce("first_key", "row_key").alias("first_key")] if keyed else []))


def product(values: list[np.ndarray], side: np.ndarray, percent: int, rows: int = 256, columns: int = 1024, pairs: int = 1_500_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row indices, column indices, whether the overlap of each pair reaches the bound), range of rows by range of rows.

    side: 2 meets all, 0 and 1 meet the other. Rows are ordered by size, so each range of rows meets one range of columns, from
    its own first row on. N-grams held by many rows are multiplied as dense chunks; the others are counted pair by pair. What is
    held at once is bounded by `pairs`, however many pairs are similar.
    """
    order = np.argsort([len(v) for v in values], kind="stable")
    values, kind = [values[i] for i in order], side[order]
    size = np.array([len(v) for v in values], np.int64)
    if len(size) < 2:
        return
    row = np.repeat(np.arange(len(size)), size)
    _, column, held = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    keep = held[column] > 1
    row, column = row[keep], column[keep]
    dense = held[column] > 24
    names, dense_column = np.unique(column[dense], return_inverse=True)
    dense_row = row[dense]
    by_column = np.argsort(column[~dense], kind="stable")
    thin_column, thin_row = column[~dense][by_column], row[~dense][by_column]
    last = np.searchsorted(thin_column, thin_column, "right")
    reach = last - np.arange(len(thin_row)) - 1  # the later rows of the same column
    dense_at = np.searchsorted(dense_row, np.arange(len(size) + 1))
    thin_order = np.argsort(thin_row, kind="stable")
    thin_at = np.searchsorted(thin_row[thin_order], np.arange(len(size) + 1))
    weight = np.bincount(thin_row, reach, len(size)) + pairs // rows + len(size) - np.arange(len(size))
    for r0, r1 in N.slices(weight, pairs):
        top = int(np.searchsorted(size * percent, size[r1 - 1] * 100, "right"))  # larger sets cannot reach the bound
        counts = np.zeros((r1 - r0, top - r0), np.float32)
        for c0 in range(0, len(names), columns):
            own = slice(dense_at[r0], dense_at[top])
            pick = (dense_column[own] >= c0) & (dense_column[own] < c0 + columns)
            if pick.any():
                block = np.zeros((top - r0, min(columns, len(names) - c0)), np.float32)
                block[dense_row[own][pick] - r0, dense_column[own][pick] - c0] = 1
                counts += block[: r1 - r0] @ block.T
        mine = thin_order[thin_at[r0] : thin_at[r1]]
        n = reach[mine]
        if n.sum():
            base = np.repeat(mine, n)
            other = base + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            b = thin_row[other]
            ok = b < top
            flat = (thin_row[base[ok]] - r0) * (top - r0) + b[ok] - r0
            counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        overlap = counts.astype(np.int64)
        good = (100 + percent) * overlap >= percent * (size[r0:r1, None] + size[None, r0:top])
        good &= np.arange(r0, top)[None, :] > np.arange(r0, r1)[:, None]
        good &= (kind[r0:r1, None] == 2) | (kind[r0:r1, None] != kind[None, r0:top])
        yield order[r0:r1], order[r0:top], good


def link(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least index of each component, links of each node with copies counted) from a product's ranges, none of which is kept."""
    label, links = np.arange(len(copies)), np.zeros(len(copies))
    weight = copies.astype(float)
    for rows, columns, good in found:
        links[rows] += good @ weight[columns]
        links[columns] += weight[rows] @ good
        for k in np.flatnonzero(good.any(1)):
            near = label[columns[good[k]]]
            least = min(int(near.min()), int(label[rows[k]]))
            if least != label[rows[k]] or (near != least).any():  # each time there is one component less
                met = np.zeros(len(label), bool)
                met[near] = met[label[rows[k]]] = True
                label[met[label]] = least
    return label, np.rint(links).astype(np.int64)
