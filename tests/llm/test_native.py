import hashlib
import math
import random
import re
import struct

import duckdb
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from emberfield.llm import fingerprints as fp
from emberfield.llm import mixing, url_filter


def test_mix_equals_sql_and_reaches_targets(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randrange(1, 5) for _ in range(r.choice([0, 1, 5, 40, 300]))), r.choice(["a", "a", "a", "b", "É", "z", None, "tiny"] if i > 3 else ["one"]), "x") for i in range(600)]
    rows += [(700, None, "null text", "x"), (701, "a b", "two", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(frame).toPandas().sort_values("doc_id").reset_index(drop=True)
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source", "size"])  # noqa: F841
    want = duckdb.sql(mixing.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False, rtol=1e-12)
    got["source"] = documents["source"].fillna("~")
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"), n=("size", "sum"))
    assert ((by.target - by.taken).abs() <= by.most / 2 + 1e-6).all()
    assert (by.target <= 2 * by.n + 1e-9).all() and (got.taken <= 2 * got["size"]).all()
    assert by.target.sum() == pytest.approx(min(1.5 * by.n.sum(), 2 * by.n.sum()))


def test_mixed_repeats_rows_with_any_columns(spark):
    rows = [(i, f"w{i} " * (i % 9), ["a", "b", None][i % 3], f"own {i}", i) for i in range(200)] + [(5, "w " * 100_000, "a", "long", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _key string, copies int")
    taken = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    found = [tuple(r) for r in out.collect()]
    assert set(found) <= set(rows) and all(found.count(r) == taken[r[0], len(r[1].split())] for r in rows)


def test_mix_empty_and_repeats(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    out = mixing.mix(spark.createDataFrame([(1, "a b", None), (1, "a b", None), (None, "", "s")], "doc_id long, text string, source string")).collect()
    assert len(out) == 3 and len({r["taken"] for r in out if r["doc_id"] == 1}) == 1


PAGES = [
    (1, "https://Blog.Example.COM/en/1?x", "<p>"),
    (2, "http://example.com/en/77#t", ""),
    (3, "http://a.example.net/de/81", None),
    (4, "http://a.example.net/de/91", "<link rel=canonical href='/de/81'>"),
    (5, "no scheme", '<link rel="canonical" href="http://x.org/es/">'),
    (6, None, None),
    (7, "http://free.info/a/b", '<head><LINK REL="canonical" HREF="https://x.org/es/1#f"></head>'),
    (8, "http://free.info/c", '<meta http-equiv="refresh" content="0; url=a/b">'),
    (9, "http://other.info/", '<link rel="canonical" href="http://free2.info/q">'),
    (10, "http://free2.info/q", '<link rel="canonical" href="https://example.com/en/7x">'),
    (11, "http://free2.info/r", '<meta http-equiv="refresh" content="0; url=http://y.com/en/">'),
    (12, "http://free3.info/r", '<link rel="canonical" href="http://y.com/en/">'),
    (13, "http://y.com/en/", '<link rel="canonical" href="http://example.com/en/71">'),
    (14, "http://notexample.com/en/7", ""),
    (15, "://", ""),
    (7, "http://free.info/a/b", ""),
    (16, "http://alone.info?u=://z/es/", ""),
]


def test_url_verdicts(spark):
    out = url_filter.judge(spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, node string"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == len(PAGES)
    assert got[1] == ("blog.example.com", "/en/1", "com/en/", "block")
    assert got[2] == ("example.com", "/en/77", "example.com/en/7", "allow")
    assert got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("net/de/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[15] == ("", "", None, "allow")
    assert got[7][2:] == (None, "block") and got[8][2:] == (None, "block")
    assert got[9][2:] == (None, "allow") and got[10][2:] == (None, "allow")
    assert got[13][2:] == ("com/en/", "block") and got[12][2:] == (None, "allow") and got[11][2:] == (None, "allow")
    assert got[14] == ("notexample.com", "/en/7", "com/en/", "block")
    assert got[16] == ("alone.info", "", None, "allow")


def test_url_in_a_very_long_page(spark):
    page = "<p>" + "word <b>x</b> " * 300_000 + "<link rel='canonical' href='https://x.org/es/9'>"
    rows = [(1, "http://free.info/a", page), (1, "http://free.info/a", page), (2, "http://free.info/b", page[:3_000_000])]
    got = sorted(tuple(r) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "rule", "verdict").collect())
    assert got == [(1, None, "block"), (1, None, "block"), (2, None, "allow")]


def test_url_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def edited(rows):
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 40, 500])
def test_fingerprints_of_edited_texts(spark, n):
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdé😀") for _ in range(4))
    rows = [(r.randrange(-50, 5000), "\n".join(" ".join(word() for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(0, 9)))) for _ in range(n)]
    rows += [(None, None), (None, "same"), (3, "same"), (3, "same")] if n > 1 else []
    got = fp.fingerprints(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, r int").repartition(3), bucket_chars=2000).collect()
    assert sorted(((x["doc_id"], x["n_chars"], x["edited_sha256"]) for x in got), key=str) == edited(rows)
    assert len({x["fingerprint"] for x in got if x["n_chars"] == 4 and x["doc_id"] in (3, None)}) <= 2
    assert all(0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1 for x in got)
    if n == 500:
        long = [x for x in got if x["n_chars"] > 80]
        assert sum(x["near_edited"] > x["near_next"] for x in long) > 0.98 * len(long)


def vector(text):
    """The vector by its definition, in plain Python."""
    h = lambda data, seed=42: xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)
    lines = [t for t in (x.strip(" ") for x in text.split("\n")) if t]
    identity, count = [0] * 4, [0] * 64
    for t in lines:
        identity = [(s + h(struct.pack("<i", k), h(t.encode()))) & (1 << 62) - 1 for k, s in enumerate(identity)]
        words = re.split(r"[\x20\x09-\x0D]+", t)
        for i in range(max(1, len(words) - 1)):
            count[(h(words[i + 1].encode(), h(words[i].encode())) if len(words) > 1 else h(words[0].encode())) & 63] += 1
    return [*identity, sum(count), *[count[k] + (count[k + 1] << 31) for k in range(0, 64, 2)]], count


def alike(a, b):
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True)) - sum(x) * sum(y) / 64
    (va, a), (vb, b) = vector(a), vector(b)
    norm = math.sqrt(dot(a, a) * dot(b, b))
    return 1.0 if va == vb else max(0.0, min(1.0, dot(a, b) / norm)) if norm else 0.0


def test_fingerprints_equal_brute_force(spark):
    r = random.Random(8)
    rows = [(i * 3 - 40, "\n".join(" ".join(r.choice(["a", "bb", "é", "😀x"]) + str(r.randrange(30)) for _ in range(r.randrange(0, 14))) for _ in range(r.randrange(0, 9)))) for i in range(120)]
    rows += [((1 << 60) + k, f"line one\nline {k}\n\n  and \t more " * 5) for k in range(20)] + [(5000, None), (5001, ""), (5002, "word"), (5003, " "), (5004, "one line of twelve words, and the cut falls within this line")]
    rows += [(6000, " ".join(f"w{k % 977}" for k in range(1_100_000)) + "\nlast line")]  # over 2^20 pairs
    got = {x["doc_id"]: x for x in fp.fingerprints(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, v int").repartition(3), bucket_chars=3000).collect()}
    rows.sort()
    text = lambda v: "".join(f"{x:016x}" for x in v[0])
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        changed = t[: len(t) - q] + following[:q]
        assert got[i]["fingerprint"] == text(vector(t)) and got[i]["edited_fingerprint"] == text(vector(changed))
        assert got[i]["near_edited"] == pytest.approx(alike(t, changed), abs=1e-9) and got[i]["near_next"] == pytest.approx(alike(t, following), abs=1e-9)


def test_ranges_start_at_keys(spark):
    frame = spark.createDataFrame([((1 << 62) + k // 2,) for k in range(300)] + [(-(1 << 63),), ((1 << 63) - 1,)], "_key long")
    starts = fp._starts(frame, 9)
    assert starts == sorted(set(starts)) and starts[0] == -(1 << 63) and len(starts) > 1
    got = frame.select("_key", fp._rank(starts, "_key").alias("r")).collect()
    assert all(x["r"] == sum(s <= x["_key"] for s in starts) for x in got)


def test_fingerprint_is_a_sum_of_paragraphs(spark):
    frame = spark.createDataFrame([("a b c\nd e\nlone", "lone\n a b c \nd e", "d e\nlone", "a b c")], "x string, y string, z string, p string")
    for c in "xyzp":
        frame = fp.with_vector(frame, c, c + "v")
    row = frame.select(fp.text_of("xv").alias("x"), fp.text_of("yv").alias("y"), fp.add("zv", "pv").alias("grown"), "xv", "zv", fp.add("xv", "pv", -1).alias("cut")).first()
    assert row["x"] == row["y"] and row["grown"] == row["xv"] and row["cut"] == row["zv"] and re.fullmatch("[0-9a-f]{592}", row["x"])


def test_fingerprints_empty(spark):
    assert fp.fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_likeness_of_equal_and_empty(spark):
    frame = fp.with_vector(fp.with_vector(spark.createDataFrame([("a b", ""), ("", ""), ("a b", "a b")], "x string, y string"), "x", "v"), "y", "w")
    assert [r[0] for r in frame.select(fp.likeness("v", "w"), F.lit(1)).collect()] == [0.0, 1.0, 1.0]


def test_only_real_addresses_are_aliases(spark):
    link = lambda to: f'<html><head><link rel="canonical" href="{to}"></head></html>'
    pages = [
        (1, "foo?next=http://a.com/en/1", link("/x")), (2, "bar?next=http://ok.org/1", ""), (3, "/x?u=http://fine.org/", ""), (4, "foo?next=http://b.net/1", link("http://c.com/en/2")),
        (5, "http://d.net/1", f'<!-- {link("http://c.com/en/2")} -->'), (6, "http://e.net/1", f'<script>var x = \'{link("http://c.com/en/2")}\'</script>'),
        (7, "http://f.net/1", '<link data-rel="canonical" href="http://c.com/en/2">'), (8, "HTTP://G.net/1#top", link("http://c.com/en/2")), (9, "http://g.net/1", None), (10, None, link("http://c.com/en/2")), (11, "//x", ""),
    ]
    got = {r["page_id"]: (r["host"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: ("a.com", "block"), 2: ("ok.org", "allow"), 3: ("fine.org", "allow"), 4: ("b.net", "block"), 5: ("d.net", "allow"), 6: ("e.net", "allow"), 7: ("f.net", "allow"), 8: ("g.net", "block"), 9: ("g.net", "block"), 10: ("", "allow"), 11: ("", "allow")}


def test_rows_of_one_id_or_none_are_no_block(spark):
    rows = [(7, " ".join(f"w{i}" for _ in range(50)), "a") for i in range(20)] + [(None, f"v{i} " * 20, "b") for i in range(40)] + [(100 + i, "x " * 30, "c") for i in range(60)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, of in got.groupby("source_size"):
        assert abs(of["taken"].sum() - of["target"].iat[0]) <= 0.5 * of["size"].max()
    assert len(got) == 120
