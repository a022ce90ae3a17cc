"""Spelling variants by an index of variable-length grams.

Words are counted over all texts. A dictionary of frequent grams says how long a gram has to be: at each place of a word, between the
marks `^` and `$`, the gram is the shortest of at least two characters that is not frequent, up to a length that depends on the words
compared. As a gram is chosen by its own characters alone, an edit changes only grams that contain the edited place. The
most grams over one place therefore bound how many one edit can affect: two near words share all but so many grams, so
one of the rarest of these and one more is among them. Only these short lists are merged, by gram, place and length;
each pair met is verified.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, durable, forget

LETTERS = r"[A-Za-zÀ-ÿ]"
SHORTEST, LONGEST = 2, 8


def corpus_words(docs: DataFrame, edit_modulus: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """word and n, its occurrences, for words of at least `least_length` code points that occur at least `least_count` times in all texts.

    Words are maximal runs of LETTERS, A-Z lower-cased. Where the crc32 of `<doc_id>:<run>` (nothing for a null doc_id) is divisible by
    `edit_modulus`, the code point at that crc32 modulo the run's length is deleted.
    """
    doc, run = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("run")
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({LETTERS}{{{least_length},}})"), F.lit(1))).alias("run"))
    h = F.crc32(F.concat(F.col("doc"), F.lit(":"), run))
    at = (F.col("h") % F.length(run)).cast("int")
    edited = F.when(F.col("h") % edit_modulus == 0, F.concat(F.substring(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)
    words = runs.withColumn("h", h).select(edited.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def longest_gram(length: int) -> int:
    """The longest gram where the shorter of two words has this length: short enough that no edit touches all grams of a word."""
    return max(SHORTEST, min(length, LONGEST))


def decompose(word: str, longest: int, frequent: set[str]) -> list[tuple[str, int]]:
    """The gram at each place of a word with its marks, and the place."""
    marked, out = f"^{word}$", []
    for p in range(len(marked) - SHORTEST + 1):
        end, most = p + SHORTEST, min(p + longest, len(marked))
        while end < most and marked[p:end] in frequent:
            end += 1
        out.append((marked[p:end], p))
    return out


def affected(grams: list[tuple[str, int]], length: int) -> int:
    """The most grams that one insertion, deletion or replacement in a word of this length can affect: those over one of its places."""
    change = [0] * (length + 3)
    for g, p in grams:
        change[max(p, 1)] += 1
        change[p + len(g)] -= 1
    most = now = 0
    for c in change[: length + 1]:
        now += c
        most = max(most, now)
    return most


def rarest(grams: list[tuple[str, int]], least: int, counts: dict[str, int]) -> list[tuple[str, int]]:
    """The `least` rarest grams. Grams that are not frequent come first, in their own order; equal grams by place, an order that an edit does not change."""
    return [(g, p) for _, g, p in sorted((counts.get(g, 0), g, p) for g, p in grams)[:least]]


def one_edit(word: str, other: str, long: int = 64) -> Column:
    """Whether two columns of different words differ by one code point inserted, deleted or replaced; `other` is not the longer one.
    The edit distance costs the square of the length, so long words are compared up to their first difference and after it."""
    at = F.array_position(F.zip_with(F.split(word, ""), F.split(other, ""), lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    further = F.when(F.length(word) == F.length(other), at + 1).otherwise(at)
    by_parts = (F.length(word) - F.length(other) <= 1) & (F.substr(word, at + 1) == F.substr(other, further))
    return F.when(F.length(word) <= long, F.levenshtein(word, other, 1) == 1).otherwise(by_parts)


def frequent_grams(words: DataFrame, entries: int) -> DataFrame:
    """gram and n: the grams of SHORTEST to LONGEST characters that occur more than so often in the distinct words that no more than
    `entries` can, as their occurrences are counted first."""
    sizes = range(SHORTEST, LONGEST + 1)
    total = words.agg(F.sum(sum(F.greatest(F.length("word") + 3 - s, F.lit(0)) for s in sizes))).first()[0] or 0
    above = max(20, -(-total // entries))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            count = Counter()
            for word in pdf["word"]:
                marked = f"^{word}$"
                for s in sizes:
                    count.update([marked[p : p + s] for p in range(len(marked) - s + 1)])
                if len(count) > 500_000:  # what a task holds stays small
                    yield pd.DataFrame({"gram": count.keys(), "k": count.values()})
                    count.clear()
            yield pd.DataFrame({"gram": count.keys(), "k": count.values()})

    return words.select("word").mapInPandas(task, "gram string, k long").groupBy("gram").agg(F.sum("k").alias("n")).where(F.col("n") > above)


def gram_lists(words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """word, n, own (places of its lists among words of its length) and shorter (its lists among words one shorter):
    arrays of struct(gram, place), the rarest grams of the word."""
    shared = words.sparkSession.sparkContext.broadcast(counts)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        for pdf in batches:
            out = {"own": [], "shorter": []}
            for word in pdf["word"]:
                for kind, length in (("own", len(word)), ("shorter", len(word) - 1)):
                    grams = decompose(word, longest_gram(length), counts)
                    out[kind].append([{"gram": g, "place": p} for g, p in rarest(grams, affected(grams, len(word)) + 1, counts)])
            yield pdf.assign(**out)

    lists = "array<struct<gram: string, place: int>>"
    return words.select("word", "n").mapInPandas(task, f"word string, n long, own {lists}, shorter {lists}")


def near_words(words: DataFrame, entries: int = 100_000) -> DataFrame:
    """word, n, other, other_n: all pairs, in both directions, of words that differ by exactly one code point inserted, deleted or replaced.

    words: distinct word and n. The dictionary that tasks hold has at most `entries` grams.
    """
    counts = {r["gram"]: r["n"] for r in frequent_grams(words, entries).collect()}  # at most `entries` short strings
    lists = durable(gram_lists(words, counts))
    key = lambda place, length: F.xxhash64("g.gram", place, length).alias("key")
    own, longer = lists.select("word", "n", F.explode("own").alias("g")), lists.select("word", "n", F.explode("shorter").alias("g"))
    place, length = F.col("g.place"), F.length("word")
    index = own.select(key(place, length), F.col("word").alias("other"), F.col("n").alias("other_n"))
    # a gram after a deleted place stands one place further on in the longer word
    moved = longer.select(F.explode(F.array(place, place - 1)).alias("at"), "word", "n", "g").where("at >= 0")
    probes = own.select(key(place, length), "word", "n").union(moved.select(key(F.col("at"), length - 1), "word", "n"))
    # words of equal length meet once
    met = probes.join(index, "key").where((F.length("word") > F.length("other")) | ((F.length("word") == F.length("other")) & (F.col("word") < F.col("other"))))
    near = durable(met.where(one_edit("word", "other")).select("word", "n", "other", "other_n"))
    forget(lists)
    both = near.union(near.select("other", "other_n", "word", "n")).repartition("word")
    out = durable(both.groupBy("word", "n", "other", "other_n").agg(F.lit(1).alias("_")).drop("_"))
    forget(near)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the end of the path from word to form to its form and so on; forms: distinct word and form, without circles.
    Each round doubles the steps. The result is a table of durable()."""
    now = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = durable(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        forget(now)
        if not new.where("moved").limit(1).count():
            out = new.drop("moved")
            out.written = new.written
            return out
        now = new.drop("moved")
        now.written = new.written


def spelling_variants(docs: DataFrame, entries: int = 100_000, ratio: int = 2, edit_modulus: int = 97) -> DataFrame:
    """word, n, n_near, form, form_n and root for every word of corpus_words().

    docs: doc_id and text; other columns are ignored; a null text has no words; repeated rows count as often as they occur; texts of any
    length are read whole. A word's form is its near word of largest n, ties to the smallest in code-point order, if its n is at least
    `ratio` (at least 2) times the word's; else null. root follows forms to the last and is the word itself if it has none. No words: an empty table.
    """
    words = durable(corpus_words(docs, edit_modulus))
    near = near_words(words, entries)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("own_n"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("b"))
    ok = -F.col("b.minus") >= ratio * F.col("own_n")
    chosen = durable(best.select("word", "n_near", F.when(ok, F.col("b.other")).alias("form"), F.when(ok, -F.col("b.minus")).alias("form_n")))
    forget(near)
    ends = roots(chosen.where("form IS NOT NULL"))
    out = words.join(chosen, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(b))),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
pairs AS (SELECT doc, run, count(*) AS k FROM runs WHERE length(run) >= 5 GROUP BY ALL),
points AS (SELECT doc, run, k, list_transform(string_split(doc || ':' || run, ''), lambda c: ord(c)) AS p FROM pairs),
bytes AS (SELECT doc, run, k, flatten(list_transform(p, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 | (c >> 6), 128 | (c & 63)] END)) AS b FROM points),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(b, lambda x: CAST(x AS BIGINT))), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) AS h FROM bytes, crc),
edited AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
masked AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS rest FROM places),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM masked a JOIN masked b USING (rest) WHERE a.word <> b.word
         UNION SELECT cut.word, cut.n, w.word, w.n FROM cut JOIN w ON cut.rest = w.word
         UNION SELECT w.word, w.n, cut.word, cut.n FROM cut JOIN w ON cut.rest = w.word),
best AS (SELECT word, n, count(*) AS n_near, min((-m, other)) AS b FROM near GROUP BY word, n),
forms AS (SELECT word, n_near, CASE WHEN -b[1] >= 2 * n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * n THEN -b[1] END AS form_n FROM best),
path AS (SELECT word, word AS root FROM w UNION ALL SELECT path.word, forms.form FROM path JOIN forms ON forms.word = path.root WHERE forms.form IS NOT NULL),
ends AS (SELECT path.word, root FROM path LEFT JOIN forms ON forms.word = path.root WHERE forms.form IS NULL)
SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, form, form_n, root FROM w JOIN ends USING (word) LEFT JOIN forms USING (word)
"""
