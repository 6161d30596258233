"""Groups of spelling variants: words at one edit from each other, found by their rarest bigrams.

An edit changes two bigrams of a word at most, and moves those behind it by one place at most. Sort
the bigrams of a word by how rare they are in the vocabulary, equal ones by place: the first one
that an edit leaves is among the three first of both words, as at most two stand before it on either
side. So each word is joined on its three rarest bigrams only, among words of fitting lengths, and
at equal places seen from the end of the word that the edit is not at: all that stands between that
end and the bigram must agree too, which the key of the join holds. A verification of the distance
follows.

The alphabet is 90 letters, so that there are 8,100 bigrams at most; only their counts reach the
driver and the tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_array

#: Distinct words that a task counts before it hands them on.
HELD = 1 << 18
#: From so many characters on, the runs of a text are walked one by one instead of listed.
LONG_TEXT = 1 << 20


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, every: int = 31) -> DataFrame:
    """``(word, n)``: the runs of letters of all texts, noised, and how often they occur.

    A run is a maximal one of ``[A-Za-z\\u00C0-\\u00FF]``; only A-Z are lower-cased. Where ``every``
    divides the crc32 of ``<id>:<run>``, the run loses its code point number crc32 mod length.
    Results under ``shortest`` code points don't count. A null text holds no runs; a null id reads
    as the empty string; repeated rows count again.
    """
    run = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")

    def batch_of(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            texts = pc.ascii_lower(text_array(batch.column(1)))
            for doc, text in zip(batch.column(0), texts):
                key, text = zlib.crc32(f"{'' if doc.as_py() is None else doc.as_py()}:".encode()), text.as_py()
                runs = Counter(run.findall(text) if len(text) < LONG_TEXT else (m.group() for m in run.finditer(text)))
                for word, n in runs.items():
                    h = zlib.crc32(word.encode(), key)
                    if h % every == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1 :]
                        if len(word) < shortest:
                            continue
                    found[word] += n
                if len(found) >= HELD:
                    yield batch_of(found)
                    found = Counter()
        yield batch_of(found)

    return docs.select(id_col, text_col).mapInArrow(tally, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bigrams(words: pa.Array) -> tuple[np.ndarray, ...]:
    """Number of the word, place and code of each bigram; the words' lengths and odd letters; letters are below 256."""
    listed = words.to_pylist()
    data = np.frombuffer("".join(listed).encode("latin-1"), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, listed), np.int64, len(listed))
    ends = np.cumsum(size)
    starts_one = np.ones(len(data), bool)
    starts_one[ends - 1] = False
    at = np.flatnonzero(starts_one)
    word = np.repeat(np.arange(len(listed)), size - 1)
    odd = np.bitwise_xor.reduceat(np.left_shift(1, data & 63), ends - size)
    return word, at - (ends - size)[word], data[at] << 8 | data[at + 1], size, odd


def bigram_ranks(words: DataFrame) -> np.ndarray:
    """The place of each bigram code from rarest to most frequent over the distinct words, ties by code."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_bigrams(batch.column(0))[2], minlength=1 << 16)
        gram = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(gram, pa.int32()), "n": pa.array(total[gram], pa.int64())})

    counts = np.zeros(1 << 16, np.int64)
    for r in words.select("word").mapInArrow(tally, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r.gram] = r.n
    ranks = np.empty(1 << 16, np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(1 << 16)
    return ranks


def rarest_bigrams(words: DataFrame, ranks: np.ndarray, keep: int = 3) -> DataFrame:
    """``(word, n, gram, place, size, odd)``: the ``keep`` rarest bigrams of each word of over ``keep`` code points.

    Bit b of odd is set if the letters whose code is b mod 64 are odd in number: an edit changes two bits at most.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            word, place, gram, size, odd = _bigrams(batch.column(0))
            order = np.argsort(word << 16 | ranks[gram], kind="stable")
            first = np.cumsum(size - 1) - (size - 1)
            chosen = order[(first[:, None] + np.arange(keep)).ravel()]
            rows = pa.array(word[chosen])
            yield pa.RecordBatch.from_pydict({"word": batch.column(0).take(rows), "n": batch.column(1).take(rows)} | {k: pa.array(v[chosen], pa.int32()) for k, v in (("gram", gram), ("place", place), ("size", size[word]))} | {"odd": pa.array(odd[word[chosen]])})

    return words.where(F.length("word") > keep).select("word", "n").mapInArrow(pick, "word string, n long, gram int, place int, size int, odd long")


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, n_a, b, n_b)``, each pair once: words that differ by exactly one code point.

    ``words`` has distinct words, with their n, of at least four letters (a-z, \\u00C0-\\u00FF); the
    proof needs a bigram that an edit leaves. It must have been cut.
    """
    rare = cut(rarest_bigrams(words, bigram_ranks(words)))
    # an edit behind a shared bigram leaves what stands up to its end, one before it what follows from its start
    head, tail = F.expr("substring(word, 1, place + 2)"), F.expr("substring(word, place + 1)")
    keys = lambda more: F.explode(F.array(*[F.xxhash64(F.lit(i), part, F.col("size") + m) for i, part in enumerate((head, tail)) for m in more]))
    left = rare.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("size").alias("size_a"), F.col("odd").alias("odd_a"), keys((0, 1)).alias("key"))
    right = rare.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("size").alias("size_b"), F.col("odd").alias("odd_b"), keys((0,)).alias("key"))
    fits = ((F.col("size_a") < F.col("size_b")) | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= 2)
    met = left.join(right, "key").where(fits & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").dropDuplicates(["a", "b"])


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, times: int = 10, every: int = 31) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word that occurs ``least`` times.

    The form of a word is its near word of largest n (ties: the smallest in code-point order), if
    that is ``times`` times its own n at least; the root is where the forms lead. Words without near
    ones have n_near 0, no form, and are their own root. What null texts and ids and repeated rows
    give is said at :func:`count_words`; an empty table gives no words.
    """
    if shortest < 4 or times < 2:
        raise ValueError("words of four code points at least, and forms at least twice as frequent")
    words = cut(count_words(docs, id_col, text_col, shortest, every).where(F.col("n") >= least))
    pairs = near_pairs(words)
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    known = alone.unionByName(pairs.select(both.alias("p")).select("p.*")).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    formed = -F.col("best.less") >= times * F.col("n")
    known = cut(known.select("word", "n", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")))
    # each form is `times` times as frequent as its word, which bounds the length of a chain
    steps, most = 0, (known.agg(F.max("n")).first()[0] or 0) // (least * times)
    while most:
        steps, most = steps + 1, most // times
    up = known.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(steps)) if steps else 0):  # each round doubles the steps that are taken
        up = cut(up)
        up = up.join(up.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return known.join(up, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants_sql() -> str:
    """DuckDB SQL for the rows of :func:`variants` over ``documents``, written from the definitions."""
    return r"""
WITH RECURSIVE crc_table(i, c, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc_table WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM crc_table WHERE k = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
), counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
coded AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, unicode(ch)::BIGINT - 64] END))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h
  FROM counted, tab
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM coded)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cuts AS (
  SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT DISTINCT a.word AS word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most FROM pairs GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
    CASE WHEN b.most >= 10 * w.n THEN (SELECT min(near) FROM pairs p WHERE p.word = w.word AND p.near_n = b.most) END AS form,
    CASE WHEN b.most >= 10 * w.n THEN b.most END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain(word, stop) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.stop = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.stop AS root
FROM formed f JOIN chain c ON f.word = c.word JOIN formed g ON c.stop = g.word AND g.form IS NULL
"""
