"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of words of a lexicon (a fixed list, and words and word stems
that mark toxic training texts), their nearness to the second person, capitals, punctuation,
repeated characters and obfuscated spellings. Words are counted and features taken where the texts
are; the trees are grown on the driver over the features of a bounded sample of labelled rows;
scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import lgamma, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, text_array

#: Labelled rows that are learned from at most, taken in the order of a hash of doc_id.
TRAIN_ROWS = 20_000
#: Bytes of their texts together at most.
TRAIN_BYTES = 1 << 28

# Common insults and second-person words of English, German, French and Spanish.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting trash garbage scum clown "
    "fool jerk imbecile cretin filth vermin creep bastard bitch shit crap asshole bullshit fuck fucking "
    "dummkopf trottel arschloch abschaum drecksau scheisse scheiße wichser "
    "idiote imbécile connard connasse salaud ordure abruti merde crétin "
    "idiota imbécil estúpido estúpida gilipollas cabrón basura escoria mierda".split()
)
SECOND = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split())

_TOKEN = re.compile(r"[^\W_]+(?:[*@$!1][^\W_]+)*")
_LEET = str.maketrans("013457@$!", "oieastasi")
_OBFUSCATED = re.compile(r"\b(?:\w[.\-*_]){3,}\w\b|\w[*@$]+\w")
_RUN = re.compile(r"(.)\1{3,}")
STEMS = (4, 5, 6)
NAMES = ["words", "lexicon", "lexicon_share", "learned", "learned_share", "stems", "stems_share", "near_second", "second_share", "upper", "punct", "exclaim", "symbols", "digits", "obfuscated", "leet_hits", "runs", "mean_word", "distinct"]


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def features(text: str, learned: frozenset[str], stems: frozenset[str]) -> list[float]:
    words = tokens(text)
    n, size = len(words), max(1, len(text))
    at, fixed, own, roots, leet = [], 0, 0, 0, 0
    for i, w in enumerate(words):
        if w in INSULTS:
            fixed += 1
            at.append(i)
        if w in learned:
            own += 1
            at.append(i)
        elif len(w) >= 4 and (w[:5] in stems or w[:4] in stems or w[:6] in stems):
            roots += 1
            at.append(i)
        if not w.isalpha() and w.translate(_LEET) in INSULTS:
            leet += 1
    second = {i for i, w in enumerate(words) if w in SECOND}
    near = sum(1 for i in at if any(j in second for j in range(i - 5, i + 6))) if second else 0
    d = max(1, n)
    letters = sum(map(str.isalpha, text)) or 1
    upper = sum(map(str.isupper, text))
    odd = sum(text.count(c) for c in "*#$%&@^~")
    return [log(1 + n), fixed, fixed / d, own, own / d, roots, roots / d, near, len(second) / d, upper / letters, sum(text.count(c) for c in ".,;:?!-") / size, text.count("!") / size, odd / size, sum(map(text.count, "0123456789")) / size, len(_OBFUSCATED.findall(text)) / d if odd or "-" in text or "_" in text else 0.0, leet, len(_RUN.findall(text)), letters / d, len(set(words)) / d]


# -- learning, on the driver, over the bounded sample -------------------------------------------


def count_words(texts: list[str], labels: list[int]) -> tuple[list[Counter], list[Counter]]:
    """In how many texts of label 0 and of label 1 each word is, and each stem."""
    words: list[Counter] = [Counter(), Counter()]
    roots: list[Counter] = [Counter(), Counter()]
    for t, y in zip(texts, labels):
        own = set(tokens(t))
        words[y].update(own)
        roots[y].update({w[:k] for w in own for k in STEMS if len(w) >= k})
    return words, roots


def marking(counts: Iterator[tuple[str, int, int]], tried: int, base: float, most: int = 3000) -> frozenset[str]:
    """Of ``tried`` words those of (word, toxic texts, all texts) whose texts are toxic far more often than chance would let any of them be."""
    out = []
    for w, k, n in counts:
        # in logarithms: the number of ways to choose k of n texts outgrows a double
        ways = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
        if k >= 4 and k >= 0.9 * n and ways + k * log(base) + log(tried) < log(0.05):
            out.append((k, w))
    return frozenset(w for _, w in sorted(out, reverse=True)[:most])


def base_rate(toxic: int, texts: int) -> float:
    return min(0.5, max(1e-3, toxic / max(1, texts)))


def learn_lexicon(texts: list[str], labels: list[int], most: int = 3000) -> tuple[frozenset[str], frozenset[str]]:
    """Words and word stems that mark toxic texts."""
    base = base_rate(sum(labels), len(labels))
    words, roots = (marking(((w, k, k + c[0][w]) for w, k in c[1].items()), max(1, len(c[0].keys() | c[1].keys())), base, most) for c in count_words(texts, labels))
    return words, roots


class Trees:
    """Boosted regression trees of the logistic loss over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, smooth: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.smooth = rounds, depth, rate, bins, smooth
        self.base, self.trees, self.cuts = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(p / (1 - p)))
        self.cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, self.bins + 1)[1:-1])) if len(np.unique(c)) > 1 else np.zeros(0) for c in x.T]
        z = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            node, tree = np.zeros(len(y), int), []
            for _ in range(self.depth):
                split = {}
                for k in np.unique(node):
                    own = node == k
                    split[k] = self._best(z[own], (y - q)[own], (q * (1 - q))[own])
                tree.append(split)
                go = np.zeros(len(y), int)
                for k, s in split.items():
                    if s:
                        own = node == k
                        go[own] = z[own, s[0]] > s[1]
                node = node * 2 + go
            leaves = np.zeros(2**self.depth)
            for k in np.unique(node):
                own = node == k
                leaves[k] = self.rate * (y - q)[own].sum() / ((q * (1 - q))[own].sum() + self.smooth)
            self.trees.append((tree, leaves))
            score = score + leaves[node]
        return self

    def _best(self, z: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, at = 1e-6, None
        whole = g.sum() ** 2 / (h.sum() + self.smooth)
        for f, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            gs, hs = np.cumsum(np.bincount(z[:, f], g, len(cuts) + 1))[:-1], np.cumsum(np.bincount(z[:, f], h, len(cuts) + 1))[:-1]
            gain = gs**2 / (hs + self.smooth) + (g.sum() - gs) ** 2 / (h.sum() - hs + self.smooth) - whole
            if gain.max() > best:
                best, at = float(gain.max()), (f, int(gain.argmax()))
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        z = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], axis=1) if len(x) else None
        for tree, leaves in self.trees if len(x) else []:
            node = np.zeros(len(x), int)
            for split in tree:
                go = np.zeros(len(x), int)
                for k, s in split.items():
                    if s:
                        own = node == k
                        go[own] = z[own, s[0]] > s[1]
                node = node * 2 + go
            score += leaves[node]
        return score


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the calibrated chances there, with half a count of doubt at each end."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margin[order], y[order]):
        if blocks and blocks[-1][3] == m:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([float(v), 1.0, float(m), float(m)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ps = np.array([(b[0] + 0.5 * b[0] / b[1] + 0.25) / (b[1] + 1) for b in blocks for _ in range(2)])
    return xs, np.maximum.accumulate(np.clip(ps, 0, 1))


class Scorer:
    def __init__(self, learned: frozenset[str], stems: frozenset[str], x: np.ndarray, labels: np.ndarray, grows: np.ndarray):
        """x: the features of all rows; rows that don't grow the trees calibrate; if either are none, all do both."""
        self.learned, self.stems = learned, stems
        grow = np.flatnonzero(grows) if grows.any() else np.arange(len(x))
        hold = np.flatnonzero(~grows) if not grows.all() else grow
        y = labels.astype(float)
        self.trees = Trees().fit(x[grow], y[grow])
        self.xs, self.ps = isotonic(self.trees.margin(x[hold]), y[hold])

    def __call__(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t, self.learned, self.stems) for t in texts]).reshape(-1, len(NAMES))
        return np.interp(self.trees.margin(x), self.xs, self.ps)


# -- Spark ------------------------------------------------------------------------------------


def fold_of(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Scorer:
    """A scorer from labelled documents whose crc32(doc_id) mod 5 is not 0, of which 1 calibrates.

    At most ``rows`` labels, and texts of ``size`` bytes together, are used, those with the
    smallest hash of doc_id, so that what the driver holds is bounded. Rows with a null id, label
    or text are not learned from; of contradicting labels of one doc_id toxic counts; repeated
    rows of one text count once; without any labelled row the score is 0.5.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = named.where("doc_id is not null and toxic in (0, 1)").where(fold_of(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = {r.doc_id: r.toxic for r in chosen.collect()}
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    # the sample is bounded by ``rows``, so it may be sent to all executors
    among = lambda ids: source.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id", "left_semi")
    sizes = {r.doc_id: r.n for r in among(picked).groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    held, total = [], 0
    for i in picked:  # in the order of the hashes
        if i in sizes and total + sizes[i] <= size:
            held.append(i)
            total += sizes[i]
    calibrates = lambda i: crc32(str(i).encode()) % 5 == 1  # noqa: E731, fold_of
    none_grows = all(map(calibrates, held))
    known = spark.createDataFrame([(i, picked[i], none_grows or not calibrates(i)) for i in held], "doc_id long, toxic int, grows boolean")
    texts = among(held).groupBy("doc_id").agg(F.sort_array(F.collect_set("text")).alias("texts"))
    sample = cut(texts.join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "grows", F.posexplode("texts").alias("place", "text")))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, (clean, toxic) in enumerate(count_words(text_array(batch.column(1)).to_pylist(), batch.column(0).to_pylist())):
                own = sorted(clean.keys() | toxic.keys())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(own, pa.string()), pa.array([toxic[w] for w in own], pa.int64()), pa.array([clean[w] + toxic[w] for w in own], pa.int64())], ["kind", "word", "k", "n"])

    grown = sample.where("grows")
    counted = cut(grown.select("toxic", "text").mapInArrow(lean(words_of), "kind int, word string, k long, n long").groupBy("kind", "word").agg(F.sum("k").alias("k"), F.sum("n").alias("n")))
    tried = {r.kind: r.tried for r in counted.groupBy("kind").agg(F.count("*").alias("tried")).collect()}
    base = base_rate(*grown.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first())
    often = counted.where((F.col("k") >= 4) & (F.col("k") >= F.lit(0.9) * F.col("n"))).collect()
    learned, stems = (marking(((r.word, r.k, r.n) for r in often if r.kind == kind), tried.get(kind, 1), base) for kind in (0, 1))

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t, learned, stems) for t in text_array(batch.column(4)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(got, pa.list_(pa.float64()))], ["doc_id", "place", "toxic", "grows", "x"])

    got = sample.select("doc_id", "place", "toxic", "grows", "text").mapInArrow(lean(features_of), "doc_id long, place int, toxic int, grows boolean, x array<double>").toArrow()
    ids, place, labels_of, grows = (got[c].to_numpy() for c in ("doc_id", "place", "toxic", "grows"))
    order = np.lexsort((place, ids))
    x = np.array(got["x"].combine_chunks().flatten(), float).reshape(-1, len(NAMES))
    return Scorer(learned, stems, x[order], labels_of[order], grows[order].astype(bool))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out boolean, score double, predicted int of every row of ``docs``.

    Scores depend on the text alone, so that equal texts tie; a null text scores as an empty one.
    A null doc_id has a null held_out. Repeated rows each come back; an empty table gives an empty
    result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            for lo in range(0, len(texts), 512):
                got = shared.value(texts.slice(lo, 512).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 512), pa.array(got)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(score), "doc_id long, score double")
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without the texts scored 0.5 or more; all columns as they are.

    A null text is scored as an empty one; repeated rows go or stay together; an empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))
    place = docs.schema.names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(place))
            for lo in range(0, len(texts), 512):
                got = shared.value(texts.slice(lo, 512).to_pylist())
                yield batch.slice(lo, 512).filter(pa.array(got < 0.5))

    return docs.mapInArrow(lean(keep), docs.schema)
