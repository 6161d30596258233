"""Shared pieces of the training-data operators: lineage cuts, text buffers, rolling hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cuts import cut

#: Bytes of text that one vectorised step handles; a single longer text is still handled whole.
SLICE_BYTES = 1 << 21
#: Bytes of text whose words are hashed at once, which takes some 60 bytes for each.
HASHED_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_join(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """``rows`` joined to ``facts``, which has one row for each key; ``rows`` must have been cut.

    Keys with over a ``share``-th of the rows, of which there are fewer than ``share``, are dealt
    out over as many slices as they have such parts, and their facts repeated for each slice.
    """
    total = rows.count()
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") * share / max(1, total)).cast("int").alias("_slices")).where("_slices > 1")
    hot = F.broadcast(cut(hot.select(F.col(key).alias("_hot"), "_slices")))
    dealt = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_slice", F.coalesce(F.monotonically_increasing_id() % F.col("_slices"), F.lit(0)).cast("int")).drop("_hot", "_slices")
    repeated = facts.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))).drop("_hot", "_slices")
    return dealt.join(repeated, [key, "_slice"], how).drop("_slice")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From here on the session sends Python ``rows`` rows at once at most, as texts may be long; a smaller setting stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= rows:
        spark.conf.set(setting, str(rows))


def give_back() -> None:
    """Memory that this process has freed but keeps goes back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for ``mapInArrow``; when a task ends, its worker, which Spark keeps for later stages, gives back what it took."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def sent(facts: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Narrow ``facts``, which have been cut, to be broadcast if they are ``most`` rows or fewer; else as they are."""
    return F.broadcast(facts) if facts.limit(most + 1).count() <= most else facts


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_array(column: pa.Array) -> pa.Array:
    """The column as strings without nulls (a null text reads as the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(pc.cast(column, pa.large_string()), "")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a :func:`text_array` in one row, and the n+1 offsets of its texts."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a :func:`text_array` that hold about ``limit`` bytes each, one text at least."""
    _, off = text_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Roller:
    """Hashes of any substring from one prefix sum: sum of t[byte] * m**i mod 2**64, scaled by m**-start."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.m = int(rng.integers(1, 2**62)) * 4 + 3
        self.inv = pow(self.m, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = (self._powers(b, size) for b in (self.m, self.inv))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done, step = 1, base
        while done < n:
            out[done : 2 * done] = out[:done] * np.uint64(step)
            done, step = 2 * done, step * step % 2**64
        return out

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[:n], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of data[start:end]."""
        return (prefix[end] - prefix[start]) * self.down[start]

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Unmixed hashes of all windows of a width."""
        n = len(prefix) - width
        return (prefix[width:] - prefix[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


_WORD = np.ones(256, bool)
for _c in range(128):
    _WORD[_c] = chr(_c).isalnum()


class Shingler:
    """Word-shingle hashes of many texts at once.

    Words are maximal runs of ASCII letters, digits and non-ASCII characters of the
    lower-cased text, so case, white space and ASCII punctuation don't matter. A text with
    fewer than ``width`` words has one shingle, its whole sequence; one without words has none.
    """

    def __init__(self, width: int = 5, seed: int = 11):
        self.width, self.roller = width, Roller(seed)
        self.odd = np.random.default_rng(seed + 1).integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles in order, and the n+1 offsets of the texts' shingles."""
        data, off = text_bytes(pc.utf8_lower(texts))
        n, k = len(off) - 1, self.width
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = _WORD[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        before[off] = False
        start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside[:-1]
        after[off] = False
        # a word ends before each position that is outside, or starts a text, while the byte before is inside
        last = np.zeros(len(data) + 1, bool)
        last[1:] = inside[:-1]
        end = np.flatnonzero(last & ~after)
        words = mix64(self.roller.between(self.roller.prefix(data), start, end))
        first = np.searchsorted(start, off[:-1])
        count = np.diff(np.append(first, len(start)))
        full = np.maximum(count - k + 1, 0)
        made = np.where(full > 0, full, np.minimum(count, 1))
        out_off = np.concatenate([[0], np.cumsum(made)])
        if not len(words):
            return np.zeros(0, np.uint64), out_off
        padded = np.concatenate([words, np.zeros(k, np.uint64)])
        rolled = np.zeros(len(words), np.uint64)
        for j in range(k):
            rolled += padded[j : j + len(words)] * self.odd[j]
        keep = np.zeros(len(words), bool)
        rank = np.arange(len(words)) - np.repeat(first, count)
        keep = rank < np.repeat(np.maximum(full, 1), count)
        for i in np.flatnonzero((count > 0) & (count < k)):  # short texts: their own words only
            own = words[first[i] : first[i] + count[i]]
            rolled[first[i]] = (own * self.odd[: count[i]]).sum() + np.uint64(count[i])
        return mix64(rolled[keep]), out_off


def shingled(shingle: Shingler, texts: pa.Array, limit: int = HASHED_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """What ``shingle`` makes of all texts, which are hashed about ``limit`` bytes at a time."""
    parts = [shingle(texts.slice(lo, hi - lo)) for lo, hi in slices(texts, limit)]
    return np.concatenate([np.zeros(0, np.uint64), *[own for own, _ in parts]]), np.concatenate([[0], *[np.diff(off) for _, off in parts]]).astype(np.int64).cumsum()


def union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over arrays: ``labels`` point at roots; afterwards a[i] and b[i] share one for all i."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels
