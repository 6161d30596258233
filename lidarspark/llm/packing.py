"""Packing into sequences of bounded length: shortest pack first, over the histogram of lengths.

Documents become pieces of at most a sequence's tokens: full ones, and what is left. Only how many
pieces have each length reaches the driver (at most as many numbers as a sequence has tokens).
Lengths are placed longest first, all pieces of a length at once, each time on the packs that are
shortest so far and have room; a pattern of lengths has a count, not a list of documents. Pieces
then find their sequence by their rank among those of their length.
"""

from __future__ import annotations

import re
import zlib
from bisect import insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, slices, text_array

#: Tokens of a sequence, and the id that ends a document.
WIDTH, END = 4096, 2
#: Words whose ids a task keeps, twice at most, and the longest of them in characters.
CACHE, CACHED_CHARS = 3 << 18, 64
#: Characters that are cut into words in one step, and words that are encoded in one.
STEP_CHARS, MANY = 1 << 20, 400
#: A sign that is a token of its own between spaces, and that of no word without it.
MARK = "^"
#: White space at which a text may be cut: the tokenizer drops it, and no token reaches over it.
_GAP = re.compile("[ \n\t\r]+")
#: What ``str.split`` takes for white space and the tokenizer doesn't.
_NO_GAPS = "\x1c\x1d\x1e\x1f"


class WordIds:
    """Ids of words as little-endian 32-bit words, and of texts, which are those of their words one after the other.

    Words are encoded when first met, many at once. When CACHE words are known, they become the old
    ones, of which those that come again are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _coded(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, which are parted by the sign; those that hold it go alone, and so do all if it is more than a token."""
        plain, out = [w for w in words if MARK not in w and len(self.mark) == 1], {}
        for lo in range(0, len(plain), MANY):
            part = plain[lo : lo + MANY]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends, raw = np.flatnonzero(ids == self.mark[0]) * 4, ids.tobytes()
            out.update(zip(part, [raw[i:j] for i, j in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(raw)])]))
        out.update((w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in words if MARK in w or len(self.mark) != 1)
        return out

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of texts that hold bounded characters together."""
        split = [_GAP.split(p) if any(c in p for c in _NO_GAPS) else p.split() for p in parts]
        words = list(set().union(*split))
        own = dict(zip(words, map(self.known.get, words)))
        new = [w for w, ids in own.items() if ids is None]
        if len(self.known) + len(new) > CACHE:
            self.old, self.known = self.known, {w: ids for w, ids in own.items() if ids is not None}
        again = {w: self.old[w] for w in new if w in self.old}
        made = self._coded([w for w in new if w not in again])
        for found in (again, made):
            own.update(found)
            self.known.update(found)
        for w in [w for w in made if len(w) > CACHED_CHARS]:
            del self.known[w]
        return [b"".join(map(own.__getitem__, s)) for s in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts, owners, size = [], [], 0
        out: list[list[bytes]] = [[] for _ in texts]

        def flush() -> None:
            for i, ids in zip(owners, self.encode_parts(parts)):
                out[i].append(ids)
            parts.clear()
            owners.clear()

        for i, text in enumerate(texts):
            at = 0
            while at < len(text):
                gap = _GAP.search(text, at + STEP_CHARS) if at + STEP_CHARS < len(text) else None
                end = gap.start() if gap else len(text)
                parts.append(text[at:end])
                owners.append(i)
                size, at = size + end - at, end
                if size >= STEP_CHARS:
                    flush()
                    size = 0
        flush()
        return [b"".join(ids) for ids in out]


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The words that this process knows; a Python worker keeps them from task to task."""
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end: int = END) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: the ids of every document with ``end``, in pieces of ``width`` and a rest."""
    closing = np.array([end], "<u4").tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            rows: list[tuple] = []
            texts = text_array(batch.column(1))
            coded = (ids for lo, hi in slices(texts) for ids in words.encode(texts.slice(lo, hi - lo).to_pylist()))
            for doc, ids in zip(batch.column(0).to_pylist(), coded):
                data = memoryview(ids + closing)
                n = len(data) // 4
                rows += [(doc, s, min(width, n - s), zlib.crc32(data[4 * s : 4 * (s + width)]), n) for s in range(0, n, width)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), columns)})

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(split, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_lengths(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)`` of every pattern: longest pieces first, each on the shortest pack that has room."""
    waiting: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    fills: list[int] = []  # of patterns with room, ascending
    full: list[tuple[int, tuple[int, ...]]] = []

    def put(fill: int, n: int, pattern: tuple[int, ...]) -> None:
        if fill == width:
            full.append((n, pattern))
            return
        if not waiting[fill]:
            insort(fills, fill)
        waiting[fill].append((n, pattern))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            fill = fills[0] if fills else width
            if fill + length > width:  # none has room: new packs, each of which is the shortest until it has none either
                packs, rest = divmod(left, width // length)
                for n, size in ((packs, width // length), (min(1, rest), rest)):
                    if n:
                        put(size * length, n, (length,) * size)
                break
            n, pattern = waiting[fill].pop()
            if n > left:
                waiting[fill].append((n - left, pattern))
            elif not waiting[fill]:
                fills.pop(0)
            taken = min(n, left)
            left -= taken
            put(fill + length, taken, (*pattern, length))
    return full + [x for fill in fills for x in waiting[fill]]


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end: int = END) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece of every row.

    A document is its tokens and ``end``; a null or empty text is ``end`` alone. Documents of more
    than ``width`` tokens are cut every ``width``; no other is cut. Sequences number from 0 without a
    gap, offsets add up the lengths before. Repeated rows are documents of their own, rows without
    a doc_id as well; which of the pieces of equal length goes where isn't fixed. An empty table
    gives no pieces. ``path`` is the tokenizer's file, which every executor has.
    """
    found = cut(pieces_of(docs, path or default_path(), id_col, text_col, width, end))
    # ranges of a number within each length, so that a frequent length is many tasks' work
    numbered = found.withColumn("number", F.monotonically_increasing_id())
    dealt = cut(numbered.repartitionByRange(partitions(docs.sparkSession), "length", "number").sortWithinPartitions("length", "number").drop("number"))
    dealt = dealt.withColumn("part", F.spark_partition_id())
    # a partition holds a range of lengths: as many rows as partitions and lengths together, at most
    counts = sorted((r.part, r.length, r.n) for r in dealt.groupBy("part", "length").agg(F.count("*").alias("n")).collect())
    first: dict[tuple[int, int], int] = {}
    histogram: dict[int, int] = defaultdict(int)
    for part, length, n in counts:
        first[part, length] = histogram[length]
        histogram[length] += n

    places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # of a length: first rank, first sequence, offset
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for n, pattern in pack_lengths(histogram, width):
        for length, offset in zip(pattern, accumulate(pattern, initial=0)):
            places[length].append((ranks[length], sequence, offset))
            ranks[length] += n
        sequence += n
    tables = {length: np.array(rows, np.int64).T for length, rows in places.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths, part = batch.column("length").to_numpy(), batch.column("part")[0].as_py()
            sequences, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            starts = np.flatnonzero(np.diff(lengths, prepend=-1))
            for lo, hi in zip(starts, np.append(starts[1:], len(lengths))):
                length = int(lengths[lo])
                rank = first[part, length] + seen[length] + np.arange(hi - lo)
                seen[length] += int(hi - lo)
                ranked, sequence, offset = tables[length]
                slot = np.searchsorted(ranked, rank, side="right") - 1
                sequences[lo:hi], offsets[lo:hi] = sequence[slot] + rank - ranked[slot], offset[slot]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequences), pa.array(offsets)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return dealt.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
