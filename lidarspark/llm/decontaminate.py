"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Benchmark items are partitioned by their number of distinct word shingles. The smallest class,
under 8 shingles, is looked up by the shingles themselves, and items of fewer words than a shingle
by runs of as many words; the others are powers of two. For a
class whose items have up to m shingles, every document is read as half-overlapping segments of
2 m shingles, so an item of the class always meets a segment of a size like its own, and a
containment of 0.8 means a Jaccard similarity of 0.19 or more, however long the document is. An
item and a document are candidates if any of the MinHash values of a segment equals the item's;
a candidate is then judged by the exact share of the item's shingles that the whole document
holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shingler, lean, shingled, slices, text_array

#: MinHash functions. A pair at Jaccard j is missed with probability (1 - j)**HASHES: 4e-5 at 0.19, 1e-6 at 0.25.
HASHES = 48
#: Items under so many shingles are looked up exactly.
SMALL = 8
#: Items, and bytes of them, that are sent to the executors at once; larger benchmarks are searched in such blocks.
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 1 << 26
_BITS, _SMALL_BITS = 16, 22


class ItemIndex:
    """The MinHash index of one block of items: values by size class and hash function."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], threshold: float, runs: dict[int, dict[int, list[int]]]):
        """sets: the distinct shingles of each item; runs: of items of n words, fewer than a shingle's, the hash of their words and who has it."""
        rng = np.random.default_rng(3)
        self.runs = {n: (np.array(sorted(owners), np.uint64), [owners[x] for x in sorted(owners)]) for n, owners in runs.items()}
        self.ids, self.sets, self.threshold = ids, sets, threshold
        self.odd = rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        classes: dict[int, list[int]] = {}
        few: list[tuple[int, int]] = []
        for i, s in enumerate(sets):
            if 0 < len(s) < SMALL:
                # whoever holds enough of them holds one of these
                few += [(int(x), i) for x in s[: len(s) - max(1, int(np.ceil(threshold * len(s) - 1e-9))) + 1]]
            elif len(s):
                classes.setdefault(int(len(s)).bit_length(), []).append(i)
        few.sort()
        self.few, self.few_owner = np.array([x for x, _ in few], np.uint64), np.array([i for _, i in few], np.int64)
        self.few_seen = np.zeros(1 << _SMALL_BITS, bool)
        self.few_seen[self.few >> np.uint64(64 - _SMALL_BITS)] = True
        #: class c has items of under 2**c shingles
        self.classes = sorted(classes)
        self.seen, self.values, self.owners = {}, {}, {}
        for c, members in classes.items():
            for h in range(HASHES):
                least = np.array([(sets[i] * self.odd[h]).min() for i in members], np.uint64)
                order = np.argsort(least, kind="stable")
                self.values[c, h], self.owners[c, h] = least[order], np.array(members)[order]
                self.seen[c, h] = np.zeros(1 << _BITS, bool)
                self.seen[c, h][least >> np.uint64(64 - _BITS)] = True

    def search_runs(self, n: int, hashes: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float]]:
        """The same for items of n words, for documents as hashes of all their runs of n words."""
        known, owners = self.runs[n]
        at = np.searchsorted(known, hashes)
        at[at == len(known)] = 0
        hit = np.flatnonzero(known[at] == hashes)
        doc = np.searchsorted(off, hit, "right") - 1
        return [(d, self.ids[i], 1.0) for d, k in sorted(set(zip(doc.tolist(), at[hit].tolist()))) for i in owners[k]]

    def search(self, hashes: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float]]:
        """(document, item, containment) of the verified pairs, for documents as runs of shingle hashes."""
        found: set[tuple[int, int]] = set()
        counts = np.diff(off)
        if not len(hashes):
            return []
        maybe = np.flatnonzero(self.few_seen[hashes >> np.uint64(64 - _SMALL_BITS)]) if len(self.few) else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.few, hashes[maybe], "left"), np.searchsorted(self.few, hashes[maybe], "right")
        doc, many = np.searchsorted(off, maybe, "right") - 1, hi - lo
        own = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        found.update(zip(np.repeat(doc, many).tolist(), self.few_owner[own].tolist()))
        for h in range(HASHES):
            values, spans = hashes * self.odd[h], counts
            step = 1
            for c in self.classes:
                starts, spans, doc = _runs(spans, (1 << c) // step)
                values, step = np.minimum.reduceat(values, starts), 1 << c
                pair = values.copy()
                same = doc[1:] == doc[:-1]
                pair[:-1] = np.where(same, np.minimum(values[:-1], values[1:]), values[:-1])
                maybe = np.flatnonzero(self.seen[c, h][pair >> np.uint64(64 - _BITS)])
                if len(maybe):
                    known, owner = self.values[c, h], self.owners[c, h]
                    lo, hi = np.searchsorted(known, pair[maybe], "left"), np.searchsorted(known, pair[maybe], "right")
                    for k in np.flatnonzero(hi > lo):
                        found.update((int(doc[maybe[k]]), int(i)) for i in owner[lo[k] : hi[k]])
        out = []
        for d, i in sorted(found):
            share = float(np.isin(self.sets[i], hashes[off[d] : off[d + 1]]).mean())
            if share >= self.threshold:
                out.append((d, self.ids[i], share))
        return out


def _runs(counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of runs of ``step`` values that don't cross documents, runs per document, document of each run."""
    runs = -(-counts // step)
    doc = np.repeat(np.arange(len(counts)), runs)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
    return (np.cumsum(counts) - counts)[doc] + rank * step, runs, doc


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, containment) of all items of which a document holds ``threshold`` of the word shingles.

    Shingles are sets. An item of fewer than ``words`` words is looked up in all runs of as many words,
    and held by whoever has one that is equal, with containment 1. Items under SMALL shingles, these
    among them, are found without exception. Items or texts that are null or without words
    match nothing; a null doc_id is found under null; rows that repeat come back as often; empty
    tables give an empty result. Only the id and text columns are read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null")
    out = None
    # the stated query set, in blocks of a bounded size, against all rows
    many, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-many // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = part.collect()
        column = text_array(pa.array([r.text for r in rows], pa.string()))
        size = np.diff(Shingler(1)(column)[1])
        hashes, off = Shingler(words)(column)
        sets = [np.unique(hashes[off[i] : off[i + 1]]) if size[i] >= words else hashes[:0] for i in range(len(rows))]
        runs: dict[int, dict[int, list[int]]] = {}
        for n in {int(k) for k in size if 0 < k < words}:
            hashes, off = Shingler(n)(column)
            for i in np.flatnonzero(size == n):
                runs.setdefault(n, {}).setdefault(int(hashes[off[i]]), []).append(int(i))
        index = spark.sparkContext.broadcast(ItemIndex([r.item_id for r in rows], sets, threshold, runs))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own, short = Shingler(words), {n: Shingler(n) for n in index.value.runs}
            for batch in batches:
                texts, ids = text_array(batch.column(1)), batch.column(0)
                got: list[tuple[int, int, float]] = []
                for lo, hi in slices(texts):
                    part = texts.slice(lo, hi - lo)
                    got += [(lo + d, i, s) for d, i, s in index.value.search(*shingled(own, part))]
                    for n, shingle in short.items():
                        got += [(lo + d, i, s) for d, i, s in index.value.search_runs(n, *shingled(shingle, part))]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([g[0] for g in got], pa.int64())), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())], ["doc_id", "item_id", "containment"])

        found = source.mapInArrow(lean(search), "doc_id long, item_id long, containment double")
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold an item of the benchmark; all columns as they are.

    Rows with a null doc_id stay, as a finding can't name them.
    """
    leaks = contaminated(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("_leak")).where("_leak is not null").distinct()
    return docs.join(leaks, docs[id_col].cast("long") == leaks["_leak"], "left_anti")
