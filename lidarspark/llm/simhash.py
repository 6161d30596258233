"""SimHash near-duplicates, compared bit plane by bit plane.

Fingerprints are spread over blocking tables whose buckets must hold every pair within the
radius (pigeonhole on bit blocks), or nearly every similar pair (min-shingle keys, for wide
fingerprints). In a bucket the fingerprints stand vertically: one 64-bit word holds the same
bit of 64 rows. A query row is XORed with such words; carry-save adders count 64 distances at
once, and a block of rows is abandoned as soon as all its lanes exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shingler, cut, lean, mix64, partitions, sent, slices, spread_join, text_array, text_bytes, union
from .components import connected_components

#: Bytes of text whose shingles are spread into bits at once: 64 or 256 bytes for each shingle.
BITS_BYTES = 1 << 18
#: Hashes that are spread into bits at once, so that a text of any length takes bounded memory there.
MAJORITY_ROWS = 1 << 14
#: Rows of a bucket that are compared in one piece; larger buckets are dealt out as pairs of tiles.
TILE = 4096
#: Bytes of shingle sets in such a piece.
TILE_BYTES = 1 << 25
#: Bytes of rows that are gathered before their whole groups are compared; a larger group is still one piece.
PIECE_BYTES = 1 << 23
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


# -- fingerprints -----------------------------------------------------------------------------


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per run of ``counts`` big-endian hashes: the bits set in over half of them.

    MAJORITY_ROWS hashes are spread into bits at a time, also within one text, whose sums go on.
    """
    width = hashes.dtype.itemsize * 8 if hashes.ndim == 1 else hashes.shape[1] * 64
    out = np.zeros((len(counts), width // 8), np.uint8)
    some = np.flatnonzero(counts)
    raw, own, ends = hashes.view(np.uint8).reshape(-1, width // 8), counts[some], np.cumsum(counts[some])
    begun = np.zeros(width, np.int64)
    for lo in range(0, len(raw), MAJORITY_ROWS):
        hi = min(lo + MAJORITY_ROWS, len(raw))
        first, last = np.searchsorted(ends, [lo, hi - 1], side="right")
        here = slice(first, last + 1)
        ones = np.add.reduceat(np.unpackbits(raw[lo:hi], axis=1), np.maximum(ends[here] - own[here], lo) - lo, axis=0, dtype=np.int64)
        ones[0] += begun
        out[some[here]] = np.packbits(ones * 2 > own[here, None], axis=1)
        # of an unfinished text, what was written is written again when it ends
        begun = ones[-1] if ends[last] > hi else np.zeros(width, np.int64)
    return out


def fingerprints(texts: pa.Array, words: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints as rows of 8 big-endian bytes: XXH64 of space-joined word shingles."""
    data, off = text_bytes(texts)
    raw, hashes, counts = data.tobytes(), [], np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(len(texts)):
        split = raw[off[i] : off[i + 1]].translate(_LOWER).split()
        n = len(split)
        if not n:
            continue
        joined = b" ".join(split)
        if n <= words:
            hashes.append(digest(joined, seed))
            counts[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, n) + 1)
        starts = np.concatenate([[0], ends[: n - words]]).tolist()
        hashes += [digest(joined[s:e], seed) for s, e in zip(starts, (ends[words - 1 :] - 1).tolist())]
        counts[i] = n - words + 1
    return majority(np.array(hashes, dtype=np.uint64).astype(">u8"), counts)


# -- bit-sliced comparison --------------------------------------------------------------------


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter exceeds the radius."""
    more, same = np.zeros_like(counter[0]), np.full_like(counter[0], _ONES)
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            same &= counter[k]
        else:
            more |= same & counter[k]
            same &= ~counter[k]
    return more


def _add(counter: list[np.ndarray], carry: np.ndarray, level: int) -> None:
    for k in range(level, len(counter)):
        counter[k], carry = counter[k] ^ carry, counter[k] & carry
    counter[-1] |= carry  # saturates


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def bit_sliced_links(prints: np.ndarray, ends: np.ndarray, radius: int, chunk: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of rows of one group whose prints differ in at most ``radius`` bits.

    prints: rows of packed bytes, groups one after another; ends: for each row, its group's end.
    """
    n = len(prints)
    if n < 2:
        return
    width, blocks = prints.shape[1] * 8, -(-n // 64)
    bits = np.unpackbits(prints, axis=1)
    lanes = np.zeros((width, blocks * 64), np.uint8)
    lanes[:, :n] = bits.T
    planes = np.packbits(lanes, axis=1, bitorder="little").view(np.uint64)
    # one byte a bit, 0 or -1, which widens to a whole word of the query's bit
    masks = -np.ascontiguousarray(bits.T).view(np.int8)
    levels = int(radius).bit_length() + 1
    first, many = np.arange(n) // 64, (ends - 1) // 64 - np.arange(n) // 64 + 1
    many[ends - 1 <= np.arange(n)] = 0
    total, offset = int(many.sum()), np.cumsum(many)
    for lo in range(0, total, chunk):
        at = np.arange(lo, min(lo + chunk, total))
        row = np.searchsorted(offset, at, side="right")
        block = first[row] + at - (offset[row] - many[row])
        # lanes that may count: rows after the query, before its group's end
        low = np.clip(row + 1 - block * 64, 0, 64).astype(np.uint64)
        high = np.clip(ends[row] - block * 64, 0, 64).astype(np.uint64)
        valid = np.where(low > 63, np.uint64(0), _ONES << np.minimum(low, np.uint64(63))) & np.where(high > 63, _ONES, ~(_ONES << np.minimum(high, np.uint64(63))))
        counter = [np.zeros(len(row), np.uint64) for _ in range(max(levels, 4))]
        for p in range(0, width, 8):
            d = [planes[p + k][block] ^ masks[p + k][row].astype(np.int64).view(np.uint64) for k in range(8)]
            ones, t1 = _csa(counter[0], d[0], d[1])
            ones, t2 = _csa(ones, d[2], d[3])
            ones, t3 = _csa(ones, d[4], d[5])
            ones, t4 = _csa(ones, d[6], d[7])
            twos, f1 = _csa(counter[1], t1, t2)
            twos, f2 = _csa(twos, t3, t4)
            fours, e1 = _csa(counter[2], f1, f2)
            counter[0], counter[1], counter[2] = ones, twos, fours
            _add(counter, e1, 3)
            if p + 8 >= 24 and p % 16 == 0 and p + 8 < width or p + 8 == width:
                near = valid & ~_above(counter, radius)
                alive = np.flatnonzero(near)
                if len(alive) < len(row) * 0.8 or p + 8 == width:
                    row, block, valid, counter = row[alive], block[alive], valid[alive], [c[alive] for c in counter]
                    if p + 8 == width and len(alive):
                        hit = np.unpackbits(near[alive].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                        task, lane = np.nonzero(hit)
                        yield row[task], block[task] * 64 + lane
                    if not len(alive):
                        break


# -- Spark ------------------------------------------------------------------------------------


def block_tables(rows: int, radius: int, width: int = 64, most: int = 4096) -> list[tuple[int, ...]]:
    """Bit positions of the blocking tables: with b blocks, prints within the radius agree on b - radius of them.

    The fewest blocks are taken whose expected bucket holds ``most`` rows or fewer.
    """
    for b in range(radius + 1, radius + 5):
        edges = [width * k // b for k in range(b + 1)]
        if rows / 2 ** (width * (b - radius) / b) <= most:
            break
    return [tuple(p for k in pick for p in range(edges[k], edges[k + 1])) for pick in combinations(range(b), b - radius)]


def _pigeonhole(prints: np.ndarray, tables: list[tuple[int, ...]]) -> list[np.ndarray]:
    bits = np.unpackbits(prints, axis=1)
    weight = lambda k: (np.uint64(1) << np.arange(k, dtype=np.uint64))
    return [(bits[:, list(t)].astype(np.uint64) * weight(len(t))).sum(axis=1).astype(np.uint64).view(np.int64) for t in tables]


def dealt(keyed: DataFrame, group: list[str], name: str, tiles) -> DataFrame:
    """Rows of the groups with the pair of tiles ``i``, ``j`` they meet in and ``t``, their own; groups of more than one tile are dealt out as pairs."""
    hot = keyed.groupBy(*group).agg(tiles.cast("int").alias("tiles")).where("tiles > 1")
    return (
        keyed.join(hot, group, "left")
        .withColumn("t", F.when(F.col("tiles") > 1, F.pmod(F.xxhash64(name), F.col("tiles")).cast("int")).otherwise(0))
        .withColumn("other", F.explode(F.when(F.col("tiles") > 1, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.lit(0)))))
        .withColumn("i", F.least("t", "other"))
        .withColumn("j", F.greatest("t", "other"))
        .drop("tiles", "other")
    )


def linked(keyed: DataFrame, radius: int, tile: int = TILE, width: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that join all prints of a bucket within the radius, as stars, and the piece (``tab, key, i, j``) of each.

    keyed: (tab int, key long, print binary), prints distinct within a bucket. Buckets over
    ``tile`` rows are dealt out as pairs of tiles, so that no task holds more than two. Only the
    first ``width`` bytes of a print are compared, if given; the others are part of its name.
    """
    n = partitions(keyed.sparkSession)
    pairs = dealt(keyed, ["tab", "key"], "print", F.ceil(F.count("*") / tile)).drop("t")
    group = ["tab", "key", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for piece in _whole_groups(batches, group, held):
            size = piece.column("print")[0].as_buffer().size if len(piece) else 0
            prints = np.frombuffer(b"".join(piece.column("print").to_pylist()), np.uint8).reshape(-1, size)
            new = _changes(piece, group)
            starts = np.flatnonzero(new)
            ends = np.repeat(np.append(starts[1:], len(piece)), np.diff(np.append(starts, len(piece))))
            labels = np.arange(len(piece))
            for a, b in bit_sliced_links(np.ascontiguousarray(prints[:, :width]), ends, radius):
                labels = union(labels, a, b)
            moved = np.flatnonzero(labels != np.arange(len(piece)))
            column, moved_rows = piece.column("print"), pa.array(moved)
            yield pa.RecordBatch.from_arrays([column.take(moved_rows), column.take(pa.array(labels[moved])), *[piece.column(c).take(moved_rows) for c in group]], ["a", "b", *group])

    # by print, so that the centre of rows that meet in several buckets is the same in all
    return pairs.repartition(n, *group).sortWithinPartitions(*group, "print").mapInArrow(lean(compare), "a binary, b binary, tab int, key long, i int, j int")


def _changes(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    new = np.zeros(len(batch), bool)
    if len(batch):
        new[0] = True
        for c in columns:
            x = batch.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
    return new


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str], held: list[pa.RecordBatch], at_least: int = 1 << 15, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of a sorted stream joined and split so that no group is cut, each of ``at_least`` rows or ``size`` bytes, or the last."""
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= at_least or sum(b.nbytes for b in held) >= size:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cut_at = int(np.flatnonzero(_changes(whole, columns))[-1])
            if cut_at:
                yield whole.slice(0, cut_at)
            held[:] = [whole.slice(cut_at)]
            rows = len(held[0])
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def group_rows(printed: DataFrame, links: DataFrame) -> DataFrame:
    """``printed`` (doc_id, print, ...), which has been cut, with component_id: the smallest doc_id reachable over the links."""
    roots = connected_components(links)
    classes = printed.groupBy("print").agg(F.min("doc_id").alias("least"))
    placed = cut(classes.join(roots, classes["print"] == roots["node"], "left").select("print", "least", F.coalesce("component", "print").alias("root")))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return spread_join(printed, spread_join(placed, named, "root").select("print", "component_id"), "print")


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    Every pair of fingerprints within ``radius`` bits is found. A null or wordless text has
    fingerprint zero and is linked like any other; a null doc_id is linked but never names a
    component (null if it holds no other); repeated rows each come back; an empty table gives
    an empty result. Other columns of ``docs`` are not read.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            done = [fingerprints(texts.slice(lo, hi - lo), words) for lo, hi in slices(texts, BITS_BYTES)]
            rows = np.concatenate(done) if done else np.zeros((0, 8), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "print"])

    printed = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(prints), "doc_id long, print binary"))
    distinct = printed.select("print").distinct()
    tables = block_tables(printed.select(F.approx_count_distinct("print")).first()[0], radius)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 8)
            for t, key in enumerate(_pigeonhole(rows, tables)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(key), batch.column(0)], ["tab", "key", "print"])

    links = linked(distinct.mapInArrow(lean(keys), "tab int, key long, print binary"), radius)
    return group_rows(printed, links).select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "component_id")


@cache
def _worst_share(similarity: float, most: int = 40) -> float:
    """The largest chance that a bit differs in two sets at the similarity or above, over all unions of up to ``most`` shingles.

    Small sets are worst, as their ties read as zero; large ones come down to acos(2s / (1 + s)) / pi.
    """
    worst = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    over = lambda own, ones, size: sum(comb(own, k) for k in range(own + 1) if 2 * (ones + k) > size) / 2**own
    for whole in range(1, most + 1):
        for both in (b for b in range(1, whole + 1) if b / whole >= similarity):
            for left in range((whole - both) // 2 + 1):
                right, share = whole - both - left, 0.0
                for ones in range(both + 1):
                    p, q = over(left, ones, both + left), over(right, ones, both + right)
                    share += comb(both, ones) / 2**both * (p * (1 - q) + q * (1 - p))
                worst = max(worst, share)
    return worst


def _places(hashes: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """The place of each hash among the distinct ones, in less memory than the inverse of ``np.unique`` takes."""
    distinct, places = np.unique(hashes), np.empty(len(hashes), np.int32)
    for lo in range(0, len(hashes), step):
        places[lo : lo + step] = np.searchsorted(distinct, hashes[lo : lo + step])
    return places


def similar_links(prints: np.ndarray, ends: np.ndarray, tiles: np.ndarray, cross: np.ndarray, hashes: np.ndarray, off: np.ndarray, radius: int, similarity: float, labels: np.ndarray) -> np.ndarray:
    """``labels`` after joining rows of a group over all pairs within the radius whose sets' Jaccard is at least the similarity.

    hashes[off[i]:off[i + 1]] is the set of row i. Where ``cross``, only rows of two tiles are
    compared. Pairs that are joined already needn't be looked up.
    """
    sizes = np.diff(off)
    named = _places(hashes)
    mark = np.zeros(len(hashes), bool)
    for a, b in bit_sliced_links(prints, ends, radius, 1 << 12):  # rows alike are pairs by the million
        few, many = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        may = (few / many >= similarity) & ~(cross[a] & (tiles[a] == tiles[b]))
        a, b = a[may], b[may]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for own in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1) if len(a) else []:
            x = a[own[0]]
            y = b[own][labels[b[own]] != labels[x]]
            if not len(y):
                continue
            mine = named[off[x] : off[x + 1]]
            mark[mine] = True
            for lo in range(0, len(y), 256):
                part = y[lo : lo + 256]
                starts = np.cumsum(sizes[part]) - sizes[part]
                at = np.repeat(off[part] - starts, sizes[part]) + np.arange(sizes[part].sum())
                shared = np.add.reduceat(mark[named[at]], starts, dtype=np.int64)
                same = part[shared / (sizes[x] + sizes[part] - shared) >= similarity]
                labels = union(labels, np.full(len(same), x), same)
            mark[mine] = False
    return labels


def shingle_sets(shingle: Shingler, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in order, and how many each has."""
    hashes, off = shingle(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(off))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[first], np.bincount(text[first], minlength=len(texts))


def _sets_of(shingle: Shingler, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of all texts one after the other, and the n+1 offsets."""
    sets = [shingle_sets(shingle, texts.slice(lo, hi - lo)) for lo, hi in slices(texts, BITS_BYTES)]
    return np.concatenate([own for own, _ in sets]), np.concatenate([[0], *[counts for _, counts in sets]]).cumsum()


def star_links(links: DataFrame, rows: DataFrame, texts: DataFrame, words: int, similarity: float, tile: int = TILE) -> DataFrame:
    """Those links ``(a, b)`` whose sets' exact Jaccard is at least the similarity.

    rows: (sig, name, size) of all ends; texts: (name, text). The members a of a star meet its
    centre b in one piece, or in several if they are over ``tile`` or TILE_BYTES of shingles.
    """
    n, group = partitions(links.sparkSession), ["centre", "part"]
    members = links.select(F.col("b").alias("centre"), F.col("a").alias("sig")).join(rows, "sig")
    parts = members.groupBy("centre").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("size") * 8 / TILE_BYTES)).cast("int").alias("parts"))
    parts = cut(parts)
    hot = parts.where("parts > 1")
    dealt_members = members.join(hot, "centre", "left").select("centre", F.coalesce(F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"), F.lit(0)).alias("part"), F.lit(1).alias("kind"), "sig", "name")
    centres = parts.join(rows, parts["centre"] == rows["sig"]).select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "sig", "name")
    pairs = dealt_members.union(centres).join(texts, "name").select(*group, "kind", "sig", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for piece in _whole_groups(batches, group, []):
            hashes, off = _sets_of(shingle, text_array(piece.column("text")))
            named, sizes = _places(hashes), np.diff(off)
            mark, same = np.zeros(len(hashes), bool), np.zeros(len(piece), bool)
            starts = np.flatnonzero(_changes(piece, group))
            for lo, hi in zip(starts, np.append(starts[1:], len(piece))):
                mark[named[off[lo] : off[lo + 1]]] = True
                if hi > lo + 1:
                    shared = np.add.reduceat(mark[named[off[lo + 1] : off[hi]]], off[lo + 1 : hi] - off[lo + 1], dtype=np.int64)
                    same[lo + 1 : hi] = shared / (sizes[lo] + sizes[lo + 1 : hi] - shared) >= similarity
                mark[named[off[lo] : off[lo + 1]]] = False
            found = pa.array(np.flatnonzero(same))
            yield pa.RecordBatch.from_arrays([piece.column("sig").take(found), piece.column("centre").take(found)], ["a", "b"])

    return pairs.repartition(n, *group).sortWithinPartitions(*group, "kind").mapInArrow(lean(compare), "a binary, b binary")


def verified(candidates: DataFrame, texts: DataFrame, words: int, radius: int, similarity: float, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` of texts in a group whose exact Jaccard is at least the similarity, as spanning forests.

    candidates: (component long, sig binary, print binary, name binary, size int, known binary),
    one row for each sig of a group, of which those with one ``known`` are joined already; texts:
    (name, text), one row for each name. Groups over ``tile`` rows or TILE_BYTES of shingles are
    dealt out as pairs of tiles; only candidates' texts are sent there.
    """
    n = partitions(candidates.sparkSession)
    group = ["component", "i", "j"]
    tiles = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("size") * 8 / TILE_BYTES))
    pairs = dealt(candidates, ["component"], "sig", tiles).join(texts, "name").select(*group, "t", "sig", "print", "known", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for piece in _whole_groups(batches, group, []):
            prints = np.frombuffer(b"".join(piece.column("print").to_pylist()), np.uint8).reshape(len(piece), -1)
            starts = np.flatnonzero(_changes(piece, group))
            ends = np.repeat(np.append(starts[1:], len(piece)), np.diff(np.append(starts, len(piece))))
            hashes, off = _sets_of(shingle, text_array(piece.column("text")))
            own, i, j = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("t", "i", "j"))
            first: dict[tuple[int, bytes], int] = {}
            labels = np.array([first.setdefault(k, at) for at, k in enumerate(zip(ends.tolist(), piece.column("known").to_pylist()))])
            labels = similar_links(prints, ends, own, i != j, hashes, off, radius, similarity, labels)
            moved = np.flatnonzero(labels != np.arange(len(piece)))
            column = piece.column("sig")
            yield pa.RecordBatch.from_arrays([column.take(pa.array(moved)), column.take(pa.array(labels[moved]))], ["a", "b"])

    return pairs.repartition(n, *group).sortWithinPartitions(*group).mapInArrow(lean(compare), "a binary, b binary")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, keys: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of texts whose sets of word shingles have a Jaccard of ``similarity`` or more, and of chains of such.

    Candidates are found by 256-bit fingerprints of the sets, compared in buckets of ``keys``
    min-shingles, of which a pair at similarity 0.8 shares none with probability 0.2**keys
    (3e-6). The radius is the mean distance at the similarity, for the sizes of sets where it is
    largest, and three standard deviations: at similarity 0.8 exactly, 0.22 % of pairs of 4 and 5
    shingles are beyond it and 4 in a million pairs of large sets of one size. Every link is then
    verified on the sets themselves, so that no two texts below the similarity are linked: first
    those to the centre of the rows of a bucket that candidates join, then, only where these leave
    such rows apart, all others among them. Case, punctuation and white space don't count. Null
    and wordless texts are alone.
    """
    share = _worst_share(similarity)
    radius = int(256 * share + 3 * (256 * share * (1 - share)) ** 0.5)
    odd = np.random.default_rng(5).integers(1, 2**63, keys + 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            texts = text_array(batch.column(1))
            for lo, hi in slices(texts, BITS_BYTES):
                hashes, counts = shingle_sets(shingle, texts.slice(lo, hi - lo))
                some = np.flatnonzero(counts)
                at = (np.cumsum(counts) - counts)[some]
                wide = np.stack([mix64(hashes * o) for o in odd[:4]], axis=1).reshape(-1, 4) if len(hashes) else np.zeros((0, 4), np.uint64)
                rows = majority(np.ascontiguousarray(wide), counts)[some]
                least = [np.minimum.reduceat(hashes * o, at).view(np.int64) for o in odd[6:]] if len(some) else [np.zeros(0, np.int64)] * keys
                sums = np.stack([np.add.reduceat(mix64(hashes * o), at) for o in odd[4:6]], axis=1) if len(some) else np.zeros((0, 2), np.uint64)
                mins = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(least, axis=1).ravel()), keys).cast(pa.list_(pa.int64()))
                own, names = (batch.column(k).slice(lo, hi - lo).take(pa.array(some)) for k in (0, 2))
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array([r.tobytes() for r in sums], pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary()), mins, names, pa.array(counts[some].astype(np.int32))],
                    ["doc_id", "sig", "print", "mins", "name", "size"],
                )

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.col(text_col))).alias("name"))
    printed = cut(named.mapInArrow(lean(prints), "doc_id long, sig binary, print binary, mins array<long>, name binary, size int"))
    # texts of equal sets are one row from here on; a print carries its set's name
    keyed = printed.select(F.posexplode("mins").alias("tab", "key"), F.concat("print", "sig").alias("print")).distinct()
    sig = lambda c: F.substring(c, 33, 16).alias(c)
    stars = cut(linked(keyed, radius, width=32).select(F.xxhash64("tab", "key", "i", "j", "b").alias("star"), sig("a"), sig("b")))
    links = stars.select("a", "b").distinct()
    ends = stars.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    one = printed.groupBy("sig").agg(F.min(F.struct("name", "print", "size")).alias("o")).select("sig", "o.*")
    one = cut(one.join(ends, "sig"))

    def texts_of(rows: DataFrame) -> DataFrame:
        return named.select("name", "text").join(sent(cut(rows.select("name").distinct())), "name", "left_semi").dropDuplicates(["name"])

    sure = cut(star_links(links, one.select("sig", "name", "size"), texts_of(one), words, similarity))
    roots = connected_components(sure)
    members = stars.select("star", F.explode(F.array("a", "b")).alias("sig")).distinct().join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("star", "sig", F.coalesce("component", "sig").alias("known"))
    # of stars of the same members one is enough
    apart = members.groupBy("star").agg(F.count("*").alias("n"), F.sum(F.xxhash64("sig").cast("decimal(38)")).alias("s"), F.sum(F.xxhash64(F.lit(1), "sig").cast("decimal(38)")).alias("t"), (F.min("known") != F.max("known")).alias("apart")).where("apart")
    apart = apart.groupBy("n", "s", "t").agg(F.min("star").alias("star")).select("star")
    # stars that share most of their rows are compared as one, others each by itself, whichever is fewer pairs
    placed = connected_components(stars.join(apart, "star").select("a", "b")).withColumnRenamed("node", "sig")
    placed = cut(members.join(apart, "star").join(placed, "sig").select("star", "sig", "known", "component"))
    squares = placed.groupBy("component", "star").agg(F.count("*").alias("n")).groupBy("component").agg(F.sum(F.col("n") * F.col("n")).alias("squares"))
    whole = placed.groupBy("component").agg(F.count_distinct("sig").alias("n")).join(squares, "component").where(F.col("n") * F.col("n") <= F.col("squares")).select("component", F.lit(True).alias("whole"))
    rest = placed.join(whole, "component", "left").select(F.when(F.col("whole"), F.xxhash64("component")).otherwise(F.col("star")).alias("component"), "sig", "known").distinct()
    rest = cut(rest.join(one, "sig").select("component", "sig", "print", "name", "size", "known"))
    links = sure.unionByName(verified(rest, texts_of(rest), words, radius, similarity))
    return group_rows(printed.select("doc_id", F.col("sig").alias("print")), links).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest doc_id.

    Texts without words are nobody's copies, and rows without a doc_id can't be named: both
    stay. Rows that repeat a doc_id count as one document, of which the row with the smallest
    text stays (a null text is smallest), and of equal texts the one with the smallest hash of
    the other columns. An empty table gives an empty result. All columns are returned as they are.
    """
    groups = near_copies(docs, text_col=text_col, **options)
    gone = groups.where("doc_id is not null and component_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("_least")).where("doc_id <> _least").select(F.col("doc_id").alias("_gone"))
    twice = cut(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_twice")).agg(F.count("*").alias("_n")).where("_n > 1").select("_twice"))
    gone, again = sent(cut(gone)), sent(twice)
    kept = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    if twice.isEmpty():
        return kept
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    order = F.struct(F.col(text_col).isNotNull().alias("a"), F.col(text_col).alias("b"), F.xxhash64(*plain).alias("c"))
    repeated = kept.join(again, kept["doc_id"] == again["_twice"], "left_semi")
    one = repeated.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("_row")).select("_row.*")
    return kept.join(again, kept["doc_id"] == again["_twice"], "left_anti").unionByName(one)
