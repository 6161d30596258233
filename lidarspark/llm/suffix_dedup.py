"""Exact substring removal by distributed sorting of sampled suffixes.

A difference cover samples positions, sorts their leading triples into names, and places every
other suffix by the bytes up to its next sample and that sample's name; adjacent prefixes are
then compared. Matches are at least ``length`` (50) bytes here, so no order beyond a window of
that many bytes is needed, and the cover is content-defined (a synchronising set): of the 27
triples of 8-byte words (24 bytes) that start in a window, the one with the smallest hash is its
sample. Equal windows have the same sample at the same place, so that a name's windows only have
to be merged with each other; a cover of fixed residues compares each residue with every other
and ships each suffix.

1. Equal texts are one text from the first exchange on; their other documents go whole.
2. Names: a block of texts sends each of its names once, six bytes long, to the name's bucket,
   which answers with a bit for each: is it held by two texts? Other names can't have a match.
3. Suffixes: the samples of such names, with the bytes of the windows they stand for, are sent
   to the buckets once for each class of equal runs in a block, with the smallest and the largest
   of its documents. A bucket sorts the windows of a name and compares adjacent ones byte by byte.
4. The block is told the smallest document of the windows, for classes that lose any, and cuts
   its texts.

The texts are exchanged once; all steps read that exchange. What reaches a bucket of one name is
at most a record a block for each class, however many documents hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roller, cut, mix64, partitions, spread_join, text_array, text_bytes

LENGTH, TRIPLE = 50, 24
#: Bytes of text in which samples are sought at once; longer texts are read in pieces that overlap.
PIECE = 1 << 21
#: Bytes of text of a block, and of a partition; a longer text is a block of its own.
BLOCK, PART = 1 << 22, 1 << 26
_POS = np.uint64((1 << 22) - 1)
#: Documents without an id sort after all others and are nobody's source.
NO_ID = np.iinfo(np.int64).max
#: Distinct texts that a task remembers while it leaves out copies.
SEEN = 1 << 17

_CLASS = np.dtype([("name", "<u8"), ("least", "<i8"), ("most", "<i8"), ("block", "<i4"), ("number", "<u4"), ("windows", "u1"), ("lead", "u1")])
#: The windows from:to of each run of a class also start in the document ``least``.
_FOUND = np.dtype([("number", "<u4"), ("from", "u1"), ("to", "u1"), ("least", "<i8")])


def samples(data: np.ndarray, off: np.ndarray, roller: Roller, length: int = LENGTH, triple: int = TRIPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, sample, first window, windows) of all runs of windows with one sample; texts lie in data[off[i]:off[i+1]]."""
    none = (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    n = len(data)
    if n < length:
        return none
    names = mix64(roller.windows(roller.prefix(data), triple))
    packed = (names & ~_POS) | np.arange(len(names), dtype=np.uint64)
    width, reach = length - triple + 1, 1
    least = packed
    while reach * 2 <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    at = (least & _POS).astype(np.int64)
    # windows that reach over a text's end are none
    room = np.repeat(off[1:], np.diff(off))[: len(at)] - np.arange(len(at)) >= length
    windows = np.flatnonzero(room)
    if not len(windows):
        return none
    at = at[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    return names[at[first]], at[first], windows[first], np.diff(np.append(first, len(windows)))


def _pieces(off: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text, first byte, last byte) of what is read at once; a longer text comes in overlapping pieces."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + PIECE, "right")) - 1)
        if off[hi] - off[lo] <= PIECE:
            yield lo, hi, int(off[lo]), int(off[hi])
        else:
            for s in range(int(off[lo]), int(off[hi]) - LENGTH + 1, PIECE - LENGTH + 1):
                yield lo, hi, s, min(s + PIECE, int(off[hi]))
        lo = hi


def _take(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes data[start:start+size] one after another."""
    ends = np.cumsum(size)
    step = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(step):
        step[0] = start[0]
        step[ends[:-1]] = start[1:] - (start[:-1] + size[:-1] - 1)
        np.cumsum(step, out=step)
    return data[step]


class Block:
    """The distinct texts of a block in the order of their digests, and their samples."""

    def __init__(self, rows: pa.Table):
        digest = rows["digest"].to_pylist()
        doc = rows["doc"].to_numpy()
        order = sorted(range(len(digest)), key=lambda i: (digest[i], doc[i]))
        first = [k for k in range(len(order)) if not k or digest[order[k]] != digest[order[k - 1]]]
        self.digests = [digest[order[k]] for k in first]
        self.least = doc[[order[k] for k in first]] if first else np.zeros(0, np.int64)
        # a row without a text only lowers the smallest document of its digest
        held = {digest[i]: i for i in np.flatnonzero(rows["text"].is_valid().to_numpy())}
        self.data, self.off = text_bytes(text_array(rows["text"].combine_chunks().take(pa.array([held[d] for d in self.digests], pa.int64()))))

    def sample(self, roller: Roller) -> None:
        """name, text, first (byte of the first window), windows and lead of all runs."""
        found = []
        for lo, hi, b0, b1 in _pieces(self.off):
            own = np.clip(self.off[lo : hi + 1] - b0, 0, b1 - b0)
            name, at, first, many = samples(self.data[b0:b1], own, roller)
            found.append((name, lo + np.searchsorted(own, first, "right") - 1, first + b0, many, at - first))
        self.name, self.text, self.first, self.windows, self.lead = [np.concatenate(c) for c in zip(*found)] if found else (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 4

    def names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct names, whether two texts hold them, the order of the samples by name, and each one's place."""
        order = np.argsort(self.name, kind="stable")
        new = np.append(True, self.name[order][1:] != self.name[order][:-1])[: len(order)]
        cuts = np.flatnonzero(new)
        text = self.text[order]  # texts ascend within a name
        two = text[cuts] != text[np.append(cuts[1:], len(order))[: len(cuts)] - 1] if len(cuts) else np.zeros(0, bool)
        return self.name[order][cuts], two, order, np.cumsum(new) - 1

    def classes(self, roller: Roller) -> tuple[np.ndarray, np.ndarray]:
        """The samples in the order of their classes, and where classes begin: runs of equal name, lead and bytes."""
        size = self.windows + LENGTH - 1
        run = np.zeros(len(self.name), np.uint64)
        for lo, hi, b0, b1 in _pieces(self.off):
            i, j = np.searchsorted(self.first, [b0, b1 - LENGTH + 1])
            if i < j:
                own = self.first[i:j] - b0
                run[i:j] = roller.between(roller.prefix(self.data[b0:b1]), own, own + size[i:j])
        key = mix64(self.name + mix64(run) + (self.lead * 256 + self.windows).astype(np.uint64))
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])[: len(order)]
        # equal keys are one class only where the bytes confirm it
        again = np.flatnonzero(~new)
        for lo in range(0, len(again), 1 << 15):
            rows = again[lo : lo + (1 << 15)]
            a, b = order[rows], order[rows - 1]
            alike = (size[a] == size[b]) & (self.lead[a] == self.lead[b])
            part, x, y = rows[alike], a[alike], b[alike]
            differ = np.add.reduceat(_take(self.data, self.first[x], size[x]) != _take(self.data, self.first[y], size[x]), np.cumsum(size[x]) - size[x], dtype=np.int64) > 0 if len(part) else np.zeros(0, bool)
            new[part] = differ
            new[rows[~alike]] = True
        return order, np.flatnonzero(new)


def send_names(block: Block, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, names of six bytes in order, then a bit for each: held by two texts of the block)."""
    name, two, _, _ = block.names()
    bucket, order, cuts = _by_bucket(name, buckets)
    raw = name[order].view(np.uint8).reshape(-1, 8)[:, 2:]
    for i, j in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(bucket[i]), raw[i:j].tobytes() + np.packbits(two[order[i:j]]).tobytes()


def _by_bucket(name: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bucket = ((name & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    return bucket, order, np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(order)])


def meet_names(blobs: list[bytes]) -> list[bytes]:
    """For each blob of one bucket the bits of its names: held by two texts of the corpus."""
    counts, names, two = [], [], []
    for b in blobs:
        k = len(b) * 8 // 49
        raw = np.zeros((k, 8), np.uint8)
        raw[:, :6] = np.frombuffer(b, np.uint8, k * 6).reshape(k, 6)
        counts.append(k)
        names.append(raw.view(np.uint64).ravel())
        two.append(np.unpackbits(np.frombuffer(b, np.uint8, offset=k * 6), count=k).astype(bool))
    name, many = np.concatenate(names), np.concatenate(two)
    order = np.argsort(name, kind="stable")
    cuts = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1])[: len(order)])
    width = np.diff(np.append(cuts, len(order)))
    shared = np.empty(len(name), bool)
    shared[order] = np.repeat(np.logical_or.reduceat(many[order], cuts) | (width > 1), width) if len(cuts) else False
    return [np.packbits(s).tobytes() for s in np.split(shared, np.cumsum(counts)[:-1])]


def send_classes(block: Block, at: int, answers: dict[int, bytes], buckets: int, roller: Roller) -> Iterator[tuple[int, bytes]]:
    """(bucket, classes and the bytes of one run of each) of the names that two texts hold."""
    name, _, order, place = block.names()
    bucket, by, cuts = _by_bucket(name, buckets)
    shared = np.zeros(len(name), bool)
    for i, j in zip(cuts, np.append(cuts[1:], len(by))):
        shared[by[i:j]] = np.unpackbits(np.frombuffer(answers[int(bucket[i])], np.uint8), count=j - i).astype(bool)
    use = np.empty(len(order), bool)
    use[order] = shared[place]
    member, starts = block.classes(roller)
    keep = np.flatnonzero(use[member[starts]]) if len(starts) else starts
    if not len(keep):
        return
    doc = block.least[block.text[member]]
    low, high = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
    one = member[starts[keep]]
    bucket, by, cuts = _by_bucket(block.name[one], buckets)
    one, keep = one[by], keep[by]
    records = np.zeros(len(one), _CLASS)
    records["name"], records["least"], records["most"], records["block"], records["number"] = block.name[one], low[keep], high[keep], at, keep
    records["windows"], records["lead"] = block.windows[one], block.lead[one]
    size = block.windows[one] + LENGTH - 1
    held, ends = _take(block.data, block.first[one], size), np.concatenate([[0], np.cumsum(size)])
    for i, j in zip(cuts, np.append(cuts[1:], len(one))):
        yield int(bucket[i]), np.uint32(j - i).tobytes() + records[i:j].tobytes() + held[ends[i] : ends[j]].tobytes()


def meet_classes(blobs: list[bytes], roller: Roller, chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and what they have to know of their classes, from the classes of one bucket."""
    records, held = [], []
    for b in blobs:
        n = int(np.frombuffer(b, np.uint32, 1)[0])
        records.append(np.frombuffer(b, _CLASS, n, 4))
        held.append(np.frombuffer(b, np.uint8, offset=4 + n * _CLASS.itemsize))
    rec, data = np.concatenate(records), np.concatenate(held)
    size = rec["windows"].astype(np.int64) + LENGTH - 1
    start = np.cumsum(size) - size
    order = np.argsort(rec["name"], kind="stable")
    cuts = np.flatnonzero(np.append(True, rec["name"][order][1:] != rec["name"][order][:-1]))
    # names of one document only can't be sources of another
    many = np.minimum.reduceat(rec["least"][order], cuts) < np.maximum.reduceat(rec["most"][order], cuts)
    use = order[np.repeat(many, np.diff(np.append(cuts, len(order))))]
    # whole names at a time, about ``chunk`` windows
    edge = np.flatnonzero(np.append(rec["name"][use][1:] != rec["name"][use][:-1], True)[: len(use)]) + 1
    windows = np.cumsum(rec["windows"][use].astype(np.int64))
    blocks, found, lo = [np.zeros(0, np.int32)], [np.zeros(0, _FOUND)], 0
    while lo < len(use):
        base = windows[lo - 1] if lo else 0
        k = max(0, int(np.searchsorted(windows[edge - 1], base + chunk, "right")) - 1)
        hi = int(edge[k]) if edge[k] > lo else int(edge[np.searchsorted(edge, lo, "right")])
        owner, out = _merge(rec[use[lo:hi]], start[use[lo:hi]], data, roller)
        blocks.append(rec["block"][use[lo:hi]][owner])
        found.append(out)
        lo = hi
    return np.concatenate(blocks), np.concatenate(found)


def _merge(rec: np.ndarray, start: np.ndarray, data: np.ndarray, roller: Roller) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``rec`` and what was found of them: the windows of some names, sorted, adjacent ones compared."""
    many = rec["windows"].astype(np.int64)
    size = many + LENGTH - 1
    part = _take(data, start, size)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(rec)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    at = begin[owner] + place
    hashes = mix64(roller.windows(roller.prefix(part), LENGTH))[at]
    order = np.argsort(hashes, kind="stable")
    same = _adjacent(part, at, hashes, order)
    cuts = np.flatnonzero(~same)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(rec["least"][owner[order]], cuts), np.diff(np.append(cuts, len(order))))
    # back in the order of their places; runs with the same smallest document are one finding
    gone = least < rec["most"][owner]
    new = gone.copy()
    new[1:] &= (owner[1:] != owner[:-1]) | (least[1:] != least[:-1]) | ~gone[:-1]
    first = np.flatnonzero(new)
    last = gone.copy()
    last[:-1] &= (owner[1:] != owner[:-1]) | (least[1:] != least[:-1]) | ~gone[1:]
    out = np.zeros(len(first), _FOUND)
    out["number"], out["from"], out["to"], out["least"] = rec["number"][owner[first]], place[first], place[np.flatnonzero(last)] + 1, least[first]
    return owner[first], out


def _adjacent(part: np.ndarray, at: np.ndarray, hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For windows sorted by hash: is each one's text that of the window before? Sorts ``order`` further where one hash has several texts."""
    view = as_strided(part, (len(part) - LENGTH + 1, LENGTH), (1, 1))
    sorted_hashes = hashes[order]
    alike = np.append(False, sorted_hashes[1:] == sorted_hashes[:-1])
    same = alike.copy()

    def confirm(rows: np.ndarray) -> None:
        for i in range(0, len(rows), 1 << 18):
            r = rows[i : i + (1 << 18)]
            same[r] = (view[at[order[r]]] == view[at[order[r - 1]]]).all(axis=1)

    confirm(np.flatnonzero(alike))
    starts = np.flatnonzero(~alike)
    odd = np.unique(np.searchsorted(starts, np.flatnonzero(alike & ~same), "right") - 1)
    for k in odd:
        lo, hi = starts[k], starts[k + 1] if k + 1 < len(starts) else len(order)
        own = order[lo:hi]
        order[lo:hi] = own[np.argsort(np.array([view[i].tobytes() + b"." for i in at[own]]), kind="stable")]
        confirm(np.arange(lo + 1, hi))
    return same


def cleaned(block: Block, found: np.ndarray, roller: Roller) -> Iterator[tuple[bytes, int, int, int, int, bytes, bytes]]:
    """(digest, smallest document, n_bytes, n_removed, n_spans, text, kept text) of the texts of a block."""
    member, starts = block.classes(roller)
    many = np.diff(np.append(starts, len(member)))[found["number"]]
    which = np.repeat(np.arange(len(found)), many)
    run = member[starts[found["number"]][which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)] if len(which) else np.zeros(0, np.int64)
    text = block.text[run]
    gone = found["least"][which] < block.least[text]
    text, which, run = text[gone], which[gone], run[gone]
    begin = block.first[run] - block.off[text] + found["from"][which]
    end = block.first[run] - block.off[text] + found["to"][which].astype(np.int64) - 1 + LENGTH
    order = np.lexsort((begin, text))
    text, begin, end = text[order], begin[order], end[order]
    edges = np.searchsorted(text, np.arange(len(block.digests) + 1))
    raw = block.data.tobytes()
    for i, digest in enumerate(block.digests):
        whole = raw[block.off[i] : block.off[i + 1]]
        lo, hi = edges[i], edges[i + 1]
        if lo == hi:
            yield digest, int(block.least[i]), len(whole), 0, 0, whole, whole
            continue
        reach = np.maximum.accumulate(end[lo:hi])
        new = np.append(True, begin[lo:hi][1:] > reach[:-1])
        a, b = begin[lo:hi][new].tolist(), reach[np.append(np.flatnonzero(new)[1:], hi - lo) - 1].tolist()
        kept = b"".join(whole[x:y] for x, y in zip([0, *b], [*a, len(whole)]))
        yield digest, int(block.least[i]), len(whole), len(whole) - len(kept), len(a), whole, kept


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept binary) of every row of ``docs``.

    Each byte goes that lies in a 50-byte string which also starts in a document with a smaller
    doc_id. A null text counts as empty. Rows without a doc_id are cleaned but are nobody's
    source; rows that share a doc_id are no sources of each other, and each comes back. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("digest", F.unhex(F.md5("text")))
    small = cut(source.select("doc_id", "doc", "digest", F.octet_length("text").cast("long").alias("n")))
    total = small.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // (block_bytes or BLOCK)))
    parts = max(partitions(spark), -(-total // PART))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text at most once a task; a smaller document of one that was sent comes without it."""
        seen: dict[bytes, int] = {}
        for batch in batches:
            doc, digest = batch.column("doc").to_pylist(), batch.column("digest").to_pylist()
            rows, whole = [], []
            for i, (d, k) in enumerate(zip(doc, digest)):
                had = seen.get(k)
                if had is None or d < had:
                    rows.append(i)
                    whole.append(had is None)
                    seen[k] = d
            text = pa.compute.if_else(pa.array(whole, pa.bool_()), batch.column("text").take(pa.array(rows, pa.int64())), pa.scalar(None, batch.column("text").type))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("block", "digest", "doc")), text], ["block", "digest", "doc", "text"])
            if len(seen) > SEEN:
                seen.clear()

    texts = source.select(F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int").alias("block"), "digest", "doc", "text").mapInArrow(once, "block int, digest binary, doc long, text string").repartition(parts, "block")

    def table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
        columns = list(zip(*rows)) or [()] * len(schema)
        return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, schema)], names=[n for n, _ in schema])

    blob = [("bucket", pa.int32()), ("block", pa.int32()), ("blob", pa.binary())]
    spelled = "bucket int, block int, blob binary"

    def whole(rows: pa.Table) -> Block:
        block = Block(rows)
        block.sample(Roller())
        return block

    def name(rows: pa.Table) -> pa.Table:
        at = rows["block"][0].as_py()
        return table([(b, at, x) for b, x in send_names(whole(rows), parts)], blob)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), pa.schema(blob))
        if len(held):
            bits = meet_names(held["blob"].to_pylist())
            yield from pa.table([held["bucket"], held["block"], pa.array(bits, pa.binary())], names=["bucket", "block", "blob"]).combine_chunks().to_batches()

    def suffix(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(rows):
            return table([], blob)
        at, known = rows["block"][0].as_py(), dict(zip(answers["bucket"].to_pylist(), answers["blob"].to_pylist()))
        return table([(b, at, x) for b, x in send_classes(whole(rows), at, known, parts, Roller())], blob)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for batch in batches for b in batch.column("blob").to_pylist()]
        if held:
            block, found = meet_classes(held, Roller())
            order = np.argsort(block, kind="stable")
            block, found = block[order], found[order]
            cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(block)])
            yield from table([(0, int(block[i]), found[i:j].tobytes()) for i, j in zip(cuts, np.append(cuts[1:], len(block)))], blob).to_batches()

    done = [("digest", pa.binary()), ("least", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("own_sha256", pa.string()), ("kept", pa.binary()), ("own", pa.binary())]

    def clean(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not len(rows):
            return table([], done)
        spans = np.frombuffer(b"".join(found["blob"].to_pylist()), _FOUND)
        hexed = lambda b: hashlib.sha256(b).hexdigest()
        out = []
        for digest, least, n, gone, runs, own, kept in cleaned(whole(rows), spans, Roller()):
            out.append((digest, least, n, gone, runs, hexed(kept), hexed(own if n < LENGTH else b""), kept if kept_text else None, own if kept_text and n < LENGTH else b"" if kept_text else None))
        return table(out, done)

    # every name and class of a bucket meets in one task, of about PART bytes of text
    deal = lambda rows: rows.repartition(parts, "bucket")
    answers = deal(texts.groupBy("block").applyInArrow(name, spelled)).mapInArrow(answer, spelled).repartition(parts, "block")
    classes = deal(texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(suffix, spelled))
    found = classes.mapInArrow(merge, spelled).repartition(parts, "block")
    result = texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(clean, "digest binary, least long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, own_sha256 string, kept binary, own binary")
    # of equal texts, that of the smallest document is cut by spans, the others go whole
    both = spread_join(small, result, "digest")
    copy, long = F.col("doc") > F.col("least"), F.col("n_bytes") >= LENGTH
    columns = [
        "doc_id",
        "n_bytes",
        F.when(~copy, F.col("n_removed")).when(long, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"),
        F.when(~copy, F.col("n_spans")).when(long, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(copy, F.col("own_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    return both.select(*columns, *([F.when(copy, F.col("own")).otherwise(F.col("kept")).alias("kept")] if kept_text else []))
