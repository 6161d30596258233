"""SentencePiece encoding and decoding over a relational lattice.

The distinct words of the corpus are cut into all substrings of bounded length, which are
equi-joined to the piece table; the matches of a word are its lattice of edges. The edges are
grouped by word and folded with Spark's higher-order ``aggregate``: by Viterbi (best sum of
scores) for a unigram model, by merges in the order of scores for a BPE model, for which
Viterbi would give other pieces than the model's own. Documents are then encoded by looking
their words up in the folded table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, slices, text_array

SPACE = "▁"
#: A word of a line: a run of spaces with what follows up to the next space.
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Words of the broadcast table at most, the most frequent ones; the others are folded where they stand.
DICTIONARY = 1 << 18
#: Longest word, in characters, that goes into the lattice table.
WORD_CHARS = 48
#: Bytes of text that are encoded at once; their words take some 15 times as much as Python strings.
ENCODED_BYTES = 1 << 20


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = buf[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(buf):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, buf[i : i + n]
            i += n


class Model:
    """The piece table and the settings of a model file, read with the library on the driver."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = dict(_fields(sp.serialized_model_proto()))
        trainer, normal = dict(_fields(proto.get(2, b""))), dict(_fields(proto.get(3, b"")))
        self.kind = {1: "unigram", 2: "bpe"}.get(trainer.get(3, 1))
        if self.kind is None or normal.get(2, b"") or normal.get(4, 1):
            raise ValueError("only unigram and BPE models without text normalisation are supported")
        self.prefix = bool(normal.get(3, 1))
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.unk = sp.unk_id()
        self.byte0 = next((i for i in range(n) if sp.is_byte(i)), None)
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.table = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.longest = max(map(len, self.table), default=1)
        #: The cost of making a piece by a merge: the smallest comes first.
        self.cost = {p: -self.scores[i] for p, i in self.table.items()}
        self.raw = [bytes([i - self.byte0]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        if not any(SPACE in p.strip(SPACE) or (p.endswith(SPACE) and p.strip(SPACE)) or "\n" in p for p in self.table):
            return
        raise ValueError("pieces that reach over words are not supported")

    def fallback(self, text: str) -> list[int]:
        return [self.unk] if self.byte0 is None else [self.byte0 + b for b in text.encode()]

    def fold(self, word: str) -> list[int]:
        """The ids of one word: the same fold as :func:`fold_words`, for words outside the table."""
        table, scores = self.table, self.scores
        parts = list(word)
        if self.kind == "bpe":
            parts = self._merge_long(parts) if len(parts) > 200 else self._merge(parts)
        else:
            floor = min(self.scores) - 10
            best = [(0.0, 0, "")] + [(-1e300, 0, "")] * len(word)
            for e in range(1, len(word) + 1):
                for s in range(max(0, e - self.longest), e):
                    p = word[s:e]
                    score = scores[table[p]] if p in table else floor if e - s == 1 else None
                    if score is not None and best[s][0] + score > best[e][0]:
                        best[e] = (best[s][0] + score, s, p)
            parts, e = [], len(word)
            while e:
                parts.append(best[e][2])
                e = best[e][1]
            parts.reverse()
        return [i for p in parts for i in ([table[p]] if p in table else self.fallback(p))]

    def _merge(self, parts: list[str]) -> list[str]:
        """BPE merges: the best pair first, the leftmost of equals."""
        cost, none = self.cost.get, float("inf")
        pairs = [cost(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = cost(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = cost(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """BPE merges with a heap and linked places, for very long words."""
        import heapq

        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (k := self.table.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[k], i, parts[i] + parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = right[i]
            if not parts[i] or j < 0 or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [p for p in parts if p]

    def merge_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
        """Keys of the pairs of symbols that make a piece, in order, with its id and its rank; and the symbols of the characters.

        A symbol is a piece's id, or a number from the pieces' count on for a character that is
        no piece but part of some.
        """
        symbols = dict(self.table)
        for p in self.table:
            for c in p:
                symbols.setdefault(c, len(self.pieces) + len(symbols))
        ranks = dict(zip(sorted(set(self.cost.values())), range(len(self.table))))
        pairs = {(symbols[p[:k]] << 24) + symbols[p[k:]]: p for p in self.table for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        keys = np.array(sorted(pairs), np.int64)
        made = [pairs[k] for k in keys.tolist()]
        return keys, np.array([self.table[p] for p in made], np.int64), np.array([ranks[self.cost[p]] for p in made], np.int64), {c: i for c, i in symbols.items() if len(c) == 1}

    @cached_property
    def merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`merge_table`, with the symbols by code point (-1: none), up to the last that has one."""
        keys, made, rank, characters = self.merge_table()
        known = np.full(max(map(ord, characters), default=0) + 1, -1, np.int64)
        known[[ord(c) for c in characters]] = list(characters.values())
        return keys, made, rank, known

    def fold_many(self, words: list[str], chunk: int = 4096, longest: int = 64) -> list[bytes]:
        """The ids of many words, as :meth:`fold` gives them; BPE merges step by step in all words of a chunk at once."""
        if self.kind != "bpe":
            return [np.array(self.fold(w), np.int32).tobytes() for w in words]
        keys, made, rank, known = self.merges
        none = np.iinfo(np.int64).max
        out: list[bytes] = [b""] * len(words)

        def look(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = (a << 24) + b
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (keys[at] == key) & (a >= 0) & (b >= 0)
            return np.where(hit, rank[at], none), made[at]

        def done(rows: np.ndarray, symbols: np.ndarray, sizes: np.ndarray) -> None:
            inside = np.arange(symbols.shape[1]) < sizes[:, None]
            flat, ends = symbols[inside], np.cumsum(sizes)
            if ((flat < 0) | (flat >= len(self.pieces))).any():
                for r, e, n in zip(rows.tolist(), ends.tolist(), sizes.tolist()):
                    # characters that are no piece
                    out[r] = np.array([i for s in flat[e - n : e].tolist() for i in ([s] if 0 <= s < len(self.pieces) else self.fallback(chr(-2 - s) if s < 0 else plain[s]))], np.int32).tobytes()
                return
            raw = flat.astype(np.int32).tobytes()
            for r, e, n in zip(rows.tolist(), ends.tolist(), sizes.tolist()):
                out[r] = raw[4 * (e - n) : 4 * e]

        plain = {int(known[ord(c)]): c for c in map(chr, np.flatnonzero(known >= len(self.pieces)).tolist())} if len(keys) else {}
        size = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero((size > longest) | (size == 0)).tolist():
            out[i] = np.array(self.fold(words[i]), np.int32).tobytes()
        order = np.flatnonzero((size > 0) & (size <= longest))
        order = order[np.argsort(size[order], kind="stable")]
        for lo in range(0, len(order), chunk):
            rows = order[lo : lo + chunk]
            sizes = size[rows]
            point = np.frombuffer("".join([words[i] for i in rows.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            symbol = np.where(point < len(known), known[np.minimum(point, len(known) - 1)], -1)
            symbols = np.full((len(rows), int(sizes[-1]) + 1), -1, np.int64)
            symbols[np.arange(symbols.shape[1]) < sizes[:, None]] = np.where(symbol < 0, -2 - point, symbol)
            costs, joined = look(symbols[:, :-1], symbols[:, 1:])
            while len(rows):
                at = costs.argmin(axis=1)
                every = np.arange(len(rows))
                more = costs[every, at] != none
                if not more.all():
                    done(rows[~more], symbols[~more], sizes[~more])
                    rows, symbols, sizes, costs, joined, at = rows[more], symbols[more], sizes[more], costs[more], joined[more], at[more]
                    every = np.arange(len(rows))
                    if not len(rows):
                        break
                symbols[every, at] = joined[every, at]
                # the places after the pair move up by one
                place = np.arange(costs.shape[1] - 1)
                symbols = np.take_along_axis(symbols, np.arange(symbols.shape[1] - 1) + (np.arange(symbols.shape[1] - 1) > at[:, None]), axis=1)
                moved = place + (place >= at[:, None])
                costs, joined = np.take_along_axis(costs, moved, axis=1), np.take_along_axis(joined, moved, axis=1)
                sizes = sizes - 1
                if not costs.shape[1]:
                    done(rows, symbols, sizes)
                    break
                for shift in (-1, 0):
                    some = np.flatnonzero((at + shift >= 0) & (at + shift < costs.shape[1]))
                    k = at[some] + shift
                    costs[some, k], joined[some, k] = look(symbols[some, k], symbols[some, k + 1])
        return out

    def words(self, text: str) -> list[str]:
        """Runs of spaces, as space marks, with what follows up to the next space or line end; and line ends."""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if self.prefix and text:
            text = " " + text
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            if "  " in line or line[-1:] == " ":
                out += _WORD.findall(line.replace(" ", SPACE))
            elif line:
                # single spaces only: the first word is empty where the line begins with one
                own = line.replace(" ", " " + SPACE).split(" ")
                out += own if own[0] else own[1:]
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


class Dictionary:
    """The ids of many words, in flat buffers: some 45 bytes a word in every Python worker, where a dict takes some 170."""

    def __init__(self, words: pa.Array, ids: pa.Array):
        # Python's hashes differ from one process to the next: each makes its own, some thousands of words at a time
        own = [np.fromiter(map(hash, words.slice(lo, 1 << 13).to_pylist()), np.int64) for lo in range(0, len(words), 1 << 13)]
        hashes = np.concatenate([np.zeros(0, np.int64), *own])
        order = np.argsort(hashes)
        self.hashes, self.words, ids = hashes[order], words.take(pa.array(order)), ids.take(pa.array(order))
        self.flat, self.off = ids.flatten().to_numpy().astype(np.int32).tobytes(), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())]).astype(np.int32)

    def __reduce__(self):
        return Dictionary, (self.words, pa.ListArray.from_arrays(pa.array(self.off), pa.array(np.frombuffer(self.flat, np.int32))))

    def __len__(self) -> int:
        return len(self.words)

    def look(self, words: list[str]) -> dict[str, bytes]:
        """The ids of those of ``words`` that it holds; of words of one hash it may find the first only."""
        if not len(self):
            return {}
        asked = np.fromiter(map(hash, words), np.int64, len(words))
        order = np.argsort(asked)
        asked = asked[order]
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self) - 1)
        hit = self.hashes[at] == asked
        at, found = at[hit], list(map(words.__getitem__, order[hit].tolist()))
        # words of one hash need not be equal
        same = pc.equal(self.words.take(pa.array(at)), pa.array(found, self.words.type)).to_numpy(zero_copy_only=False)
        begin, end = (4 * self.off[at + k] for k in (0, 1))
        return {w: self.flat[a:b] for w, a, b, yes in zip(found, begin.tolist(), end.tolist(), same.tolist()) if yes}


def word_counts(docs: DataFrame, model: Model, text_col: str = "text", flush: int = 200_000) -> DataFrame:
    """(word, n) over all texts; counted in each task first, in tables of bounded size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in text_array(batch.column(0)).to_pylist():
                seen.update(model.words(text))
                if len(seen) > flush:
                    yield out()
        yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = DICTIONARY) -> DataFrame:
    """The most frequent words, at most ``most``: those above the lowest count that keeps within it."""
    steps = {r.b: r.k for r in counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("b")).agg(F.count("*").alias("k")).collect()}
    total, least = 0, max(steps, default=0) + 1
    for b in sorted(steps, reverse=True):
        if total + steps[b] > most:
            break
        total, least = total + steps[b], b
    return counts.where(F.floor(F.log2("n") * 8) >= least).select("word")


def fold_words(spark: SparkSession, words: DataFrame, model: Model) -> DataFrame:
    """(word, ids): substrings of bounded length, joined to the pieces, grouped by word and folded."""
    pieces = spark.createDataFrame([(p, i, float(model.scores[i])) for p, i in model.table.items()], "piece string, id int, score double")
    n = F.length("word")
    spans = words.where((n > 0) & (n <= WORD_CHARS)).select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = spans.select("word", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.length("word"), F.col("s") + model.longest))).alias("e"))
    spans = spans.withColumn("piece", F.expr("substring(word, s + 1, e - s)"))
    # the piece table is the model's, of a fixed size whatever the corpus
    edges = spans.join(F.broadcast(pieces), "piece", "left").where("id is not null or e = s + 1")
    grouped = edges.groupBy("word").agg(F.collect_list(F.struct("s", "e", "id", "score")).alias("edges"))
    # an unknown character stands for the bytes of its UTF-8 form
    if model.byte0 is None:
        unknown = f"array({model.unk})"
    else:
        unknown = f"transform(sequence(1, cast(length(hex(encode(c, 'UTF-8'))) / 2 as int)), k -> cast(conv(substring(hex(encode(c, 'UTF-8')), 2 * k - 1, 2), 16, 10) as int) + {model.byte0})"
    if model.kind == "bpe":
        # the fold's state: the places between which the symbols stand; a step joins the best pair, the leftmost of equals
        best = "array_min(transform(sequence(0, size(b) - 3), i -> struct(coalesce(-try_element_at(best, b[i] * 1000 + b[i + 2]), double('inf')) as k, i as i)))"
        step = f"if(size(b) < 3, b, transform(array({best}), m -> if(m.k = double('inf'), b, filter(b, (x, j) -> j <> m.i + 1)))[0])"
        bounds = f"aggregate(sequence(1, length(word)), sequence(0, length(word)), (b, _) -> {step})"
    else:
        # the fold's state: for each place the best score and the cuts that lead to it
        floor = min(model.scores) - 10
        edge = "filter(edges, x -> x.e = p)"
        paths = f"transform({edge}, x -> struct(acc[x.s].k + coalesce(x.score, {floor}d) as k, array_append(acc[x.s].b, p) as b))"
        bounds = f"aggregate(sequence(1, length(word)), array(struct(0d as k, array(0) as b)), (acc, p) -> array_append(acc, array_max({paths})), acc -> acc[length(word)].b)"
    mapped = grouped.select(
        "word",
        "edges",
        F.expr("map_from_entries(transform(filter(edges, x -> x.id is not null), x -> struct(x.s * 1000 + x.e, x.score)))").alias("best"),
        F.expr("map_from_entries(transform(filter(edges, x -> x.id is not null), x -> struct(x.s * 1000 + x.e, x.id)))").alias("known"),
    )
    folded = mapped.withColumn("bounds", F.expr(bounds))
    spell = f"flatten(transform(sequence(0, size(bounds) - 2), i -> if(try_element_at(known, bounds[i] * 1000 + bounds[i + 1]) is not null, array(try_element_at(known, bounds[i] * 1000 + bounds[i + 1])), transform(array(substring(word, bounds[i] + 1, bounds[i + 1] - bounds[i])), c -> {unknown})[0])))"
    return folded.select("word", F.expr(spell).alias("ids"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id, ids array<int>, n_pieces int, decoded string of every row: encoded, and decoded again.

    The ids are those of the library. Words beyond the ``dictionary`` most frequent, or longer
    than WORD_CHARS, are folded in the task that reads them, so that the table sent to the
    executors has a fixed bound. A null text gives null ids, count and text; an empty text an
    empty list. Texts that hold the model's own space mark come back with spaces, as they do
    from the library. Repeated rows each come back; an empty table gives an empty result. Other
    columns are not read.
    """
    spark = docs.sparkSession
    model = Model(path)
    words = cut(fold_words(spark, frequent_words(cut(word_counts(docs, model, text_col)), dictionary), model))
    folded = words.select("word", "ids").toArrow().combine_chunks()
    known = Dictionary(*(pa.concat_arrays(folded.column(c).chunks) if folded.num_rows else pa.array([], folded.schema.field(c).type) for c in ("word", "ids")))
    if model.kind == "bpe":
        model.merges  # made here once, not in every worker
    shared = spark.sparkContext.broadcast((model, known))

    def encoded(rows: pa.Array, column: pa.Array) -> pa.RecordBatch:
        model, known = shared.value
        words = [None if t is None else model.words(t) for t in column.to_pylist()]
        own = list(set(chain.from_iterable(w for w in words if w)))
        ids = known.look(own)
        ids.update(zip(rare := [w for w in own if w not in ids], model.fold_many(rare)))
        blobs = [None if w is None else b"".join(map(ids.__getitem__, w)) for w in words]
        sizes = np.array([0 if b is None else len(b) // 4 for b in blobs], np.int64)
        flat = np.frombuffer(b"".join(b for b in blobs if b), np.int32)
        off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        null = pa.array([b is None for b in blobs], pa.bool_())
        lists = pa.ListArray.from_arrays(pa.array(off), pa.array(flat), mask=null)
        decoded = [None if b is None else model.decode(np.frombuffer(b, np.int32).tolist()) for b in blobs]
        counts = pa.array([None if b is None else len(b) // 4 for b in blobs], pa.int32())
        return pa.RecordBatch.from_arrays([rows, lists, counts, pa.array(decoded, pa.string())], ["doc_id", "ids", "n_pieces", "decoded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(text_array(batch.column(1)), ENCODED_BYTES):
                yield encoded(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id long, ids array<int>, n_pieces int, decoded string")


def default_model() -> str:
    """The installed public model; any other path can be given instead."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
