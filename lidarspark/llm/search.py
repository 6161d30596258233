"""Ranked lexical search: an inverted index in shards, walked document at a time.

A shard is a bounded run of documents. Its index has a row for each term with the documents that
hold it, as gaps between their places in the order of doc_id, and their occurrences, both as
variable-length integers. A query merges the postings of its terms by a heap of the next document
of each list and keeps the best in a bounded heap. Once that is full, lists whose best points
together can't lift a document into it leave the merge and are only asked about documents that the
others bring (MaxScore). The shards' best are merged over groups of shards, then over all.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace
from itertools import count
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cuts import scratch
from .common import cut, text_array

#: Bytes of text and documents of a shard at most; a longer text is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 1 << 24, 1 << 16
#: Bytes of a text that are cut into terms in one step.
STEP_BYTES = 1 << 22
#: Bytes of the items that are searched in one pass over the index; a longer item is a pass of its own.
BLOCK_BYTES = 1 << 22
#: Groups of shards whose best are merged before the last merge.
GROUPS = 64

#: Bytes of terms: ASCII letters, which become lower case, digits, and all of non-ASCII characters.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32) for b in range(256))


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded length."""
    folded, at = raw.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + STEP_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values, seven bits to a byte with the low ones first, the last byte below 128; and where each ends."""
    rest, width = values >> 7, np.ones(len(values), np.int64)
    while rest.any():
        width += rest > 0
        rest = rest >> 7
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(width.max(initial=0))):
        has = width > k
        out[(ends - width)[has] + k] = (values[has] >> (7 * k) & 127) | np.where(width[has] > k + 1, 128, 0)
    return out, ends


def read_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128) + 1
    starts = np.concatenate([[0], ends])[:-1]
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts) if len(ends) else np.zeros(0, np.int64)


class _Shard:
    """The documents of a shard while it is filled."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.terms: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.places: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.bytes = 0

    def add(self, doc: int | None, raw: bytes) -> None:
        size, self.bytes = 0, self.bytes + len(raw)
        for part in terms_of(raw):
            self.terms.append(np.fromiter(map(self.places.__getitem__, part), np.int32, len(part)))
            size += len(part)
        self.ids.append(doc)
        self.sizes.append(size)

    @property
    def full(self) -> bool:
        return self.bytes >= SHARD_BYTES or len(self.ids) >= SHARD_DOCS

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """A row for each term, and one without a term for the documents: their ids and sizes in order of id, nulls last."""
        n = len(self.ids)
        order = sorted(range(n), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        size = np.array(self.sizes, np.int64)
        known = [self.ids[i] for i in order if self.ids[i] is not None]
        table = np.concatenate([[len(known)], np.array(known, np.int64), size[order]]).astype("<i8").tobytes()
        yield _index_batch(shard, [None], [int((size > 0).sum())], [int(size.sum())], [table])
        keys = np.concatenate([t.astype(np.int64) for t in self.terms] or [np.zeros(0, np.int64)]) * n + np.repeat(place, size)
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        if not len(first):
            return
        tf, term, doc = np.diff(first, append=len(keys)), keys[first] // n, keys[first] % n
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        gap = np.diff(doc, prepend=0)
        gap[starts] = doc[starts]
        data, ends = varints(np.column_stack([gap, tf]).ravel())
        df, raw = np.diff(starts, append=len(term)), data.tobytes()
        bounds = np.append(ends[2 * starts] - np.where(starts > 0, ends[2 * starts] - ends[2 * starts - 1], ends[0]), len(raw))
        names = list(self.places)
        for lo in range(0, len(starts), 1 << 16):
            some = range(lo, min(lo + (1 << 16), len(starts)))
            yield _index_batch(shard, [names[term[starts[i]]] for i in some], df[some.start : some.stop], np.add.reduceat(tf, starts)[some.start : some.stop], [raw[bounds[i] : bounds[i + 1]] for i in some])


def _index_batch(shard: int, terms: list, df: list, n: list, postings: list[bytes]) -> pa.RecordBatch:
    named = pa.array(terms, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(terms), pa.int64()), "term": named, "df": pa.array(df, pa.int64()), "n": pa.array(n, pa.int64()), "postings": pa.array(postings, pa.binary())})


def build_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(shard, term, df, n, postings)``: the index of all documents, written as Parquet and opened.

    ``path`` is a folder that all executors share; without one, a new one in the checkpoint folder.
    Terms are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. The
    row of a shard whose term is null has its documents: df with at least one term, n terms in all.
    A null text has no terms; repeated rows are documents of their own; documents without an id are
    searched too, and stand behind the others. An empty table gives an empty index. Documents aren't
    shuffled: a shard is filled from the rows that one task reads.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = count(TaskContext.get().partitionId() << 32), _Shard()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), text_array(batch.column(1))):
                shard.add(doc, text.as_buffer().to_pybytes())
                if shard.full:
                    yield from shard.rows(next(number))
                    shard = _Shard()
        if shard.ids:
            yield from shard.rows(next(number))

    path = path or scratch(docs.sparkSession, "postings")
    found = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(fill, "shard long, term string, df long, n long, postings binary")
    found.write.parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def best_documents(lists: list[tuple[list[int], list[int]]], looks: list[dict[int, int]], k: int) -> list[tuple[int, int]]:
    """The k best (score, place), the earlier of equals first; lists: (ascending places, points above 0) of each term.

    ``looks`` has the same points by place.
    """
    by_most = sorted((max(points), i) for i, (_, points) in enumerate(lists))
    lists, looks, n = [lists[i] for _, i in by_most], [looks[i] for _, i in by_most], len(lists)
    most = [0]
    for x, _ in by_most:
        most.append(most[-1] + x)
    at, merged, bar = [0] * n, 0, 0  # lists below `merged` are only asked
    kept: list[tuple[int, int]] = []
    heap = [places[0] * n + i for i, (places, _) in enumerate(lists)]
    heapify(heap)
    while heap:
        doc, score = heap[0] // n, 0
        while heap and heap[0] // n == doc:
            i = heap[0] % n
            places, points = lists[i]
            score += points[at[i]]
            at[i] += 1
            if at[i] < len(places):
                heapreplace(heap, places[at[i]] * n + i)
            else:
                heappop(heap)
        for i in range(merged - 1, -1, -1):
            if score + most[i + 1] <= bar:
                break
            score += looks[i].get(doc, 0)
        if score > bar:
            if len(kept) < k:
                heappush(kept, (score, -doc))
            else:
                heapreplace(kept, (score, -doc))
            if len(kept) == k and kept[0][0] > bar:
                bar, before = kept[0][0], merged
                while merged < n and most[merged + 1] <= bar:
                    merged += 1
                if merged > before:
                    heap = [lists[i][0][at[i]] * n + i for i in range(merged, n) if at[i] < len(lists[i][0])]
                    heapify(heap)
    return [(score, -doc) for score, doc in sorted(kept, reverse=True)]


def _search_shard(queries: list[tuple[int, dict[str, int]]], weights: dict[str, int], n_docs: int, n_terms: int, k: int):
    """The function that answers all queries of a block from the rows of one shard."""

    def answer(rows: pa.Table) -> pa.Table:
        postings = dict(zip(rows.column("term").to_pylist(), rows.column("postings").to_pylist()))
        table = np.frombuffer(postings.pop(None), "<i8")
        ids, sizes = table[1 : 1 + table[0]].tolist(), table[1 + table[0] :]
        ids += [None] * (len(sizes) - len(ids))
        m = 75 + 25 * sizes * n_docs // n_terms
        lists, looks = {}, {}
        for term, data in postings.items():
            read = read_varints(data)
            places, tf = np.cumsum(read[::2]), read[1::2]
            points = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[places]))
            there = points > 0
            if there.any():
                lists[term] = places[there].tolist(), points[there].tolist()
                looks[term] = dict(zip(*lists[term]))
        found: list[tuple[int, int | None, int]] = []
        for q, terms in queries:
            own = [(t, times) for t, times in terms.items() if t in lists]
            if own:
                picked = [lists[t] if times == 1 else (lists[t][0], [times * x for x in lists[t][1]]) for t, times in own]
                asked = [looks[t] if times == 1 else dict(zip(*p)) for (t, times), p in zip(own, picked)]
                found += [(q, ids[place], score) for score, place in best_documents(picked, asked, k)]
        q, doc, score = zip(*found) if found else ((), (), ())
        return pa.table({"q": pa.array(q, pa.int32()), "shard": pa.array([rows.column("shard")[0].as_py()] * len(q), pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})

    return answer


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The distinct rows (id, text) of ``items`` in lists of bounded bytes."""
    block, size = [], 0
    for item, text in items.where("text is not null").distinct().toLocalIterator():
        block.append((item, text))
        size += len(text) + 64
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of highest score above 0 of every item.

    ``index`` comes from :func:`build_index`. The score sums, over the terms of an item with their
    repeats, weight * saturated occurrences in 64-bit integers; see the README for the formula. Of equal scores the
    smaller doc_id comes first, a document without one last; documents that repeat a doc_id are
    ranked each by itself. Rows that repeat both an item's id and its text are one item; texts that
    share an id are ranked each by itself. Items that are null, empty or without a known term have
    no rows. Items pass in blocks of bounded size, each against all shards.
    """
    spark = index.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    n_docs, n_terms = index.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in _blocks(items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))) if n_docs else ():
        out = out.union(_search_block(spark, index, block, kind, n_docs, n_terms, k))
    return out


def _search_block(spark: SparkSession, index: DataFrame, block: list[tuple], kind: str, n_docs: int, n_terms: int, k: int) -> DataFrame:
    queries = [(q, Counter(t.decode() for part in terms_of(text.encode()) for t in part)) for q, (_, text) in enumerate(block)]
    asked = spark.createDataFrame([(t,) for t in sorted({t for _, terms in queries for t in terms})], "term string")
    held = index.join(F.broadcast(asked), "term")  # at most the terms of BLOCK_BYTES
    weights = {r.term: floor(1000 * log((2 * n_docs + 2) / (2 * r.df + 1))) for r in held.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    queries = [(q, {t: n for t, n in terms.items() if weights.get(t, 0) > 0}) for q, terms in queries]
    heavy = spark.createDataFrame([(t,) for t in sorted(t for t, w in weights.items() if w > 0)], "term string")
    rows = index.join(F.broadcast(heavy), "term").select("shard", "term", "postings").union(index.where("term is null").select("shard", "term", "postings"))
    best = rows.groupBy("shard").applyInArrow(_search_shard(queries, weights, n_docs, n_terms, k), "q int, shard long, doc_id long, score long")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("shard"))
    some = Window.partitionBy("q", "group").orderBy(*order)
    best = best.withColumn("group", F.pmod(F.hash("shard"), F.lit(GROUPS))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], f"q int, item_id {kind}")
    return cut(best.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))


def search_sql() -> str:
    """DuckDB SQL for the rows of :func:`search` over ``documents`` and ``benchmark``, written from the definitions."""
    term = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
    return f"""
WITH asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {term} FROM benchmark) GROUP BY ALL),
postings AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {term} FROM documents) GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, corpus WHERE term IN (SELECT term FROM asked) GROUP BY term),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN docs USING (doc_id), corpus GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
WHERE rank <= 20
"""
