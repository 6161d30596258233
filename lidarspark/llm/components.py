"""Connected components of a link table, in a few rounds of aggregations and equi-joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, union

#: Links that a task joins at once.
CHUNK = 1 << 17


def _forest(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Links ``(u, v)`` that join what each chunk of some ``chunk`` links joins: every node, once, to the smallest it reaches there."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        links = pa.Table.from_batches(held)
        ends = pa.concat_arrays([links[c].combine_chunks() if links[c].num_chunks != 1 else links[c].chunk(0) for c in ("u", "v")]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        at = place[ends.indices.to_numpy()]
        labels = union(np.arange(len(order)), at[: len(links)], at[len(links) :])
        nodes, moved = ends.dictionary.take(order), np.flatnonzero(labels != np.arange(len(order)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(labels[moved]))], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= chunk:
            yield joined(held)
            held, rows = [], 0
    if rows:
        yield joined(held)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014), before each of which a
    task joins the ``chunk`` links it holds: a node has one link a chunk at most from there on. A hub's
    neighbours never meet in one task, and the joins are ones whose hot side Spark may split.
    Links with a null end and loops are ignored; repeated links count once; no links give an
    empty result.
    """

    def forest(links: DataFrame) -> DataFrame:
        return links.mapInArrow(lean(lambda batches: _forest(batches, chunk)), links.schema)

    # of links (u, v) v is the smaller end
    links = cut(forest(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")))
    for _ in range(max_rounds):
        ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("up")), F.struct(F.col("v").alias("node"), F.lit(None).alias("up")))).alias("e")).select("e.*")
        nodes = ends.groupBy("node").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.count("up").alias("ups"), F.count("*").alias("all"))
        # done when every node hangs from one that hangs from none
        if nodes.where("least <> most or (ups > 0 and ups < all)").isEmpty():
            return nodes.select("node", F.coalesce("least", "node").alias("component"))
        # large-star: what hangs from v hangs from the smallest that v hangs from
        least = links.groupBy(F.col("u").alias("_v")).agg(F.min("v").alias("_least"))
        large = forest(links.join(least, links["v"] == least["_v"], "left").select("u", F.coalesce("_least", "v").alias("v")))
        # small-star: u, and all that it hangs from, hang from the smallest of them
        hung = large.groupBy("u").agg(F.min("v").alias("least"), F.collect_set("v").alias("ups"))
        links = cut(forest(hung.select(F.explode(F.concat(F.array("u"), "ups")).alias("u"), F.col("least").alias("v")).where("u <> v")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
