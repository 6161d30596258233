"""Cost-weighted shortest paths on nearest-neighbour graphs."""

from __future__ import annotations

import heapq
from functools import reduce
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cuts import cut, scratch
from .density import finite, sample_leaves, with_leaf
from .spatial import knn_join, nearest_point

#: Points of a tile, which one task walks with a heap; as the tree's sample tells them. A round costs some
#: jobs and the rounds are as many as tiles in a row, so that tiles are as large as a task holds with ease.
TILE = 100_000
#: Bytes of a row group of edges, and tiles that are named to the scan one by one.
ROW_GROUP, FEW_TILES = 1 << 23, 200


def edge_cost(distance: Column, score: Column, penalty: float = 5.0) -> Column:
    """Length, made dearer where the target's score is low."""
    return distance * (F.lit(1.0) + F.lit(float(penalty)) * (F.lit(1.0) - score))


def knn_edges(points: DataFrame, k: int = 8) -> DataFrame:
    """(src, dst, dist): each point and its k nearest others; directed, ties by id."""
    near = knn_join(points.select("id", "easting", "northing"), points, k, keep=("id",))
    return near.select(F.col("id").alias("src"), F.col("n_id").alias("dst"), F.sqrt("d2").alias("dist"))


def costed(edges: DataFrame, points: DataFrame, penalty: float = 5.0) -> DataFrame:
    scores = points.select(F.col("id").alias("dst"), F.col("trav_score").alias("_score"))
    return edges.join(scores, "dst").select("src", "dst", "dist", edge_cost(F.col("dist"), F.col("_score"), penalty).alias("cost"))


#: Rows of a tile's walk: edges, labels (a is reached over b at a cost), and offers to another tile's points.
_EDGE, _LABEL, _OFFER, _OFFER_OF_NO_LENGTH = range(4)
_ROWS = "tile int, kind int, a long, b long, cost double, other int"


def _walk(start: int, goal: int | None, bound: float):
    """The function that spreads the offers to one tile over its points with a heap.

    Costs beyond ``bound``, which the goal is known to have at most, are left. Of equally cheap ways
    the one over the smaller id counts, whenever it is found; only an edge of no cost never replaces
    another, so that no two points lead to each other.
    """

    def walk(rows: pa.Table) -> pa.Table:
        tile = rows.column("tile")[0].as_py()
        kinds = rows.column("kind").to_numpy()
        columns = ("a", "b", "cost", "other")
        of = lambda *some: zip(*[rows.filter(pa.array(np.isin(kinds, some))).column(c).to_pylist() for c in columns])
        edges = rows.filter(pa.array(kinds == _EDGE)).combine_chunks()
        edges = edges.take(pa.array(np.argsort(edges.column("a").to_numpy(), kind="stable")))
        sources, firsts = np.unique(edges.column("a").to_numpy(), return_index=True)
        after = dict(zip(sources.tolist(), zip(firsts.tolist(), np.append(firsts[1:], len(edges)).tolist())))
        ends, costs, others = (edges.column(c).to_numpy() for c in ("b", "cost", "other"))
        best = {a: (c, b, other) for a, b, c, other in of(_LABEL)}
        heap: list[tuple[float, int]] = []

        def offer(to: int, cost: float, prev: int | None, other: int | None, far: bool) -> None:
            old = best.get(to)
            if old is None or cost < old[0]:
                best[to] = cost, prev, other
                heapq.heappush(heap, (cost, to))
            elif far and cost == old[0] and old[1] is not None and prev is not None and prev < old[1]:
                best[to] = cost, prev, other

        for kind, far in ((_OFFER, True), (_OFFER_OF_NO_LENGTH, False)):
            for a, b, c, other in of(kind):
                offer(a, c, b, other, far)
        least, done, sent = bound, set(), {}
        while heap:
            cost, at = heapq.heappop(heap)
            if cost > least:
                break
            if at in done or cost > best[at][0]:
                continue
            done.add(at)
            if at == goal:
                least = cost
            lo, hi = after.get(at, (0, 0))
            for to, c, other in zip(ends[lo:hi].tolist(), costs[lo:hi].tolist(), others[lo:hi].tolist()):
                if to == start:
                    continue
                if other == tile:
                    offer(to, cost + c, at, tile, c > 0)
                else:
                    way = (cost + c, c <= 0, at)
                    if to not in sent or way < sent[to][0]:
                        sent[to] = way, other
        out = [(tile, _LABEL, a, prev, cost, other) for a, (cost, prev, other) in best.items()]
        out += [(other, _OFFER_OF_NO_LENGTH if flat else _OFFER, to, at, cost, tile) for to, ((cost, flat, at), other) in sent.items() if cost <= least]
        names = ("tile", "kind", "a", "b", "cost", "other")
        kind = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
        return pa.table({n: pa.array(v, t) for n, v, t in zip(names, zip(*out) if out else [()] * 6, kind)})

    return walk


class Reached:
    """The labels that a search has left: in each round those of the tiles that were walked; the last round of a tile counts."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rounds, self.last = spark, [], {}

    def add(self, out: DataFrame, tiles: list[int]) -> None:
        self.last |= dict.fromkeys(tiles, len(self.rounds))
        self.rounds.append(out.where(F.col("kind") == _LABEL))

    def of(self, tiles: list[int]) -> DataFrame:
        """The labels of some tiles; the driver knows a number for each tile, of which there are as many as points over TILE."""
        by_round: dict[int, list[tuple[int]]] = {}
        for tile in tiles:
            if tile in self.last:
                by_round.setdefault(self.last[tile], []).append((tile,))
        parts = [self.rounds[k].join(F.broadcast(self.spark.createDataFrame(some, "tile int")), "tile") for k, some in by_round.items()]
        return reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], _ROWS))

    def fold(self) -> None:
        """One round in place of all, so that plans stay short."""
        whole = cut(self.of(list(self.last)))
        self.rounds, self.last = [whole], dict.fromkeys(self.last, 0)


def search(edges: DataFrame, tiles: DataFrame, start: int, goal: int | None = None, most: int = 100_000) -> Reached:
    """Labels of all points that can be reached from ``start``, or of those no farther than ``goal``.

    ``tiles`` has the tile of each id. A round walks the tiles that got offers, each in a group of
    its own: its edges, its labels so far, and the offers. What leaves a tile are offers to the
    next. A tile is walked again only if it was offered something, so that rounds are as many as
    the tiles that the longest way crosses, and costs are summed along ways as one heap over all
    would, to the last digit.
    """
    spark = edges.sparkSession
    tiles = tiles.select("id", "tile")
    ends = edges.select("src", "dst", "cost").join(tiles.withColumnsRenamed({"id": "src"}), "src").join(tiles.withColumnsRenamed({"id": "dst", "tile": "other"}), "dst")
    # sorted by tile in small row groups, so that a round reads about the tiles it walks
    path = scratch(spark, "edges")
    laid = ends.select("tile", F.lit(_EDGE).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "cost", "other").repartitionByRange("tile", "a").sortWithinPartitions("tile")
    laid.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    links = spark.read.parquet(path)
    reached, bound = Reached(spark), inf
    home = tiles.where(F.col("id") == start).select("tile").limit(1).collect()
    active = [home[0].tile] if home else []
    offers = spark.createDataFrame([(t, _OFFER, start, None, 0.0, None) for t in active], _ROWS)
    for i in range(most):
        if not active:
            return reached
        reach = F.col("tile").isin(active) if len(active) <= FEW_TILES else F.col("tile").between(active[0], active[-1])
        own = links.where(reach).join(F.broadcast(spark.createDataFrame([(t,) for t in active], "tile int")), "tile").select("tile", "kind", "a", "b", "cost", "other")
        rows = own.unionByName(reached.of(active)).unionByName(offers)
        out = cut(rows.groupBy("tile").applyInArrow(_walk(start, goal, bound), _ROWS))
        reached.add(out, active)
        # by tile, the least offer and what the goal costs
        told = out.groupBy("tile").agg(F.min(F.when(F.col("kind") >= _OFFER, F.col("cost"))).alias("least"), F.min(F.when((F.col("kind") == _LABEL) & (F.col("a") == F.lit(goal).cast("long")), F.col("cost"))).alias("met")).collect()
        bound = min([bound, *(r.met for r in told if r.met is not None)])
        if i % 32 == 31:
            reached.fold()
        offers = out.where((F.col("kind") >= _OFFER) & (F.col("cost") <= bound))
        active = sorted(r.tile for r in told if r.least is not None and r.least <= bound)
    raise RuntimeError("the distances did not settle")


def distances(edges: DataFrame, tiles: DataFrame, start: int) -> DataFrame:
    """(id, cost, prev) of all points that can be reached; see :func:`search`."""
    found = search(edges, tiles, start)
    return found.of(list(found.last)).select(F.col("a").alias("id"), "cost", F.col("b").alias("prev"))


def way_back(reached: Reached, tile: int, goal: int) -> list[tuple[int, float]]:
    """(id, cost) from the start to the goal: a job for each tile crossed, which returns the path's own rows."""
    path: list[tuple[int, float]] = []
    at: int | None = goal
    while at is not None:
        last = at

        def follow(rows: pa.Table) -> pa.Table:
            best = dict(zip(rows.column("a").to_pylist(), zip(rows.column("cost").to_pylist(), rows.column("b").to_pylist(), rows.column("other").to_pylist())))
            out, here = [], last
            while here in best:
                cost, prev, other = best[here]
                out.append((here, cost, prev, other, len(out)))
                here = prev if other == rows.column("tile")[0].as_py() else None
            names = (("id", pa.int64()), ("cost", pa.float64()), ("prev", pa.int64()), ("other", pa.int32()), ("k", pa.int32()))
            return pa.table({n: pa.array(v, t) for (n, t), v in zip(names, zip(*out) if out else [()] * 5)})

        part = sorted(reached.of([tile]).groupBy("tile").applyInArrow(follow, "id long, cost double, prev long, other int, k int").collect(), key=lambda r: r.k)
        if not part:
            return []
        path += [(r.id, r.cost) for r in part]
        at, tile = part[-1].prev, part[-1].other
    return path[::-1]


def tiles_of(points: DataFrame, tile: int = TILE) -> DataFrame:
    """(id, tile): parts of the cloud of some ``tile`` points at most, by the partition tree of a sample."""
    leaves = sample_leaves(points, tile)
    if leaves is None:
        return points.select("id", F.lit(0).alias("tile"))
    return with_leaf(points.where(finite("easting") & finite("northing")).select("id", "easting", "northing"), leaves).select("id", F.col("_leaf").alias("tile"))


def shortest_path(points: DataFrame, a: tuple[float, float], b: tuple[float, float], k: int = 8, penalty: float = 5.0, tile: int = TILE) -> DataFrame:
    """(step, id, easting, northing, altitude, cost) from the point nearest to a to the one nearest to b.

    Empty if b can't be reached or there are no points. The cloud is searched tile by tile, and the
    path walked back over the tiles it crosses: only its own rows reach the driver.
    """
    spark = points.sparkSession
    ends = [nearest_point(points, *p).select("id").collect() for p in (a, b)]
    walk: list[tuple[int, float]] = []
    if all(ends):
        first, last = ends[0][0].id, ends[1][0].id
        places = cut(tiles_of(points, tile))
        goal = places.where(F.col("id") == last).first()
        walk = way_back(search(costed(knn_edges(points, k), points, penalty), places, first, last), goal.tile, last)
    steps = spark.createDataFrame([(i, at, cost) for i, (at, cost) in enumerate(walk)], "step int, id long, cost double")
    return points.select("id", "easting", "northing", "altitude").join(F.broadcast(steps), "id").select("step", "id", "easting", "northing", "altitude", "cost")
