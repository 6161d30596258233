"""Embedding near-duplicates by dual traversal of cover trees, exact above a cosine threshold.

On the unit sphere a cosine is a distance: cos >= c means |a - b| <= sqrt(2 - 2 c). The top of
the tree is laid over a bounded sample; every vector goes to its nearest top node, whose
covering radius is measured over all of them. Pairs of top nodes that lie too far apart for
their radii are pruned; the others are compared tile by tile. The lower levels of a tile, nets of
halving radii, are built once, in the task that gathers it; its vectors travel in the order of
the tree. A pair of tiles walks pairs of nodes, prunes those beyond the threshold by their
covering radii, takes those wholly within it as a whole, and computes the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, spread_join, union
from .components import connected_components

#: Vectors of the sample over which the top is laid, and its nodes at most.
SAMPLE, TOP = 4096, 256
#: Vectors of a tile, and their bytes in double precision, at most.
TILE, TILE_BYTES = 1 << 14, 1 << 23
#: Children that one node gets at most, besides one for what they don't cover; points of a leaf.
FAN, LEAF = 48, 96
_SLACK = 1e-9
#: Error of a product of unit vectors in single precision, up to many thousand components.
_SINGLE = 1e-3


class Node:
    """Points lo:hi of the tree's order, all within ``radius`` of point ``center``."""

    __slots__ = ("center", "hi", "kids", "lo", "radius")

    def __init__(self, lo: int, hi: int, center: int, radius: float, kids: list[Node]):
        self.lo, self.hi, self.center, self.radius, self.kids = lo, hi, center, radius, kids


def _net(x: np.ndarray, points: np.ndarray, radius: float, pivots: np.ndarray, near: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Greedy net over the pivots, rows of ``points``: what lies within ``radius`` of each, and what no pivot took."""
    left, groups = np.ones(len(points), bool), []
    close = near >= 1 - radius * radius / 2
    for k, at in enumerate(pivots):
        if left[at]:
            own = left & close[:, k]
            own[at] = True
            groups.append(np.concatenate([points[[at]], points[own & (np.arange(len(points)) != at)]]))
            left &= ~own
    return groups, points[left]


def build(x: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> tuple[np.ndarray, Node]:
    """The cover tree of the unit vectors in x, and its order of them. Level k's net has radius 2 / 2**k.

    Covering radii are as measured. Where a level's ``fan`` pivots cover hardly more than
    themselves, the next level is tried; a node that no level gathers is a leaf.
    """
    order: list[np.ndarray] = []

    def grow(points: np.ndarray, level: int, at: int) -> Node:
        center = x[points[0]]
        radius = float(np.sqrt(((x[points] - center) ** 2).sum(axis=1).max()))
        if len(points) > leaf and radius > _SLACK:
            pivots = np.unique(np.linspace(0, len(points) - 1, fan).astype(np.int64))
            near = x[points] @ x[points[pivots]].T
            for deeper in range(level + 1, 13):
                if 2.0 / 2**deeper >= radius:
                    continue
                groups, left = _net(x, points, 2.0 / 2**deeper, pivots, near)
                if len(points) - len(left) >= 2 * len(groups) or not len(left):
                    kids, to = [], at
                    for g in groups:
                        kids.append(grow(g, deeper, to))
                        to += len(g)
                    if len(left):
                        # the rest is gathered again while that makes headway
                        kids.append(grow(left, deeper if len(left) <= 0.75 * len(points) else 12, to))
                    return Node(at, at + len(points), kids[0].center, radius, kids)
        order.append(points)
        return Node(at, at + len(points), at, radius, [])

    root = grow(np.arange(len(x)), 0, 0)
    return np.concatenate(order), root


def pack(root: Node) -> bytes:
    """A tree as bytes: its nodes with their numbers of children, each before its children."""
    rows, stack = [], [root]
    while stack:
        node = stack.pop()
        rows.append((node.lo, node.hi, node.center, node.radius, len(node.kids)))
        stack += node.kids[::-1]
    return np.array(rows, np.float64).tobytes()


def unpack(blob: bytes) -> Node:
    rows = iter(np.frombuffer(blob, np.float64).reshape(-1, 5).tolist())

    def read() -> Node:
        lo, hi, center, radius, kids = next(rows)
        return Node(int(lo), int(hi), int(center), radius, [read() for _ in range(int(kids))])

    return read()


def dual(x: np.ndarray, a: Node, y: np.ndarray, b: Node, cosine: float, same: bool) -> Iterator[tuple[str, slice | np.ndarray, slice | np.ndarray]]:
    """('all', points of x, points of y): linked each with each; ('pairs', i, j): single links.

    With ``same`` (both trees are one) each unordered pair comes once and none with itself.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    single, other = x.astype(np.float32), y.astype(np.float32)
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        own = same and p is q
        apart = 0.0 if own else float(np.sqrt(((x[p.center] - y[q.center]) ** 2).sum()))
        if apart > reach + p.radius + q.radius + _SLACK:
            continue
        if (2 * p.radius if own else apart + p.radius + q.radius) <= reach - _SLACK:
            yield ("all", slice(p.lo, p.hi), slice(q.lo, q.hi))
        elif not p.kids and not q.kids:
            for lo in range(p.lo, p.hi, 512):
                hi = min(lo + 512, p.hi)
                # single precision rules out what lies clearly below; the rest is computed in double
                start = lo if own else q.lo
                product = single[lo:hi] @ other[start : q.hi].T
                hit = np.flatnonzero(product.ravel() >= np.float32(cosine - _SINGLE))
                i, j = lo + hit // (q.hi - start), start + hit % (q.hi - start)
                if own:
                    i, j = i[later := j > i], j[later]
                for at in range(0, len(i), 1 << 16):
                    s, t = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                    sure = np.einsum("ij,ij->i", x[s], y[t]) >= cosine
                    if sure.any():
                        yield ("pairs", s[sure], t[sure])
        elif own:
            stack += [(p.kids[i], p.kids[j]) for i in range(len(p.kids)) for j in range(i, len(p.kids))]
        elif q.kids and (not p.kids or q.radius >= p.radius):
            stack += [(p, k) for k in q.kids]
        else:
            stack += [(k, q) for k in p.kids]


def _links(x: np.ndarray, tx: Node, mx: np.ndarray, y: np.ndarray, ty: Node, my: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors linked to each row of x and of y (one array if same), and roots of a spanning forest over x then y."""
    shift = 0 if same else len(x)
    degree, labels = np.zeros(shift + len(y), np.int64), np.arange(shift + len(y))
    for kind, i, j in dual(x, tx, y, ty, cosine, same):
        if kind == "all":
            to = slice(j.start + shift, j.stop + shift)
            if same and i == j:
                degree[i] += mx[i].sum() - mx[i]
            else:
                degree[i] += my[j].sum()
                degree[to] += mx[i].sum()
            every = np.concatenate([np.arange(i.start, i.stop), np.arange(to.start, to.stop)])
            labels = union(labels, every, np.full(len(every), every[0]))
        else:
            np.add.at(degree, i, my[j])
            np.add.at(degree, j + shift, mx[i])
            labels = union(labels, i, j + shift)
    return degree, labels


def _units(column: pa.Array) -> list[bytes | None]:
    """Unit vectors in double precision as bytes; None for what links with nothing."""
    out: list[bytes | None] = [None] * len(column)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()  # of valid lists
    null = flat.is_null().to_numpy(zero_copy_only=False)
    value = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        at = start[rows][:, None] + np.arange(n)
        a = value[at]
        most = np.abs(a).max(axis=1)
        good = np.isfinite(a).all(axis=1) & (most > 0) & ~null[at].any(axis=1)
        a = a[good] / most[good, None]
        a = a / np.sqrt((a * a).sum(axis=1))[:, None] + 0.0
        for i, u in zip(rows[good].tolist(), a):
            out[i] = u.tobytes()
    return out


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Null and zero vectors and those with null or non-finite components link with nothing, as do
    vectors of different lengths. Equal vectors are compared once and counted as many. A null
    vec_id is linked but names no component (its own is null if it stands alone; kept is then
    null). Rows that repeat each come back and are linked with each other; an empty table gives
    an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_units(batch.column(1)), pa.binary())], ["vec_id", "unit"])

    rows = cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).mapInArrow(prepare, "vec_id long, unit binary"))
    classes = cut(rows.where("unit is not null").groupBy("unit").agg(F.count("*").alias("m"), F.min("vec_id").alias("least")).withColumn("c", F.monotonically_increasing_id()))

    # the top: a cover tree over a bounded sample, by the length of the vectors
    sample = [np.frombuffer(r.unit) for r in classes.orderBy(F.xxhash64("unit")).limit(SAMPLE).select("unit").collect()]
    tops: dict[int, np.ndarray] = {}
    for size in {len(s) for s in sample}:
        x = np.stack([s for s in sample if len(s) == size])
        order, root = build(x, leaf=max(1, len(x) // 8), fan=16)
        level = [root]
        while any(k.kids for k in level) and sum(max(1, len(k.kids)) for k in level) <= TOP:
            level = [c for k in level for c in (k.kids or [k])]
        tops[size] = x[order[[k.center for k in level]]]
        tile = max(1, min(tile, TILE_BYTES // (8 * size)))
    shared = spark.sparkContext.broadcast(tops)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [np.frombuffer(b) for b in batch.column("unit").to_pylist()]
            size = np.array([len(u) for u in units], np.int32)
            cell, far = np.zeros(len(units), np.int32), np.zeros(len(units))
            for k in np.unique(size):
                own = np.flatnonzero(size == k)
                if int(k) in shared.value:
                    x, top = np.stack([units[i] for i in own]), shared.value[int(k)]
                    near = (x @ top.T).argmax(axis=1)
                    cell[own], far[own] = near, np.sqrt(((x - top[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("m"), batch.column("unit"), pa.array(size), pa.array(cell), pa.array(far)], ["c", "m", "unit", "size", "cell", "far"])

    placed = cut(classes.select("c", "m", "unit").mapInArrow(place, "c long, m long, unit binary, size int, cell int, far double"))
    # one row a top node: TOP of them at most for each vector length of the sample
    cells = {(r["size"], r.cell): (r.n, r.far) for r in placed.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    tiles = {k: -(-n // tile) for k, (n, _) in cells.items()}
    first, total = {}, 0
    for k in sorted(cells):
        first[k], total = total, total + tiles[k]
    near = []
    for size in sorted({k[0] for k in cells}):
        own = [k for k in sorted(cells) if k[0] == size]
        radius = np.array([cells[k][1] for k in own])
        top = tops[size][[k[1] for k in own]] if size in tops else np.zeros((len(own), 1))
        for i, k in enumerate(own):
            apart = np.sqrt(((top[i:] - top[i]) ** 2).sum(axis=1))
            for j in i + np.flatnonzero(apart <= reach + radius[i] + radius[i:] + _SLACK):
                near.append((first[k], tiles[k], first[own[j]], tiles[own[j]]))
    # pairs of tiles of the node pairs that are left
    pairs = spark.createDataFrame(near, "fa int, na int, fb int, nb int").select(F.explode(F.expr("sequence(fa, fa + na - 1)")).alias("a"), "fb", "nb").select("a", F.explode(F.expr("sequence(fb, fb + nb - 1)")).alias("b")).where("a <= b").withColumn("pair", F.col("a").cast("long") * total + F.col("b"))
    to = pairs.select(F.col("a").alias("tile"), "pair", F.lit(0).alias("side")).union(pairs.where("a <> b").select(F.col("b").alias("tile"), "pair", F.lit(1).alias("side")))
    where = spark.createDataFrame([(*k, first[k], tiles[k]) for k in sorted(cells)], "size int, cell int, fa int, na int")
    # a row for each top node
    tiled = placed.join(F.broadcast(where), ["size", "cell"]).select((F.col("fa") + F.pmod(F.xxhash64("unit"), F.col("na"))).cast("int").alias("tile"), "c", "m", "unit")

    def runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
        """The rows of each value of a column by which they are sorted."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            value = batch.column(by).to_numpy()
            cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(value)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and held[0].column(by)[0].as_py() != value[lo]:
                        yield pa.Table.from_batches(held).combine_chunks()
                        held = []
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "tile"):
            order, root = build(np.frombuffer(b"".join(rows["unit"].to_pylist())).reshape(len(rows), -1))
            done = rows.take(pa.array(order)).append_column("at", pa.array(np.arange(len(rows), dtype=np.int32))).combine_chunks()
            yield from done.to_batches()
            # the tree itself comes before the vectors
            yield pa.RecordBatch.from_arrays([rows["tile"].chunk(0)[:1], pa.array([-1]), pa.array([0]), pa.array([pack(root)], pa.binary()), pa.array([-1], pa.int32())], ["tile", "c", "m", "unit", "at"])

    planted = tiled.repartition(max(partitions(spark), 1), "tile").sortWithinPartitions("tile").mapInArrow(plant, "tile int, c long, m long, unit binary, at int")
    dealt = planted.join(to, "tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "pair"):
            side, at = rows["side"].to_numpy(), rows["at"].to_numpy()
            halves = []
            for k in (0, 1):
                own = rows.filter(pa.array((side == k) & (at >= 0)))
                if len(own):
                    tree = unpack(rows["unit"][int(np.flatnonzero((side == k) & (at < 0))[0])].as_py())
                    halves.append((np.frombuffer(b"".join(own["unit"].to_pylist())).reshape(len(own), -1), tree, own["m"].to_numpy(), own["c"].to_numpy()))
            (x, tx, mx, cx), (y, ty, my, cy) = halves[0], halves[-1]
            same = len(halves) == 1
            degree, labels = _links(x, tx, mx, y, ty, my, cosine, same)
            ids, some = cx if same else np.concatenate([cx, cy]), np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(degree[some]), pa.array(ids[labels[some]])], ["c", "links", "root"])

    found = cut(dealt.repartition(max(partitions(spark), 1), "pair").sortWithinPartitions("pair", "side", "at").mapInArrow(compare, "c long, links long, root long"))
    degree = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    named = cut(classes.select("unit", "c", "m", "least").join(degree, "c", "left").join(roots, F.col("c") == F.col("node"), "left").select("unit", "least", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), F.coalesce("component", "c").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    done = spread_join(named, least, "root").select("unit", "n_links", "component_id")
    alone = rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = spread_join(rows.where("unit is not null"), done, "unit").select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
