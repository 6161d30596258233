"""A partition tree of a cloud, cut from a bounded sample: where points are, and how densely.

The box of the sampled points of a node is cut in the middle of its longer side until a leaf has few
of them; as each half shrinks to its own points, empty space is cut away first, and two patches far
apart share no leaf. The leaves' regions cover the whole plane, so that every point has a leaf,
sampled or not. The tree is some thousand leaves on the driver, whatever the size of the cloud.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import inf, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Points that the tree is cut from, and those of a leaf, at most.
SAMPLE, LEAF = 1 << 16, 32
#: Sampled points that tell a density.
FEW = 8


@dataclass(frozen=True)
class Leaves:
    """The tree: node i is cut along ``axis`` at ``at`` into nodes low and high; in a leaf, axis is -1 and low its number."""

    axis: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    #: Of each leaf: xmin, ymin, xmax, ymax of its sampled points, and of its region.
    boxes: np.ndarray
    regions: np.ndarray
    #: Points of each leaf, estimated.
    counts: np.ndarray
    #: Of each leaf, from itself up to the root: sampled points, points, width and height of their box.
    above: list[list[tuple[int, float, float, float]]]
    #: xmin, ymin, xmax, ymax of all points.
    extent: tuple[float, float, float, float]

    def find(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The leaf of each place; values that aren't numbers go to any."""
        node = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(self.axis[node] >= 0)
        while len(open_):
            own = node[open_]
            value = np.where(self.axis[own] == 0, x[open_], y[open_])
            node[open_] = np.where(value < self.at[own], self.low[own], self.high[own])
            open_ = open_[self.axis[node[open_]] >= 0]
        return self.low[node]

    def radius(self, k: int) -> np.ndarray:
        """Of each leaf, the radius of a circle that holds some 3 k points at its density.

        Leaves of too few points or samples to tell take the density of the node above that has enough.
        """
        out = []
        for way in self.above:
            _, n, wide, tall = next((node for node in way if node[0] >= FEW and node[1] >= k), way[-1])
            out.append(max(sqrt(3 * k * wide * tall / (pi * n)), k * max(wide, tall) / n))
        return np.array(out)

    def beyond(self, leaf: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far each place is from the points of its leaf."""
        box = self.boxes[leaf]
        return np.hypot(np.maximum(0, np.maximum(box[:, 0] - x, x - box[:, 2])), np.maximum(0, np.maximum(box[:, 1] - y, y - box[:, 3])))

    def within(self, box: np.ndarray, reach: float) -> np.ndarray:
        """The leaves whose region comes as near to a box as ``reach``."""
        gap = np.maximum(0, np.maximum(self.regions[:, :2] - box[2:], box[:2] - self.regions[:, 2:]))
        return np.flatnonzero(np.hypot(gap[:, 0], gap[:, 1]) <= reach)


def cut_leaves(xy: np.ndarray, n: int, extent: tuple[float, float, float, float], leaf: int = LEAF) -> Leaves:
    """The tree over sampled places, at least one, of ``n`` points in an extent."""
    axis, at, low, high, boxes, regions, counts, above = [], [], [], [], [], [], [], []
    waiting = [(xy, (-inf, -inf, inf, inf), None, [])]
    while waiting:
        own, region, parent, way = waiting.pop()
        me = len(axis)
        if parent is not None:
            (low if parent[1] == 0 else high)[parent[0]] = me
        first, last = own.min(axis=0), own.max(axis=0)
        way = [(len(own), len(own) * n / len(xy), *(last - first).tolist()), *way]
        side = int(last[1] - first[1] > last[0] - first[0])
        middle = first[side] + (last[side] - first[side]) / 2
        below = own[:, side] < middle
        inner = len(own) > leaf and below.any()
        axis.append(side if inner else -1)
        at.append(middle)
        low.append(len(boxes))
        high.append(0)
        if inner:
            left, right = list(region), list(region)
            left[2 + side] = right[side] = middle
            waiting += [(own[~below], tuple(right), (me, 1), way), (own[below], tuple(left), (me, 0), way)]
        else:
            boxes.append((*first, *last))
            regions.append(region)
            counts.append(way[0][1])
            above.append(way)
    return Leaves(np.array(axis), np.array(at), np.array(low), np.array(high), np.array(boxes), np.array(regions), np.array(counts), above, extent)


def sample_leaves(points: DataFrame, most: int | None = None) -> Leaves | None:
    """The tree of a cloud, from an aggregate and a sample of some SAMPLE points; None without points.

    Its leaves have some ``most`` points at most, by the sample; without a number LEAF sampled ones.
    """
    there = points.select(F.col("easting").cast("double").alias("x"), F.col("northing").cast("double").alias("y")).where(finite("x") & finite("y"))
    n, *extent = there.agg(F.count("*"), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if not n:
        return None
    some = there if n <= SAMPLE else there.sample(fraction=SAMPLE / n, seed=17)
    xy = some.toPandas().to_numpy(np.float64)  # SAMPLE rows, up to chance
    xy = xy if len(xy) else there.limit(1).toPandas().to_numpy(np.float64)
    return cut_leaves(xy, n, tuple(extent), LEAF if most is None else max(1, int(most * len(xy) / n)))


def finite(column: str):
    """True where a coordinate is a number; null ones, NaN and infinities are near nothing."""
    return F.coalesce(F.abs(F.col(column)) < F.lit(inf), F.lit(False))


def with_leaf(df: DataFrame, leaves: Leaves, radius: np.ndarray | None = None) -> DataFrame:
    """``df`` with ``_leaf``; given the leaves' radii, also with ``_class``: 2 ** (class / 2) is what a place searches first."""
    columns, leaves = "_leaf int" if radius is None else "_leaf int, _class int", replace(leaves, above=[])  # tasks don't need the nodes above

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("easting", "northing"))
            leaf = leaves.find(x, y)
            more = [pa.array(leaf, pa.int32())]
            if radius is not None:
                more.append(pa.array(np.ceil(2 * np.log2(radius[leaf] + leaves.beyond(leaf, x, y))), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *columns.replace(" int", "").split(", ")])

    return df.mapInArrow(place, StructType([*df.schema.fields, *StructType.fromDDL(columns).fields]))
