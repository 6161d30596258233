"""Radio coverage over a raster: grid, heights, planes, diffraction, fields, power."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import radio
from .spatial import TILE_RADII, cell, knn_join, nearest_point, reached

#: Columns of a transmitter, in SQL types.
TX = "tx int, x double, y double, h_m double, power_dbm double, freq_hz double, heading_deg double, gain_db double, az array<struct<angle:double,gain:double>>, el array<struct<angle:double,gain:double>>, aperture_m double, eps_r double, roughness_m double, reflect boolean, rx_aperture_m double, n_freq int, frac double"


@dataclass(frozen=True)
class Grid:
    """A regular raster whose edge cells lie on its bounds."""

    xmin: float
    xmax: float
    ymin: float
    ymax: float
    nx: int
    ny: int

    @classmethod
    def over(cls, points: DataFrame, resolution: float = 2.0, margin: float = 20.0) -> Grid | None:
        """The extent of the points and a margin; 8 cells a side at least. None without points."""
        e = points.agg(F.min("easting"), F.max("easting"), F.min("northing"), F.max("northing")).first()
        if e[0] is None:
            return None
        x0, x1, y0, y1 = e[0] - margin, e[1] + margin, e[2] - margin, e[3] + margin
        return cls(x0, x1, y0, y1, max(8, ceil((x1 - x0) / resolution)), max(8, ceil((y1 - y0) / resolution)))

    def cells(self, spark) -> DataFrame:
        """(cell, iy, ix, x, y), x running fastest; made on the executors."""
        flat = spark.range(self.nx * self.ny).select(F.col("id").alias("cell"), F.expr(f"cast(id div {self.nx} as int)").alias("iy"), F.expr(f"cast(id % {self.nx} as int)").alias("ix"))
        return flat.withColumn("x", spaced("ix", self.xmin, self.xmax, self.nx)).withColumn("y", spaced("iy", self.ymin, self.ymax, self.ny))


def spaced(i: str, lo: float, hi: float, n: int):
    """The i-th of n evenly spaced values, both ends included; one value is the lower end."""
    return F.lit(lo) + F.col(i) * F.lit((hi - lo) / (n - 1) if n > 1 else 0.0)


def ground(cells: DataFrame, points: DataFrame) -> DataFrame:
    """The cells with z, the height of the point nearest in the plane; 0 without points."""
    probes = cells.select("cell", F.col("x").alias("easting"), F.col("y").alias("northing"))
    best = knn_join(probes, points, 1, key="cell", itself=True, keep=("id", "easting", "northing", "altitude")).select("cell", F.col("n_altitude").alias("z"))
    return cells.join(best, "cell", "left").withColumn("z", F.coalesce("z", F.lit(0.0)))


def _normals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Planes of all nodes of a batch at once, from the points of each, the nearest first."""
    for batch in batches:
        spots = batch.column("spots")
        n = spots.value_lengths().to_numpy(zero_copy_only=False)
        flat = spots.flatten()
        xyz = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("n_easting", "n_northing", "n_altitude")])
        first = np.cumsum(n) - n
        if len(n):
            mid = np.add.reduceat(xyz, first) / n[:, None]
            off = xyz - np.repeat(mid, n, axis=0)
            spread = np.add.reduceat(off[:, :, None] * off[:, None, :], first) / n[:, None, None]
            normal = np.linalg.eigh(spread)[1][:, :, 0]
            normal /= np.linalg.norm(normal, axis=1)[:, None]
            normal[normal[:, 2] < 0] *= -1
            few = n < 6
            mid[few], normal[few] = xyz[first[few]], (0.0, 0.0, 1.0)
        else:
            mid = normal = np.zeros((0, 3))
        yield pa.RecordBatch.from_arrays([batch.column("node"), *map(pa.array, mid.T.copy()), *map(pa.array, normal.T.copy())], ["node", "px", "py", "pz", "nx", "ny", "nz"])


def lattice(spark, grid: Grid, step: float = 10.0) -> DataFrame:
    """(node, gx, gy, easting, northing) of a coarse lattice over the grid, x running fastest."""
    n, m = (max(1, ceil((hi - lo) / step)) for lo, hi in ((grid.xmin, grid.xmax), (grid.ymin, grid.ymax)))
    nodes = spark.range(n * m).select(F.col("id").alias("node"), F.expr(f"cast(id % {n} as int)").alias("gx"), F.expr(f"cast(id div {n} as int)").alias("gy"))
    return nodes.withColumn("easting", spaced("gx", grid.xmin, grid.xmax, n)).withColumn("northing", spaced("gy", grid.ymin, grid.ymax, m))


def near_nodes(spark, grid: Grid, points: DataFrame, step: float = 10.0, k: int = 64) -> DataFrame:
    """The k nearest points with an altitude of each node of the lattice."""
    return knn_join(lattice(spark, grid, step), points.where("altitude is not null"), k, key="node", itself=True)


def planes(spark, grid: Grid, points: DataFrame, step: float = 10.0, k: int = 64) -> DataFrame:
    """(node, gx, gy, px, py, pz, nx, ny, nz): a plane at each node of a coarse lattice over the grid.

    Principal axes of the k nearest points need eigenvectors, which numpy gives for a batch of nodes
    at once; a node with fewer than 6 points takes its nearest one and a level plane.
    Points without an altitude aren't used.
    """
    nodes, near = lattice(spark, grid, step), near_nodes(spark, grid, points, step, k)
    spots = near.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rank", "n_easting", "n_northing", "n_altitude"))).alias("spots"))  # k a node
    fitted = spots.mapInArrow(_normals, "node long, px double, py double, pz double, nx double, ny double, nz double")
    flat = [F.coalesce(c, d).alias(c) for c, d in (("px", F.col("easting")), ("py", F.col("northing")), ("pz", F.lit(0.0)), ("nx", F.lit(0.0)), ("ny", F.lit(0.0)), ("nz", F.lit(1.0)))]
    return nodes.join(fitted, "node", "left").select("node", "gx", "gy", *flat)


def nearest_node(cells: DataFrame, grid: Grid, step: float = 10.0) -> DataFrame:
    """The cells with the lattice node nearest to each, in closed form; of two as near, the lower."""
    n, m = (max(1, ceil((hi - lo) / step)) for lo, hi in ((grid.xmin, grid.xmax), (grid.ymin, grid.ymax)))

    def index(c: str, lo: float, hi: float, k: int):
        gap = (hi - lo) / (k - 1) if k > 1 else 1.0
        return F.least(F.lit(k - 1), F.greatest(F.lit(0), F.ceil((F.col(c) - F.lit(lo)) / F.lit(gap) - 0.5))).cast("long")

    return cells.withColumn("node", index("y", grid.ymin, grid.ymax, m) * n + index("x", grid.xmin, grid.xmax, n))


def tops(held: DataFrame) -> DataFrame:
    """(jx, jy, ceiling): the greatest height of the points that reach into each tile; tiles without any are absent."""
    return held.groupBy("jx", "jy").agg(F.max("oz").alias("ceiling"))


def diffraction(pairs: DataFrame, points: DataFrame, samples: int = 8, radius: float = 0.6, clearance: float = 0.05, extra_db: float = 15.0) -> DataFrame:
    """(tx, cell, loss): the worst knife-edge loss over samples of each ray; rays without obstacles are absent.

    A sample is in one tile, a point in each that it reaches into. A sample first meets the ceiling of
    its tile, one row; those that lie below it then meet the points there. A higher point never has
    a lower loss, so that the points' losses go into one aggregate by ray.
    """
    r, wide = F.lit(float(radius)), TILE_RADII * radius
    t = F.expr(f"transform(sequence(0, {samples - 1}), i -> 0.1d + i * {0.8 / (samples - 1)!r}d)")
    ray = pairs.select("tx", "cell", "tx_x", "tx_y", "tx_h", "x", "y", "z", "lam", "d", F.explode(t).alias("t"))
    along = lambda a, b: F.col(a) + F.col("t") * (F.col(b) - F.col(a))
    at = ray.select("tx", "cell", "t", "lam", "d", along("tx_x", "x").alias("sx"), along("tx_y", "y").alias("sy"), along("tx_h", "z").alias("sz"))
    at = at.withColumn("jx", cell(F.col("sx"), wide)).withColumn("jy", cell(F.col("sy"), wide))
    held = points.select(reached(F.col("easting"), wide, radius).alias("jx"), F.col("easting").alias("ox"), F.col("northing").alias("oy"), F.col("altitude").alias("oz"))
    held = held.select("jx", reached(F.col("oy"), wide, radius).alias("jy"), "ox", "oy", "oz")
    low = at.join(tops(held), ["jx", "jy"]).where(F.col("ceiling") > F.col("sz") + clearance).drop("ceiling")
    dx, dy = F.col("ox") - F.col("sx"), F.col("oy") - F.col("sy")
    hit = low.join(held, ["jx", "jy"]).where((dx * dx + dy * dy <= r * r) & (F.col("oz") > F.col("sz") + clearance))
    d1 = F.col("d") * F.col("t")
    loss = radio.knife_edge_loss(F.col("oz") - F.col("sz"), d1, F.col("d") - d1, F.col("lam")) + extra_db
    return hit.select("tx", "cell", loss.alias("loss")).groupBy("tx", "cell").agg(F.max("loss").alias("loss"))


def fields(rays: DataFrame) -> DataFrame:
    """(tx, cell, iy, ix, x, y, z, mw): power of direct and reflected field, mean over the frequencies.

    rays: cells crossed with transmitters, with gain, loss and the plane of each cell.
    """
    c = F.col
    freqs = F.transform(F.sequence(F.lit(0), c("n_freq") - 1), lambda i: c("freq_hz") * (F.lit(1.0) + F.when(c("n_freq") > 1, -c("frac") + i * (c("frac") * 2.0 / F.greatest(c("n_freq") - 1, F.lit(1)))).otherwise(0.0)))
    r = rays.withColumn("f", F.explode(freqs)).withColumn("w", F.lit(radio.LIGHT) / c("f"))
    # the image of the transmitter in the cell's plane
    side = (c("tx_x") - c("px")) * c("nx") + (c("tx_y") - c("py")) * c("ny") + (c("tx_h") - c("pz")) * c("nz")
    image = [c(a) - F.lit(2.0) * side * c(b) for a, b in (("tx_x", "nx"), ("tx_y", "ny"), ("tx_h", "nz"))]
    back = F.sqrt((c("x") - image[0]) * (c("x") - image[0]) + (c("y") - image[1]) * (c("y") - image[1]) + (c("z") - image[2]) * (c("z") - image[2]))
    into = F.sqrt((c("px") - c("tx_x")) * (c("px") - c("tx_x")) + (c("py") - c("tx_y")) * (c("py") - c("tx_y")) + (c("pz") - c("tx_h")) * (c("pz") - c("tx_h")))
    cos_i = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(side / F.nullif(into, F.lit(0.0)), F.lit(0.0))))
    size, sign = radio.fresnel(cos_i, c("eps_r"))
    sin_i = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - cos_i * cos_i))
    bend = F.lit(4.0 * pi) * c("roughness_m") * sin_i / c("w")
    power = radio.watts(c("power_dbm"))
    dr, di = radio.field(power, c("gain"), c("w"), F.greatest(c("d"), c("far")), c("d"), c("loss"))
    rr, ri = radio.field(power, c("gain"), c("w"), F.greatest(back, c("far")), back, c("loss"))
    share = F.when(c("reflect"), size * sign * F.exp(-(bend * bend))).otherwise(0.0)
    re, im = dr + share * rr, di + share * ri
    place = ["iy", "ix", "x", "y", "z"]
    return r.select("tx", "cell", *place, ((re * re + im * im) * 1000.0).alias("mw")).groupBy("tx", "cell").agg(*[F.first(p).alias(p) for p in place], F.avg("mw").alias("mw"))


def rays(cells: DataFrame, txs: DataFrame) -> DataFrame:
    """Every cell with every transmitter: a handful of transmitters, which a setup lists by hand."""
    across, along = radio.lobes(F.col("az"), F.col("el"), F.col("gain_db"))
    tx = txs.select("tx", F.col("x").alias("tx_x"), F.col("y").alias("tx_y"), F.col("h_m").alias("tx_h"), across.alias("across"), along.alias("along"), *[x for x in txs.columns if x not in ("tx", "x", "y", "h_m", "az", "el")])
    both = cells.crossJoin(F.broadcast(tx))
    dx, dy, dz = F.col("x") - F.col("tx_x"), F.col("y") - F.col("tx_y"), F.col("z") - F.col("tx_h")
    lam = F.lit(radio.LIGHT) / F.col("freq_hz")
    both = both.withColumn("d", F.sqrt(dx * dx + dy * dy + dz * dz)).withColumn("lam", lam).withColumn("far", F.lit(2.0) * F.col("aperture_m") * F.col("aperture_m") / lam)
    rel = radio.relative_azimuth(radio.azimuth(dx, dy), F.col("heading_deg"))
    return both.withColumn("gain", radio.antenna_gain(F.col("across"), F.col("along"), F.col("gain_db"), rel, radio.elevation(dx, dy, dz))).drop("across", "along")


def smooth(power: DataFrame, grid: Grid, aperture_m: float) -> DataFrame:
    """Gaussian blur of each transmitter's milliwatt image: two passes of weighted neighbours, edges reflected."""
    out = power
    for axis, n, gap in (("iy", grid.ny, (grid.ymax - grid.ymin) / max(1, grid.ny - 1)), ("ix", grid.nx, (grid.xmax - grid.xmin) / max(1, grid.nx - 1))):
        sigma = max(1.0, aperture_m / gap) if gap > 0 else 1.0
        reach = int(4 * sigma + 0.5)
        weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(w)).alias("w")) for k, w in zip(range(-reach, reach + 1), weights / weights.sum())])
        spread = out.select("tx", "iy", "ix", "mw", F.explode(offsets).alias("o"))
        # a value also stands for its mirror images beyond both edges
        places = F.array(*[F.col(axis) + 2 * n * m for m in (-1, 0, 1)], *[2 * n * m - 1 - F.col(axis) for m in (0, 1, 2)])
        to = spread.withColumn("p", F.explode(places)).withColumn("to", F.col("p") + F.col("o.k")).where(F.col("to").between(0, n - 1))
        other = "ix" if axis == "iy" else "iy"
        blurred = to.groupBy("tx", other, F.col("to").alias(axis)).agg(F.sum(F.col("mw") * F.col("o.w")).alias("mw"))
        out = blurred
    return power.drop("mw").join(out, ["tx", "iy", "ix"])


def coverage(points: DataFrame, txs: DataFrame, grid: Grid, reflections: bool = True, diffract: bool = True) -> DataFrame:
    """(iy, ix, x, y, z, rssi_dbm) of all cells: powers of the transmitters summed, 1e-12 mW at least."""
    spark = points.sparkSession
    cells = nearest_node(ground(grid.cells(spark), points), grid)
    cells = cells.join(planes(spark, grid, points).drop("gx", "gy"), "node")
    every = rays(cells, txs)
    if not reflections:
        every = every.withColumn("reflect", F.lit(False))
    if diffract:
        every = every.join(diffraction(every, points), ["tx", "cell"], "left").withColumn("loss", F.coalesce("loss", F.lit(0.0)))
    else:
        every = every.withColumn("loss", F.lit(0.0))
    power = fields(every)
    for row in txs.where("rx_aperture_m > 0").select("tx", "rx_aperture_m").collect():
        power = power.where(F.col("tx") != row.tx).unionByName(smooth(power.where(F.col("tx") == row.tx), grid, row.rx_aperture_m).select(*power.columns))
    return power.groupBy("iy", "ix", "x", "y", "z").agg(radio.dbm(F.sum("mw")).alias("rssi_dbm"))


def add_transmitter(txs: DataFrame, points: DataFrame, antennas: DataFrame, **given) -> DataFrame:
    """``txs`` with one more: its height above ground becomes absolute, its antenna's spec is looked up by name.

    Given fields override the antenna's; an unknown name is kept without a spec.
    """
    spark = points.sparkSession
    spec = {"h_m": 2.0, "power_dbm": 20.0, "freq_hz": 2.4e9, "heading_deg": 0.0, "aperture_m": 0.1, "eps_r": 6.0, "roughness_m": 0.02, "reflect": True, "rx_aperture_m": 0.0, "n_freq": 5, "frac": 0.005}
    config = antennas.where(F.col("name") == F.lit(given.get("ant_config", ""))).select("gain_db", radio.normal_pattern(F.col("azimuth_pattern")).alias("az"), radio.normal_pattern(F.col("elevation_pattern")).alias("el"))
    found = [r.asDict(recursive=True) for r in config.limit(1).collect()]
    spec |= {"gain_db": 0.0, "az": None, "el": None} | (found[0] if found else {})
    for name in ("az", "el"):
        if isinstance(given.get(name), (list, dict)):
            given[name] = [{"angle": a, "gain": g} for a, g in radio.parse_pattern(given[name])]
    spec |= {k: v for k, v in given.items() if k in spec or k in ("x", "y")}
    foot = nearest_point(points, spec["x"], spec["y"]).select("altitude").collect()
    spec["h_m"] = float(spec["h_m"]) + (foot[0].altitude if foot and foot[0].altitude is not None else 0.0)
    most = txs.agg(F.max("tx")).first()[0]
    spec["tx"] = 0 if most is None else most + 1
    names = [f.split()[0] for f in TX.replace("array<struct<angle:double,gain:double>>", "p").split(", ")]
    return txs.unionByName(spark.createDataFrame([tuple(spec[n] for n in names)], TX))


def raster_order(df: DataFrame) -> DataFrame:
    """Rows as a flat raster: ``at`` = iy * nx + ix, x fastest."""
    wide = F.broadcast(df.agg((F.max("ix") + 1).alias("_nx")))
    return df.join(wide).withColumn("at", F.col("iy") * F.col("_nx") + F.col("ix")).drop("_nx").orderBy("at")
