"""Terrain metrics of a neighbourhood: plane fit, roughness, curvature, traversability.

All come from one aggregation of moments about the probe point, which keeps the sums well
conditioned at UTM coordinates; partial sums combine before the shuffle, and no pair of points
is ever kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import METRICS
from .spatial import neighbour_join

#: Relative size of the plane system's determinant below which its places count as collinear.
COLLINEAR = 1e-12


def moments(pairs: DataFrame, key: str = "id") -> DataFrame:
    """n and the population covariances of the neighbours of each probe, about the probe."""
    dx, dy, dz = (F.col(f"n_{c}") - F.col(c) for c in ("easting", "northing", "altitude"))
    d = pairs.select(key, dx.alias("x"), dy.alias("y"), dz.alias("z"))
    one = {"sx": "x", "sy": "y", "sz": "z"}
    two = {"qxx": ("x", "x"), "qxy": ("x", "y"), "qyy": ("y", "y"), "qxz": ("x", "z"), "qyz": ("y", "z"), "qzz": ("z", "z")}
    sums = d.groupBy(key).agg(F.count("z").alias("n"), *[F.sum(c).alias(a) for a, c in one.items()], *[F.sum(F.col(a) * F.col(b)).alias(k) for k, (a, b) in two.items()])
    n = F.nullif(F.col("n"), F.lit(0))
    return sums.select(key, "n", *[(F.col(f"q{a}{b}") / n - F.col(f"s{a}") / n * F.col(f"s{b}") / n).alias(f"s{a}{b}") for a, b in ("xx", "xy", "yy", "xz", "yz", "zz")])


def plane(m: DataFrame) -> DataFrame:
    """Adds a and b of the least-squares plane z = a x + b y + c, of minimum norm where it isn't unique."""
    sxx, sxy, syy, sxz, syz = (F.col(c) for c in ("sxx", "sxy", "syy", "sxz", "syz"))
    spread = sxx + syy
    det = sxx * syy - sxy * sxy
    # collinear places: the slope along their one direction, whose matrix is u u' times the spread
    thin = F.when(spread <= 0, F.lit(0.0))
    a = F.when(det > F.lit(COLLINEAR) * spread * spread, (sxz * syy - syz * sxy) / F.when(det != 0, det)).otherwise(F.coalesce(thin, (sxx * sxz + sxy * syz) / F.when(spread > 0, spread * spread)))
    b = F.when(det > F.lit(COLLINEAR) * spread * spread, (syz * sxx - sxz * sxy) / F.when(det != 0, det)).otherwise(F.coalesce(thin, (sxy * sxz + syy * syz) / F.when(spread > 0, spread * spread)))
    return m.withColumn("a", a).withColumn("b", b)


def with_curvature(m: DataFrame) -> DataFrame:
    """Adds the smallest eigenvalue's share of the trace of the covariance of (x, y, z); null if that is zero.

    Closed form by steps, each a projection of its own.
    """
    xx, xy, yy, xz, yz, zz, mean, p = (F.col(c) for c in ("sxx", "sxy", "syy", "sxz", "syz", "szz", "_mean", "_p"))
    out = m.withColumn("_mean", (xx + yy + zz) / 3.0)
    off = xy * xy + xz * xz + yz * yz
    out = out.withColumn("_p", F.sqrt(((xx - mean) * (xx - mean) + (yy - mean) * (yy - mean) + (zz - mean) * (zz - mean) + 2.0 * off) / 6.0))
    det = (xx - mean) * ((yy - mean) * (zz - mean) - yz * yz) - xy * (xy * (zz - mean) - yz * xz) + xz * (xy * yz - (yy - mean) * xz)
    out = out.withColumn("_r", F.when(p > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2.0 * p * p * p)))))
    out = out.withColumn("_least", F.coalesce(mean + 2.0 * p * F.cos(F.acos(F.col("_r")) / 3.0 + F.lit(2.0943951023931953)), mean))
    return out.withColumn("curvature", F.when(mean > 0, F.greatest(F.lit(0.0), F.col("_least") / (3.0 * mean)))).drop("_mean", "_p", "_r", "_least")


def metrics(m: DataFrame, max_slope: float = 90.0, max_rough: float = 1.0, key: str = "id") -> DataFrame:
    """The seven metrics of each probe's moments with at least three neighbours."""
    fitted = with_curvature(plane(m.where(F.col("n") >= 3)))
    a, b = F.col("a"), F.col("b")
    norm = F.sqrt(a * a + b * b + 1.0)
    shaped = fitted.select(
        key,
        "n",
        (-a / norm).alias("normal_x"),
        (-b / norm).alias("normal_y"),
        (F.lit(1.0) / norm).alias("normal_z"),
        F.degrees(F.atan(F.sqrt(a * a + b * b))).alias("slope"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("szz") - a * F.col("sxz") - b * F.col("syz"))).alias("rough"),
        "curvature",
    )
    share = lambda c, most: F.least(F.lit(1.0), F.col(c) / F.lit(float(most)))
    score = F.when(F.col("curvature").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - (share("slope", max_slope) + share("rough", max_rough) + F.col("curvature"))))
    return shaped.withColumn("trav_score", score)


def terrain_metrics(points: DataFrame, radius: float = 1.0, max_slope: float = 90.0, max_rough: float = 1.0, circle: bool = False) -> DataFrame:
    """id, n and the metrics of every point with three neighbours or more (itself counts)."""
    slim = points.select("id", "easting", "northing", "altitude")
    return metrics(moments(neighbour_join(slim, slim, radius, circle)), max_slope, max_rough)


def with_metrics(points: DataFrame, computed: DataFrame) -> DataFrame:
    """A new snapshot of the points with their metrics; those without any keep nulls."""
    return points.drop(*METRICS).join(computed.select("id", *METRICS), "id", "left")
