"""UTM zones and projections as column expressions (WGS84, Krüger series to the sixth order)."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
N = FLATTENING / (2 - FLATTENING)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
ECCENTRICITY = sqrt(FLATTENING * (2 - FLATTENING))

# Coefficients of the series in n (Karney, 2011), for the inverse and the forward projection.
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360 - 81 * N**5 / 512 + 96199 * N**6 / 604800,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440 + 46 * N**5 / 105 - 1118711 * N**6 / 3870720,
    17 * N**3 / 480 - 37 * N**4 / 840 - 209 * N**5 / 4480 + 5569 * N**6 / 90720,
    4397 * N**4 / 161280 - 11 * N**5 / 504 - 830251 * N**6 / 7257600,
    4583 * N**5 / 161280 - 108847 * N**6 / 3991680,
    20648693 * N**6 / 638668800,
)
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180 - 127 * N**5 / 288 + 7891 * N**6 / 37800,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440 + 281 * N**5 / 630 - 1983433 * N**6 / 1935360,
    61 * N**3 / 240 - 103 * N**4 / 140 + 15061 * N**5 / 26880 + 167603 * N**6 / 181440,
    49561 * N**4 / 161280 - 179 * N**5 / 168 + 6601661 * N**6 / 7257600,
    34729 * N**5 / 80640 - 3418889 * N**6 / 1995840,
    212378941 * N**6 / 319334400,
)
#: Steps from the conformal to the geographic latitude; each gains about five digits.
NEWTON = 3


def zone_number(zone: Column) -> Column:
    """The digits before the last character; null if they are none."""
    return F.when(F.length(zone) > 1, F.substring(zone, F.lit(1), F.length(zone) - 1)).try_cast("int")


def is_north(zone: Column) -> Column:
    """Only a last character N or n means north; any other is south."""
    return F.upper(F.right(zone, F.lit(1))) == "N"


def valid_zone(zone: Column) -> Column:
    return zone.rlike("^[0-9]{1,2}[NS]$")


def zone_label(number: Column, hemisphere: Column) -> Column:
    """Number and hemisphere as one string; null for a zone that isn't positive."""
    return F.when(number > 0, F.concat(number.cast("string"), hemisphere))


def zone_of_text(wkt: Column) -> Column:
    """``15N`` from a coordinate-system text that names a UTM zone; null if it names none."""
    number = F.nullif(F.regexp_extract(wkt, r"(?i)UTM\s+zone\s*([0-9]+)([NS])?", 1), F.lit(""))
    half = F.regexp_extract(wkt, r"(?i)UTM\s+zone\s*([0-9]+)([NS])?", 2)
    return F.when(number.isNotNull(), F.concat(number.cast("int").cast("string"), F.when(half == "", "?").otherwise(F.upper(half))))


def with_latlon(rows: DataFrame, easting: Column, northing: Column, zone: Column, north: Column) -> DataFrame:
    """``rows`` with latitude and longitude in degrees.

    Each step is a projection of its own, so that no expression repeats the ones before it.
    """
    m, e, e2 = F.lit(SCALE * RECTIFYING), F.lit(ECCENTRICITY), F.lit(ECCENTRICITY**2)
    xi, eta, x, y, tau, root, sigma, back = (F.col(f"_utm_{c}") for c in ("xi", "eta", "x", "y", "tau", "root", "sigma", "back"))
    out = rows.withColumns({"_utm_eta": (easting - F.lit(500000.0)) / m, "_utm_xi": (northing - F.when(north, F.lit(0.0)).otherwise(F.lit(10000000.0))) / m, "_utm_zone": zone})
    up, right = xi, eta
    for j, b in enumerate(BETA, 1):
        up = up - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        right = right - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    out = out.withColumns({"_utm_x": up, "_utm_y": right})
    # tau is the tangent of the latitude, taup that of the conformal one
    taup = F.col("_utm_taup")
    out = out.withColumn("_utm_taup", F.sin(x) / F.sqrt(F.sinh(y) * F.sinh(y) + F.cos(x) * F.cos(x))).withColumn("_utm_tau", taup / (F.lit(1.0) - e2))
    for _ in range(NEWTON):
        out = out.withColumn("_utm_root", F.sqrt(F.lit(1.0) + tau * tau)).withColumn("_utm_sigma", F.sinh(e * F.atanh(e * tau / root)))
        out = out.withColumn("_utm_back", tau * F.sqrt(F.lit(1.0) + sigma * sigma) - sigma * root)
        step = (taup - back) / F.sqrt(F.lit(1.0) + back * back) * (F.lit(1.0) + (F.lit(1.0) - e2) * tau * tau) / ((F.lit(1.0) - e2) * root)
        out = out.withColumn("_utm_tau", tau + step)
    longitude = F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (F.lit(6.0) * F.col("_utm_zone") - F.lit(183.0))
    out = out.withColumns({"latitude": F.degrees(F.atan(tau)), "longitude": longitude})
    return out.drop(*[c for c in out.columns if c.startswith("_utm_")])


def from_latlon(latitude: Column, longitude: Column, zone: Column, north: Column) -> tuple[Column, Column]:
    """Easting and northing in a given zone."""
    lam = F.radians(longitude - (F.lit(6.0) * zone - F.lit(183.0)))
    tau = F.tan(F.radians(latitude))
    root = F.sqrt(F.lit(1.0) + tau * tau)
    sigma = F.sinh(F.lit(ECCENTRICITY) * F.atanh(F.lit(ECCENTRICITY) * tau / root))
    taup = tau * F.sqrt(F.lit(1.0) + sigma * sigma) - sigma * root
    xi = F.atan2(taup, F.cos(lam))
    eta = F.asinh(F.sin(lam) / F.sqrt(taup * taup + F.cos(lam) * F.cos(lam)))
    x, y = xi, eta
    for j, a in enumerate(ALPHA, 1):
        x = x + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        y = y + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    m = F.lit(SCALE * RECTIFYING)
    return m * y + F.lit(500000.0), m * x + F.when(north, F.lit(0.0)).otherwise(F.lit(10000000.0))


def project_rows(rows: DataFrame, errors: bool = False) -> DataFrame:
    """String rows (easting, northing, zone, ...) with latitude and longitude as text of six decimals.

    Rows whose numbers or zone can't be read are dropped, or alone returned with ``errors``.
    """
    e, n = F.col("easting").try_cast("double"), F.col("northing").try_cast("double")
    zone, north = zone_number(F.trim("zone")), is_north(F.trim("zone"))
    good = e.isNotNull() & n.isNotNull() & zone.between(1, 60) & ~F.isnan(e) & ~F.isnan(n)
    if errors:
        return rows.where(~F.coalesce(good, F.lit(False)))
    done = with_latlon(rows.where(good), e, n, zone, north)
    return done.withColumns({c: F.format_string("%.6f", F.col(c)) for c in ("latitude", "longitude")})
