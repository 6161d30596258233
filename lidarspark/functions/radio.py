"""Antenna patterns and radio propagation as column expressions."""

from __future__ import annotations

from math import pi
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

LIGHT = 299792458.0
#: Least received power, in milliwatts.
FLOOR_MW = 1e-12


def parse_pattern(raw: Any) -> list[tuple[float, float]]:
    """(angle mod 360, gain) pairs in order of angle, equal angles as given, from any accepted shape; bad entries are skipped.

    A map of angle to gain; or a list of pairs, of maps with angle and gain, of other maps, whose two
    first values count, or of texts such as "10,3", "10:3" and "10 3". Anything else, a text too, is empty.
    """
    pairs: list[tuple[Any, Any]] = []
    if isinstance(raw, dict):
        pairs = list(raw.items())
    elif isinstance(raw, (list, tuple)):
        for entry in raw:
            if isinstance(entry, dict):
                if "angle" in entry and "gain" in entry:
                    pairs.append((entry["angle"], entry["gain"]))
                elif len(entry) >= 2:
                    pairs.append(tuple(entry.values())[:2])
            elif isinstance(entry, str):
                parts = entry.replace(",", " ").replace(":", " ").split()
                if len(parts) >= 2:
                    pairs.append((parts[0], parts[1]))
            elif isinstance(entry, (list, tuple)) and len(entry) >= 2:
                pairs.append((entry[0], entry[1]))
    out = []
    for angle, gain in pairs:
        try:
            out.append((float(angle) % 360.0, float(gain)))
        except (TypeError, ValueError):
            continue
    return sorted(out, key=lambda pair: pair[0])


def normal_pattern(pattern: Column) -> Column:
    """The same for a column of [angle, gain] arrays: an array of structs in order of angle."""
    whole = F.filter(pattern, lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())
    placed = F.transform(whole, lambda p, i: F.struct(F.pmod(p[0], F.lit(360.0)).alias("angle"), i.alias("place"), p[1].alias("gain")))
    return F.transform(F.array_sort(placed), lambda p: F.struct(p["angle"].alias("angle"), p["gain"].alias("gain")))


def segments(pattern: Column, lift: Column) -> Column:
    """A normal pattern as (angle, gain, slope), each from its angle to the next, closed at 360 degrees by the first entry.

    ``lift`` is added to the gains. The first segment holds the first gain below the first angle.
    """
    after = lambda i: F.when(i + 1 < F.size(pattern), F.get(pattern, i + 1)).otherwise(F.struct((pattern[0]["angle"] + 360.0).alias("angle"), pattern[0]["gain"].alias("gain")))
    part = lambda angle, gain, slope: F.struct(angle.alias("angle"), (gain + lift).alias("gain"), slope.alias("slope"))
    rising = lambda p, i: F.coalesce((after(i)["gain"] - p["gain"]) / F.nullif(after(i)["angle"] - p["angle"], F.lit(0.0)), F.lit(0.0))
    parts = F.transform(pattern, lambda p, i: part(p["angle"], p["gain"], rising(p, i)))
    return F.when(F.size(pattern) > 0, F.concat(F.array(part(F.lit(-1.0), pattern[0]["gain"], F.lit(0.0))), parts))


def at_angle(parts: Column, angle: Column) -> Column:
    """Gain at an angle of :func:`segments`, in one pass over them; null without any."""
    a = F.pmod(angle, F.lit(360.0))
    return F.aggregate(parts, F.lit(None).cast("double"), lambda held, s: F.when(s["angle"] <= a, s["gain"] + (a - s["angle"]) * s["slope"]).otherwise(held))


def interpolate(pattern: Column, angle: Column) -> Column:
    """Gain at an angle of a normal pattern: linear, closed at 360 degrees by the first entry.

    Angles below the first entry take its gain; empty patterns give null.
    """
    return at_angle(segments(pattern, F.lit(0.0)), angle)


def azimuth(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def relative_azimuth(az: Column, heading: Column) -> Column:
    """From a compass heading: the bearing (90 - heading) mod 360 is zero."""
    return F.pmod(az - F.pmod(F.lit(90.0) - heading, F.lit(360.0)), F.lit(360.0))


def elevation(dx: Column, dy: Column, dz: Column) -> Column:
    return F.degrees(F.atan2(dz, F.sqrt(dx * dx + dy * dy)))


def lobes(az_pattern: Column, el_pattern: Column, gain: Column) -> tuple[Column, Column]:
    """Segments of both patterns, once for each antenna: the azimuth lifted to the antenna's gain, the elevation about zero."""
    top = lambda p: F.array_max(F.transform(p, lambda x: x["gain"]))
    return segments(az_pattern, gain - top(az_pattern)), segments(el_pattern, F.when(F.abs(top(el_pattern)) <= 2.0, F.lit(0.0)).otherwise(-top(el_pattern)))


def antenna_gain(across: Column, along: Column, gain: Column, rel_az: Column, el: Column) -> Column:
    """Total gain in dB of an antenna's :func:`lobes`."""
    return F.coalesce(at_angle(across, rel_az), gain) + F.coalesce(at_angle(along, el), F.lit(0.0))


def knife_edge_loss(h: Column, d1: Column, d2: Column, wavelength: Column) -> Column:
    """Diffraction loss in dB over one edge of height h above the line of sight."""
    v = h * F.sqrt(F.lit(2.0) * (d1 + d2) / F.when((d1 > 0) & (d2 > 0), wavelength * d1 * d2))
    w = v - 0.1
    loss = F.greatest(F.lit(0.0), F.lit(6.9) + F.lit(20.0) * F.log10(F.sqrt(w * w + 1.0) + w))
    return F.when((d1 <= 0) | (d2 <= 0) | (v <= -0.78), F.lit(0.0)).otherwise(loss)


def fresnel(cos_i: Column, eps: Column) -> tuple[Column, Column]:
    """Magnitude and sign of the unpolarised reflection; total reflection is (1, -1)."""
    n2 = F.sqrt(eps)
    sin_t = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - cos_i * cos_i)) / n2
    cos_t = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - sin_t * sin_t))
    rs = (cos_i - n2 * cos_t) / F.nullif(cos_i + n2 * cos_t, F.lit(0.0))
    rp = (n2 * cos_i - cos_t) / F.nullif(n2 * cos_i + cos_t, F.lit(0.0))
    total = sin_t > 1.0
    size = F.when(total, F.lit(1.0)).otherwise((F.abs(rs) + F.abs(rp)) / 2.0)
    sign = F.when(total | ((rs + rp) / 2.0 < 0), F.lit(-1.0)).otherwise(F.lit(1.0))
    return size, sign


def watts(dbm: Column) -> Column:
    return F.pow(F.lit(10.0), dbm / 10.0) / 1000.0


def dbm(milliwatts: Column) -> Column:
    return F.lit(10.0) * F.log10(F.greatest(milliwatts, F.lit(FLOOR_MW)))


def field(power_w: Column, gain_db: Column, wavelength: Column, reach: Column, path: Column, loss_db: Column) -> tuple[Column, Column]:
    """Real and imaginary part of the field over a path, attenuated at ``reach`` and by a loss."""
    size = F.sqrt(power_w * F.pow(F.lit(10.0), gain_db / 10.0)) * wavelength / (F.lit(4.0 * pi) * reach) * F.pow(F.lit(10.0), -loss_db / 20.0)
    phase = F.lit(2.0 * pi) * path / wavelength
    return size * F.cos(phase), -size * F.sin(phase)


def quality(rssi: Column) -> Column:
    return F.when(rssi >= -55, "Excellent").when(rssi >= -65, "Good").when(rssi >= -75, "Fair").when(rssi >= -85, "Poor").otherwise("Unusable")


def rssi_rgb(rssi: Column) -> tuple[Column, Column, Column]:
    """Colour between black (-100), red (-85), yellow (-75), green (-65) and blue (-55 dBm)."""
    up = lambda lo, hi: (rssi - lo) / (hi - lo)
    red = F.when(rssi <= -100, 0.0).when(rssi <= -85, up(-100.0, -85.0)).when(rssi <= -75, 1.0).when(rssi <= -65, F.lit(1.0) - up(-75.0, -65.0)).otherwise(0.0)
    green = F.when(rssi <= -85, 0.0).when(rssi <= -75, up(-85.0, -75.0)).when(rssi <= -65, 1.0).when(rssi <= -55, F.lit(1.0) - up(-65.0, -55.0)).otherwise(0.0)
    blue = F.when(rssi <= -65, 0.0).when(rssi <= -55, up(-65.0, -55.0)).otherwise(1.0)
    return red, green, blue


def score_rgb(score: Column) -> tuple[Column, Column, Column]:
    return F.lit(1.0) - score, score, F.lit(0.0)
