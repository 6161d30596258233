"""The registered queries over the driver's tables, with their oracles in SQL.

The cloud comes from ``events``. Oracles are written for DuckDB from the definitions, apart from
the expressions of the Spark side; figures are rounded where the engines' last digits differ.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import radio, utm
from ..operators import coverage, paths, spatial, summaries, terrain
from ..operators.cuts import cut, scratch
from ..operators.spatial import Box
from ..schema import ANTENNAS, CLASS_LABELS, classifications, default_antennas
from ..session import Survey
from ..sources import las, snapshots, sql, tables
from ..sources.tables import CLOUD_SQL, antenna_list, cloud
from ..streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BOX = Box(518810.0, 518830.0, 4252301.0, 4252304.0)
_BOX = f"easting BETWEEN {BOX.xmin!r}::DOUBLE AND {BOX.xmax!r}::DOUBLE AND northing BETWEEN {BOX.ymin!r}::DOUBLE AND {BOX.ymax!r}::DOUBLE"
_CLOUD = f"WITH points AS ({CLOUD_SQL} FROM events)"
ZONES = ((1, "15N"), (2, "12N"), (3, "13N"))
_ZONES = ", ".join(f"({i}, '{z}')" for i, z in ZONES)
#: A radio setup over the cloud: two transmitters, inside its extent at every size.
SITES = ((0, 518812.3, 4252301.7, 1300.9, 20.0, 2.4e9, 90.0, "AM-2G16-90"), (1, 518838.9, 4252303.1, 1305.0, 17.0, 2.45e9, 270.0, "AMY-9M16"))


def whole_grid(points: DataFrame) -> coverage.Grid:
    """The raster over the whole cloud: 20 m beyond its extent, a cell each 2 m."""
    grid = coverage.Grid.over(points, 2.0, 20.0)
    if grid is None:
        raise ValueError("no points")
    return grid


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Columns rounded half away from zero, with minus zero as zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def _sql_round(x: str, digits: int) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE"


# -- filters and projections ------------------------------------------------------------------------


@query(f"{_CLOUD} SELECT * FROM points WHERE {_BOX}")
def points_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_box(cloud(spark, sf_dir), BOX)


@query(f"{_CLOUD} SELECT * FROM points WHERE {_BOX} AND class_code <> 2")
def points_nonground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_box(cloud(spark, sf_dir), BOX).where("class_code <> 2")


@query(f"{_CLOUD} SELECT * FROM points WHERE {_BOX} AND class_code = 2")
def points_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_box(cloud(spark, sf_dir), BOX).where("class_code = 2")


@query(f"{_CLOUD} SELECT * FROM points WHERE {_BOX} AND altitude BETWEEN 1301::DOUBLE AND 1301.5::DOUBLE")
def points_altitude_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_box(cloud(spark, sf_dir), BOX).where(F.col("altitude").between(1301.0, 1301.5))


_STORED = "CASE WHEN {0}::FLOAT::DOUBLE > {0} THEN ({0} * (1e0 - 1e0 / 8388608e0))::FLOAT::DOUBLE ELSE {0}::FLOAT::DOUBLE END"


@query(f"{_CLOUD} SELECT * FROM points WHERE {_BOX.replace('easting', _STORED.format('easting')).replace('northing', _STORED.format('northing'))}")
def rtree_compat_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.in_box(cloud(spark, sf_dir), BOX, rtree_compat=True)


@query(f"{_CLOUD} SELECT p.*, z.label AS zone, c.label AS class_label FROM points p LEFT JOIN (VALUES {_ZONES}) z(id, label) ON p.zone_id = z.id LEFT JOIN (VALUES {', '.join(f'({k}, {chr(39)}{v}{chr(39)})' for k, v in CLASS_LABELS.items())}) c(code, label) ON p.class_code = c.code")
def zone_class_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.decode(cloud(spark, sf_dir), spark.createDataFrame(ZONES, "id int, label string"), classifications(spark))


@query("""WITH old AS (SELECT * FROM (VALUES (1, 'AIR'), (2, 'RAIL')) t(id, label)),
fresh AS (SELECT DISTINCT upper(l_shipmode) AS label FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'rail' WHEN 1 THEN 'ship' WHEN 2 THEN 'truck' ELSE 'mail' END AS l_shipmode FROM lineitem))
SELECT id, label FROM old UNION ALL SELECT (2 + row_number() OVER (ORDER BY label))::INTEGER, label FROM fresh WHERE label NOT IN (SELECT label FROM old)""")
def zone_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("upper(case l_linenumber % 4 when 0 then 'rail' when 1 then 'ship' when 2 then 'truck' else 'mail' end) as label")
    return summaries.get_or_create_zones(modes, spark.createDataFrame([(1, "AIR"), (2, "RAIL")], "id int, label string"))


_LABELS = "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in CLASS_LABELS.items()) + ") t(code, label)"


@query(f"{_LABELS} UNION ALL SELECT DISTINCT p_size, concat('Own class ', p_size) FROM part WHERE p_size NOT IN (SELECT code FROM ({_LABELS}))")
def classification_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes that parts bring along are added; those that are there stay as they are."""
    own = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_size as code", "concat('Own class ', p_size) as label")
    return summaries.insert_or_ignore(classifications(spark), own, "code")


# -- summaries ---------------------------------------------------------------------------------------

@query(
    f"{_CLOUD} SELECT count(*) AS n, round(avg(easting), 6) AS cx, round(avg(northing), 6) AS cy, round(avg(altitude), 6) AS cz, min(easting) AS xmin, max(easting) AS xmax, min(northing) AS ymin, max(northing) AS ymax, min(altitude) AS zmin, max(altitude) AS zmax FROM points"
)
def cloud_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summaries.cloud_summary(cloud(spark, sf_dir)), 6, "cx", "cy", "cz")


@query(f"{_CLOUD}, m AS (SELECT round(avg(easting), 6) AS e, round(avg(northing), 6) AS n, round(avg(altitude), 6) AS a FROM points) SELECT id, easting - e AS x, northing - n AS y, altitude - a AS z FROM points, m")
def points_recentred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.recentred(cloud(spark, sf_dir))


@query(f"{_CLOUD} SELECT * FROM points ORDER BY md5(id || ':42'), id LIMIT 500")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.reservoir(cloud(spark, sf_dir), 500)


@query(
    f"{_CLOUD} SELECT 0 AS meta, id, round(easting, 3) AS x, round(northing, 3) AS y, round(altitude, 3) AS z, NULL::BIGINT AS n FROM points WHERE {_BOX} UNION ALL SELECT 1, NULL, round(avg(easting), 3), round(avg(northing), 3), round(avg(altitude), 3), count(*) FROM points WHERE {_BOX}"
)
def ndjson_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = summaries.ndjson(spatial.in_box(cloud(spark, sf_dir), BOX))
    read = F.from_json("line", "x double, y double, z double, _meta struct<centroid:array<double>,bounds:array<double>,count:bigint>")
    row = lines.withColumn("j", read)
    axes = [F.round(F.coalesce(F.col(f"j.{a}"), F.col("j._meta.centroid")[i]), 3).alias(a) for i, a in enumerate("xyz")]
    return row.select("meta", "id", *axes, F.col("j._meta.count").alias("n"))


# -- terrain -----------------------------------------------------------------------------------------

_PAIRS = """p AS (SELECT *, floor(easting / 1e0)::BIGINT AS gx, floor(northing / 1e0)::BIGINT AS gy FROM points),
probes AS (SELECT p.*, gx + ox AS jx, gy + oy AS jy FROM p, (VALUES (-1), (0), (1)) a(ox), (VALUES (-1), (0), (1)) b(oy)),
pairs AS (SELECT a.id, b.easting - a.easting AS dx, b.northing - a.northing AS dy, b.altitude - a.altitude AS dz FROM probes a JOIN p b ON a.jx = b.gx AND a.jy = b.gy
  WHERE b.easting BETWEEN a.easting - 1e0 AND a.easting + 1e0 AND b.northing BETWEEN a.northing - 1e0 AND a.northing + 1e0)"""
_MOMENTS = f"""{_CLOUD}, {_PAIRS},
m AS (SELECT id, count(*) AS n, covar_pop(dx, dx) AS sxx, covar_pop(dx, dy) AS sxy, covar_pop(dy, dy) AS syy, covar_pop(dx, dz) AS sxz, covar_pop(dy, dz) AS syz, covar_pop(dz, dz) AS szz FROM pairs GROUP BY id HAVING count(*) >= 3),
fit AS (SELECT *, (sxz * syy - syz * sxy) / (sxx * syy - sxy * sxy) AS a, (syz * sxx - sxz * sxy) / (sxx * syy - sxy * sxy) AS b, (sxx + syy + szz) / 3e0 AS q FROM m),
sp AS (SELECT *, sqrt(((sxx - q) ** 2 + (syy - q) ** 2 + (szz - q) ** 2 + 2e0 * (sxy ** 2 + sxz ** 2 + syz ** 2)) / 6e0) AS w FROM fit),
ev AS (SELECT *, greatest(-1e0, least(1e0, ((sxx - q) * ((syy - q) * (szz - q) - syz * syz) - sxy * (sxy * (szz - q) - syz * sxz) + sxz * (sxy * syz - (syy - q) * sxz)) / (2e0 * w * w * w))) AS r FROM sp),
raw AS (SELECT id, n, -a / sqrt(a * a + b * b + 1) AS normal_x, -b / sqrt(a * a + b * b + 1) AS normal_y, 1 / sqrt(a * a + b * b + 1) AS normal_z, degrees(atan(sqrt(a * a + b * b))) AS slope,
  sqrt(greatest(0e0, szz - a * sxz - b * syz)) AS rough, greatest(0e0, (q + 2e0 * w * cos(acos(r) / 3e0 + 2e0 * pi() / 3e0)) / (3e0 * q)) AS curvature FROM ev),
metrics AS (SELECT *, greatest(0e0, 1e0 - (least(1e0, slope / 90e0) + least(1e0, rough / 1e0) + curvature)) AS trav_score FROM raw)"""
_METRICS = ("normal_x", "normal_y", "normal_z", "slope", "rough", "curvature", "trav_score")
_ROUNDED = ", ".join(f"{_sql_round(c, 6)} AS {c}" for c in _METRICS)


def _terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.terrain_metrics(cloud(spark, sf_dir), radius=1.0)


@query(f"{_MOMENTS} SELECT id, n, {_ROUNDED} FROM metrics")
def terrain_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_terrain(spark, sf_dir), 6, *_METRICS)


@query(f"{_CLOUD}, {_PAIRS} SELECT id, count(*) AS n FROM pairs GROUP BY id HAVING count(*) >= 3")
def neighbourhood_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = cloud(spark, sf_dir).select("id", "easting", "northing")
    return spatial.neighbour_join(slim, slim, 1.0, keep=("id", "easting", "northing")).groupBy("id").agg(F.count("*").alias("n")).where("n >= 3")


@query(f"{_MOMENTS} SELECT id, {_sql_round('a', 6)} AS a, {_sql_round('b', 6)} AS b FROM fit")
def terrain_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = cloud(spark, sf_dir).select("id", "easting", "northing", "altitude")
    fitted = terrain.plane(terrain.moments(spatial.neighbour_join(slim, slim, 1.0)).where("n >= 3"))
    return rounded(fitted.select("id", "a", "b"), 6, "a", "b")


@query(f"{_MOMENTS} SELECT p.id, p.easting, p.northing, p.altitude, {_sql_round('m.trav_score', 6)} AS trav_score FROM points p JOIN metrics m USING (id) WHERE {_BOX} AND round(m.trav_score, 6) >= 0.8::DOUBLE")
def points_bbox_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rounded(terrain.with_metrics(cloud(spark, sf_dir), cut(_terrain(spark, sf_dir))), 6, "trav_score")
    return spatial.in_box(scored, BOX).where(F.col("trav_score") >= 0.8).select("id", "easting", "northing", "altitude", "trav_score")


@query(f"{_MOMENTS} SELECT p.*, {_ROUNDED} FROM points p LEFT JOIN metrics m USING (id)")
def metrics_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(terrain.with_metrics(cloud(spark, sf_dir), _terrain(spark, sf_dir)), 6, *_METRICS)


@query(f"{_MOMENTS} SELECT id, {_sql_round('1e0 - trav_score', 6)} AS red, {_sql_round('trav_score', 6)} AS green, 0.0::DOUBLE AS blue FROM metrics")
def score_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    red, green, blue = radio.score_rgb(F.col("trav_score"))
    return rounded(_terrain(spark, sf_dir).select("id", red.alias("red"), green.alias("green"), blue.alias("blue")), 6, "red", "green")


@query(f"{_MOMENTS} SELECT id, {_sql_round('(trav_score - min(trav_score) OVER ()) / (max(trav_score) OVER () - min(trav_score) OVER () + 1e-8)', 5)} AS norm FROM metrics")
def score_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the bounds need all scores first: they are computed once
    return rounded(summaries.normalised(cut(_terrain(spark, sf_dir).select("id", "trav_score"))).select("id", "norm"), 5, "norm")


# -- nearest neighbours and paths ---------------------------------------------------------------------

_KNN = f"""{_CLOUD}, p AS (SELECT *, floor(easting / 4e0)::BIGINT AS gx, floor(northing / 4e0)::BIGINT AS gy FROM points),
probes AS (SELECT p.*, gx + ox AS jx, gy + oy AS jy FROM p, (VALUES (-1), (0), (1)) a(ox), (VALUES (-1), (0), (1)) b(oy)),
near AS (SELECT a.id AS src, b.id AS dst, (b.easting - a.easting) * (b.easting - a.easting) + (b.northing - a.northing) * (b.northing - a.northing) AS d2 FROM probes a JOIN p b ON a.jx = b.gx AND a.jy = b.gy AND a.id <> b.id),
edges AS (SELECT src, dst, sqrt(d2) AS dist FROM near QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) <= 8)"""


@query(f"{_KNN} SELECT src, dst, round(dist, 6) AS dist FROM edges")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paths.knn_edges(cloud(spark, sf_dir), 8), 6, "dist")


@query(f"{_KNN} SELECT src, dst, {_sql_round('dist * (1e0 + 5e0 * (1e0 - ((dst * 37) % 101) / 100e0))', 6)} AS cost FROM edges")
def edge_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _scored(spark, sf_dir)
    return rounded(paths.costed(paths.knn_edges(points, 8), points, 5.0).select("src", "dst", "cost"), 6, "cost")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).withColumn("trav_score", F.expr("((id * 37) % 101) / 100e0"))


@query(f"{_CLOUD} SELECT id, easting, northing, altitude, zone_id, class_code, round((easting - 518820e0) * (easting - 518820e0) + (northing - 4252302e0) * (northing - 4252302e0), 8) AS d2 FROM points ORDER BY (easting - 518820e0) * (easting - 518820e0) + (northing - 4252302e0) * (northing - 4252302e0), id LIMIT 1")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.nearest_point(cloud(spark, sf_dir), 518820.0, 4252302.0), 8, "d2")


_EXTENT = "SELECT min(easting) - 20e0 AS xmin, max(easting) + 20e0 AS xmax, min(northing) - 20e0 AS ymin, max(northing) + 20e0 AS ymax, greatest(8, ceil((max(easting) - min(easting) + 40e0) / 2e0))::INTEGER AS nx, greatest(8, ceil((max(northing) - min(northing) + 40e0) / 2e0))::INTEGER AS ny FROM points"
_CELLS = f"""g AS ({_EXTENT}), ys AS (SELECT unnest(range(ny)) AS iy FROM g), xs AS (SELECT unnest(range(nx)) AS ix FROM g),
cells AS (SELECT (iy * nx + ix)::BIGINT AS cell, iy::INTEGER AS iy, ix::INTEGER AS ix, xmin + ix * ((xmax - xmin) / (nx - 1)) AS x, ymin + iy * ((ymax - ymin) / (ny - 1)) AS y FROM g, ys, xs),
ground AS (SELECT cell, iy, ix, x, y, arg_min(altitude, ((easting - x) * (easting - x) + (northing - y) * (northing - y), id)) AS z FROM cells, points GROUP BY ALL)"""


def _ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cloud(spark, sf_dir)
    return coverage.ground(whole_grid(points).cells(spark), points)


@query(f"{_CLOUD}, {_CELLS} SELECT iy, ix, round(x, 6) AS x, round(y, 6) AS y FROM cells")
def raster_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(whole_grid(cloud(spark, sf_dir)).cells(spark).drop("cell"), 6, "x", "y")


@query(f"{_CLOUD}, {_CELLS} SELECT iy, ix, round(z, 6) AS z FROM ground")
def grid_ground_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ground(spark, sf_dir).select("iy", "ix", "z"), 6, "z")


@query(f"{_CLOUD} {_EXTENT}")
def grid_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = coverage.Grid.over(cloud(spark, sf_dir), 2.0, 20.0)
    return spark.createDataFrame([(g.xmin, g.xmax, g.ymin, g.ymax, g.nx, g.ny)], "xmin double, xmax double, ymin double, ymax double, nx int, ny int")


#: Ends of the path: beside the first points, and the point nearest to a place far beyond the last ones.
_FROM, _TO = (518802.0, 4252301.0), (518848.0, 4260000.0)


def _path_sql() -> str:
    """Distances over the whole cloud until nothing gets cheaper, the last point of each way, then the way back."""
    nearest = "(SELECT id FROM points ORDER BY (easting - {0!r}::DOUBLE) * (easting - {0!r}::DOUBLE) + (northing - {1!r}::DOUBLE) * (northing - {1!r}::DOUBLE), id LIMIT 1)"
    return f"""WITH RECURSIVE points AS ({CLOUD_SQL} FROM events),
{_KNN.removeprefix(_CLOUD + ", ")},
costs AS MATERIALIZED (SELECT src, dst, dist * (1e0 + 5e0 * (1e0 - ((dst * 37) % 101) / 100e0)) AS cost FROM edges),
ends AS MATERIALIZED (SELECT {nearest.format(*_FROM)} AS first, {nearest.format(*_TO)} AS last),
d(id, cost) USING KEY (id) AS (
  SELECT first, 0e0 FROM ends
  UNION SELECT e.dst, min(d.cost + e.cost) FROM d JOIN costs e ON d.id = e.src LEFT JOIN recurring.d r ON r.id = e.dst WHERE r.id IS NULL OR d.cost + e.cost < r.cost GROUP BY e.dst),
prevs AS MATERIALIZED (SELECT b.id, any_value(b.cost) AS cost, min(a.id) AS prev FROM d b LEFT JOIN costs e ON e.dst = b.id AND e.cost > 0 AND b.id <> (SELECT first FROM ends) LEFT JOIN d a ON a.id = e.src AND a.cost + e.cost = b.cost GROUP BY b.id),
back AS (SELECT p.*, 0 AS hops FROM prevs p JOIN ends ON p.id = last UNION ALL SELECT p.*, hops + 1 FROM back JOIN prevs p ON back.prev = p.id)
SELECT (max(hops) OVER () - hops)::INTEGER AS step, id, easting, northing, altitude, {_sql_round("cost", 6)} AS cost FROM back JOIN points USING (id)"""


@query(_path_sql())
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paths.shortest_path(_scored(spark, sf_dir), _FROM, _TO, 8, 5.0), 6, "cost")


# -- projection ---------------------------------------------------------------------------------------

_TEXT = "SELECT id, CASE WHEN id % 97 = 0 THEN 'x' ELSE printf('%.3f', easting) END AS easting, printf('%.3f', northing) AS northing, CASE WHEN id % 101 = 0 THEN '' WHEN id % 3 = 0 THEN '15N' WHEN id % 3 = 1 THEN '33S' ELSE '12n' END AS zone FROM points"


def _text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).selectExpr("id", "case when id % 97 = 0 then 'x' else format_string('%.3f', easting) end as easting", "format_string('%.3f', northing) as northing", "case when id % 101 = 0 then '' when id % 3 = 0 then '15N' when id % 3 = 1 then '33S' else '12n' end as zone")


def _latlon_sql() -> str:
    """The inverse projection by series, then four Newton steps, in SQL."""
    m = utm.SCALE * utm.RECTIFYING
    x = "xi" + "".join(f" - {b!r}::DOUBLE * sin({2 * j}e0 * xi) * cosh({2 * j}e0 * eta)" for j, b in enumerate(utm.BETA, 1))
    y = "eta" + "".join(f" - {b!r}::DOUBLE * cos({2 * j}e0 * xi) * sinh({2 * j}e0 * eta)" for j, b in enumerate(utm.BETA, 1))
    e = utm.ECCENTRICITY
    steps = ["t0 AS (SELECT *, sin(x) / sqrt(sinh(y) * sinh(y) + cos(x) * cos(x)) AS tp, sin(x) / sqrt(sinh(y) * sinh(y) + cos(x) * cos(x)) AS tau FROM xy)"]
    for k in range(4):
        steps.append(f"s{k} AS (SELECT *, sqrt(1 + tau * tau) AS rt, sinh({e!r}::DOUBLE * atanh({e!r}::DOUBLE * tau / sqrt(1 + tau * tau))) AS sg FROM t{k})")
        steps.append(f"t{k + 1} AS (SELECT * EXCLUDE (tau, rt, sg), tau + (tp - (tau * sqrt(1 + sg * sg) - sg * rt)) / sqrt(1 + (tau * sqrt(1 + sg * sg) - sg * rt) ** 2) * (1 + {1 - e * e!r}::DOUBLE * tau * tau) / ({1 - e * e!r}::DOUBLE * rt) AS tau FROM s{k})")
    return f"""{_CLOUD}, text AS ({_TEXT}),
num AS (SELECT id, easting, northing, zone, try_cast(easting AS DOUBLE) AS e, try_cast(northing AS DOUBLE) AS n, try_cast(left(zone, -1) AS INTEGER) AS k, upper(right(zone, 1)) = 'N' AS north FROM text),
good AS (SELECT *, (e - 500000e0) / {m!r}::DOUBLE AS eta, (n - CASE WHEN north THEN 0e0 ELSE 10000000e0 END) / {m!r}::DOUBLE AS xi FROM num WHERE e IS NOT NULL AND n IS NOT NULL AND k BETWEEN 1 AND 60),
xy AS (SELECT *, {x} AS x, {y} AS y FROM good), {", ".join(steps)}
SELECT id, easting, northing, zone, printf('%.6f', degrees(atan(tau))) AS latitude, printf('%.6f', degrees(atan2(sinh(y), cos(x))) + 6e0 * k - 183e0) AS longitude FROM t4"""


@query(_latlon_sql())
def utm_to_latlon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utm.project_rows(_text_rows(spark, sf_dir))


@query(f"{_CLOUD}, text AS ({_TEXT}) SELECT id, easting, northing, zone FROM text WHERE id % 97 = 0 OR id % 101 = 0")
def utm_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utm.project_rows(_text_rows(spark, sf_dir), errors=True)


@query(f"{_CLOUD}, text AS ({_TEXT}) SELECT id, try_cast(left(zone, -1) AS INTEGER) AS number, coalesce(upper(right(zone, 1)) = 'N', false) AS north, regexp_full_match(zone, '[0-9]{{1,2}}[NS]') AS valid FROM text")
def parse_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.col("zone")
    return _text_rows(spark, sf_dir).select("id", utm.zone_number(zone).alias("number"), utm.is_north(zone).alias("north"), utm.valid_zone(zone).alias("valid"))


# -- radio --------------------------------------------------------------------------------------------


@query(f"{_CLOUD}, r AS (SELECT id, -30e0 - (id % 90) AS rssi FROM points) SELECT id, rssi, CASE WHEN rssi >= -55 THEN 'Excellent' WHEN rssi >= -65 THEN 'Good' WHEN rssi >= -75 THEN 'Fair' WHEN rssi >= -85 THEN 'Poor' ELSE 'Unusable' END AS quality FROM r")
def rssi_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).selectExpr("id", "-30e0 - (id % 90) as rssi").withColumn("quality", radio.quality(F.col("rssi")))


@query(
    f"""{_CLOUD}, r AS (SELECT id, greatest(-100e0, least(-55e0, -30e0 - (id % 900) / 10e0)) AS v FROM points),
stops AS (SELECT * FROM (VALUES (-100e0, -85e0, 0e0, 0e0, 0e0, 1e0, 0e0, 0e0), (-85e0, -75e0, 1e0, 0e0, 0e0, 1e0, 1e0, 0e0), (-75e0, -65e0, 1e0, 1e0, 0e0, 0e0, 1e0, 0e0), (-65e0, -55e0, 0e0, 1e0, 0e0, 0e0, 0e0, 1e0)) t(lo, hi, r0, g0, b0, r1, g1, b1))
SELECT id, {_sql_round('r0 + (v - lo) / (hi - lo) * (r1 - r0)', 6)} AS red, {_sql_round('g0 + (v - lo) / (hi - lo) * (g1 - g0)', 6)} AS green, {_sql_round('b0 + (v - lo) / (hi - lo) * (b1 - b0)', 6)} AS blue FROM r JOIN stops ON v >= lo AND (v < hi OR (v = hi AND hi = -55e0))"""
)
def rssi_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    red, green, blue = radio.rssi_rgb(F.col("rssi"))
    df = cloud(spark, sf_dir).selectExpr("id", "-30e0 - (id % 900) / 10e0 as rssi").select("id", red.alias("red"), green.alias("green"), blue.alias("blue"))
    return rounded(df, 6, "red", "green", "blue")


def _values(pattern: list) -> str:
    """SQL rows (k, a0, g0, a1, g1) of the segments of a pattern, closed at 360 degrees."""
    pairs = sorted((a % 360.0, g) for a, g in pattern)
    pairs.append((pairs[0][0] + 360.0, pairs[0][1]))
    return ", ".join(f"({a0!r}::DOUBLE, {g0!r}::DOUBLE, {a1!r}::DOUBLE, {g1!r}::DOUBLE)" for (a0, g0), (a1, g1) in zip(pairs, pairs[1:]))


def _gain_sql(antenna: dict, rel: str, el: str) -> str:
    """Scalar SQL of an antenna's gain; below a pattern's first angle its first gain holds."""
    def interp(pattern: list, angle: str) -> str:
        first = min((a % 360.0, g) for a, g in pattern)
        a = f"((({angle}) % 360e0 + 360e0) % 360e0)"
        return f"(CASE WHEN {a} < {first[0]!r} THEN {first[1]!r}::DOUBLE ELSE (SELECT g0 + ({a} - a0) / (a1 - a0) * (g1 - g0) FROM (VALUES {_values(pattern)}) s(a0, g0, a1, g1) WHERE {a} >= a0 AND {a} < a1) END)"

    az, elev = antenna["azimuth_pattern"], antenna["elevation_pattern"]
    top = max(g for _, g in elev)
    return f"({interp(az, rel)} + {antenna['gain_db'] - max(g for _, g in az)!r}::DOUBLE + {interp(elev, el)} + {0.0 if abs(top) <= 2 else -top!r}::DOUBLE)"


@query(
    f"{_CLOUD}, a AS (SELECT id, (id * 7.3e0) % 360e0 AS rel, (id % 121) - 60e0 AS el FROM points) "
    + " UNION ALL ".join(f"SELECT id, '{a['name']}' AS name, {_sql_round(_gain_sql(a, 'rel', 'el'), 6)} AS gain FROM a" for a in ANTENNAS)
)
def antenna_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    angles = cloud(spark, sf_dir).selectExpr("id", "(id * 7.3e0) % 360e0 as rel", "(id % 121) - 60e0 as el")
    across, along = radio.lobes(radio.normal_pattern(F.col("azimuth_pattern")), radio.normal_pattern(F.col("elevation_pattern")), F.col("gain_db"))
    specs = F.broadcast(default_antennas(spark).select("name", "gain_db", across.alias("across"), along.alias("along")))
    gain = radio.antenna_gain(F.col("across"), F.col("along"), F.col("gain_db"), F.col("rel"), F.col("el"))
    return rounded(angles.crossJoin(specs).select("id", "name", gain.alias("gain")), 6, "gain")


#: Antennas of a fleet: one for each nation, of which the first two bear the names of built-in ones.
_FLEET = """SELECT CASE n_nationkey WHEN 0 THEN 'AMY-9M16' WHEN 1 THEN 'AM-5G20-90' ELSE n_name END AS name, concat('model ', n_regionkey) AS model, 'dish' AS type,
CASE WHEN n_nationkey % 3 = 0 THEN 'remeasured' END AS notes, 10e0 + n_nationkey AS gain_db, 5e0 + n_regionkey AS hp_bw_deg, 7e0 AS vp_bw_deg, 1e9 + n_nationkey AS freq_hz_min, 2e9 + n_nationkey AS freq_hz_max"""
_LISTED = ("name", "model", "type", "notes", "gain_db", "hp_bw_deg", "vp_bw_deg", "freq_hz_min", "freq_hz_max")


def _quoted(v) -> str:
    return "''" if v is None else repr(v) + "::DOUBLE" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"


def _fleet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specs of the fleet as files of one antenna each, read with the built-in ones; each has a pattern by its nation's numbers."""
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("_nation")
    specs = spark.sql(f"{_FLEET}, array(array(0e0, 0e0), array(90e0, -1e0 * n_nationkey), array(270e0, -1e0 * n_regionkey)) AS azimuth_pattern FROM _nation")
    folder = scratch(spark, "antennas")
    specs.repartition(1).write.option("maxRecordsPerFile", 1).json(folder)  # a file a nation
    return tables.antenna_configs(spark, folder)


_BUILT = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_quoted(a[c]) for c in _LISTED) + ")" for a in ANTENNAS) + f") t({', '.join(_LISTED)})"
_ALL_ANTENNAS = f"fleet AS ({_FLEET} FROM nation), antennas AS (SELECT * REPLACE (coalesce(notes, '') AS notes) FROM fleet UNION ALL SELECT * FROM ({_BUILT}) WHERE name NOT IN (SELECT name FROM fleet))"


@query(f"WITH {_ALL_ANTENNAS} SELECT * FROM antennas")
def antenna_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of the fleet's antennas beside and in place of the built-in ones."""
    return antenna_list(_fleet_files(spark, sf_dir))


@query(
    f"{_CLOUD}, k AS (SELECT id, (id % 41) / 4e0 - 3e0 AS h, (id % 23) * 1e0 AS d1, (id % 31) * 2e0 AS d2 FROM points), v AS (SELECT *, CASE WHEN d1 > 0 AND d2 > 0 THEN h * sqrt(2e0 * (d1 + d2) / (0.125e0 * d1 * d2)) END AS v FROM k) SELECT id, {_sql_round('CASE WHEN v IS NULL OR v <= -0.78e0 THEN 0e0 ELSE greatest(0e0, 6.9e0 + 20e0 * log10(sqrt((v - 0.1e0) * (v - 0.1e0) + 1e0) + v - 0.1e0)) END', 6)} AS loss FROM v"
)
def knife_edge_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = cloud(spark, sf_dir).selectExpr("id", "(id % 41) / 4e0 - 3e0 as h", "(id % 23) * 1e0 as d1", "(id % 31) * 2e0 as d2")
    return rounded(k.select("id", radio.knife_edge_loss(F.col("h"), F.col("d1"), F.col("d2"), F.lit(0.125)).alias("loss")), 6, "loss")


@query(
    f"""{_CLOUD}, f AS (SELECT id, (id % 101) / 100e0 AS c, CASE WHEN id % 2 = 0 THEN 6e0 ELSE 0.5e0 END AS eps FROM points),
g AS (SELECT *, sqrt(eps) AS n2, sqrt(greatest(0e0, 1e0 - c * c)) / sqrt(eps) AS st FROM f), h AS (SELECT *, sqrt(greatest(0e0, 1e0 - st * st)) AS ct FROM g),
r AS (SELECT *, (c - n2 * ct) / nullif(c + n2 * ct, 0e0) AS rs, (n2 * c - ct) / nullif(n2 * c + ct, 0e0) AS rp FROM h)
SELECT id, {_sql_round('CASE WHEN st > 1 THEN 1e0 ELSE (abs(rs) + abs(rp)) / 2e0 END', 6)} AS magnitude, CASE WHEN st > 1 OR (rs + rp) / 2e0 < 0 THEN -1e0 ELSE 1e0 END AS sign FROM r"""
)
def fresnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cloud(spark, sf_dir).selectExpr("id", "(id % 101) / 100e0 as c", "case when id % 2 = 0 then 6e0 else 0.5e0 end as eps")
    size, sign = radio.fresnel(F.col("c"), F.col("eps"))
    return rounded(f.select("id", size.alias("magnitude"), sign.alias("sign")), 6, "magnitude")


def _sites(spark: SparkSession) -> DataFrame:
    bare = spark.createDataFrame(SITES, "tx int, x double, y double, h_m double, power_dbm double, freq_hz double, heading_deg double, ant_config string")
    specs = default_antennas(spark).select(F.col("name").alias("ant_config"), "gain_db", radio.normal_pattern(F.col("azimuth_pattern")).alias("az"), radio.normal_pattern(F.col("elevation_pattern")).alias("el"))
    defaults = {"aperture_m": 0.1, "eps_r": 6.0, "roughness_m": 0.02, "reflect": True, "rx_aperture_m": 0.0, "n_freq": 5, "frac": 0.005}
    return bare.join(F.broadcast(specs), "ant_config", "left").withColumn("gain_db", F.coalesce("gain_db", F.lit(0.0))).withColumns({k: F.lit(v) for k, v in defaults.items()})


@query(f"WITH {_ALL_ANTENNAS} SELECT s_suppkey AS tx, 'NATION_' || (s_nationkey + CASE WHEN s_suppkey % 10 = 0 THEN 100 ELSE 0 END) AS ant_config, coalesce(gain_db, 0e0) AS gain_db, CASE WHEN gain_db IS NULL THEN -1 ELSE 3 END AS n_azimuth FROM supplier LEFT JOIN antennas ON name = 'NATION_' || (s_nationkey + CASE WHEN s_suppkey % 10 = 0 THEN 100 ELSE 0 END)")
def tx_antenna_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transmitters of all suppliers with the spec of their nation's antenna; unknown names are kept without one."""
    specs = cut(_fleet_files(spark, sf_dir).select(F.col("name").alias("ant_config"), "gain_db", radio.normal_pattern(F.col("azimuth_pattern")).alias("az")))
    bare = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey as tx", "concat('NATION_', s_nationkey + case when s_suppkey % 10 = 0 then 100 else 0 end) as ant_config")
    return bare.join(specs, "ant_config", "left").select("tx", "ant_config", F.coalesce("gain_db", F.lit(0.0)).alias("gain_db"), F.coalesce(F.size("az"), F.lit(-1)).alias("n_azimuth"))


def _rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.rays(_ground(spark, sf_dir), _sites(spark))


_TXS = ", ".join(f"({s[0]}, {s[1]!r}::DOUBLE, {s[2]!r}::DOUBLE, {s[3]!r}::DOUBLE, {s[4]!r}::DOUBLE, {s[5]!r}::DOUBLE, {s[6]!r}::DOUBLE)" for s in SITES)
_RAYS = f"""{_CLOUD}, {_CELLS}, tx AS (SELECT * FROM (VALUES {_TXS}) t(tx, tx_x, tx_y, tx_h, p, f, heading)),
rays AS (SELECT tx, cell, iy, ix, x, y, z, tx_x, tx_y, tx_h, p, f, heading, sqrt((x - tx_x) ** 2 + (y - tx_y) ** 2 + (z - tx_h) ** 2) AS d, 299792458e0 / f AS lam FROM ground, tx),
samples AS (SELECT tx, cell, d, lam, t, tx_x + t * (x - tx_x) AS sx, tx_y + t * (y - tx_y) AS sy, tx_h + t * (z - tx_h) AS sz FROM rays, (SELECT 0.1e0 + k * {0.8 / 7!r}::DOUBLE AS t FROM range(8) r(k))),
tops AS (SELECT tx, cell, t, d, lam, sz, max(altitude) AS top FROM samples JOIN points ON easting BETWEEN sx - 0.6e0 AND sx + 0.6e0 AND northing BETWEEN sy - 0.6e0 AND sy + 0.6e0 WHERE (easting - sx) * (easting - sx) + (northing - sy) * (northing - sy) <= 0.36e0 AND altitude > sz + 0.05e0 GROUP BY ALL),
edges AS (SELECT tx, cell, (top - sz) * sqrt(2e0 * d / (lam * d * t * (d - d * t))) AS v FROM tops),
losses AS (SELECT tx, cell, max(CASE WHEN v <= -0.78e0 THEN 0e0 ELSE greatest(0e0, 6.9e0 + 20e0 * log10(sqrt((v - 0.1e0) * (v - 0.1e0) + 1e0) + v - 0.1e0)) END + 15e0) AS loss FROM edges GROUP BY tx, cell)"""


@query(f"{_RAYS} SELECT tx, cell, round(loss, 5) AS loss FROM losses")
def ray_diffraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coverage.diffraction(_rays(spark, sf_dir), cloud(spark, sf_dir)), 5, "loss")


def _direct_sql() -> str:
    by_name = {a["name"]: a for a in ANTENNAS}
    rel = "(degrees(atan2(y - tx_y, x - tx_x)) - (90e0 - heading))"
    el = "degrees(atan2(z - tx_h, sqrt((x - tx_x) * (x - tx_x) + (y - tx_y) * (y - tx_y))))"
    gain = "CASE tx " + " ".join(f"WHEN {s[0]} THEN {_gain_sql(by_name[s[7]], rel, el)}" for s in SITES) + " END"
    mw = "1000e0 * pow(10e0, p / 10e0) / 1000e0 * pow(10e0, g / 10e0) * pow(299792458e0 / fi / (4e0 * pi() * greatest(d, 0.02e0 / lam)) * pow(10e0, -coalesce(loss, 0e0) / 20e0), 2)"
    return f"""{_RAYS}, gains AS (SELECT *, {gain} AS g FROM rays),
freqs AS (SELECT r.*, l.loss, r.f * (1e0 - 0.005e0 + k * 0.0025e0) AS fi FROM gains r LEFT JOIN losses l USING (tx, cell), range(5) q(k)),
power AS (SELECT tx, iy, ix, avg({mw}) AS mw FROM freqs GROUP BY ALL)
SELECT iy, ix, round(10e0 * log10(greatest(sum(mw), 1e-12)), 4) AS rssi_dbm FROM power GROUP BY iy, ix"""


@query(_direct_sql())
def rf_coverage_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cloud(spark, sf_dir)
    power = coverage.coverage(points, _sites(spark), whole_grid(points), reflections=False)
    return rounded(power.select("iy", "ix", "rssi_dbm"), 4, "rssi_dbm")


@query()
def rf_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cloud(spark, sf_dir)
    return coverage.coverage(points, _sites(spark), whole_grid(points))


@query()
def coarse_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cloud(spark, sf_dir)
    return coverage.planes(spark, whole_grid(points), points)


@query(_direct_sql().replace("SELECT iy, ix, round(", "SELECT 'heatmap' AS type, (iy * (SELECT nx FROM g) + ix)::BIGINT AS at, round(any_value(x), 4) AS x, round(any_value(y), 4) AS y, round(").replace("power AS (SELECT tx, iy, ix,", "power AS (SELECT tx, iy, ix, x, y,"))
def heatmap_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON lines of the raster, read again: a row for each cell in its order."""
    points = cloud(spark, sf_dir)
    made = cut(summaries.heatmap_json(coverage.coverage(points, _sites(spark), whole_grid(points), reflections=False)))
    head = F.broadcast(made.where("iy = -1").select(F.get_json_object("json", "$.type").alias("type")))  # one row
    read = made.where("iy >= 0").select(F.from_json("json", "iy int, y double, xs array<double>, rssi array<double>").alias("j")).select("j.*")
    cells = read.select("iy", "y", "xs", F.posexplode("rssi").alias("ix", "rssi_dbm")).crossJoin(head)
    placed = cells.select("type", (F.col("iy") * F.size("xs") + F.col("ix")).cast("long").alias("at"), F.get("xs", "ix").alias("x"), "y", "rssi_dbm")
    return rounded(placed, 4, "x", "y", "rssi_dbm")


@query(f"{_CLOUD}, {_CELLS} SELECT iy * nx + ix AS at, round(z, 6) AS z FROM ground, g")
def raster_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coverage.raster_order(_ground(spark, sf_dir)).select("at", "z"), 6, "z")


@query(
    f"""{_CLOUD}, probes AS (SELECT id, easting + 0.3e0 AS x, northing - 0.2e0 AS y FROM points),
near AS (SELECT q.id, arg_min(p.altitude, ((p.easting - x) * (p.easting - x) + (p.northing - y) * (p.northing - y), p.id)) AS z FROM probes q JOIN points p
  ON abs(floor(p.easting / 5e0) - floor(x / 5e0)) <= 2 AND abs(floor(p.northing / 5e0) - floor(y / 5e0)) <= 2 GROUP BY q.id)
SELECT id, round(coalesce(z, 0.15e0), 6) AS z FROM probes LEFT JOIN near USING (id)"""
)
def client_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cloud(spark, sf_dir)
    probes = points.selectExpr("id", "easting + 0.3e0 as easting", "northing - 0.2e0 as northing")
    return rounded(spatial.nearest_height(probes, points, 5.0, 2, 0.15).select("id", "z"), 6, "z")


# -- files and stores: written to a folder of their own, read again ---------------------------------------


_FILED_POINTS = f"{_CLOUD} SELECT round(easting, 3) AS easting, round(northing, 3) AS northing, round(altitude, 3) AS altitude, class_code, '12N' AS zone"


@query(f"{_FILED_POINTS}, true AS several FROM points")
def las_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud as LAS files written side by side, read again in ranges of their points."""
    las.register(spark)
    path = scratch(spark, "las")
    cloud(spark, sf_dir).select("easting", "northing", "altitude", "class_code").repartition(6).write.format("las").option("zone", "12N").mode("append").save(path)
    back = spark.read.format("las").option("range", 3000).option("strict", "true").load(path)
    several = F.lit(len(las.files_of(path)) >= 6)
    return rounded(back.select("easting", "northing", "altitude", "class_code", "zone", several.alias("several")), 3, "easting", "northing", "altitude")


@query(f"{_FILED_POINTS} FROM points")
def las_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAS files put into a folder before and after a restart of the stream that follows it: each point once."""
    las.register(spark)
    path, target, checkpoint = scratch(spark, "las"), scratch(spark, "points"), scratch(spark, "stream")
    for part in ("id % 3 = 0", "id % 3 <> 0"):
        cloud(spark, sf_dir).where(part).select("easting", "northing", "altitude", "class_code").repartition(3).write.format("las").option("zone", "12N").mode("append").save(path)
        stream = spark.readStream.format("las").option("range", 3000).option("strict", "true").load(path)
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
    return rounded(spark.read.parquet(target).select("easting", "northing", "altitude", "class_code", "zone"), 3, "easting", "northing", "altitude")


@query(f"WITH done AS ({_latlon_sql()}) SELECT id, easting, northing, zone, latitude, longitude, false AS failed FROM done UNION ALL SELECT id, easting, northing, nullif(zone, ''), NULL, NULL, true FROM ({_CLOUD}, text AS ({_TEXT}) SELECT * FROM text WHERE id % 97 = 0 OR id % 101 = 0)")
def utm_csv_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV in, CSV in parts of 1,000 rows out, and the rows that failed."""
    source, target = scratch(spark, "csv"), scratch(spark, "latlon")
    _text_rows(spark, sf_dir).write.option("header", True).csv(source)
    failed = tables.project_csv(spark, source, target, 1000)
    done = spark.read.csv(target, header=True)
    names = ["id", "easting", "northing", "zone"]
    both = done.select(*names, "latitude", "longitude", F.lit(False).alias("failed")).unionByName(failed.select(*names, F.lit(None).cast("string").alias("latitude"), F.lit(None).cast("string").alias("longitude"), F.lit(True).alias("failed")))
    return both.withColumn("id", F.col("id").cast("long"))


@query(f"WITH {_ALL_ANTENNAS} SELECT type, count(*) AS n, sum(gain_db) AS gain_db, min(freq_hz_min) AS freq_hz_min, max(freq_hz_max) AS freq_hz_max, count(*) FILTER (WHERE notes <> '') AS noted FROM antennas GROUP BY type")
def antenna_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The antennas of files and built-in ones by kind."""
    kinds = antenna_list(_fleet_files(spark, sf_dir)).groupBy("type")
    return kinds.agg(F.count("*").alias("n"), F.sum("gain_db").alias("gain_db"), F.min("freq_hz_min").alias("freq_hz_min"), F.max("freq_hz_max").alias("freq_hz_max"), F.count_if(F.col("notes") != "").alias("noted"))


@query("SELECT n_name AS name, k, CASE k WHEN 0 THEN 0e0 WHEN 1 THEN 90e0 ELSE 270e0 END AS angle, CASE k WHEN 0 THEN 0e0 WHEN 1 THEN -1e0 * n_nationkey ELSE -1e0 * n_regionkey END AS gain FROM nation, (SELECT unnest(range(3))::INTEGER AS k) WHERE n_name = 'NATION_7'")
def antenna_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.antenna_named(_fleet_files(spark, sf_dir), "NATION_7")
    return found.select("name", F.posexplode("azimuth_pattern").alias("k", "p")).select("name", "k", F.col("p")[0].alias("angle"), F.col("p")[1].alias("gain"))


_FOOT = "(SELECT altitude FROM points ORDER BY (easting - {0}) * (easting - {0}) + (northing - {1}) * (northing - {1}), id LIMIT 1)"


@query(f"""{_CLOUD} SELECT * FROM (VALUES {", ".join(f"({s[0]}, {s[1]!r}::DOUBLE, {s[2]!r}::DOUBLE, {s[3]!r}::DOUBLE, {s[4]!r}::DOUBLE, {s[6]!r}::DOUBLE, 16e0, {len(next(a for a in ANTENNAS if a['name'] == s[7])['azimuth_pattern'])})" for s in SITES)}) t(tx, x, y, h_m, power_dbm, heading_deg, gain_db, n_azimuth)
UNION ALL SELECT 2, 518820.5e0, 4252302.5e0, round(3.5e0 + {_FOOT.format("518820.5e0", "4252302.5e0")}, 6), 11e0, 0e0, 9.25e0, 18
UNION ALL SELECT 3, 518825e0, 4252301e0, round(2e0 + {_FOOT.format("518825e0", "4252301e0")}, 6), 20e0, 45e0, 0e0, -1""")
def add_transmitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One with an antenna whose gain the caller overrides, one with an unknown antenna."""
    points, antennas = cloud(spark, sf_dir), default_antennas(spark)
    txs = _sites(spark).select(*[f.split()[0] for f in coverage.TX.replace("array<struct<angle:double,gain:double>>", "p").split(", ")])
    txs = coverage.add_transmitter(txs, points, antennas, x=518820.5, y=4252302.5, h_m=3.5, power_dbm=11.0, ant_config="AM-2G16-90", gain_db=9.25)
    txs = coverage.add_transmitter(txs, points, antennas, x=518825.0, y=4252301.0, heading_deg=45.0, ant_config="none such")
    return rounded(txs.select("tx", "x", "y", "h_m", "power_dbm", "heading_deg", "gain_db", F.coalesce(F.size("az"), F.lit(-1)).alias("n_azimuth")), 6, "h_m")


def _smooth_sql(aperture: float = 6.0, reach_of: float = 4.0) -> str:
    """Two passes of a normal curve over a picture that is mirrored at its edges."""
    def blur(source: str, axis: str, other: str, n: str, lo: str, hi: str) -> str:
        return f"""SELECT {other}, {axis}, sum(w * v) / sum(w) AS v FROM (
  SELECT t.{axis}, s.{other}, exp(-0.5e0 * (k / sigma) ** 2) AS w, s.mw AS v FROM {source} s JOIN (
    SELECT a.i AS {axis}, k, sigma, CASE WHEN a.i + k < 0 THEN -1 - a.i - k WHEN a.i + k >= {n} THEN 2 * {n} - 1 - a.i - k ELSE a.i + k END AS at
    FROM (SELECT unnest(range({n})) AS i, {n}, greatest(1e0, {aperture!r}::DOUBLE / (({hi} - {lo}) / ({n} - 1))) AS sigma FROM g) a, (SELECT unnest(range(-20, 21)) AS k) o WHERE abs(k) <= floor({reach_of!r}::DOUBLE * sigma + 0.5e0)) t ON s.{axis} = t.at) GROUP BY ALL"""
    return f"""{_CLOUD}, {_CELLS}, mw AS (SELECT iy, ix, 1e0 + (cell * 37) % 101 AS mw FROM cells),
down AS (SELECT ix, iy, v AS mw FROM ({blur("mw", "iy", "ix", "ny", "ymin", "ymax")})), over_ AS ({blur("down", "ix", "iy", "nx", "xmin", "xmax")})
SELECT 0 AS tx, iy::INTEGER AS iy, ix::INTEGER AS ix, round(v, 6) AS mw FROM over_"""


@query(_smooth_sql())
def rx_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = whole_grid(cloud(spark, sf_dir))
    picture = grid.cells(spark).selectExpr("0 as tx", "iy", "ix", "1e0 + (cell * 37) % 101 as mw")
    return rounded(coverage.smooth(picture, grid, 6.0).select("tx", "iy", "ix", "mw"), 6, "mw")


@query(f"{_CLOUD} SELECT id, floor(easting / 50e0)::BIGINT AS cell_x, floor(northing / 50e0)::BIGINT AS cell_y, altitude FROM points")
def append_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud in two batches, appended to one table in the order of its cells."""
    path, points = scratch(spark, "points"), cloud(spark, sf_dir)
    for batch in ("id % 3 = 0", "id % 3 <> 0"):
        tables.write_points(points.where(batch), path, mode="append")
    return tables.read_points(spark, path).selectExpr("id", "cast(cell_x as long) as cell_x", "cast(cell_y as long) as cell_y", "altitude")


def _stored(spark: SparkSession, sf_dir: str, rows: int) -> str:
    """A snapshot of the cloud, in files of so many points."""
    path = scratch(spark, "snapshots")
    snapshots.append(cloud(spark, sf_dir), path, rows=rows)
    return path


@query(f"{_CLOUD} SELECT * FROM points WHERE {_BOX}")
def snapshot_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box from the files that reach into it."""
    return snapshots.read(spark, _stored(spark, sf_dir, 1000), BOX)


@query(f"{_CLOUD} SELECT id, easting, northing, CASE WHEN id % 50 = 7 THEN id / 4e0 ELSE altitude END AS altitude, zone_id, class_code FROM points WHERE id % 90 <> 4")
def snapshot_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New heights by id, then points without some, each in a snapshot of its own."""
    path = _stored(spark, sf_dir, 2000)
    snapshots.update(spark, path, cloud(spark, sf_dir).where("id % 50 = 7").selectExpr("id", "id / 4e0 as altitude"), rows=2000)
    snapshots.merge(spark, path, gone=cloud(spark, sf_dir).where("id % 90 = 4").select("id"), rows=2000)
    return snapshots.read(spark, path)


@query(f"{_CLOUD} SELECT id, easting, northing, altitude, true AS few FROM points")
def snapshot_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cloud in many small appends, put together; ``few`` tells that one small file is left at most."""
    path, points = scratch(spark, "snapshots"), cloud(spark, sf_dir)
    for k in range(4):
        snapshots.append(points.where(F.col("id") % 4 == k), path, rows=200_000)
    snapshots.compact(spark, path, 200_000, rows=400_000)
    small = snapshots.files(spark, path).where("rows < 100000").count()
    return snapshots.read(spark, path).select("id", "easting", "northing", "altitude", F.lit(small <= 1).alias("few"))


_CHANGED = f"WITH points AS (SELECT id, easting + CASE WHEN id % 11 = 5 THEN 0.3e0 ELSE 0e0 END AS easting, northing, altitude, zone_id, class_code FROM ({CLOUD_SQL} FROM events) WHERE id % 7 <> 3)"


@query(f"{_MOMENTS.replace(_CLOUD, _CHANGED)} SELECT p.*, {_ROUNDED} FROM points p LEFT JOIN metrics m USING (id)")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored cloud after a stream of points that come, go and move, with the metrics kept up."""
    path, source, points = scratch(spark, "store"), scratch(spark, "changes"), cloud(spark, sf_dir)
    changes.create(points.where("id % 10 <> 0"), path, rows=20_000)
    come = points.where("id % 10 = 0").selectExpr("*", "false as gone", "1L as seq")
    go = points.where("id % 7 = 3").selectExpr("*", "true as gone", "2L as seq")
    move = points.where("id % 11 = 5 and id % 7 <> 3").withColumn("easting", F.col("easting") + 0.3).selectExpr("*", "false as gone", "3L as seq")
    for batch in (come, go, move):
        batch.coalesce(1).write.mode("append").parquet(source)  # a file, whose batch comes after the one before
    changes.follow(spark, source, path, scratch(spark, "stream"), files=1, rows=20_000).awaitTermination()
    return rounded(snapshots.read(spark, path), 6, *_METRICS)


@query(f"{_CLOUD} SELECT 'points' AS name, 13 AS n_columns, count(*) AS n FROM points UNION ALL SELECT 'zones', 2, count(*) FROM region UNION ALL SELECT 'classifications', 2, {len(CLASS_LABELS)}")
def create_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty store, created again after a zone for each region and the cloud were added: what is there stays."""
    folder = scratch(spark, "store")
    tables.create(spark, folder)
    spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("r_regionkey as id", "r_name as label").write.mode("append").parquet(f"{folder}/zones")
    bare = cloud(spark, sf_dir).withColumns({m: F.lit(None).cast("double") for m in _METRICS})
    bare.write.mode("append").parquet(f"{folder}/points")
    tables.create(spark, folder)
    found = [spark.read.parquet(f"{folder}/{name}") for name in ("points", "zones", "classifications")]
    rows = [t.agg(F.lit(name).alias("name"), F.lit(len(t.columns)).alias("n_columns"), F.count("*").alias("n")) for name, t in zip(("points", "zones", "classifications"), found)]
    return rows[0].union(rows[1]).union(rows[2])


# -- regions, sessions and SQL functions over the cloud -----------------------------------------------------


def _inside(x0: str, x1: str, y0: str, y1: str) -> str:
    return f"easting BETWEEN {x0} AND {x1} AND northing BETWEEN {y0} AND {y1}"


@query(f"""{_CLOUD}, m AS (SELECT round((min(easting) + max(easting)) / 2e0, 3) AS cx, round((min(northing) + max(northing)) / 2e0, 3) AS cy FROM points)
SELECT 'size' AS region, id FROM points, m WHERE {_inside("cx - 3e0", "cx + 3e0", "cy - 3e0", "cy + 3e0")}
UNION ALL SELECT 'radius', id FROM points, m WHERE {_inside("cx - 4.5e0", "cx + 4.5e0", "cy - 4.5e0", "cy + 4.5e0")}
UNION ALL SELECT 'span', id FROM points, m WHERE {_inside("cx - 9e0", "cx + 6e0", "cy - 3e0", "cy + 12e0")}""")
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the regions about the middle of the cloud: by size, by radius, and spanning two places with a margin."""
    points = cloud(spark, sf_dir)
    x, y = points.agg(*[F.round((F.min(c) + F.max(c)) / 2.0, 3) for c in ("easting", "northing")]).first()
    boxes = {"size": Box.around(x, y, 6.0 / 2), "radius": Box.around(x, y, 4.5), "span": Box.spanning((x + 4.0, y - 1.0), (x - 7.0, y + 10.0), 2.0)}
    found = [spatial.in_box(points, box).select(F.lit(name).alias("region"), "id") for name, box in boxes.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"{_CLOUD} SELECT 'all' AS name, id FROM points WHERE {_BOX} UNION ALL SELECT 'ground', id FROM points WHERE {_BOX} AND class_code = 2 UNION ALL SELECT 'high', id FROM points WHERE {_BOX} AND altitude >= 1301e0")
def spatial_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a box: all of it, its ground, and what is high."""
    box = f"easting between {BOX.xmin!r} and {BOX.xmax!r} and northing between {BOX.ymin!r} and {BOX.ymax!r}"
    tables.views(cloud(spark, sf_dir), {"_box": box, "_box_ground": f"{box} and class_code = 2", "_box_high": f"{box} and altitude >= 1301e0"})
    return spark.sql("SELECT 'all' AS name, id FROM _box UNION ALL SELECT 'ground', id FROM _box_ground UNION ALL SELECT 'high', id FROM _box_high")


@query(f"{_CLOUD}, r AS (SELECT * FROM points WHERE {_inside('518810e0', '518826e0', '4252300e0', '4252308e0')}) SELECT count(*) AS n, round(avg(altitude), 6) AS cz, greatest(8, ceil((max(easting) - min(easting) + 4e0) / 1.5e0))::INTEGER AS nx, greatest(8, ceil((max(northing) - min(northing) + 4e0) / 1.5e0))::INTEGER AS ny, 2 AS txs, 0 AS cleared FROM r")
def survey_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session: region, grid, two transmitters, and the same session without them."""
    survey = Survey(cloud(spark, sf_dir)).load_box(518818.0, 4252304.0, 8.0)
    survey = replace(survey, region=Box(518810.0, 518826.0, 4252300.0, 4252308.0)).set_grid(1.5, 2.0)
    survey = survey.add_tx(518812.0, 4252302.0, ant_config="AM-2G16-90").add_tx(518820.0, 4252303.0)
    grid, cleared = survey.grid, survey.clear_txs()
    told = survey.summary().select("n", "cz", F.lit(grid.nx).alias("nx"), F.lit(grid.ny).alias("ny"), F.lit(survey.txs.count()).alias("txs"), F.lit(0 if cleared.txs is None else 1).alias("cleared"))
    return rounded(told.withColumn("txs", F.col("txs").cast("int")), 6, "cz")


@query(f"{_CLOUD}, s AS (SELECT *, ((id * 37) % 101) / 100e0 AS trav_score FROM points) SELECT id, trav_score FROM s WHERE trav_score >= 0.75e0 AND class_code = 2")
def scored_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by score and class from a table that is laid out by cell and score, compacted once."""
    path, packed = scratch(spark, "scored"), scratch(spark, "packed")
    tables.write_points(_scored(spark, sf_dir), path, files=8)
    tables.compact(spark, path, packed, 2)
    return tables.read_points(spark, packed).where("trav_score >= 0.75 and class_code = 2").select("id", "trav_score")


@query(f"{_FILED_POINTS}, true AS ok FROM points")
def las_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAS files copied into another folder one by one, of which one that isn't there is told."""
    las.register(spark)
    source, target = scratch(spark, "las"), scratch(spark, "converted")
    cloud(spark, sf_dir).select("easting", "northing", "altitude", "class_code").repartition(4).write.format("las").option("zone", "12N").mode("append").save(source)
    paths = las.files_of(source)
    told = cut(las.convert(spark, [*paths, f"{source}/missing.las"], target))
    ok = told.where("ok").count() == len(paths) and told.where("not ok and error is not null").count() == 1
    back = spark.read.format("las").load(target)
    return rounded(back.select("easting", "northing", "altitude", "class_code", "zone", F.lit(ok).alias("ok")), 3, "easting", "northing", "altitude")


@query(f"{_CLOUD} SELECT id, easting, northing, altitude, zone_id, class_code FROM points WHERE {_inside('518815.5e0', '518822.5e0', '4252298.5e0', '4252305.5e0')}")
def sql_points_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(cloud(spark, sf_dir), "_points")
    return spark.sql("SELECT * FROM points_in(518819, 4252302, 3.5)")


@query(f"{_CLOUD}, near AS (SELECT id, (easting - 518820e0) * (easting - 518820e0) + (northing - 4252302e0) * (northing - 4252302e0) AS d2 FROM points) SELECT row_number() OVER (ORDER BY d2, id)::INTEGER AS rank, id, round(d2, 8) AS d2 FROM near QUALIFY rank <= 25")
def sql_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(cloud(spark, sf_dir), "_points")
    return rounded(spark.sql("SELECT * FROM nearest_to(518820, 4252302, 25)"), 8, "d2")


@query(f"{_CLOUD}, {_PAIRS} SELECT id, count(*) AS n FROM pairs GROUP BY id")
def sql_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(cloud(spark, sf_dir), "_points")
    return spark.sql("SELECT id, count(*) AS n FROM neighbours_within(1.0) GROUP BY id")


@query(f"""{_CLOUD}, g AS ({_EXTENT}), k AS (SELECT *, greatest(1, ceil((xmax - xmin) / 10e0))::BIGINT AS n, greatest(1, ceil((ymax - ymin) / 10e0))::BIGINT AS m FROM g),
nodes AS (SELECT gy * n + gx AS node, xmin + gx * CASE WHEN n > 1 THEN (xmax - xmin) / (n - 1) ELSE 0e0 END AS x, ymin + gy * CASE WHEN m > 1 THEN (ymax - ymin) / (m - 1) ELSE 0e0 END AS y FROM k, (SELECT unnest(range(n)) AS gx FROM k), (SELECT unnest(range(m)) AS gy FROM k)),
near AS (SELECT node, easting, northing, altitude FROM nodes, points QUALIFY row_number() OVER (PARTITION BY node ORDER BY (easting - x) * (easting - x) + (northing - y) * (northing - y), id) <= 64)
SELECT node, count(*) AS n, round(avg(easting), 5) AS px, round(avg(northing), 5) AS py, round(avg(altitude), 9) AS pz, true AS unit, true AS upward, true AS eigen, true AS least FROM near GROUP BY node""")
def plane_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarse planes, and whether each normal is of unit length, points up, and is the eigenvector of the least eigenvalue."""
    points = cloud(spark, sf_dir)
    grid = whole_grid(points)
    found = cut(coverage.planes(spark, grid, points))
    near = coverage.near_nodes(spark, grid, points)
    off = near.join(found.select("node", "px", "py", "pz"), "node").select("node", *[(F.col(a) - F.col(b)).alias(c) for a, b, c in (("n_easting", "px", "x"), ("n_northing", "py", "y"), ("n_altitude", "pz", "z"))])
    spread = off.groupBy("node").agg(F.count("*").alias("n"), *[F.avg(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])
    v = {"x": F.col("nx"), "y": F.col("ny"), "z": F.col("nz")}
    s = lambda a, b: F.col("s" + "".join(sorted(a + b)))
    image = {a: s(a, "x") * v["x"] + s(a, "y") * v["y"] + s(a, "z") * v["z"] for a in "xyz"}
    value = image["x"] * v["x"] + image["y"] * v["y"] + image["z"] * v["z"]
    told = found.join(spread, "node").withColumn("value", value)
    small = F.lit(1e-7) * (F.col("sxx") + F.col("syy") + F.col("szz") + 1e-9)
    residual = F.sqrt(sum(((image[a] - F.col("value") * v[a]) * (image[a] - F.col("value") * v[a]) for a in "xyz"), F.lit(0.0)))
    # without the least eigenvalue on its diagonal the matrix has no negative one: neither sum of minors is negative
    left = {a: s(a, a) - F.col("value") for a in "xyz"}
    minors = sum((left[a] * left[b] - s(a, b) * s(a, b) for a, b in ("xy", "xz", "yz")), F.lit(0.0))
    length = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
    rows = told.select("node", "n", "px", "py", "pz", (F.abs(length - 1.0) < 1e-9).alias("unit"), (v["z"] >= 0).alias("upward"), (residual < small).alias("eigen"), ((left["x"] + left["y"] + left["z"] > -small) & (minors > -small * (F.col("sxx") + F.col("syy") + F.col("szz")))).alias("least"))
    return rounded(rounded(rows, 5, "px", "py"), 9, "pz")  # a mean of 64 heights to the millimetre has 9 digits
