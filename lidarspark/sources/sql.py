"""The queries of a survey as SQL table functions over a view of points; their filters reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Names, arguments and bodies; {points} is the view. An argument that is a constant is one in the scan's filters.
FUNCTIONS = {
    "points_in": ("x DOUBLE, y DOUBLE, half DOUBLE", "*", "SELECT p.* FROM {points} p WHERE p.easting BETWEEN points_in.x - points_in.half AND points_in.x + points_in.half AND p.northing BETWEEN points_in.y - points_in.half AND points_in.y + points_in.half"),
    "points_spanning": (
        "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, margin DOUBLE",
        "*",
        "SELECT p.* FROM {points} p WHERE p.easting BETWEEN least(points_spanning.x0, points_spanning.x1) - points_spanning.margin AND greatest(points_spanning.x0, points_spanning.x1) + points_spanning.margin"
        " AND p.northing BETWEEN least(points_spanning.y0, points_spanning.y1) - points_spanning.margin AND greatest(points_spanning.y0, points_spanning.y1) + points_spanning.margin",
    ),
    "points_between": ("low DOUBLE, high DOUBLE", "*", "SELECT p.* FROM {points} p WHERE p.altitude BETWEEN points_between.low AND points_between.high"),
    "nearest_to": (
        "x DOUBLE, y DOUBLE, k INT",
        "rank INT, id BIGINT, d2 DOUBLE",
        "SELECT rank, id, d2 FROM (SELECT row_number() OVER (ORDER BY d2, id) AS rank, id, d2 FROM (SELECT p.id, (p.easting - nearest_to.x) * (p.easting - nearest_to.x) + (p.northing - nearest_to.y) * (p.northing - nearest_to.y) AS d2 FROM {points} p)) WHERE rank <= nearest_to.k",
    ),
    "neighbours_within": (
        "half DOUBLE",
        "id BIGINT, n_id BIGINT",
        "SELECT a.id, b.id AS n_id FROM (SELECT p.id, p.easting, p.northing, floor(p.easting / neighbours_within.half) + dx AS cx, floor(p.northing / neighbours_within.half) + dy AS cy FROM {points} p LATERAL VIEW explode(array(-1, 0, 1)) AS dx LATERAL VIEW explode(array(-1, 0, 1)) AS dy) a"
        " JOIN {points} b ON a.cx = floor(b.easting / neighbours_within.half) AND a.cy = floor(b.northing / neighbours_within.half)"
        " WHERE b.easting BETWEEN a.easting - neighbours_within.half AND a.easting + neighbours_within.half AND b.northing BETWEEN a.northing - neighbours_within.half AND a.northing + neighbours_within.half",
    ),
}


def register(points: DataFrame, view: str = "points") -> None:
    """Makes ``points`` a temporary view, and the functions temporary ones over it: ``SELECT * FROM points_in(x, y, 10)``."""
    spark = points.sparkSession
    points.createOrReplaceTempView(view)
    columns = ", ".join(f"`{name}` {kind}" for name, kind in points.dtypes)
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns if result == '*' else result}) RETURN {body.replace('{points}', f'`{view}`')}")
