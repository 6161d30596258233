"""Aggregates over a cloud, zone keys, samples, and the rows of its JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = (("x", "easting"), ("y", "northing"), ("z", "altitude"))


def cloud_summary(points: DataFrame) -> DataFrame:
    """One row: count, centroid and bounds; zeros for an empty cloud."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"c{a}") for a, c in AXES]
    bounds = [F.coalesce(f(c), F.lit(0.0)).alias(f"{a}{n}") for a, c in AXES for n, f in (("min", F.min), ("max", F.max))]
    return points.agg(F.count("*").alias("n"), *means, *bounds)


def decode(points: DataFrame, zones: DataFrame, classes: DataFrame) -> DataFrame:
    """Points with zone and class labels; both tables are small dimensions of fixed kind."""
    z = F.broadcast(zones.select(F.col("id").alias("zone_id"), F.col("label").alias("zone")))
    c = F.broadcast(classes.select(F.col("code").alias("class_code"), F.col("label").alias("class_label")))
    return points.join(z, "zone_id", "left").join(c, "class_code", "left")


def get_or_create_zones(labels: DataFrame, existing: DataFrame) -> DataFrame:
    """The zone table with new labels after the largest id, in the order of their text."""
    fresh = labels.select("label").where("label is not null").distinct().join(existing.select("label"), "label", "left_anti")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # zones are at most 120 labels
    numbered = fresh.withColumn("k", F.row_number().over(Window.orderBy("label"))).crossJoin(F.broadcast(top))
    return existing.select("id", "label").unionByName(numbered.select((F.col("top") + F.col("k")).cast("int").alias("id"), "label"))


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))


def normalised(points: DataFrame, column: str = "trav_score") -> DataFrame:
    """The column scaled to its minimum and maximum over the loaded set."""
    span = F.broadcast(points.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")))
    return points.crossJoin(span).withColumn("norm", (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(1e-8))).drop("_lo", "_hi")


def recentred(points: DataFrame) -> DataFrame:
    """Coordinates relative to the centroid, which is taken to the micrometre."""
    middle = F.broadcast(points.agg(*[F.round(F.avg(c), 6).alias(f"_{a}") for a, c in AXES]))
    return points.crossJoin(middle).select("id", *[(F.col(c) - F.col(f"_{a}")).alias(a) for a, c in AXES])


def reservoir(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k rows, each set as likely as any: the smallest of seeded hashes, so the same rows on any layout."""
    return points.orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(k)


def ndjson(points: DataFrame) -> DataFrame:
    """(meta, id, line): a line for each point, and the last with centroid, bounds and count."""
    lines = points.select(F.lit(0).alias("meta"), "id", F.to_json(F.struct(*[F.col(c).alias(a) for a, c in AXES])).alias("line"))
    s = cloud_summary(points)
    meta = F.to_json(F.struct(F.struct(F.array("cx", "cy", "cz").alias("centroid"), F.array("xmin", "xmax", "ymin", "ymax", "zmin", "zmax").alias("bounds"), F.col("n").alias("count")).alias("_meta")))
    return lines.unionByName(s.select(F.lit(1).alias("meta"), F.lit(None).cast("long").alias("id"), meta.alias("line")))


def heatmap_json(raster: DataFrame, method: str = "Spark", seconds: float = 0.0) -> DataFrame:
    """(iy, json): a line for each row of the raster with its y, its xs and its powers, and a first one, iy -1, that says what they are."""
    spark = raster.sparkSession
    head = spark.range(1).select(F.lit(-1).alias("iy"), F.to_json(F.struct(F.lit("heatmap").alias("type"), F.lit(method).alias("simulation_method"), F.lit(seconds).alias("simulation_time"))).alias("json"))
    row = raster.groupBy("iy").agg(F.first("y").alias("y"), F.array_sort(F.collect_list(F.struct("ix", "x", "rssi_dbm"))).alias("r"))
    line = F.struct("iy", "y", F.transform("r", lambda c: c["x"]).alias("xs"), F.transform("r", lambda c: c["rssi_dbm"]).alias("rssi"))
    return head.unionByName(row.select("iy", F.to_json(line).alias("json")))
