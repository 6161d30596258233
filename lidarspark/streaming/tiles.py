"""New tiles of points as a stream: append them, and recompute the metrics that they change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cuts import cut
from ..operators.spatial import cell
from ..operators.terrain import terrain_metrics
from ..schema import POINTS


def ingest(spark: SparkSession, source: str, table: str, metrics: str, checkpoint: str, radius: float = 1.0) -> StreamingQuery:
    """Follow a folder of parquet tiles: each batch goes to ``table``, and a snapshot of the
    metrics of all points within reach of it to ``metrics``, by batch.

    A batch is written under its number, so one that is repeated after a failure replaces itself.
    """
    tiles = spark.readStream.schema(POINTS).parquet(source)

    def settle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        new = spark.read.schema(POINTS).parquet(f"{table}/batch={number}")
        touched(spark.read.schema(POINTS).parquet(table).select(*POINTS.names), new, radius).write.mode("overwrite").parquet(f"{metrics}/batch={number}")

    return tiles.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def around(points: DataFrame, places: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """The points in cells that touch a place's, and those one cell further out, which their metrics need.

    The extent of the places, which one row states, reaches the scan, so that files and row groups
    beyond it aren't read.
    """
    ends = places.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("easting", "northing") for f in (F.min, F.max)]).first()
    for c in ("easting", "northing"):
        low, high = ends[f"min_{c}"], ends[f"max_{c}"]
        points = points.where("false") if low is None else points.where(F.col(c).between(low - 3 * radius, high + 3 * radius))

    span = lambda c: F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2))
    cells = places.select(cell(F.col("easting"), radius).alias("_cx"), cell(F.col("northing"), radius).alias("_cy")).distinct()
    ring = cells.withColumn("_x", span("_cx")).withColumn("_y", span("_cy"))
    close = (F.abs(F.col("_x") - F.col("_cx")) <= 1) & (F.abs(F.col("_y") - F.col("_cy")) <= 1)
    ring = ring.groupBy("_x", "_y").agg(F.max(close).alias("_own"))
    # both are read from one join
    met = cut(points.withColumn("_x", cell(F.col("easting"), radius)).withColumn("_y", cell(F.col("northing"), radius)).join(ring, ["_x", "_y"]).drop("_x", "_y"))
    return met.where("_own").drop("_own"), met.drop("_own")


def touched(points: DataFrame, new: DataFrame, radius: float) -> DataFrame:
    """Metrics of all points in cells that touch a new point's: theirs may have changed."""
    own, halo = around(points, new, radius)
    return terrain_metrics(halo, radius).join(own.select("id"), "id", "left_semi")


def latest(spark: SparkSession, metrics: str) -> DataFrame:
    """The last metrics of each point over all batches."""
    every = spark.read.option("basePath", metrics).parquet(f"{metrics}/batch=*")
    columns = [c for c in every.columns if c not in ("id", "batch")]
    return every.groupBy("id").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("id", "s.*")
