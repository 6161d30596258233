"""Points that come, go and move as a stream: one snapshot a batch, with the metrics they change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.cuts import cut
from ..operators.terrain import terrain_metrics, with_metrics
from ..schema import METRICS, POINTS, PROCESSED
from ..sources import snapshots
from .tiles import around

#: A change: a point as it is from now on, or that it is gone; of several of one id the one with the greatest seq counts.
CHANGES = T.StructType([*(T.StructField(f.name, f.dataType) for f in POINTS.fields), T.StructField("gone", T.BooleanType()), T.StructField("seq", T.LongType())])


def create(points: DataFrame, path: str, radius: float = 1.0, rows: int = snapshots.ROWS) -> int:
    """A first snapshot of points with their metrics."""
    points = cut(points.select(*POINTS.names))
    return snapshots.append(with_metrics(points, terrain_metrics(points, radius)).select(*PROCESSED.names), path, rows=rows)


def apply_changes(spark: SparkSession, path: str, changes: DataFrame, radius: float = 1.0, batch: int | None = None, rows: int = snapshots.ROWS) -> int:
    """A snapshot after the changes: points and the metrics of all that lie within reach of an old or a new place, at once.

    A change of an id that isn't there adds the point; that an unknown one is gone changes nothing.
    A change without coordinates counts only if the point is gone. Points that are left with fewer
    than three neighbours lose their metrics.
    """
    rows_of = F.struct(*[c for c in CHANGES.names if c != "seq"])
    usable = changes.where("id is not null and (gone or (easting is not null and northing is not null))")
    last = cut(usable.groupBy("id").agg(F.max_by(rows_of, F.struct("seq", rows_of)).alias("s")).select("s.*"))
    ids, gone = last.select("id"), last.where("gone").select("id")
    put = last.where("not coalesce(gone, false)").select(*POINTS.names)
    before = snapshots.read(spark, path).select(*POINTS.names).join(ids, "id", "left_semi")
    places = cut(before.select("easting", "northing").union(put.select("easting", "northing")))
    points = snapshots.read(spark, path).select(*POINTS.names).join(ids, "id", "left_anti").unionByName(put)
    own, halo = around(points, places, radius)
    changed = with_metrics(own, terrain_metrics(halo, radius)).select(*PROCESSED.names)
    return snapshots.merge(spark, path, changed, gone, batch=batch, rows=rows)


def follow(spark: SparkSession, source: str, path: str, checkpoint: str, radius: float = 1.0, files: int = 1000, rows: int = snapshots.ROWS) -> StreamingQuery:
    """Follow a folder of parquet files of changes, so many a batch; each batch is one snapshot of ``path``.

    The snapshot keeps the number of its batch, so that one that is repeated after a failure counts once.
    """
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files).parquet(source)

    def settle(batch: DataFrame, number: int) -> None:
        if snapshots.last_batch(spark, path) < number:
            apply_changes(spark, path, batch, radius, number, rows)

    return stream.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
