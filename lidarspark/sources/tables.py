"""Point tables, CSV, NDJSON and antenna configurations: readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.utm import project_rows
from ..operators.spatial import with_cells
from ..operators.summaries import ndjson
from ..schema import ANTENNA, default_antennas

#: The cloud derived from ``events``; fractions carry an exponent so that Spark and DuckDB both read doubles.
CLOUD_SQL = """select event_id as id,
  518800e0 + (event_id % 100) * 0.5e0 + ((event_id * 7919) % 1009) / 2018e0 - 0.25e0 as easting,
  4252300e0 + floor(event_id / 100e0) * 0.5e0 + ((event_id * 104729) % 997) / 1994e0 - 0.25e0 as northing,
  1300e0 + 0.05e0 * (event_id % 100) + 0.02e0 * floor(event_id / 100e0) + ((event_id * 31) % 101) / 1000e0 as altitude,
  cast(user_id % 3 as int) + 1 as zone_id,
  case when event_id % 10 < 6 then 2 when event_id % 10 < 8 then 5 when event_id % 10 = 8 then 6 else 1 end as class_code"""


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    columns = CLOUD_SQL.removeprefix("select ").split(",\n")
    return events.selectExpr(*[c.strip() for c in columns])


def write_points(points: DataFrame, path: str, side: float = 50.0, mode: str = "overwrite", files: int | None = None) -> None:
    """Points as parquet, laid out by grid cell: row-group statistics then prune boxes and scores."""
    laid = with_cells(points, side)
    order = ["cell_x", "cell_y", *(["trav_score"] if "trav_score" in points.columns else []), "id"]
    dealt = laid.repartitionByRange(files, "cell_x", "cell_y") if files else laid.repartitionByRange("cell_x", "cell_y")
    dealt.sortWithinPartitions(*order).write.mode(mode).parquet(path)


def read_points(spark: SparkSession, path: str, box=None, side: float = 50.0) -> DataFrame:
    """The points, pruned to the cells of a box; the exact box is left to the caller's predicate."""
    points = spark.read.parquet(path)
    if box is None:
        return points
    span = lambda lo, hi: (int(lo // side), int(hi // side))
    return points.where(F.col("cell_x").between(*span(box.xmin, box.xmax)) & F.col("cell_y").between(*span(box.ymin, box.ymax)))


def compact(spark: SparkSession, path: str, target: str, files: int) -> None:
    """Rewrite a table into so many files, in its layout."""
    points = spark.read.parquet(path)
    points.repartitionByRange(files, "cell_x", "cell_y").sortWithinPartitions("cell_x", "cell_y", "id").write.mode("overwrite").parquet(target)


def create(spark: SparkSession, folder: str) -> None:
    """The tables of an empty store, with the classification labels; tables that are there stay as they are."""
    from ..schema import CLASSES, PROCESSED, ZONES, classifications

    system = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    first = {"points": spark.createDataFrame([], PROCESSED), "zones": spark.createDataFrame([], ZONES), "classifications": classifications(spark).to(CLASSES)}
    for name, rows in first.items():
        if not system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def views(points: DataFrame, boxes: dict[str, str]) -> None:
    """Temporary views of predicates over the point table."""
    for name, predicate in boxes.items():
        points.where(predicate).createOrReplaceTempView(name)


def project_csv(spark: SparkSession, source: str, target: str, chunk: int = 1000) -> DataFrame:
    """UTM rows of CSV files as CSV with latitude and longitude, ``chunk`` rows a file; returns the rows that failed."""
    rows = spark.read.csv(source, header=True, inferSchema=False)
    project_rows(rows).write.mode("overwrite").option("header", True).option("maxRecordsPerFile", chunk).csv(target)
    return project_rows(rows, errors=True)


def write_ndjson(points: DataFrame, path: str) -> None:
    """A line of JSON for each point, in the order of their ids, and the summary line last."""
    ndjson(points).orderBy("meta", "id").select("line").write.mode("overwrite").text(path)


def antenna_configs(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Antenna specs: the built-in ones and those of a folder's JSON files.

    A spec without a name takes its file's; of equal names the last file counts, and files
    count over built-in ones; files that aren't JSON objects are skipped.
    """
    built = default_antennas(spark).withColumn("file", F.lit(""))
    if path is not None:
        from pyspark.sql import types as T

        shape = T.StructType([*ANTENNA.fields, T.StructField("_corrupt_record", T.StringType())])
        read = spark.read.schema(shape).option("mode", "PERMISSIVE").json(path, multiLine=True, pathGlobFilter="*.json").withColumn("file", F.col("_metadata.file_name"))
        good = read.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
        built = built.unionByName(good.withColumn("name", F.coalesce("name", F.regexp_replace("file", r"\.json$", ""))))
    columns = [f.name for f in ANTENNA.fields]
    last = built.groupBy("name").agg(F.max_by(F.struct(*columns), "file").alias("s"))
    return last.select("s.*")


def antenna_named(antennas: DataFrame, name: str | None) -> DataFrame:
    """The spec of a name, upper and lower case told apart; no row for an unknown or null one."""
    return antennas.where(F.col("name") == F.lit(name)) if name is not None else antennas.where("false")


def antenna_list(antennas: DataFrame) -> DataFrame:
    """The listing: texts that are missing are empty, numbers that are missing null."""
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("name", "model", "type", "notes")]
    return antennas.select(*texts, "gain_db", "hp_bw_deg", "vp_bw_deg", "freq_hz_min", "freq_hz_max")
