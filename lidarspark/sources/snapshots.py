"""A point table in snapshots: files along a space-filling curve, and an index of their boxes.

Data files are written once and never changed. A snapshot is a small table that lists its files with
their rows, bytes and boxes: a box reads the files that the index names and no other, an update
writes the files anew that hold one of its points, compaction those that are small. The next
snapshot counts once Spark has marked its index as complete, so that a job that dies leaves the one
before. One writer at a time; readers of a snapshot aren't disturbed until :func:`vacuum`.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cuts import cut
from ..operators.spatial import Box, cell, in_box

#: Metres of a cell of the curve, and rows of a file, about.
SIDE, ROWS = 1.0, 4_000_000
#: Tasks that write at least, if there are as many files, and files of a task beyond them.
TASKS, FILES_A_TASK = 200, 64
INDEX = "file string, rows bigint, bytes bigint, xmin double, xmax double, ymin double, ymax double, batch bigint"


def z_key(x: Column, y: Column, side: float = SIDE) -> Column:
    """Place along a Z-order curve over cells: the bits of both cells' numbers in turn."""

    def spread(c: Column) -> Column:
        # the 31 low bits of a number, each moved to twice its place
        out = (cell(c, side) + F.lit(1 << 30)).bitwiseAND(F.lit((1 << 31) - 1))
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
        return out

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete snapshots, ascending."""
    system, where = _system(spark, f"{path}/index/*/_SUCCESS")
    return sorted(int(s.getPath().getParent().getName()) for s in system.globStatus(where) or ())


def files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The index of a snapshot, the last if none is named; no rows if there is no snapshot."""
    known = versions(spark, path)
    version = version if version is not None else known[-1] if known else None
    if version is None:
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).parquet(f"{path}/index/{version:08d}")


def last_batch(spark: SparkSession, path: str) -> int:
    """The number of the batch that the last snapshot came from; -1 for none."""
    found = files(spark, path).agg(F.max("batch")).first()[0]
    return -1 if found is None else found


def _write(spark: SparkSession, path: str, points: DataFrame, rows: int, side: float) -> DataFrame:
    """The index rows of ``points`` as new files along the curve."""
    folder, points = f"data/{uuid4().hex}", cut(points)
    key = z_key(F.col("easting"), F.col("northing"), side).alias("_z")
    wanted = max(1, -(-points.count() // rows))
    tasks = min(wanted, max(TASKS, wanted // FILES_A_TASK))  # what a task tells the driver is paid once for several files
    laid = points.select("*", key).repartitionByRange(tasks, "_z", "id").sortWithinPartitions("_z", "id").drop("_z")
    (laid.write.option("maxRecordsPerFile", rows) if tasks < wanted else laid.write).parquet(f"{path}/{folder}")
    back = spark.read.schema(points.schema).parquet(f"{path}/{folder}").select("easting", "northing", F.concat(F.lit(f"{folder}/"), F.col("_metadata.file_name")).alias("file"), F.col("_metadata.file_size").alias("bytes"))
    ends = [f(c).alias(f"{a}{f.__name__}") for c, a in (("easting", "x"), ("northing", "y")) for f in (F.min, F.max)]
    found = back.groupBy("file").agg(F.count("*").alias("rows"), F.max("bytes").alias("bytes"), *ends)
    found = cut(found.select("file", "rows", "bytes", "xmin", "xmax", "ymin", "ymax"))
    if found.isEmpty():  # a file without rows, for its columns
        name = spark.read.parquet(f"{path}/{folder}").inputFiles()[0].rsplit("/", 1)[1]
        return spark.createDataFrame([(f"{folder}/{name}", 0, 0, None, None, None, None)], INDEX.removesuffix(", batch bigint"))
    return found


def _commit(spark: SparkSession, path: str, index: DataFrame, batch: int | None) -> int:
    known = versions(spark, path)
    version, told = (known[-1] if known else 0) + 1, batch if batch is not None else last_batch(spark, path)
    system, where = _system(spark, f"{path}/index/{version:08d}")
    system.delete(where, True)  # of a job that died before its index was complete
    index.select(*[c.split()[0] for c in INDEX.split(", ")[:-1]], F.lit(told).cast("bigint").alias("batch")).write.parquet(f"{path}/index/{version:08d}")
    return version


def append(points: DataFrame, path: str, batch: int | None = None, rows: int = ROWS, side: float = SIDE) -> int:
    """A snapshot with more points; returns its number. Without points it lists one file without rows more, which keeps the columns."""
    spark = points.sparkSession
    return _commit(spark, path, files(spark, path).drop("batch").unionByName(_write(spark, path, points, rows, side)), batch)


def _folders(spark: SparkSession, path: str, names: list[str]) -> list[str]:
    """The files, with a folder in place of its files where all it holds are named: many paths are listed by a task each."""
    own: dict[str, list[str]] = {}
    for name in names:
        own.setdefault(name.rsplit("/", 1)[0], []).append(name)
    out = []
    for folder, some in own.items():
        system, where = _system(spark, f"{path}/{folder}/part-*")
        out += [folder] if len(some) > 1 and len(some) == len(system.globStatus(where) or ()) else some
    return out


def open_files(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """The points of some files of the index; their columns if there are none of them."""
    some = [r.file for r in index.where("rows > 0").select("file").collect()]  # names of files, not of points
    if some:
        return spark.read.parquet(*[f"{path}/{f}" for f in _folders(spark, path, some)])
    any_file = files(spark, path).select("file").first()
    if any_file is None:
        raise ValueError(f"{path}: no snapshot")
    return spark.read.parquet(f"{path}/{any_file.file}").where("false")


def within(index: DataFrame, box: Box) -> DataFrame:
    return index.where((F.col("xmax") >= box.xmin) & (F.col("xmin") <= box.xmax) & (F.col("ymax") >= box.ymin) & (F.col("ymin") <= box.ymax))


def read(spark: SparkSession, path: str, box: Box | None = None, version: int | None = None) -> DataFrame:
    """The points of a snapshot, or those of a box: only files that reach into it are opened."""
    index = files(spark, path, version)
    return open_files(spark, path, index) if box is None else in_box(open_files(spark, path, within(index, box)), box)


def merge(spark: SparkSession, path: str, changed: DataFrame | None = None, gone: DataFrame | None = None, batch: int | None = None, box: Box | None = None, rows: int = ROWS, side: float = SIDE) -> int:
    """A snapshot with ``changed`` rows in place of those of their ids, or besides, and without the ids in ``gone``.

    Only files that hold one of these ids are written anew. ``box``, if given, holds all old places
    of the ids, so that files beyond it aren't searched. An id in both is changed; of ids that repeat,
    all rows are replaced.
    """
    index = files(spark, path)
    ids = [d.select("id") for d in (changed, gone) if d is not None]
    named = cut((ids[0] if len(ids) == 1 else ids[0].union(ids[1])).distinct())
    held = open_files(spark, path, within(index, box) if box else index)
    name = F.regexp_extract("_metadata.file_path", "(data/[^/]+/[^/]+)$", 1).alias("file")
    touched = [(r.file,) for r in held.select("id", name).join(named, "id", "left_semi").select("file").distinct().collect()]
    listed = spark.createDataFrame(touched, "file string")
    new = open_files(spark, path, index.join(F.broadcast(listed), "file", "left_semi")).join(named, "id", "left_anti")
    new = new if changed is None else new.unionByName(changed.select(*new.columns))
    return _commit(spark, path, index.drop("batch").join(F.broadcast(listed), "file", "left_anti").unionByName(_write(spark, path, new, rows, side)), batch)


def update(spark: SparkSession, path: str, values: DataFrame, box: Box | None = None, rows: int = ROWS, side: float = SIDE) -> int:
    """A snapshot in which the rows of ``values``' ids have its other columns; ids that aren't there count for nothing."""
    names = [c for c in values.columns if c != "id"]
    told = cut(values.select("id", *[F.col(c).alias(f"_{c}") for c in names]))
    held = read(spark, path, box).join(told, "id")
    return merge(spark, path, held.select(*[F.col(f"_{c}" if c in names else c).alias(c) for c in held.columns if c not in {f"_{n}" for n in names}]), box=box, rows=rows, side=side)


def compact(spark: SparkSession, path: str, small: int, rows: int = ROWS, side: float = SIDE) -> int | None:
    """A snapshot in which the files of under ``small`` rows are put together along the curve; the others stay as they are.

    None if there are fewer than two such files.
    """
    index = files(spark, path).drop("batch")
    few = cut(index.where(F.col("rows") < small))
    if few.count() < 2:
        return None
    return _commit(spark, path, index.where(F.col("rows") >= small).unionByName(_write(spark, path, open_files(spark, path, few), rows, side)), None)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the files that the last snapshot doesn't list, and all other snapshots; returns how many files went."""
    last = versions(spark, path)[-1]
    kept = {r.file for r in files(spark, path, last).select("file").collect()}
    system, where = _system(spark, f"{path}/data/*/part-*")
    dead = [s.getPath() for s in system.globStatus(where) or () if f"data/{s.getPath().getParent().getName()}/{s.getPath().getName()}" not in kept]
    for file in dead:
        system.delete(file, False)
    for s in system.globStatus(_system(spark, f"{path}/index/*")[1]) or ():
        if int(s.getPath().getName()) != last:
            system.delete(s.getPath(), True)
    return len(dead)
