"""LAS files as a Spark data source, read by ranges of points and written as format 6.

Layout by the public ASPRS LAS 1.4 standard. Partitions are ranges of points, so one large file
is read by many tasks, and no task holds more than a range or one file of ``FILE`` points.
Register with :func:`register`, then ``spark.read.format("las")``, or ``readStream`` for a folder
that files are put into. Paths are local ones, which the
executors must see too, or URIs of a file system that Arrow knows (``s3://``, ``gs://``, ``hdfs://``).
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "id bigint, easting double, northing double, altitude double, class_code int, zone string, file string"
#: Points of a partition, points of a written file at most, and bits of an id that number the points of a file.
RANGE, FILE, ID_BITS = 1_000_000, 4_000_000, 34
#: Numbers of files.
NUMBERS = 1 << (63 - ID_BITS)
#: A point of format 6: what is written of it.
RECORD = np.dtype({"names": ["xyz", "code"], "formats": ["3<i4", "u1"], "offsets": [0, 16], "itemsize": 30})


def plain(path: str) -> str:
    """An absolute local path, without a file scheme, or the URI as it is."""
    path = re.sub("^file:/+", "/", path)
    return path if "://" in path else os.path.abspath(path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    path = plain(path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Header:
    """What reading needs of a header: layout, scales, offsets, number of points, zone."""

    def __init__(self, path: str):
        system, inner = opened(path)
        with system.open_input_file(inner) as f:
            head = f.read(375)
            if head[:4] != b"LASF" or len(head) < 227:
                raise ValueError(f"{path}: not a LAS file")
            size, self.start, vlrs = struct.unpack_from("<HII", head, 94)
            self.format, self.record, count = struct.unpack_from("<BHI", head, 104)
            if self.format & 128:
                raise ValueError(f"{path}: LAZ-compressed points need a LAZ codec, which is not installed; convert the file to LAS")
            self.scale, self.offset = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
            wide = head[24] == 1 and head[25] >= 4 and size >= 375
            self.count = struct.unpack_from("<Q", head, 247)[0] if wide else count
            f.seek(size)
            self.vlrs = []
            for _ in range(vlrs):
                v = f.read(54)
                if len(v) < 54:
                    break
                user, number, n = v[2:18].rstrip(b"\0"), *struct.unpack_from("<HH", v, 18)
                self.vlrs.append((user.decode("utf-8", "ignore"), number, f.read(n), v[22:54].rstrip(b"\0").decode("utf-8", "ignore")))
        self.zone = zone_of(self.vlrs)


def zone_of(vlrs: list[tuple[str, int, bytes, str]]) -> str | None:
    """``15N`` from the coordinate-system records, else from any record's payload or description."""
    text = lambda b: b.decode("utf-8", "ignore")
    for user, number, data, _ in vlrs:
        if (user, number) == ("LASF_Projection", 2112) and (m := re.search(r"UTM\s+zone\s+(\d+)([NS])", text(data), re.I)):
            return f"{int(m[1])}{m[2].upper()}"
    for _, _, data, said in vlrs:
        for part in (text(data), said):
            if m := re.search(r"UTM\s+zone\s*([0-9]+)([NS])?", part, re.I):
                return f"{int(m[1])}{(m[2] or '?').upper()}"
    return None


def files_of(path: str) -> list[str]:
    """The file itself, or the .las files of a folder in the order of their names."""
    path = plain(path)
    system, inner = opened(path)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file)
        found = [f"{path.rstrip('/')}/{name}" for name in names if name.endswith(".las") and not name.startswith(".")]
    else:
        found = [path] if path.lower().endswith(".las") else []
    if not found:
        raise FileNotFoundError(f"no .las file at {path}")
    return found


def number_of(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") % NUMBERS


def numbers_of(paths: list[str]) -> list[int]:
    """A number for each file, by the hash of its name, so that files that come later don't renumber points.

    Where two names share a hash, which takes tens of thousands of files, the later name moves to the next free number.
    """
    taken: dict[int, str] = {}
    for path in sorted(paths, key=os.path.basename):
        at = number_of(os.path.basename(path))
        while at in taken:
            at = (at + 1) % NUMBERS
        taken[at] = path
    number = {path: at for at, path in taken.items()}
    return [number[path] for path in paths]


def chunks(path: str, head: Header, first: int, count: int) -> Iterator[np.ndarray]:
    """The bytes of points first, first + 1, ..., a row each, at most ``RANGE`` points at a time."""
    system, inner = opened(path)
    with system.open_input_file(inner) as f:
        f.seek(head.start + first * head.record)
        for done in range(0, count, RANGE):
            wanted = min(RANGE, count - done)
            data = f.read(wanted * head.record)
            if len(data) < wanted * head.record:
                raise ValueError(f"{path}: ends before point {first + done + wanted} of {head.count}")
            yield np.frombuffer(data, np.uint8).reshape(wanted, head.record)


def fields(raw: np.ndarray, head: Header) -> tuple[np.ndarray, np.ndarray]:
    """Unscaled coordinates and class codes of rows of bytes."""
    return np.ascontiguousarray(raw[:, :12]).view("<i4"), raw[:, 16] if head.format >= 6 else raw[:, 15] & 31


class Range(InputPartition):
    def __init__(self, path: str, number: int, first: int, count: int):
        self.path, self.number, self.first, self.count = path, number, first, count


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.zone = options["path"], options.get("zone")
        self.range, self.strict = int(options.get("range", RANGE)), options.get("strict", "false").lower() == "true"

    def partitions(self) -> list[Range]:
        paths = files_of(self.path)
        return self.ranges(paths, numbers_of(paths))

    def ranges(self, paths: list[str], numbers: list[int]) -> list[Range]:
        """The ranges of some files; their headers are read many at a time."""
        out = []
        with ThreadPoolExecutor(32) as pool:
            heads = list(pool.map(Header, paths))
        for number, path, head in zip(numbers, paths, heads):
            if head.count >> ID_BITS:
                raise ValueError(f"{path}: {head.count} points; a file can have {1 << ID_BITS} at most")
            zone = self.zone or head.zone
            if self.strict and not (zone and re.fullmatch(r"\d{1,2}[NS]", zone)):
                raise ValueError(f"{path}: no UTM zone; give one with option('zone', '15N')")
            out += [Range(path, number, i, min(self.range, head.count - i)) for i in range(0, head.count, self.range)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        head = Header(part.path)
        at = (part.number << ID_BITS) + part.first
        for raw in chunks(part.path, head, part.first, part.count):
            xyz, code = fields(raw, head)
            n = len(raw)
            x, y, z = (pa.array(xyz[:, i] * head.scale[i] + head.offset[i]) for i in range(3))
            zone, file = (pa.array([text] * n, pa.string()) for text in (self.zone or head.zone, os.path.basename(part.path)))
            yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(n, dtype=np.int64)), x, y, z, pa.array(code.astype(np.int32)), zone, file], ["id", "easting", "northing", "altitude", "class_code", "zone", "file"])
            at += n


class LasStream(LasReader, DataSourceStreamReader):
    """The files of a folder in the order of their arrival, each once.

    The order is kept in a log beside them (option ``log``: another folder): an entry has the names
    of the files that were new, at most as many as option ``files`` says, and an offset is a number
    of entries. So a batch that is repeated has the files and ids it had, whatever came since. A file
    must have its name only when it is complete, and not change.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.log, self.most = options.get("log") or f"{plain(self.path)}/_arrived", int(options.get("files", 10_000))

    def entries(self) -> list[list[str]]:
        system, inner = opened(self.log)
        if system.get_file_info(inner).type != fs.FileType.Directory:
            return []
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inner)) if re.fullmatch(r"\d{10}", f.base_name))
        return [system.open_input_stream(f"{inner}/{n}").read().decode().split("\n") for n in names]

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        known = self.entries()
        try:
            here = [p.rsplit("/", 1)[1] for p in files_of(self.path)]
        except FileNotFoundError:
            here = []
        new = sorted(set(here) - {n for entry in known for n in entry})[: self.most]
        if new:
            system, inner = opened(self.log)
            system.create_dir(inner, recursive=True)
            with system.open_output_stream(f"{inner}/.next") as f:
                f.write("\n".join(new).encode())
            system.move(f"{inner}/.next", f"{inner}/{len(known):010d}")
        return {"entries": len(known) + bool(new)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        taken: dict[int, str] = {}
        numbers: dict[str, int] = {}
        known = self.entries()[: end["entries"]]
        for name in (n for entry in known for n in entry):
            at = number_of(name)
            while at in taken:
                at = (at + 1) % NUMBERS
            taken[at], numbers[name] = name, at
        names = [n for entry in known[start["entries"] :] for n in entry]
        return self.ranges([f"{plain(self.path).rstrip('/')}/{n}" for n in names], [numbers[n] for n in names])


class Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


def header(count: int, scale: tuple, offset: tuple, low: np.ndarray, high: np.ndarray, zone: str | None) -> bytes:
    """A LAS 1.4 header for points of format 6, with the zone in its coordinate-system record."""
    wkt = f'PROJCS["WGS 84 / UTM zone {zone}"]'.encode() + b"\0" if zone else b""
    vlr = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(wkt), b"coordinate system") + wkt if zone else b""
    head = bytearray(375)
    head[:4], head[24:26] = b"LASF", bytes([1, 4])
    struct.pack_into("<H", head, 6, 16)
    struct.pack_into("<HII", head, 94, 375, 375 + len(vlr), int(bool(zone)))
    struct.pack_into("<BHI", head, 104, 6, RECORD.itemsize, 0)
    struct.pack_into("<6d", head, 131, *scale, *offset)
    bounds = [v * s + o for lo, hi, s, o in zip(low, high, scale, offset) for v in (hi, lo)] if count else [0.0] * 6
    struct.pack_into("<6d", head, 179, *bounds)
    struct.pack_into("<Q", head, 247, count)
    return bytes(head) + vlr


def records(xyz: np.ndarray, code: np.ndarray) -> bytes:
    rows = np.zeros(len(xyz), RECORD)
    rows["xyz"], rows["code"] = xyz, code
    return rows.tobytes()


def write_file(path: str, xyz: np.ndarray, code: np.ndarray, zone: str | None = None, scale: float = 0.001) -> None:
    """A file of these coordinates (a row a point) and class codes."""
    offset = np.floor(xyz.min(axis=0)) if len(xyz) else np.zeros(3)
    steps = np.round((xyz - offset) / scale)
    if not (np.abs(steps) < 2.0**31).all():
        raise ValueError(f"{path}: coordinates that are no numbers, or too far apart for steps of {scale}")
    system, inner = opened(path)
    with system.open_output_stream(inner) as f:
        f.write(header(len(xyz), (scale,) * 3, tuple(offset), *((steps.min(axis=0), steps.max(axis=0)) if len(xyz) else (offset, offset)), zone))
        f.write(records(steps, code))


def copy_file(source: str, target: str) -> None:
    """A file's coordinates, class codes and zone as LAS 1.4, range by range: once for the bounds, once to write."""
    head = Header(source)
    low, high = np.full(3, 2**31 - 1), np.full(3, -(2**31))
    for raw in chunks(source, head, 0, head.count):
        xyz, _ = fields(raw, head)
        low, high = np.minimum(low, xyz.min(axis=0)), np.maximum(high, xyz.max(axis=0))
    system, inner = opened(target)
    with system.open_output_stream(inner + ".tmp") as f:
        f.write(header(head.count, head.scale, head.offset, low, high, head.zone))
        for raw in chunks(source, head, 0, head.count):
            f.write(records(*fields(raw, head)))
    system.move(inner + ".tmp", inner)


class LasWriter(DataSourceArrowWriter):
    """Files of at most ``FILE`` points from each task; a null altitude or class is written as 0.

    Files have their names once all tasks are done; overwriting clears the folder's other .las files then.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.zone, self.overwrite = plain(options["path"]), options.get("zone"), overwrite
        self.job = uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task, written, held = TaskContext.get(), [], []
        system, inner = opened(self.path)

        def flush() -> None:
            if held:
                system.create_dir(inner, recursive=True)
                path = f"{self.path}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(written):04d}-{self.job}.las.tmp"
                xyz, code = (np.concatenate(part) for part in zip(*held))
                held.clear()
                write_file(path, xyz, code, self.zone)
                written.append(path)

        room = FILE
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, room)
                values = [pc.cast(part.column(c), pa.float64()) for c in ("easting", "northing", "altitude")]
                if values[0].null_count or values[1].null_count:
                    raise ValueError("a point without easting or northing can't be written")
                code = pc.cast(pc.fill_null(part.column("class_code"), 0), pa.int64()).to_numpy(zero_copy_only=False).astype(np.uint8)
                held.append((np.column_stack([pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False) for v in values]), code))
                at, room = at + len(part), room - len(part)
                if not room:
                    flush()
                    room = FILE
        flush()
        return Written(written)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = opened(self.path)
        if self.overwrite and system.get_file_info(inner).type == fs.FileType.Directory:
            for old in system.get_file_info(fs.FileSelector(inner)):
                if old.is_file and old.base_name.endswith(".las"):
                    system.delete_file(old.path)
        for path in (opened(p)[1] for m in messages if m for p in m.paths):
            system.move(path, path.removesuffix(".tmp"))
        self.clear()

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()

    def clear(self) -> None:
        """Deletes what this job's attempts have left, reported or not."""
        system, inner = opened(self.path)
        if system.get_file_info(inner).type == fs.FileType.Directory:
            for file in system.get_file_info(fs.FileSelector(inner)):
                if file.is_file and file.base_name.endswith(f"-{self.job}.las.tmp"):
                    system.delete_file(file.path)


class LasDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(dict(self.options))

    def streamReader(self, schema) -> LasStream:
        return LasStream(dict(self.options))

    def writer(self, schema, overwrite: bool) -> LasWriter:
        return LasWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LasDataSource)


def convert(spark: SparkSession, paths: list[str], target: str):
    """Copy point files into a folder as LAS; (src, dst, ok, error) for each, failures don't stop the rest."""
    files = spark.createDataFrame([(p,) for p in paths], "src string").repartition(max(1, len(paths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for src in batch.column(0).to_pylist():
                dst = f"{plain(target)}/{os.path.splitext(os.path.basename(src))[0]}.las"
                try:
                    system, inner = opened(target)
                    system.create_dir(inner, recursive=True)
                    copy_file(src, dst)
                    out.append((src, dst, True, None))
                except (OSError, ValueError, struct.error) as error:
                    out.append((src, None, False, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.string()))], ["src", "dst", "ok", "error"])

    return files.mapInArrow(run, "src string, dst string, ok boolean, error string")
