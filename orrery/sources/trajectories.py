"""Binary trajectories: DCD and classic NetCDF, whose frames lie at places that the header gives.

`spark.read.format("trajectory")` (after register()) reads a file or a folder: (traj_id, frame, atom_id, x, y, z), traj_id being the file's
name without its ending. Headers are read while planning; a partition is a run of frames of one file, of about PARTITION bytes, and reads these
and nothing else. Options: stride takes every so many frames, renumbered from 0.

DCD: either byte order, with or without a unit cell; a file with fixed atoms, whose frames differ in size, is refused. NetCDF: versions 1, 2 and 5
of the classic format, with a variable `coordinates` of (frame, atom, spatial) in single or double precision. Other files are refused by name.
A file without frames has no rows. write() makes either format from such rows, a file for each trajectory; values are kept in single precision.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITION, BATCH = 32 << 20, 1 << 18
SCHEMA = "traj_id string, frame int, atom_id int, x float, y float, z float"


@dataclass(frozen=True)
class Layout:
    """Where frames lie: frame f's coordinates begin at start + f * step; planes: x, y and z each by themselves, `gap` bytes apart."""

    frames: int
    atoms: int
    start: int
    step: int
    kind: str
    planes: bool
    gap: int = 0

    @property
    def size(self) -> int:
        n = self.atoms * np.dtype(self.kind).itemsize
        return 3 * n + 2 * self.gap

    def coordinates(self, data: bytes) -> np.ndarray:
        """(atoms, 3) of one frame's bytes."""
        if not self.planes:
            return np.frombuffer(data, self.kind, 3 * self.atoms).reshape(-1, 3).astype(np.float32)
        n = self.atoms * np.dtype(self.kind).itemsize + self.gap
        return np.stack([np.frombuffer(data, self.kind, self.atoms, i * n) for i in range(3)], axis=1).astype(np.float32)


def _dcd(f, size: int) -> Layout:
    head = f.read(92)
    order = "<" if head[:4] == struct.pack("<i", 84) else ">"
    control = struct.unpack(order + "20i", head[8:88])
    if control[8]:
        raise ValueError("a DCD file with fixed atoms")
    if control[11]:
        raise ValueError("a DCD file in four dimensions")
    (title,) = struct.unpack(order + "i", f.read(4))
    f.seek(92 + 8 + title)
    _, atoms, _ = struct.unpack(order + "3i", f.read(12))
    at = 92 + 8 + title + 12
    cell = 56 if control[10] else 0
    step = cell + 3 * (8 + 4 * atoms)
    return Layout(max(0, size - at) // step, atoms, at + cell + 4, step, order + "f4", True, 8)


def _netcdf(f, size: int) -> Layout:
    version = f.read(4)[3]
    count, offset = ("q" if version == 5 else "i"), ("i" if version == 1 else "q")

    def number(kind: str = "i") -> int:
        return struct.unpack(">" + kind, f.read(struct.calcsize(">" + kind)))[0]

    def text() -> str:
        n = number(count)
        return f.read(n + -n % 4)[:n].decode()

    widths = {1: 1, 2: 1, 3: 2, 4: 4, 5: 4, 6: 8, 7: 1, 8: 2, 9: 4, 10: 8, 11: 8}

    def attributes() -> None:
        number()
        for _ in range(number(count)):
            text()
            width = widths[number()]
            n = width * number(count)
            f.read(n + -n % 4)

    number(count)  # the number of records may lag behind the file
    number()
    dims = [(text(), number(count)) for _ in range(number(count))]
    attributes()
    number()
    records, found = [], None
    for _ in range(number(count)):
        name, own = text(), [number(count) for _ in range(number(count))]
        attributes()
        kind, padded, begin = number(), number(count), number(offset)
        if own and dims[own[0]][1] == 0:
            exact = widths[kind] * int(np.prod([dims[i][1] for i in own[1:]], dtype=np.int64))
            records.append((exact, exact + -exact % 4))
        if name == "coordinates":
            found = (own, kind, begin)
    if found is None or len(found[0]) != 3 or dims[found[0][2]][1] != 3 or found[1] not in (5, 6):
        raise ValueError("a NetCDF file without coordinates by frame, atom and axis")
    own, kind, begin = found
    record = dims[own[0]][1] == 0
    atoms = dims[own[1]][1]
    width = 3 * atoms * widths[kind]
    step = (records[0][0] if len(records) == 1 else sum(p for _, p in records)) if record else width
    frames = max(0, size - begin - width + step) // step if record and step else dims[own[0]][1]
    return Layout(frames, atoms, begin, step, ">f4" if kind == 5 else ">f8", False)


def layout(f, size: int, name: str) -> Layout:
    """Of an open file, by its first bytes."""
    head = f.read(8)
    f.seek(0)
    if head[4:] == b"CORD" and head[:4] in (struct.pack("<i", 84), struct.pack(">i", 84)):
        return _dcd(f, size)
    if head[:3] == b"CDF" and head[3] in (1, 2, 5):
        return _netcdf(f, size)
    raise ValueError(f"{name} is neither DCD nor classic NetCDF")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


class Frames(InputPartition):
    def __init__(self, path: str, at: Layout, begin: int, end: int) -> None:
        super().__init__((path, begin, end))
        self.path, self.at, self.begin, self.end = path, at, begin, end


class Reader(DataSourceReader):
    def __init__(self, path: str, stride: int) -> None:
        self.path, self.stride = path, stride

    def partitions(self) -> list[InputPartition]:
        system, at = _open(self.path)
        info = system.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]
        out = []
        for x in sorted(files, key=lambda x: x.path):
            with system.open_input_file(x.path) as f:
                where = layout(f, x.size, x.path)
            n, width = -(-where.frames // self.stride), max(1, PARTITION // max(1, where.size))
            out += [Frames(x.path, where, i, min(n, i + width)) for i in range(0, n, width)]
        return out or [Frames("", Layout(0, 0, 0, 0, "<f4", False), 0, 0)]

    def read(self, p: Frames) -> Iterator[pa.RecordBatch]:
        if p.begin == p.end:
            return
        system, _ = _open(self.path)
        name = p.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        step = max(1, BATCH // max(1, p.at.atoms))
        with system.open_input_file(p.path) as f:
            for i in range(p.begin, p.end, step):
                frames, parts = range(i, min(p.end, i + step)), []
                for k in frames:
                    f.seek(p.at.start + k * self.stride * p.at.step)
                    parts.append(p.at.coordinates(f.read(p.at.size)))
                xyz, n = np.concatenate(parts), len(parts) * p.at.atoms
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(np.repeat(np.array(frames, np.int32), p.at.atoms)), pa.array(np.tile(np.arange(p.at.atoms, dtype=np.int32), len(parts))), *(pa.array(np.ascontiguousarray(xyz[:, a])) for a in range(3))],
                    names=["traj_id", "frame", "atom_id", "x", "y", "z"],
                )


class TrajectorySource(DataSource):
    """Options path and stride."""

    @classmethod
    def name(cls) -> str:
        return "trajectory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("stride", 1)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TrajectorySource)


def read(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    register(spark)
    return spark.read.format("trajectory").option("stride", stride).load(path)


def _dcd_head(frames: int, atoms: int) -> bytes:
    control = [frames, 0, 1, frames] + [0] * 16
    control[19] = 24
    title = b"CREATED AS COORDINATES".ljust(80)
    record = lambda x: struct.pack("<i", len(x)) + x + struct.pack("<i", len(x))
    return record(b"CORD" + struct.pack("<20i", *control)) + record(struct.pack("<i", 1) + title) + record(struct.pack("<i", atoms))


def _netcdf_head(frames: int, atoms: int) -> bytes:
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    text = lambda k, v: name(k) + struct.pack(">i", 2) + name(v)
    none = struct.pack(">2i", 0, 0)
    dims = struct.pack(">2i", 10, 3) + b"".join(name(k) + struct.pack(">i", n) for k, n in (("frame", 0), ("spatial", 3), ("atom", atoms)))
    head = b"CDF\2" + struct.pack(">i", frames) + dims + struct.pack(">2i", 12, 2) + text("Conventions", "AMBER") + text("ConventionVersion", "1.0") + struct.pack(">2i", 11, 1)
    variable = name("coordinates") + struct.pack(">4i", 3, 0, 2, 1) + none + struct.pack(">2i", 5, 12 * atoms)
    return head + variable + struct.pack(">q", len(head) + len(variable) + 8)


def write(coords: DataFrame, path: str, kind: str = "dcd") -> DataFrame:
    """A file path/traj_id.dcd or .nc for each trajectory; (file, frames). Frames and atoms count from 0, and every frame has every atom.

    A trajectory's rows come sorted to one task, which holds one frame. A repeated task writes the same file again, under a name of its own
    that takes the place of the file when it is whole."""
    head, ending = {"dcd": (_dcd_head, "dcd"), "netcdf": (_netcdf_head, "nc")}[kind]
    size = coords.groupBy("traj_id").agg((F.max("frame") + 1).alias("n_frames"), (F.max("atom_id") + 1).alias("n_atoms"))
    rows = coords.join(size, "traj_id").select(F.col("traj_id").cast("string").alias("traj_id"), F.col("frame").cast("long").alias("frame"), *(F.col(a).cast("float").alias(a) for a in "xyz"), "n_frames", "n_atoms", "atom_id")
    rows = rows.repartition("traj_id").sortWithinPartitions("traj_id", "frame", "atom_id").drop("atom_id")

    def frame(xyz: np.ndarray) -> bytes:
        if kind == "netcdf":
            return xyz.astype(">f4").tobytes()
        mark = struct.pack("<i", 4 * len(xyz))
        return b"".join(mark + np.ascontiguousarray(xyz[:, a]).astype("<f4").tobytes() + mark for a in range(3))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        system, at = _open(path)
        system.create_dir(at, recursive=True)
        now, f, done, rest, names, counts = None, None, 0, np.zeros((0, 3), np.float32), [], []

        def close() -> None:
            if f is not None:
                f.close()
                if len(rest) or done != n_frames:
                    raise ValueError(f"{now}: not every frame has every atom")
                system.move(f"{at}/.{now}-{mine}", f"{at}/{now}.{ending}")
                names.append(f"{at}/{now}.{ending}")
                counts.append(done)

        for b in batches:
            ids = b.column("traj_id").to_numpy(zero_copy_only=False)
            xyz = np.stack([b.column(a).to_numpy() for a in "xyz"], axis=1)
            cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])).tolist() if len(ids) else []
            for i, j in zip(cuts, [*cuts[1:], len(ids)]):
                if ids[i] != now:
                    close()
                    now, mine, done, rest = ids[i], uuid.uuid4().hex, 0, np.zeros((0, 3), np.float32)
                    n_frames, n_atoms = b.column("n_frames")[i].as_py(), b.column("n_atoms")[i].as_py()
                    f = system.open_output_stream(f"{at}/.{now}-{mine}")
                    f.write(head(n_frames, n_atoms))
                rest = np.concatenate([rest, xyz[i:j]])
                while len(rest) >= n_atoms:
                    f.write(frame(rest[:n_atoms]))
                    rest, done = rest[n_atoms:], done + 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["file", "frames"])

    return coords.sparkSession.createDataFrame(rows.mapInArrow(written, "file string, frames long").collect(), "file string, frames long")
