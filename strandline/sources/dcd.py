"""Binary trajectories as a Spark data source: one row a frame, blocks of frames as partitions."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


class Layout:
    """What the headers of a file say: frames, atoms, byte order, bytes of a frame and where the first starts."""

    def __init__(self, head: bytes):
        self.order = "<" if struct.unpack_from("<i", head, 0)[0] == 84 else ">"
        if struct.unpack_from(self.order + "i", head, 0)[0] != 84 or head[4:8] != b"CORD":
            raise ValueError("not a trajectory file")
        self.frames = struct.unpack_from(self.order + "i", head, 8)[0]
        self.cell = struct.unpack_from(self.order + "i", head, 48)[0] != 0
        titles = struct.unpack_from(self.order + "i", head, 92)[0]
        at = 92 + 4 + titles + 4
        self.atoms = struct.unpack_from(self.order + "i", head, at + 4)[0]
        self.start = at + 12
        self.frame_bytes = (56 if self.cell else 0) + 3 * (4 * self.atoms + 8)

    def frame(self, raw: bytes) -> np.ndarray:
        at = 56 if self.cell else 0
        axes = [np.frombuffer(raw, self.order + "f4", self.atoms, at + 4 + k * (4 * self.atoms + 8)) for k in range(3)]
        return np.stack(axes, axis=1).astype("f4").ravel()


def header(n: int, atoms: int) -> bytes:
    """The headers of a file of so many frames and atoms."""
    control = [0] * 20
    control[0], control[1], control[2], control[19] = n, 1, 1, 24
    return struct.pack("<i4s20ii", 84, b"CORD", *control, 84) + struct.pack("<ii80si", 84, 1, b"frames".ljust(80), 84) + struct.pack("<iii", 4, atoms, 4)


def body(frame: np.ndarray) -> bytes:
    """The records of a frame ``atoms x 3``."""
    size = struct.pack("<i", 4 * len(frame))
    return b"".join(size + frame[:, k].astype("<f4").tobytes() + size for k in range(3))


def encode(frames: np.ndarray) -> bytes:
    """A file of ``frames x atoms x 3`` coordinates, for tests and exports."""
    return header(len(frames), frames.shape[1]) + b"".join(map(body, frames))


def store(path: str) -> tuple[FileSystem, str]:
    """The file system of a path and the path in it: a local one, or any scheme that the Arrow library reads."""
    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def ranged(path: str, start: int, size: int) -> bytes:
    """So many bytes of a file from a place on."""
    files, name = store(path)
    with files.open_input_file(name) as f:
        return f.read_at(size, start)


class Block(InputPartition):
    def __init__(self, path: str, layout: Layout, first: int, count: int):
        self.path, self.layout, self.first, self.count = path, layout, first, count


class TrajectoryReader(DataSourceReader):
    """Blocks of frames as partitions; each reads its own bytes. Frames that aren't asked for are in no block."""

    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.block = int(options["framesperpartition"])
        self.first, self.last = int(options["first"]), int(options["last"])

    def partitions(self) -> list[Block]:
        out = []
        for p in self.paths:
            layout = Layout(ranged(p, 0, 4096))
            last = min(layout.frames, self.last)
            out += [Block(p, layout, a, min(self.block, last - a)) for a in range(self.first - 1, last, self.block)]
        return out or [Block("", None, 0, 0)]

    def read(self, part: Block) -> Iterator[tuple]:
        if part.count:
            layout, size = part.layout, part.layout.frame_bytes
            raw = memoryview(ranged(part.path, layout.start + part.first * size, part.count * size))
            for k in range(part.count):
                yield part.path, part.first + k + 1, layout.frame(raw[k * size : (k + 1) * size]).tolist()


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they are and what they are to be called."""

    files: list[tuple[str, str]]


class TrajectoryWriter(DataSourceWriter):
    """Files under names of their own until the job commits, when they get theirs; a job that fails leaves none."""

    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.waiting = f"{self.folder}/_waiting-{options['job']}"

    def write(self, rows: Iterator) -> Written:
        """Rows ``(file, n_frames, frame, xyz)`` by file and frame; a frame at a time is in memory."""
        files, folder = store(self.waiting)
        files.create_dir(folder, recursive=True)
        done: list[tuple[str, str]] = []
        out, seen, expected = None, 0, 0

        def close() -> None:
            if out is not None:
                out.close()
                if seen != expected:
                    raise ValueError(f"{done[-1][1]} has {seen} frames of {expected}")

        for row in rows:
            if not done or done[-1][1] != row["file"]:
                close()
                name = f"{uuid.uuid4().hex}.part"
                out, seen, expected = files.open_output_stream(f"{folder}/{name}"), 0, row["n_frames"]
                done.append((name, row["file"]))
                out.write(header(expected, len(row["xyz"]) // 3))
            out.write(body(np.asarray(row["xyz"], "<f4").reshape(-1, 3)))
            seen += 1
        close()
        return Written(done)

    def commit(self, messages: list) -> None:
        files, folder = store(self.folder)
        waiting = store(self.waiting)[1]
        for m in messages:
            for name, final in m.files if m else []:
                files.move(f"{waiting}/{name}", f"{folder}/{final}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        files, folder = store(self.waiting)
        if files.get_file_info(folder).type == FileType.Directory:
            files.delete_dir(folder)


class TrajectorySource(DataSource):
    """``(file, frame, xyz)`` of files in any store that the Arrow library reads, and files written from such rows."""

    @classmethod
    def name(cls) -> str:
        return "trajectory"

    def schema(self) -> str:
        return "file string, frame int, xyz array<float>"

    def reader(self, schema) -> TrajectoryReader:
        return TrajectoryReader(self.options)

    def writer(self, schema, overwrite: bool) -> TrajectoryWriter:
        return TrajectoryWriter(self.options)


def read(spark: SparkSession, paths: list[str], frames_per_partition: int = 64, first: int = 1, last: int | None = None) -> DataFrame:
    """Frames ``first`` to ``last`` of files, by ranges: other blocks are never read.

    The range is an argument and no filter taken over from the query: Spark keeps a Python source's filters with its
    table, so of two queries on one frame with different filters the second would have those of the first.
    """
    spark.dataSource.register(TrajectorySource)
    options = {"paths": json.dumps(paths), "framesPerPartition": frames_per_partition, "first": max(first, 1), "last": last if last is not None else 1 << 62}
    return spark.read.format("trajectory").options(**options).load()


def write(frames: DataFrame, folder: str) -> None:
    """A file ``folder/<file>`` for each file of rows ``(file, frame, xyz)``, its frames in order; files of the same name are replaced.

    A file is streamed by one task, a frame at a time. Files appear when all are whole: tasks write beside
    them, and a job that fails leaves what was there.
    """
    frames.sparkSession.dataSource.register(TrajectorySource)
    sizes = frames.groupBy("file").agg(F.count("*").alias("n_frames"))
    rows = frames.select("file", "frame", F.col("xyz").cast("array<float>").alias("xyz")).join(sizes, "file").select("file", "n_frames", "frame", "xyz")
    rows.repartition("file").sortWithinPartitions("file", "frame").write.format("trajectory").option("path", folder).option("job", uuid.uuid4().hex).mode("append").save()


def read_anywhere(spark: SparkSession, path: str, pattern: str = "*.dcd") -> DataFrame:
    """The same from any store that Spark reads: a file is one task's, its frames are rows of batches."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames):
        import pandas as pd

        for f in frames:
            for path_, raw in zip(f["path"], f["content"], strict=True):
                layout = Layout(raw[:4096])
                for a in range(0, layout.frames, 64):
                    n = range(a, min(a + 64, layout.frames))
                    at = [layout.start + k * layout.frame_bytes for k in n]
                    yield pd.DataFrame({"file": path_, "frame": [k + 1 for k in n], "xyz": [layout.frame(raw[x : x + layout.frame_bytes]) for x in at]})

    return files.mapInPandas(run, "file string, frame int, xyz array<float>")
