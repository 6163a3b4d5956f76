"""Dense recordings (one tensor a file, HDF5) as a Spark data source: spark.read.format("pose_hdf5").

A partition is a range of frames of one file, read as a slice, so neither a file nor a session has to fit in a task.
Files are opened through the store's file system, so any path that the executors' Arrow file systems know will do. Where
the files are, and how long, is asked of their headers, once, on the driver's side.

Options: path (a file or a folder, which is searched to its bottom), frames_per_task, threads (that ask headers), and
table: `pose` (the points, default), `names` (of nodes and animals) or `edges` (of the skeleton).
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "pose_hdf5"
SCHEMAS = {
    "pose": "session string, sidx int, vframe int, track int, node int, x double, y double",
    "names": "session string, kind string, number int, name string",
    "edges": "session string, number int, a int, b int",
}
REQUIRED = ("tracks", "node_names", "track_names")
FRAMES_PER_TASK = 20_000
#: Points that a batch holds, about.
BATCH_POINTS = 1 << 16
SUFFIXES = (".h5", ".hdf5")


def decoded(name) -> str:
    """Names are bytes or text; bytes that aren't UTF-8 are replaced."""
    return bytes(name).decode("utf-8", "replace") if isinstance(name, (bytes, bytearray)) else str(name)


def session_of(uri: str) -> str:
    return uri.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def frames_last(shape: tuple[int, ...], n_nodes: int, n_tracks: int) -> bool:
    """Whether a tensor is (animal, axis, node, frame) and not (frame, axis, node, animal); an error if neither fits."""
    if len(shape) != 4 or shape[1] != 2:
        raise ValueError(f"tracks of shape {shape}: (frame, 2, node, animal) or (animal, 2, node, frame) is expected")
    turned = shape[0] == n_tracks and shape[2] == n_nodes
    if shape[2] != n_nodes or not (turned or shape[3] == n_tracks):
        raise ValueError(f"tracks of shape {shape} don't fit {n_nodes} nodes and {n_tracks} animals")
    return turned


@dataclass
class FrameRange(InputPartition):
    uri: str
    start: int
    stop: int

    def __post_init__(self):
        super().__init__(None)


def _files(path: str):
    """(file system, path in it) of each recording at or below a path, in order."""
    from pyarrow.fs import FileSelector, FileSystem, FileType

    fs, inner = FileSystem.from_uri(path)
    info = fs.get_file_info(inner)
    if info.type == FileType.NotFound:
        raise ValueError(f"nothing at {path}")
    if info.type == FileType.File:
        return [(fs, inner)]
    found = fs.get_file_info(FileSelector(inner, recursive=True))
    return [(fs, f.path) for f in sorted(found, key=lambda f: f.path) if f.type == FileType.File and f.path.lower().endswith(SUFFIXES)]


class _Open:
    """The recording at a path, with its layout known."""

    def __init__(self, fs, path: str):
        import h5py

        self.raw = fs.open_input_file(path)
        self.file = h5py.File(self.raw, "r")
        if missing := [k for k in REQUIRED if k not in self.file]:
            raise ValueError(f"{path} lacks {', '.join(missing)}")
        self.tracks = self.file["tracks"]
        self.nodes, self.animals = ([decoded(n) for n in self.file[k][:]] for k in ("node_names", "track_names"))
        self.turned = frames_last(tuple(self.tracks.shape), len(self.nodes), len(self.animals))
        self.frames = int(self.tracks.shape[3 if self.turned else 0])
        if "frame_idx" in self.file and self.file["frame_idx"].shape[0] != self.frames:
            raise ValueError(f"{path}: {self.file['frame_idx'].shape[0]} frame numbers for {self.frames} frames")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()
        self.raw.close()

    def block(self, a: int, b: int):
        """(frame, axis, node, animal) of the frames from a to b, and their video frames."""
        import numpy as np

        x = self.tracks[:, :, :, a:b].transpose(3, 1, 2, 0) if self.turned else self.tracks[a:b]
        return np.asarray(x, float), np.asarray(self.file["frame_idx"][a:b] if "frame_idx" in self.file else np.arange(a, b))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"], options.get("table", "pose")
        self.step, self.threads = int(options.get("frames_per_task", FRAMES_PER_TASK)), int(options.get("threads", 16))
        if self.table not in SCHEMAS:
            raise ValueError(f"table is one of {', '.join(SCHEMAS)}, not {self.table}")

    def partitions(self):
        def ranges(place):
            fs, path = place
            if self.table != "pose":
                return [FrameRange(path, 0, 0)]
            with _Open(fs, path) as f:
                return [FrameRange(path, a, min(a + self.step, f.frames)) for a in range(0, max(f.frames, 1), self.step)]

        with ThreadPoolExecutor(self.threads) as pool:
            return [r for each in pool.map(ranges, _files(self.path)) for r in each]

    def read(self, partition: FrameRange) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(self.path)
        session = session_of(partition.uri)
        with _Open(fs, partition.uri) as f:
            if self.table == "names":
                yield from ((session, kind, i, name) for kind, names in (("node", f.nodes), ("track", f.animals)) for i, name in enumerate(names))
                return
            if self.table == "edges":
                edges = f.file["edge_inds"][:] if "edge_inds" in f.file else ()
                yield from ((session, i, int(a), int(b)) for i, (a, b) in enumerate(edges))
                return
            n, m = len(f.nodes), len(f.animals)
            step = max(1, BATCH_POINTS // max(1, n * m))
            for a in range(partition.start, partition.stop, step):
                b = min(a + step, partition.stop)
                x, vframe = f.block(a, b)
                frame, track, node = (k.ravel().astype("int32") for k in np.meshgrid(np.arange(b - a), np.arange(m), np.arange(n), indexing="ij"))
                xy = [pa.array(x[frame, k, node, track], pa.float64(), from_pandas=True) for k in (0, 1)]  # NaN is null
                columns = [pa.array([session] * len(frame)), pa.array(frame + np.int32(a)), pa.array(vframe[frame].astype("int32")), pa.array(track), pa.array(node), *xy]
                yield pa.RecordBatch.from_arrays(columns, ["session", "sidx", "vframe", "track", "node", "x", "y"])


class PoseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "pose")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str, table: str = "pose", frames_per_task: int = FRAMES_PER_TASK) -> DataFrame:
    """A table of all recordings at or below a path; the file's stem is the session."""
    spark.dataSource.register(PoseSource)
    return spark.read.format(FORMAT).option("table", table).option("frames_per_task", frames_per_task).load(path)


def animals(spark: SparkSession, path: str) -> DataFrame:
    """session, track, name: what the recordings call their animals."""
    return read(spark, path, "names").where("kind = 'track'").selectExpr("session", "number as track", "name")
