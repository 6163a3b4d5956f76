"""The data source for dense recordings. Where h5py is absent, a stand-in with the part of its interface that is used reads
NumPy archives instead: ranges, layouts, names and errors are tested either way, HDF5's own bytes only with h5py."""

import importlib.util
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from herdlens.sources import hdf5 as H

REAL = importlib.util.find_spec("h5py") is not None
STAND_IN = '''
import io
import numpy as np


class File(dict):
    def __init__(self, raw, mode):
        with np.load(io.BytesIO(raw.read())) as z:
            super().__init__({k: z[k] for k in z.files})

    def close(self):
        pass
'''


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    if not REAL:
        module = tmp_path_factory.mktemp("standin") / "h5py.py"
        module.write_text(STAND_IN)
        spark.sparkContext.addPyFile(str(module))


def write(path, **parts):
    path.parent.mkdir(parents=True, exist_ok=True)
    if REAL:
        import h5py

        with h5py.File(path, "w") as f:
            for k, v in parts.items():
                f[k] = v
    else:
        raw = io.BytesIO()
        np.savez(raw, **parts)
        path.write_bytes(raw.getvalue())


def tensor(frames, nodes, animals, seed=1):
    """(frame, axis, node, animal), with gaps."""
    x = np.random.default_rng(seed).normal(size=(frames, 2, nodes, animals)).round(3)
    x[1, :, nodes - 1, 0] = np.nan
    return x


NAMES = {"node_names": np.array([b"nose", b"body", b"tail\xff"]), "track_names": np.array([b"white", b"black"])}


def rows_of(x, session, frame_idx=None):
    fine = lambda v: None if np.isnan(v) else float(v)
    return sorted((session, f, f if frame_idx is None else int(frame_idx[f]), t, n, fine(x[f, 0, n, t]), fine(x[f, 1, n, t])) for f in range(x.shape[0]) for t in range(x.shape[3]) for n in range(x.shape[2]))


def plain(df):
    return sorted(map(tuple, df.collect()))


def test_ranges_of_frames_of_several_files(spark, source, tmp_path):
    a, b = tensor(25, 3, 2), tensor(7, 3, 2, 2)
    idx = np.arange(25) * 5
    write(tmp_path / "in" / "one.h5", tracks=a, frame_idx=idx, **NAMES)
    write(tmp_path / "in" / "deep" / "two.h5", tracks=b.transpose(3, 1, 2, 0), edge_inds=np.array([[0, 1], [1, 2]]), **NAMES)
    (tmp_path / "in" / "notes.txt").write_text("nothing")
    df = H.read(spark, f"file://{tmp_path}/in", frames_per_task=10)
    got = {(r.session, r.sidx, r.track, r.node): (r.vframe, r.x, r.y) for r in df.collect()}
    want = {(r[0], r[1], r[3], r[4]): (r[2], r[5], r[6]) for r in rows_of(a, "one", idx) + rows_of(b, "two")}
    assert got == want
    parts = df.groupBy(F.spark_partition_id().alias("part")).agg(F.min("session").alias("lo"), F.max("session").alias("hi"), F.countDistinct("sidx").alias("frames")).collect()
    assert sorted((r.lo, r.hi, r.frames) for r in parts) == [("one", "one", 5), ("one", "one", 10), ("one", "one", 10), ("two", "two", 7)]
    assert H.animals(spark, f"file://{tmp_path}/in").where("session = 'two'").orderBy("track").collect() == [("two", 0, "white"), ("two", 1, "black")]
    names = H.read(spark, f"file://{tmp_path}/in", "names").where("session = 'one' and kind = 'node'").orderBy("number").collect()
    assert [r.name for r in names] == ["nose", "body", "tail�"]
    assert plain(H.read(spark, f"file://{tmp_path}/in", "edges")) == [("two", 0, 0, 1), ("two", 1, 1, 2)]


def test_small_batches_and_one_file(spark, source, tmp_path, monkeypatch):
    x = tensor(11, 3, 2)
    write(tmp_path / "s.h5", tracks=x, **NAMES)
    monkeypatch.setattr(H, "BATCH_POINTS", 12)
    reader = H._Reader({"path": f"file://{tmp_path}/s.h5"})
    if not REAL:
        import sys
        import types

        module = types.ModuleType("h5py")
        exec(STAND_IN, module.__dict__)
        monkeypatch.setitem(sys.modules, "h5py", module)
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert len(batches) == 6 and sum(b.num_rows for b in batches) == 66
    assert [v for b in batches for v in b.column("x").to_pylist()] == [r[5] for r in rows_of(x, "s")]


def test_what_does_not_fit_is_an_error(spark, source, tmp_path):
    x = tensor(5, 3, 2)
    bad = {
        "lacks track_names": {"tracks": x, "node_names": NAMES["node_names"]},
        "don't fit": {"tracks": x[:, :, :2], **NAMES},
        "is expected": {"tracks": x[:, 0], **NAMES},
        "frame numbers": {"tracks": x, "frame_idx": np.arange(4), **NAMES},
    }
    for k, (said, parts) in enumerate(bad.items()):
        write(tmp_path / f"b{k}.h5", **parts)
        with pytest.raises(Exception, match=said):
            H.read(spark, f"file://{tmp_path}/b{k}.h5").count()
    with pytest.raises(Exception, match="nothing at"):
        H.read(spark, f"file://{tmp_path}/none").count()
    write(tmp_path / "empty.h5", tracks=x[:0], **NAMES)
    assert H.read(spark, f"file://{tmp_path}/empty.h5").count() == 0
    # as many animals as frames: the layout that the names fit as (animal, axis, node, frame) is taken
    assert H.frames_last((2, 2, 3, 2), 3, 2) and not H.frames_last((5, 2, 3, 2), 3, 2) and H.frames_last((2, 2, 3, 9), 3, 2)
