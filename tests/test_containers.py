"""The data source of frame containers: whole folders, bounds, odd files; folders without a scheme."""

import os

import numpy as np
import pytest

from tracelab.session import with_scheme
from tracelab.sources import containers


@pytest.fixture
def folder(tmp_path):
    rng, images = np.random.default_rng(3), []
    for k, n in enumerate([5, 0, 3, 11]):
        own = rng.integers(0, 256, (n, 6)).astype(">u1")
        tail = b"xy" if k == 2 else b""  # less than an image
        path = tmp_path / f"run-{k}.glimpse"
        path.write_bytes(own.tobytes() + tail)
        os.utime(path, (1000 - k, 1000 - k))
        images.append(own)
    (tmp_path / "header.txt").write_text("frames\t19")
    return str(tmp_path), images


@pytest.mark.parametrize("order", ["name", "time"])
@pytest.mark.parametrize("stretch", [1, 20, 1 << 20])
def test_every_image_once(folder, order, stretch, monkeypatch):
    monkeypatch.setattr(containers, "STRETCH_BYTES", stretch)
    monkeypatch.setattr(containers, "BATCH_BYTES", 13)
    path, images = folder
    reader = containers.ContainerReader({"path": path, "height": "2", "width": "3", "order": order})
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    want = np.concatenate(images if order == "name" else images[::-1])
    assert [r["frame_id"] for r in got] == list(range(19))
    assert (np.array([r["pixels"] for r in got]) == want).all()
    assert max(p.n for p in reader.partitions()) <= max(1, stretch // 6)


def test_bounds_leave_out_stretches(folder, spark):
    path, images = folder
    for first, last in [(4, 8), (7, 7), (18, 100), (0, 4), (20, 30), (5, 4)]:
        got = containers.read_containers(spark, path, 2, 3, order="name", first=str(first), last=str(last)).orderBy("frame_id").collect()
        assert [r["frame_id"] for r in got] == list(range(first, min(last, 18) + 1))
        assert all((np.array(r["pixels"]) == np.concatenate(images)[r["frame_id"]]).all() for r in got)
    reader = containers.ContainerReader({"path": path, "height": "2", "width": "3", "order": "name", "first": "4", "last": "6"})
    assert [(p.first, p.n) for p in reader.partitions()] == [(4, 1), (5, 2)]
    all_ = containers.read_containers(spark, f"file://{path}", 2, 3)
    assert (all_.filter("frame_id = 7").count(), all_.filter("frame_id in (3, 12)").count(), all_.count()) == (1, 2, 19)


def test_odd_folders(tmp_path, spark):
    assert containers.read_containers(spark, str(tmp_path), 2, 3).count() == 0
    (tmp_path / "short.glimpse").write_bytes(b"12345")
    assert containers.read_containers(spark, str(tmp_path), 2, 3).count() == 0
    with pytest.raises(ValueError):
        containers.ContainerReader({"path": str(tmp_path), "height": "0", "width": "3"})


def test_folders_follow_the_default_file_system(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    default = conf.get("fs.defaultFS")
    assert with_scheme(spark, "/shared/x") == "/shared/x"
    try:
        conf.set("fs.viewfs.mounttable.table.link./shared", f"file://{tmp_path}")
        conf.set("fs.defaultFS", "viewfs://table/")
        assert with_scheme(spark, "/shared/x") == "viewfs://table/shared/x"
        assert with_scheme(spark, f"file://{tmp_path}") == f"file://{tmp_path}"
    finally:
        conf.set("fs.defaultFS", default)
