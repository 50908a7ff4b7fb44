"""Trajectories by ranges: round trips, blocks that conditions leave out, writers that commit or leave nothing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.sources import dcd


def frames(spark, files):
    return spark.createDataFrame([(name, k + 1, [float(v) for v in f.ravel()]) for name, x in files.items() for k, f in enumerate(x)], "file string, frame int, xyz array<double>").repartition(5)


def test_round_trip(spark, tmp_path):
    r = np.random.default_rng(1)
    files = {f"{n}.dcd": r.normal(0, 9, (n, 4, 3)).astype("f4") for n in (1, 7, 20)}
    dcd.write(frames(spark, files), str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == sorted(files)
    for name, x in files.items():
        assert (tmp_path / name).read_bytes() == dcd.encode(x)
    for paths in ([str(tmp_path / n) for n in files], [f"file://{tmp_path}/{n}" for n in files]):
        got = {(x.file.rsplit("/", 1)[1], x.frame): x.xyz for x in dcd.read(spark, paths, 3).collect()}
        assert got == {(n, k + 1): [float(v) for v in f.ravel()] for n, x in files.items() for k, f in enumerate(x)}
    dcd.write(frames(spark, {"7.dcd": files["1.dcd"]}), str(tmp_path))
    assert (tmp_path / "7.dcd").read_bytes() == dcd.encode(files["1.dcd"]) and len(os.listdir(tmp_path)) == 3


def test_a_job_that_fails_leaves_what_was_there(spark, tmp_path):
    x = np.ones((6, 2, 3), "f4")
    dcd.write(frames(spark, {"a.dcd": x}), str(tmp_path))
    bad = frames(spark, {"a.dcd": x * 2, "b.dcd": x}).withColumn("xyz", F.when((F.col("file") == "b.dcd") & (F.col("frame") == 4), F.raise_error("lost").cast("array<double>")).otherwise(F.col("xyz")))
    with pytest.raises(Exception, match="lost"):
        dcd.write(bad, str(tmp_path))
    assert os.listdir(tmp_path) == ["a.dcd"] and (tmp_path / "a.dcd").read_bytes() == dcd.encode(x)


def test_ranges_choose_blocks(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.dcd").write_bytes(dcd.encode(np.arange(60 * 6, dtype="f4").reshape(60, 2, 3)))
    paths = [str(tmp_path / f"{n}.dcd") for n in ("a", "b")]
    for first, last, parts in ((1, None, 12), (26, 42, 4), (31, 31, 2), (61, None, 1), (0, 3, 2), (55, 99, 2)):
        some = dcd.read(spark, paths, 10, first, last)
        want = [(p, k, 6.0 * (k - 1)) for p in paths for k in range(max(first, 1), min(last or 60, 60) + 1)]
        assert sorted((x.file, x.frame, x.xyz[0]) for x in some.collect()) == want and some.rdd.getNumPartitions() == parts


def test_one_frame_with_two_filters(spark, tmp_path):
    (tmp_path / "a.dcd").write_bytes(dcd.encode(np.zeros((9, 1, 3), "f4")))
    df = dcd.read(spark, [str(tmp_path / "a.dcd")], 4)
    assert (df.where("frame < 3").count(), df.where("frame > 3").count(), df.count()) == (2, 6, 9)
