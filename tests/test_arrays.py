"""The array source and sink: listed arrays only, tasks by row ranges, all files or none."""

import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from seedquorum.sources import arrays


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("arrays")
    r = np.random.default_rng(0)
    for i in range(2):
        x, y = r.random((1000, 5)), np.arange(1000) + 1000 * i
        np.savez(d / f"big{i}.npz", x=x, y=y, labels=np.array([f"l{k % 3}" for k in y]))
        np.savez_compressed(d / f"small{i}.npz", x=x.astype(np.float32), y=y)
    np.save(d / "one.npy", np.arange(12).reshape(4, 3))
    return str(d)


def test_row_ranges_are_tasks(spark, folder):
    got = arrays.scan_arrays(spark, f"{folder}/big*.npz", ["x", "y"], rows=300)
    assert got.columns == ["path", "row", "x", "y"] and got.rdd.getNumPartitions() == 8
    for i in range(2):
        want = np.load(f"{folder}/big{i}.npz")
        rows = sorted((r["row"], r["y"], r["x"]) for r in got.where(F.col("path").endswith(f"big{i}.npz")).collect())
        assert [r[1] for r in rows] == want["y"].tolist() and np.array_equal(np.array([r[2] for r in rows]), want["x"])
    few = got.where("row >= 250 AND row < 310")
    assert few.count() == 120 and few.rdd.getNumPartitions() == 2
    assert got.where("row = 5").count() == 2 and got.where("row > 5000").count() == 0


def test_compressed_and_single(spark, folder):
    got = arrays.scan_arrays(spark, f"{folder}/small*", ["x", "y"], rows=300)
    assert got.rdd.getNumPartitions() == 2 and dict(got.dtypes)["x"] == "array<float>"
    want = np.load(f"{folder}/small1.npz")
    rows = sorted((r["row"], r["y"], r["x"]) for r in got.where(F.col("path").contains("small1") & (F.col("row") >= 990)).collect())
    assert [r[1] for r in rows] == want["y"][990:].tolist() and np.array_equal(np.array([r[2] for r in rows], np.float32), want["x"][990:])
    one = arrays.scan_arrays(spark, f"{folder}/one.npy", [arrays.SINGLE]).orderBy("row").collect()
    assert [r[arrays.SINGLE] for r in one] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]


def test_unlisted_arrays_are_never_opened(spark, folder, tmp_path):
    """The labels' bytes are garbage from their header on: reading the others can't tell."""
    path = f"{tmp_path}/x.npz"
    with open(f"{folder}/big0.npz", "rb") as f:
        raw = bytearray(f.read())
    with zipfile.ZipFile(f"{folder}/big0.npz") as z:
        at = z.getinfo("labels.npy").header_offset
    raw[at + 30 : at + 400] = b"?" * 370
    with open(path, "wb") as f:
        f.write(raw)
    assert arrays.scan_arrays(spark, path, ["x", "y"]).agg(F.sum("y")).first()[0] == sum(range(1000))
    with pytest.raises(Exception):
        arrays.scan_arrays(spark, path, ["labels"]).collect()
    with pytest.raises(Exception, match="no array z"):
        arrays.scan_arrays(spark, f"{folder}/big0.npz", ["z"]).collect()


def test_round_trip(spark, folder, tmp_path):
    df = spark.range(0, 5000, 1, 3).select("id", (F.col("id") / 7).alias("v"), F.array(F.col("id") * 2, F.col("id") + 1).alias("pair"), F.concat(F.lit("né"), F.col("id").cast("string")).alias("name"))
    arrays.write_arrays(df, path := f"{tmp_path}/out", rows=700, compressed=True)
    assert len(os.listdir(path)) >= 8 and all(n.startswith("part-") for n in os.listdir(path))
    got = arrays.scan_arrays(spark, path, ["id", "v", "pair", "name"]).drop("path", "row")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="exists"):
        arrays.write_arrays(df, path)
    arrays.write_arrays(df.limit(3), path, mode="overwrite")
    assert arrays.scan_arrays(spark, path, ["id"]).count() == 3


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    bad = spark.range(0, 4000, 1, 4).select("id", F.when(F.col("id") == 3500, F.raise_error(F.lit("on purpose")).cast("long")).otherwise(F.col("id")).alias("v"))
    with pytest.raises(Exception, match="on purpose"):
        arrays.write_arrays(bad, path := f"{tmp_path}/out", rows=100)
    assert not os.path.exists(path) or os.listdir(path) == []
    with pytest.raises(Exception, match="null in v"):
        arrays.write_arrays(spark.range(5).select(F.when(F.col("id") > 2, F.col("id")).alias("v")), path)
    assert not os.path.exists(path) or os.listdir(path) == []
