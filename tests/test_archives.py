"""The archive source against NumPy: members, headers, scalars, layouts, temporary files, missing and unfit members."""

import numpy as np
import pytest

from tessella.sources import archives


@pytest.fixture
def folder(tmp_path):
    grid = np.arange(12.0).reshape(4, 3)
    np.savez(tmp_path / "a.npz", x=np.array([[1.0, np.nan], [np.inf, 4.0]]), n=np.arange(3), one=np.float32(2.5), text=np.array("hello"), by_column=np.asfortranarray(grid), none=np.empty((0, 2)))
    np.savez_compressed(tmp_path / "b.npz", x=np.array([[7.0, 8.0]]), cube=np.arange(8).reshape(2, 2, 2))
    np.savez(tmp_path / "c.tmp.npz", x=np.zeros((9, 2)))
    return str(tmp_path)


def test_named_members(spark, folder):
    got = {(r["path"][-5:], r["row"]): r["value"] for r in archives.scan(spark, folder, ["x"]).collect()}
    assert got == {("a.npz", 0): [1.0, None], ("a.npz", 1): [None, 4.0], ("b.npz", 0): [7.0, 8.0]}


def test_a_partition_per_file_and_member(spark, folder):
    assert archives.scan(spark, f"{folder}/a.npz", ["x", "n", "one"]).rdd.getNumPartitions() == 3


def test_layouts_scalars_and_empty_arrays(spark, folder):
    rows = archives.scan(spark, f"{folder}/a.npz", ["by_column", "one", "none", "n"]).collect()
    at = lambda n: [r["value"] for r in sorted((r for r in rows if r["name"] == n), key=lambda r: r["row"])]
    assert at("by_column") == np.arange(12.0).reshape(4, 3).tolist() and at("one") == [[2.5]] and at("none") == [] and at("n") == [[0.0], [1.0], [2.0]]
    assert sorted(r["value"] for r in archives.scan(spark, f"{folder}/b.npz", ["cube"]).collect()) == [[0.0, 1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0]]


def test_a_long_member_is_streamed(spark, tmp_path, monkeypatch):
    want = np.random.default_rng(0).normal(size=(5000, 3))
    np.savez_compressed(tmp_path / "l.npz", x=want)
    monkeypatch.setattr(archives, "CHUNK", 1000)
    reader = archives._Reader({"path": str(tmp_path), "arrays": "x"})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert max(b.num_rows for b in batches) <= 1000 // 24 + 1
    assert np.array_equal(np.array([v for b in batches for v in b.column(3).to_pylist()]), want)


def test_headers_read_no_array(spark, folder):
    got = {(r["path"][-5:], r["name"]): (r["dtype"], r["shape"], r["scalar"]) for r in archives.headers(spark, folder).collect()}
    assert got["a.npz", "x"] == ("<f8", [2, 2], None) and got["b.npz", "cube"] == ("<i8", [2, 2, 2], None)
    assert got["a.npz", "one"] == ("<f4", [], "2.5") and got["a.npz", "text"][1:] == ([], "hello") and len(got) == 8


def test_missing_and_unfit_members_are_errors(spark, folder, tmp_path):
    with pytest.raises(Exception, match="cube"):
        archives.scan(spark, folder, ["cube"]).collect()
    with pytest.raises(Exception, match="not numbers"):
        archives.scan(spark, f"{folder}/a.npz", ["text"]).collect()
    (tmp_path / "empty").mkdir()
    assert archives.scan(spark, str(tmp_path / "empty"), ["x"]).count() == 0


def test_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, [1.0, 2.0]), (2, None, [3.0, 4.0]), (3, 1.5, [5.0, 6.0])], "id long, x double, v array<double>").coalesce(1)
    path = f"{tmp_path}/out"
    assert archives.write(rows, path, {"kind": "test"}, block=2) == 2
    back = archives.scan(spark, path, ["id", "x", "v"]).collect()
    parts = {}
    for r in back:
        parts.setdefault((r["path"], r["row"]), {})[r["name"]] = r["value"]
    assert sorted((p["id"][0], p["x"][0], p["v"]) for p in parts.values() if p["x"][0]) == [(1.0, 0.5, [1.0, 2.0]), (3.0, 1.5, [5.0, 6.0])]
    assert len(parts) == 3 and {r["scalar"] for r in archives.headers(spark, path, ["kind"]).collect()} == {"test"}
