"""Manifests and snapshots of real files."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from prospectra.sources import manifests as M


@pytest.fixture
def folder(spark, tmp_path):
    path = tmp_path / "snap"
    spark.range(100).repartition(3).write.parquet(f"{path}/t")
    for f in path.rglob(".*"):
        f.unlink()
    files = sorted(p for p in path.rglob("*.parquet"))
    (path / "SHA256SUMS").write_text("".join(f"{hashlib.sha256(p.read_bytes()).hexdigest()}  {p.relative_to(path)}\n" for p in files))
    return path, files


def states(df):
    return {r["path"].rpartition("/")[2]: r["state"] for r in df.collect()}


def test_only_changed_files_are_read_again(spark, folder):
    path, files = folder
    none = spark.createDataFrame([], M.MANIFEST)
    first, s = M.updated(spark, none, M.listing(spark, str(path), "*.parquet"))
    assert set(states(s).values()) == {"new"} and len(states(s)) == 3
    rows = first.collect()
    assert {r["sha256"] for r in rows} == {hashlib.sha256(p.read_bytes()).hexdigest().upper() for p in files}
    marked = spark.createDataFrame([(r["path"], r["length"], r["modified"], "OLD" + r["sha256"][3:]) for r in rows], M.MANIFEST)
    files[0].write_bytes(files[0].read_bytes() + b"x")
    os.remove(files[1])
    second, s = M.updated(spark, marked, M.listing(spark, str(path), "*.parquet"))
    assert states(s) == {files[0].name: "changed", files[1].name: "gone", files[2].name: "kept"}
    got = {r["path"].rpartition("/")[2]: r["sha256"] for r in second.collect()}
    assert got[files[0].name] == hashlib.sha256(files[0].read_bytes()).hexdigest().upper()
    assert got[files[2].name].startswith("OLD") and files[1].name not in got


def test_a_snapshot_is_checked_before_it_is_restored(spark, folder, tmp_path):
    path, files = folder
    assert {r["state"] for r in M.verify_folder(spark, str(path)).collect()} == {"ok"}
    assert M.restore_snapshot(spark, str(path), f"{tmp_path}/out") == 3
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100
    with pytest.raises(Exception):  # it is there now
        M.restore_snapshot(spark, str(path), f"{tmp_path}/out")
    with open(path / "SHA256SUMS", "a") as f:
        f.write("00  ../other\n00  t/none.parquet\n")
    files[0].write_bytes(b"cut")
    assert {r["state"] for r in M.verify_folder(spark, str(path)).collect()} == {"ok", "unsafe", "missing", "mismatch"}
    with pytest.raises(ValueError):
        M.restore_snapshot(spark, str(path), f"{tmp_path}/more")
    assert not os.path.exists(f"{tmp_path}/more")


@pytest.mark.parametrize("path,bad", [("a/b", False), ("/a", True), ("../a", True), ("a/../b", False), ("a/../../b", True), ("./a//b", False), ("a/../..", True)])
def test_paths_that_leave_the_folder(spark, path, bad):
    assert spark.range(1).select(M.unsafe(F.lit(path))).first()[0] is bad
