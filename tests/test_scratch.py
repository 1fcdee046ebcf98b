"""Tables in the shared folder are deleted when nothing reads them."""

import os

from prospectra.operators import graph, scratch


def test_components_leave_one_table(spark):
    scratch.clear(spark)
    root = scratch.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    edges = spark.createDataFrame([(1, 2), (2, 3), (8, 9), (9, 10), (10, 3), (20, 21)], "a long, b long")
    got = graph.components(edges)
    assert {r["root"] for r in got.collect()} == {1, 20}
    assert len(set(os.listdir(root)) - before) == 1
    kept = scratch.written(edges, "kept")
    scratch.clear(spark, kept)
    assert kept.count() == 6
    scratch.clear(spark)
    assert set(os.listdir(root)) == before


def test_written_leaves_no_setting(spark):
    before = spark.conf.get(scratch.CLEANUP)
    made = scratch.written(spark.range(100).groupBy("id").count(), "t")
    assert made.count() == 100 and spark.conf.get(scratch.CLEANUP) == before
    scratch.forget(made)
