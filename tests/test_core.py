"""The library without the training-data operators: named queries against DuckDB, streams, files, the matcher."""

import math
import random

import pytest
from pyspark.sql import functions as F

from prospectra.functions import markup
from prospectra.functions import text as X
from prospectra.operators import graph, merge
from prospectra.plans import catalogue
from prospectra.sources import tables
from prospectra.streaming import events

#: Run in test_dedup, where one run of the library serves all.
ELSEWHERE = {n for n in catalogue.oracle_sql() if n.startswith("repointed_") and n != "repointed_checks"} | {"dedup_passes", "dedup_merge_log"}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) - ELSEWHERE))
def test_query(spark, small, duck, name):
    df = catalogue.queries()[name](spark, small)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = sorted((tuple(norm(v) for _, v in sorted(zip(names, r))) for r in found.fetchall()), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(norm(r[c]) for c in sorted(names)) for r in df.collect()), key=repr) == want


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {n: n for e in edges for n in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {n: r for n, r in least.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, 5, None), (2, 7, "x")], "k int, n int, s string")
    new = spark.createDataFrame([(2, 3, None), (3, 1, "y")], "k int, n int, s string")
    got = merge.upsert(old, new, ["k"], {"n": "greatest", "s": "new_or_old"})
    assert sorted(map(tuple, got.collect())) == [(1, 5, None), (2, 7, "x"), (3, 1, "y")]


@pytest.mark.parametrize("raw,want", [("12345", "https://www.facebook.com/12345"), ("@shop", "https://www.facebook.com/shop"), ("https://example.org/x", None), ("https://facebook.com/groups/1", None)])
def test_profile_url(spark, raw, want):
    assert spark.range(1).select(X.profile_url(F.lit(raw))).first()[0] == want


def test_streams_equal_batch(spark, small, tmp_path):
    src = f"{tmp_path}/events"
    rows = spark.read.parquet(f"{small}/events.parquet")
    rows.repartitionByRange(3, "ts").write.parquet(src)
    stream = events.read(spark, src, 10)
    events.run_to_table(events.once(stream), f"{tmp_path}/once", f"{tmp_path}/c1")
    assert spark.read.parquet(f"{tmp_path}/once").count() == rows.select("event_id").distinct().count()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "id int, s string")
    tables.write_csv(df, f"{tmp_path}/c", ["s", "id"])
    assert tables.registry_csv(spark, f"{tmp_path}/c", ["s", "id"]).count() == 2
    with pytest.raises(ValueError):
        tables.registry_csv(spark, f"{tmp_path}/c", ["id", "s"])
    tables.write_parquet(df, f"{tmp_path}/p")
    assert tables.manifest(spark, f"{tmp_path}/p", True).filter("length(sha256) = 64").count() > 0
    with pytest.raises(Exception):
        tables.restore(df, f"{tmp_path}/p")


def test_export_has_a_mark_and_fixed_columns(spark, tmp_path):
    df = spark.createDataFrame([("a \"b\", c", 1, "x"), (None, 2, "y")], "name string, n int, extra string").coalesce(1)
    tables.write_export(df, f"{tmp_path}/x", ["name", "phone", "n"])
    (part,) = (tmp_path / "x").glob("*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfname,phone,n")
    assert part.read_text("utf-8-sig").splitlines()[1:] == ['"a ""b"", c",,1', ",,2"]


def test_releases(spark, tmp_path):
    for day, n in (("2026-01-31", 2), ("2026-02-01", 3)):
        spark.range(n).coalesce(1).write.parquet(f"{tmp_path}/r/dt={day}/places")
    (tmp_path / "r" / "LATEST").write_text("x")
    newest = tables.read_release(spark, f"{tmp_path}/r", "LATEST").collect()
    assert len(newest) == 3 and {r["release"] for r in newest} == {"2026-02-01"} and all(r["source_file"].startswith("part-") for r in newest)
    assert tables.read_release(spark, f"{tmp_path}/r", "2026-01-31").count() == 2
    for bad in ("31-01-2026", "2026"):
        with pytest.raises(ValueError):
            tables.read_release(spark, f"{tmp_path}/r", bad)


def test_contexts_decode_and_take_linear_time(spark):
    html = "<p>Fish &amp; Chips</p><script>no@x.org</script> ok@x.example.org <b>&eacute;</b>" + "<i>pad</i>" * 100
    rows = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "a1@b.org " * 20_000)], "id int, html string")
    got = {r["id"]: r["c"] for r in rows.select("id", markup.contexts(F.col("html"), r"[a-z0-9]+@[a-z.]+[a-z]", 60).alias("c")).collect()}
    assert [c["email"] for c in got[1]] == ["no@x.org", "ok@x.example.org"] and got[1][1]["context"].startswith("Fish & Chips ok@x.example.org é pad")
    assert got[2] == got[3] == [] and len(got[4]) == 20_000
