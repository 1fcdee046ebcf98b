"""The near-dedup stage against brute force over all pairs."""

import random
import re
from collections import Counter

import corpus_pipeline
from prospectra.llm import similar
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if sets[i] == sets[j] or (both and len(sets[i] & sets[j]) / both >= 0.8):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return set(least.values())


def planted(small, spark):
    table = spark.read.parquet(f"{small}/documents.parquet")
    rng = random.Random(11)
    some = lambda n: [rng.choice("abcdefgh") + str(rng.randint(0, 999)) for _ in range(n)]
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    common = " ".join(some(9))
    for k in range(60):  # near copies of each text, about as similar as the limit, and a line that all of them hold
        base = some(rng.randint(40, 200))
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 40 + 1)):
                w[rng.randrange(len(w))] = some(1)[0]
            rows.append((10_000 + len(rows), common + "\n" + " ".join(w)))
    hot = some(120)  # and one large group of near copies
    for _ in range(150):
        w = list(hot)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = some(1)[0]
        rows.append((10_000 + len(rows), " ".join(w)))
    rows += [(30_000, None), (30_001, ""), (30_002, "a b"), (30_003, "A  b"), (30_004, "a c")]
    return rows


def found(spark, small, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, small).select("doc_id").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_near_dedup_stage_finds_every_pair(spark, small):
    rows = planted(small, spark)
    assert found(spark, small, rows) == kept(rows)


def test_crowded_groups_and_small_parts(spark, small, monkeypatch):
    """No sample of frequent shingles, so that groups of unrelated texts arise: their shingle is put last, and groups are cut into many parts."""
    rng = random.Random(4)
    line = " ".join(f"c{i}" for i in range(60))
    rows = planted(small, spark) + [(50_000 + k, line + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(90))) for k in range(200)]
    seen = []
    monkeypatch.setattr(similar, "SAMPLE", 0)
    monkeypatch.setattr(similar, "GROUP_MOST", 16)
    want = kept(rows)
    for crowd in (30, 10**6):
        monkeypatch.setattr(similar, "CROWD", crowd)
        monkeypatch.setattr(similar, "_again", lambda *a, f=similar._again: seen.append(len(a[2])) or f(*a))
        assert found(spark, small, rows) == want
        assert bool(seen) == (crowd == 30)
        seen.clear()


def test_tasks_meet_every_pair_once(spark):
    """Two rows of different roots meet in exactly one task that may pair them."""
    rows = [(7, k, 0 if k < 70 else k) for k in range(170)]
    for p, q in ((1, 1), (3, 1), (1, 4), (3, 4)):
        df = spark.createDataFrame(rows, "key long, node long, root long").withColumns({"most": F.lit(0), "p": F.lit(p), "q": F.lit(q)})
        df = df.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("root") == 0, F.lit(p)).otherwise(F.lit(q))).cast("int"))
        tasks = {}
        for r in df.select("node", "root", F.inline(F.expr(similar.TASKS))).collect():
            tasks.setdefault(r["part"], []).append((r["node"], r["root"], r["side"], r["cross"]))
        met = Counter()
        for members in tasks.values():
            assert len({m[3] for m in members}) == 1
            for i, x in enumerate(members):
                for y in members[:i]:
                    if x[1] != y[1] and (not x[3] or x[2] != y[2]):
                        met[frozenset((x[0], y[0]))] += 1
        assert set(met.values()) == {1} and len(met) == 100 * 99 // 2 + 70 * 100
