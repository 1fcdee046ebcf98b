"""The audit against a plain application of the filters in every order."""

import random
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prospectra.llm import filter_audit

SYMBOLS = set("#$%&*|")


def fails(text):
    words = text.encode().split()
    upper = sum(c.isascii() and c.isupper() for c in text)
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * len(text), bool(SYMBOLS & set(text))]


def brute(rows, labels):
    good, bad = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    judged = [(i, lang or "", [*fails(text or ""), i is not None and i > least[text or ""]]) for i, text, lang in rows]
    out, shapley = {}, Counter()
    for order in permutations(range(5)):
        name = "".join("ABCDE"[k] for k in order)
        for part in {p for _, p, _ in judged}:
            left = [d for d in judged if d[1] == part]
            every = left
            for step, k in enumerate(order, 1):
                lost = [d for d in left if d[2][k]]
                left = [d for d in left if not d[2][k]]
                redundant = sum(d[2][k] for d in every) - len(lost)
                alone = sum(d[2][k] and sum(d[2]) == 1 for d in every)
                out[part, name, step] = (len(left), len(lost), redundant, alone, sum(d[0] in good for d in lost), sum(d[0] in bad for d in lost))
                shapley[part, k] += len(lost)
    return {key: (*v, shapley[key[0], "ABCDE".index(key[1][key[2] - 1])]) for key, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        words = [rng.choice(["alpha", "Beta", "GAMMA", "δέλτα", str(rng.randrange(10**6)), str(rng.randrange(10**6))]) for _ in range(rng.choice([3, 90, 120, 300]))]
        texts.append(rng.choice([" ", "\n"]).join(words) + rng.choice(["", "", "$"]))
    texts += ["", None, "A" * 10, "x" * 200_000, "\x0b  "]
    ids = [*range(400), *[None] * 6, *range(380, 400)]
    made = [(i, rng.choice(texts), rng.choice(["en", "de", "", None])) for i in ids]
    return made + made[10:20] + [(900 + k, "one text with very many copies", "fr") for k in range(3000)] + [(5, "one text with very many copies", "en")]


LABELS = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 1000, 3)] + [(3, 1, 1), (3, None, None), (None, 1, 1)]


def test_audit_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, r[2]) for r in rows], "doc_id long, text string, lang string, mask string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = brute(rows, LABELS)
    for given in (docs, docs.orderBy(F.rand(4)).repartition(7)):
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.interaction(given, labels).collect()}
        assert got == want


def test_groups_over_many_ranges(spark, rows):
    """With many ranges the copies of one text begin, fill and end several of them."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = filter_audit.marked(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    want = Counter((i, lang or "", sum(f << k for k, f in enumerate([*fails(text or ""), i is not None and i > least[text or ""]]))) for i, text, lang in rows)
    assert Counter(map(tuple, got)) == want


def test_masks_of_slices():
    texts = pa.array([b"", b"AB#", "é É".encode(), b"w " * 120, b""])
    want = [sum(f << k for k, f in enumerate(fails(t.decode()))) for t in texts.to_pylist()]
    assert filter_audit.masks(texts).tolist() == want
    assert filter_audit.masks(texts[1:4]).tolist() == want[1:4]


def test_empty_tables_and_text_ids(spark):
    docs = spark.createDataFrame([("b", "t", "en"), ("a", "t", "en")], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([], "doc_id string, quality int, toxic int")
    assert filter_audit.interaction(docs.limit(0), labels).count() == 0
    got = {r["doc_id"]: r["mask"] >> 4 for r in filter_audit.marked(docs).collect()}
    assert got == {"a": 0, "b": 1}
    assert filter_audit.interaction(docs, labels).count() == 600
