"""Substring dedup against a brute force of lines, windows, growth and which copy stays."""

import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from prospectra.llm import substring_dedup as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(t):
    return [(m[0].translate(LOWER), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]


def units_of(t):
    """(kind and words, first word, word after the last) of a text, from the definition."""
    w = words_of(t)
    if not w:
        return []
    low = [x[0] for x in w]
    out = [(("line", *low), 0, len(w))]
    line, i = [t.count("\n", 0, x[1]) for x in w], 0
    for j in range(1, len(w) + 1):
        if j == len(w) or line[j] != line[i]:
            if j - i >= 5 and j - i < len(w):
                out.append((("line", *low[i:j]), i, j))
            i = j
    if len(w) > 25:
        h, at = [crc32(x.encode()) for x in low], set()
        for k in range(len(h) - 23):
            least = min(h[k : k + 24])
            at.add(max(x for x in range(k, k + 24) if h[x] == least))
        out += [(("passage", *low[k : k + 25]), k, k + 25) for k in sorted(at) if k + 25 <= len(w)]
    return out


def brute(rows):
    """{(id, digest): spans} of rows (id, digest, text)."""
    texts = {(i, d): t for i, d, t in rows}
    order = lambda k: (k[0] is None, k[0] if k[0] is not None else 0, k[1])
    words, first, found = {k: words_of(t) for k, t in texts.items()}, {}, {}
    for k in sorted(texts, key=order):
        found[k] = units_of(texts[k])
        for u, a, b in sorted(found[k], key=lambda x: x[1:]):
            first.setdefault(u, (k, a, b))
    out = {}
    for k, us in found.items():
        w, spans = words[k], []
        lines = [(a, b) for u, a, b in us if u[0] == "line" and first[u][:2] != (k, a)]
        for u, a, b in us:
            f, fa, fb = first[u]
            if (f, fa) == (k, a):
                continue
            if u[0] == "passage" and not any(x <= a and b <= y for x, y in lines):
                v = words[f]
                for _ in range(24):
                    if a and fa and w[a - 1][0] == v[fa - 1][0]:
                        a, fa = a - 1, fa - 1
                for _ in range(24):
                    if b < len(w) and fb < len(v) and w[b][0] == v[fb][0]:
                        b, fb = b + 1, fb + 1
            spans.append((w[a][1], w[b - 1][2]))
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out[k] = merged
    return out


def covered(spans):
    return {x for a, b in spans for x in range(a, b)}


def check(docs):
    """Every row's removed spans are the brute force's; kept texts by id and digest."""
    rows = [tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()]
    want = brute(rows)
    got = S.dedup(docs).select("doc_id", F.xxhash64("text").alias("d"), "text", "removed", "kept_text").collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [(x["a"], x["b"]) for x in r["removed"]]
        assert spans == [tuple(x) for x in want[r["doc_id"], r["d"]]], r["doc_id"]
        text = r["text"] or ""
        left = "".join(c for i, c in enumerate(text) if i not in covered(spans))
        assert (r["kept_text"] or "") == left
    return {(r["doc_id"], r["d"]): r["kept_text"] for r in got}


def test_the_whole_table(spark, small):
    check(spark.read.parquet(f"{small}/documents.parquet"))


def made(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"doc_id {kind}, text string")


def test_a_passage_is_removed_whole(spark):
    rng = random.Random(3)
    some = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    rows, passages = [], []
    for k in range(40):
        p = some(rng.randint(49, 90))
        passages.append(p)
        rows += [(3 * k, some(30) + " " + p + " " + some(20)), (3 * k + 1, "ü " + some(rng.randint(0, 40)) + "  " + p.upper() + "\n" + some(15)), (3 * k + 2, p + " " + some(40))]
    kept = check(made(spark, rows))
    by_id = {i: t for (i, _), t in kept.items()}
    for k, p in enumerate(passages):
        assert p in by_id[3 * k]
        for i in (3 * k + 1, 3 * k + 2):
            assert not set(p.split()) & set(by_id[i].lower().split())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_shared_and_missing_ids_lose_no_text(spark, kind):
    rng = random.Random(4)
    some = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    a, u = some(80), some(90)
    name = (lambda i: i) if kind == "long" else (lambda i: None if i is None else f"k{i}")
    rows = [(name(1), a), (None, a), (None, u), (name(7), a), (name(7), u + " z"), (name(7), a), (None, None), (None, ""), (name(8), some(3))]
    docs = made(spark, rows, kind)
    got = S.dedup(docs).collect()
    assert len(got) == len(rows)
    left = " ".join(r["kept_text"] or "" for r in got)
    for text in (a, u):
        assert all(left.split().count(w) == 1 for w in text.split())
    if kind == "long":
        check(docs)


def test_repeats_within_a_text_and_equal_rows(spark):
    line = "one line of seven words that repeats"
    rows = [(1, f"{line}\nother\n{line}\n{line} more"), (2, f"x\n{line}"), (2, f"x\n{line}"), (3, "a b c d e f\n" * 5)]
    kept = check(made(spark, rows))
    assert [t for (i, _), t in sorted(kept.items()) if i == 1] == [f"{line}\nother\n\n{line} more"]


def test_tables_are_deleted(spark):
    import os

    from prospectra.operators import scratch

    scratch.clear(spark)
    root = scratch.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    S.dedup_report(made(spark, [(1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before} == {"dedup-units", "dedup-cuts"}
    scratch.clear(spark)
    assert set(os.listdir(root)) == before
