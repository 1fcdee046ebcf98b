"""Runs against all periods tried one by one; awkward rows."""

import hashlib
import random
import zlib

from prospectra.llm import periodic_runs, queries


def brute(words):
    """(start, length, period) of all runs: for each period the stretches on which words that far apart agree."""
    n, least = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > s and i + p - s >= max(6, 4 * p):
                least.setdefault((s, i + p - s), p)
            i += i == s
    return sorted(((s, n, p) for (s, n), p in least.items()), key=lambda r: (r[0], r[2]))


def made_periodic(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def random_words(rng, most):
    words = [rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, most))]
    for _ in range(rng.randint(0, 2)):
        at = rng.randrange(len(words) + 1)
        words[at:at] = words[at : at + rng.randint(1, 7)] * rng.randint(2, 9)
    return words


def test_runs_equal_brute_force():
    rng = random.Random(11)
    texts = [random_words(rng, 60) for _ in range(1500)] + [["x"] * 3000, list("ab") * 900 + list("abb") * 500]
    got = periodic_runs.text_runs([" ".join(t).encode() for t in texts])
    for words, (runs, _) in zip(texts, got):
        assert list(map(tuple, runs.tolist())) == brute(words)


def test_groups_and_long_ranges():
    """Texts over several groups, with extensions longer than the short windows."""
    rng = random.Random(3)
    base = [str(rng.randrange(5000)) for _ in range(2500)]
    texts = [base * 5 + [str(i)] for i in range(12)] + [["a", "b"], [], ["z"] * 7]
    got = periodic_runs.text_runs([" ".join(t).encode() for t in texts])
    for words, (runs, _) in zip(texts, got):
        want = [(0, 12500, 2500)] if len(words) > 9 else [(0, 7, 1)] if len(words) == 7 else []
        assert [tuple(r) for r in runs.tolist() if r[1] >= 7] == want


def test_query_on_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "\t".join(random_words(rng, 80)) + "\n", "en", 1) for i in range(300)]
    rows += [(7, None, None, 1), (8, "", "x", 2), (None, "a " * 50, "x", 2), (9, " \n\x0b ", None, 0), (10, " a " * 9, None, 0), (10, " a " * 9, None, 0), (-4, "é ü " * 20, "de", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, start int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, f"file://{tmp_path}").collect()), key=repr)
    want = []
    for i, text, *_ in rows:
        words = (text or "").encode().split()
        words = made_periodic(i, words) if i is not None else words
        runs = brute(words)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        tops = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(runs), *tops, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in got) > 50


def test_operator_keeps_texts_and_columns(spark):
    docs = spark.createDataFrame([("k", 3, "go go go go go go on"), ("l", None, "x")], "collapsed string, words int, text string")
    got = periodic_runs.periodic_runs(docs, keep=["words"]).collect()
    assert [(r["words"], r["collapsed"], [tuple(x) for x in r["runs"]]) for r in got] == [(3, "go on", [(0, 6, 1)]), (None, "x", [])]
    assert periodic_runs.periodic_runs(docs.limit(0), keep=["words"]).count() == 0
