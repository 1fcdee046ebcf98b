"""The whole pipeline against a brute force of its stages."""

import os
import re
from hashlib import sha256

import numpy as np
from test_similar import kept as near_kept

import corpus_pipeline
from prospectra.llm import quality, secret_scan, token_counts
from prospectra.operators import scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def base_ok(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(3)}
    return len(w) >= 50 and 100 * len(hit) <= 50 * len(w)


def redacted(t):
    spans, out, at = sorted((a, b) for _, a, b in secret_scan.find(t)), [], 0
    merged = []
    for a, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [t[at:a], "[REDACTED]"]
        at = b
    return "".join(out) + t[at:]


def test_run_equals_brute_force(spark, small):
    scratch.clear(spark)
    root = scratch.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, small).collect()}
    assert len(set(os.listdir(root)) - before) == 1
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rules = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    stats = {r["doc_id"]: r.asDict() for r in quality.statistics(docs, ["doc_id"]).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [(d, t) for d, t in rows if base_ok(t) and not any(quality._covers(rule, stats[d]) for rule in rules)]
    least = near_kept(rows)
    rows = [(d, t) for d, t in rows if d in least]
    windows = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    rows = [(d, t) for d, t in rows if not any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))]
    tok = token_counts.load(token_counts.tokenizer_json())
    want = {}
    for d, t in rows:
        ids = tok.encode(redacted(t), add_special_tokens=False).ids
        want[d] = (len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert got == want and got
