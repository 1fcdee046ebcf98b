"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive benchmark words.  For all windows of one
length a shift table over blocks of two words says how far the search may jump
when a block cannot end a window soon; a block that can end one selects the
bucket of windows by the hash of that suffix, and a direct comparison of all
words confirms an occurrence.

The benchmark is the stated query set: its windows are searched in blocks of
bounded size against all documents, so no broadcast grows without bound.

Results for special cases: a null or empty text has no words, so no hits; a
benchmark item with no words has no window; an item shorter than the window
length is one window; items with the same text all count; repeated document
rows each give a row; null ids pass through (a null item_id is listed as
"null").  Texts are searched whole, whatever their length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialise

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = bytes(range(65, 91))
LOWER = bytes.maketrans(UPPER, UPPER.lower())
#: Windows searched at once; their tables take some 200 bytes each.
BLOCK_WINDOWS = 200_000
#: After so many blocks the passes so far are written, so that plans stay short.
BLOCKS_PER_PLAN = 16


class WuManber:
    """Search tables for windows (tuples of words) of one length."""

    def __init__(self, windows: dict[tuple, list[int]], m: int):
        self.m, self.block = m, min(2, m)
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        b = self.block
        for window, payload in windows.items():
            for end in range(b, m + 1):
                key = window[end - b : end] if b > 1 else window[end - 1]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.buckets[window[m - b :] if b > 1 else window[m - 1]].append((window, payload))

    def find(self, words: list[bytes]):
        """Yield (start, payload) of every occurrence of every window."""
        m, n, two = self.m, len(words), self.block > 1
        get, far, i = self.shift.get, self.m - self.block + 1, self.m - 1
        while i < n:
            key = (words[i - 1], words[i]) if two else words[i]
            jump = get(key, far)
            if jump:
                i += jump
                continue
            start = i - m + 1
            here = tuple(words[start : i + 1])
            for window, payload in self.buckets[key]:
                if window == here:
                    yield start, payload
            i += 1


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.translate(LOWER)) if text else []


def windows(benchmark: DataFrame, size: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(words, items): every distinct window and the items that hold it."""
    lowered = F.translate(F.col(text), UPPER.decode(), UPPER.lower().decode())
    found = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"),
        F.regexp_extract_all(lowered, F.lit(WORD_SQL), F.lit(0)).alias("w"),
    ).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = found.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _blocks(found: DataFrame, most: int):
    """The windows, brought to the driver one bounded block at a time."""
    block = []
    for row in found.toLocalIterator():
        if len(block) == most:
            yield block
            block = []
        block.append((tuple(w.encode() for w in row["words"]), row["items"]))
    yield block


def search(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
    size: int = 10, carry: dict[str, str] | None = None, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Per document: n_words, hit spans (word positions), and the items found.

    ``spans`` are "start:end" word positions, end exclusive, comma-joined.
    Every further block of windows is one more narrow pass over the texts,
    which carries the occurrences found so far along.
    """
    sc = docs.sparkSession.sparkContext
    carry = {id_col: id_col, **(carry or {})}
    schema = "n_words long, spans array<string>, items array<string>"
    blocks = _blocks(windows(benchmark, size), block_windows)
    block, given, earlier, passes = next(blocks), docs, {}, 0
    while block is not None:
        following = next(blocks, None)
        start = _searcher(sc.broadcast(block))
        more = {"__text": text} if following is not None else {}
        out = map_texts(given, text, schema, start, {**carry, **earlier, **more})
        if earlier:
            both = {"spans": F.concat("b_spans", "spans"), "items": F.array_union("b_items", "items")}
            out = out.withColumns(both).drop("b_spans", "b_items")
        passes += 1
        if passes % BLOCKS_PER_PLAN == 0:
            out = materialise(out, "decontaminate")
        given, text, block = out, "__text", following
        carry, earlier = {k: k for k in carry}, {"b_spans": "spans", "b_items": "items"}
    return out


def _searcher(tables):
    def start():
        by_length: dict[int, dict] = defaultdict(dict)
        for window, items in tables.value:
            by_length[len(window)][window] = items
        searches = [WuManber(w, m) for m, w in sorted(by_length.items())]

        def work(texts):
            n_words, spans, items = [], [], []
            for text in texts:
                words = words_of(text)
                found, who = set(), set()
                for s in searches:
                    for at, payload in s.find(words):
                        found.add((at, at + s.m))
                        who.update(payload)
                n_words.append(len(words))
                spans.append([f"{a}:{b}" for a, b in sorted(found)])
                items.append(sorted(who))
            return {"n_words": n_words, "spans": as_strings(spans), "items": as_strings(items)}

        return work

    return start


def as_strings(lists):
    import pyarrow as pa

    return pa.array(lists, pa.list_(pa.string()))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 10, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The per-document report of op3: counts, the digest of the items, the flag."""
    found = search(docs, benchmark, id_col, text, size, block_windows=block_windows)
    pair = F.transform("spans", lambda s: F.struct(F.split(s, ":")[0].cast("int").alias("a"), F.split(s, ":")[1].cast("int").alias("b")))
    # a span's words beyond the furthest end so far
    hit = F.aggregate(
        F.array_sort(pair),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["b"]).alias("end"),
            (acc["n"] + F.greatest(s["b"] - F.greatest(acc["end"], s["a"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), F.array_join(F.transform(F.array_sort(pair), lambda p: F.concat_ws(":", p["a"].cast("string"), p["b"].cast("string"))), ",").alias("hit_spans"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = 10) -> DataFrame:
    """The rows of docs, with their columns, that hold no window of a benchmark item."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("t"))
    found = search(rows, benchmark, "row", "t", size)
    return found.filter(F.size("spans") == 0).select("row.*")


def digest(items: list[str]) -> str:
    """items_sha256 of a list of items (for tests)."""
    return sha256(",".join(sorted(items)).encode()).hexdigest()
