"""Substring dedup by hashing lines and passages.

Units of a text are normalised (white space collapsed, A-Z lowered) and
hashed to 128 bits: the whole text, each line of at least LINE_WORDS words,
and windows of PASSAGE words.  Passages that repeat across documents often
begin inside a line, so line hashes alone would miss them; windows are
anchored by content instead: one starts at each word whose hash is the
smallest of some ANCHOR_SPAN neighbouring words.  Any repeated run of
PASSAGE + ANCHOR_SPAN - 1 (48) words or more thus shares a window wherever it
stands.  Windows are only seeds: a later occurrence is compared with the words
around the first one and grows, word by word, to the ends of the equal run,
which lie less than ANCHOR_SPAN words beyond the outermost windows.

Digests are grouped globally with a map-side minimum, so a unit that occurs in
a third of all documents costs one row per task; the earliest occurrence by
(id, text digest, offset) is kept and the others are removed, with their
offsets in the original text.  Occurrences meet their group in a join of which
both sides are shuffled anew, so that adaptive execution can split a hot unit.
Texts are shuffled twice, compressed: once to read the words around first
occurrences, once to cut.

A row is known by its id and a digest of its text.  Results for special cases:
null and empty texts have no units and are kept as they are; rows without an
id come after all others, in the order of their digests, and are told apart by
them, as are rows that share an id; ids may be of any type that has an order;
rows equal in id and text are the same document and get the same result (their
common units stay, unless an earlier document holds them); a unit repeated
inside one text stays at its first place; offsets are code points, end
exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_texts, materialise, slices

WORD_STR = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
LOWER_STR = {i: i + 32 for i in range(65, 91)}
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LINE_WORDS, PASSAGE, ANCHOR_SPAN = 5, 25, 24


def anchors(hashes: np.ndarray, span: int = ANCHOR_SPAN) -> np.ndarray:
    """Positions that hold the smallest (the last of equals) of span neighbouring 32-bit hashes."""
    n = len(hashes)
    if n < span:
        return np.empty(0, np.int64)
    # hash and place from the end in one number, so of equal hashes the later position is the smaller
    key = (hashes.astype(np.uint64) << np.uint64(32)) | np.arange(n, 0, -1, dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
    at = n - (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def text_units(text: bytes, line_words: int = LINE_WORDS, passage: int = PASSAGE, span: int = ANCHOR_SPAN):
    """Arrays hi, lo (a unit's digest), start, end of a text's units; offsets in bytes.  Digests of windows are odd, the others even."""
    words = text.translate(LOWER).split()  # bytes split at exactly the white space of WORD
    n = len(words)
    if not n:
        return np.empty((2, 0), np.uint64), np.empty((2, 0), np.int64)
    line = b" ".join(words)  # the normalised text; word i starts at begin[i]
    raw = np.frombuffer(b" %b " % text, np.uint8)
    blank = SPACE[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    first, last = edges[::2], edges[1::2]
    begin = np.concatenate(([0], np.cumsum(last - first + 1)))
    # lines: runs of words without a line feed between them
    starts = np.unique(np.concatenate(([0], np.searchsorted(first, np.flatnonzero(raw == 10) - 1), [n])))
    i, j = starts[:-1], starts[1:]
    long = (j - i >= line_words) & (j - i < n)
    i, j = np.concatenate(([0], i[long])), np.concatenate(([n], j[long]))
    lines = len(i)
    if n > passage:
        at = anchors(np.fromiter(map(crc32, words), np.int64, n), span)
        at = at[at + passage <= n]
        i, j = np.concatenate((i, at)), np.concatenate((j, at + passage))
    digest = xxhash.xxh3_128_digest
    made = b"".join([digest(line[a:b]) for a, b in zip(begin[i].tolist(), (begin[j] - 1).tolist())])
    hi, lo = np.frombuffer(made, ">u8").reshape(-1, 2).T.astype(np.uint64)
    lo &= ~np.uint64(1)
    lo[lines:] |= np.uint64(1)
    return np.stack([hi, lo]), np.stack([first[i], last[j - 1]])


def rows_of(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, row, t): row is a digest of the text, which tells rows of one id apart."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("t"))


def units(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, hi, lo, start, stop, packed): every unit of every text, offsets in code points.

    Each text also gives one row of its own, which has the compressed text and no unit.
    """

    def start():
        pack = zstandard.ZstdCompressor(level=1).compress

        def work(texts):
            rows, digests, places = [np.empty(0, np.int64)], [np.empty((2, 0), np.uint64)], [np.empty((2, 0), np.int64)]
            for k, t in enumerate(texts):
                if not t:
                    continue
                digest, place = text_units(t)
                if not t.isascii():
                    points = np.concatenate(([0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)))
                    place = points[place]
                rows.append(np.full(digest.shape[1], k))
                digests.append(digest)
                places.append(place)
            rows = np.concatenate(rows)
            hi, lo = np.concatenate(digests, 1).view(np.int64)
            a, b = np.concatenate(places, 1)
            n = len(texts)
            none = lambda kind: pa.nulls(n, kind)
            both = lambda x, kind: pa.concat_arrays([x, none(kind)])
            packed = pa.concat_arrays([pa.nulls(len(rows), pa.binary()), pa.array([None if t is None else pack(t) for t in texts], pa.binary())])
            return {
                "": np.concatenate((rows, np.arange(n))), "hi": both(pa.array(hi), pa.int64()), "lo": both(pa.array(lo), pa.int64()),
                "start": both(pa.array(a, pa.int32()), pa.int32()), "stop": both(pa.array(b, pa.int32()), pa.int32()), "packed": packed,
            }

        return work

    return map_texts(rows_of(docs, id_col, text), "t", "hi long, lo long, start int, stop int, packed binary", start, {"id": "id", "row": "row"}, expand=True)


def repeats(found: DataFrame) -> DataFrame:
    """(id, row, start, stop, passage, fid, frow, fstart, fstop): every occurrence but a unit's earliest, and that one."""
    found = found.filter("hi IS NOT NULL").select("id", "row", "hi", "lo", "start", "stop")
    order = F.struct(F.col("id").isNull().alias("z"), "id", "row", "start", "stop")
    groups = found.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min(order).alias("f")).filter("n > 1")
    groups = materialise(groups.select("hi", "lo", *[F.col(f"f.{c}").alias("f" + c) for c in ("id", "row", "start", "stop")]), "dedup-groups")
    later = found.join(groups, ["hi", "lo"]).filter(~(F.col("id").eqNullSafe(F.col("fid")) & (F.col("row") == F.col("frow")) & (F.col("start") == F.col("fstart"))))
    made = materialise(later.select("id", "row", "start", "stop", (F.col("lo").bitwiseAND(F.lit(1)) == 1).alias("passage"), "fid", "frow", "fstart", "fstop"), "dedup-later")
    forget(groups)
    return made


def joined_runs(spans: list[tuple]) -> list[list]:
    """Sorted (frow, fstart, start, stop, fstop) of windows of one text, with those that continue each other made one."""
    out: list[list] = []
    for s in spans:
        last = out[-1] if out else None
        if last and last[0] == s[0] and s[2] <= last[3] and s[2] >= last[2] and last[1] <= s[1] <= last[4] and s[3] >= last[3] and s[4] >= last[4]:
            last[3], last[4] = s[3], s[4]
        else:
            out.append(list(s))
    return out


def reduced(spans: list[dict]) -> list[dict]:
    """A text's repeats without the windows inside repeated lines, and with neighbouring windows of one first text joined."""
    lines = sorted((s["start"], s["stop"]) for s in spans if not s["passage"])
    merged: list[list[int]] = []
    for a, b in lines:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [m[0] for m in merged]
    inside = lambda s: (k := bisect_right(starts, s["start"])) and s["stop"] <= merged[k - 1][1]
    out = {(s["start"], s["stop"], s["frow"]): s for s in spans if not s["passage"]}
    by_first: dict = {}
    for s in spans:
        if s["passage"] and not inside(s):
            by_first.setdefault((s["fid"], s["frow"]), []).append((s["frow"], s["fstart"], s["start"], s["stop"], s["fstop"]))
    kept = list(out.values())
    for (fid, frow), windows in by_first.items():
        for _, fa, a, b, fb in joined_runs(sorted(set(windows), key=lambda w: (w[2], w[1]))):
            kept.append({"passage": True, "fid": fid, "frow": frow, "fstart": fa, "start": a, "stop": b, "fstop": fb})
    return kept


def _rows(df: DataFrame, column: str, schema: str, work) -> DataFrame:
    """df's rows, with work(the list of dicts in a column) as rows of schema in their place."""
    kind = df.select("id").schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # a row's list is as long as its text has units
                part = batch.slice(k, 256)
                made = [work(x) for x in part.column(part.schema.get_field_index(column)).to_pylist()]
                rows = pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]))
                flat = pa.array([x for m in made for x in m], fields(part, column))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *flat.flatten()], names=["id", "row", *[f.name for f in flat.type]])

    def fields(part, column):
        return part.schema.field(column).type.value_type

    return df.select("id", "row", column).mapInArrow(run, f"id {kind}, row long, {schema}")


def words_before(text: str, place: int, words: int = ANCHOR_SPAN) -> list[tuple[int, int]]:
    """The last words before a place, as spans in order; only the text close to it is read."""
    reach = 16 * words
    while True:
        low = max(0, place - reach)
        found = [m.span() for m in WORD_STR.finditer(text, low, place)]
        if not low or len(found) > words:  # the first word of a part may be cut
            return found[-words:]
        reach *= 4


def words_after(text: str, place: int, words: int = ANCHOR_SPAN) -> list[tuple[int, int]]:
    """The first words from a place on, as spans in order."""
    return [m.span() for m in islice(WORD_STR.finditer(text, place), words)]


def context(text: str, asks: list[tuple[int, int]], words: int = ANCHOR_SPAN) -> list[str]:
    """The words, lower-cased, before the place (side 0) or from the place on (side 1), one string for each ask."""
    near = (words_after(text, place, words) if side else words_before(text, place, words) for place, side in asks)
    return [" ".join([text[a:b] for a, b in spans]).translate(LOWER_STR) for spans in near]


def grown(text: str, cuts: list[dict]) -> list[list[int]]:
    """The spans to remove: lines as they are, runs of windows grown to the ends of the equal run, all merged."""
    word = lambda span: text[span[0] : span[1]].translate(LOWER_STR)
    spans = []
    for c in cuts:
        a, b = c["start"], c["stop"]
        near = c["near"].split(" ") if c["near"] else []
        if c["side"] == 0 and near:
            for own, other in zip(reversed(words_before(text, a)), reversed(near)):
                if word(own) != other:
                    break
                a = own[0]
        elif c["side"] == 1 and near:
            for own, other in zip(words_after(text, b), near):
                if word(own) != other:
                    break
                b = own[1]
        spans.append([a, b])
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' id and text, removed (merged spans of code points), firsts (ids that hold the kept copies), kept_text."""
    found = materialise(units(docs, id_col, text), "dedup-units")
    texts = found.filter("hi IS NULL").select("id", "row", "packed")
    kind = docs.select(F.col(id_col).alias("id")).schema[0].dataType.simpleString()
    later = repeats(found)
    part = F.struct("passage", "fid", "frow", "fstart", "start", "stop", "fstop")
    runs = _rows(
        later.groupBy("id", "row").agg(F.collect_set(part).alias("spans")), "spans",  # a set, as equal rows have the same spans
        f"passage boolean, fid {kind}, frow long, fstart int, start int, stop int, fstop int", reduced,
    )
    runs = materialise(runs, "dedup-runs")
    forget(later)
    # the words around first occurrences
    ends = F.array(F.struct(F.col("fstart").alias("place"), F.lit(0).alias("side")), F.struct(F.col("fstop").alias("place"), F.lit(1).alias("side")))
    asks = runs.filter("passage").select("fid", "frow", F.inline(ends)).distinct()
    asked = asks.groupBy("fid", "frow").agg(F.collect_list(F.struct("place", "side")).alias("asks"))
    same = F.col("row").eqNullSafe(F.col("frow")) & F.col("id").eqNullSafe(F.col("fid"))
    near = texts.join(asked, same).select("fid", "frow", "packed", "asks").mapInArrow(_contexts, f"fid {kind}, frow long, place int, side int, near string")
    near = materialise(near.groupBy("fid", "frow", "place", "side").agg(F.first("near").alias("near")), "dedup-near")
    # cuts of each later text
    both = F.array(F.struct(F.col("fstart").alias("place"), F.lit(0).alias("side")), F.struct(F.col("fstop").alias("place"), F.lit(1).alias("side")))
    tips = runs.filter("passage").select("id", "row", "start", "stop", F.col("fid").alias("gid"), F.col("frow").alias("grow"), F.inline(both).alias("gplace", "gside"))
    meet = F.col("gid").eqNullSafe(F.col("fid")) & (F.col("grow") == F.col("frow")) & (F.col("gplace") == F.col("place")) & (F.col("gside") == F.col("side"))
    tips = tips.join(near, meet).select("id", "row", "fid", "start", "stop", "side", "near")
    whole = runs.filter("NOT passage").select("id", "row", "fid", "start", "stop", F.lit(-1).alias("side"), F.lit(None).cast("string").alias("near"))
    cuts = tips.unionByName(whole).groupBy("id", "row").agg(
        F.collect_list(F.struct("start", "stop", "side", "near")).alias("cuts"), F.sort_array(F.collect_set("fid")).alias("firsts")
    )
    cuts = materialise(cuts.select(F.col("id").alias("cid"), F.col("row").alias("crow"), "cuts", "firsts"), "dedup-cuts")
    forget(runs, near)
    out = texts.join(cuts, F.col("row").eqNullSafe(F.col("crow")) & F.col("id").eqNullSafe(F.col("cid")), "left")
    empty = F.array().cast(f"array<{kind}>")
    out = out.select("id", F.coalesce("firsts", empty).alias("firsts"), "packed", "cuts").mapInArrow(
        _cut, f"`{id_col}` {kind}, firsts array<{kind}>, `{text}` string, removed array<struct<a:int,b:int>>, kept_text string"
    )
    return out.select(id_col, text, "removed", "firsts", "kept_text")


def _contexts(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            rows, place, side, near = [], [], [], []
            for i, (packed, asks) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                asks = [(x["place"], x["side"]) for x in asks]
                near += context(unpack(packed).decode(), asks)
                rows += [i] * len(asks)
                place += [p for p, _ in asks]
                side += [s for _, s in asks]
            at = pa.array(rows, pa.int64())
            arrays = [part.column(0).take(at), part.column(1).take(at), pa.array(place, pa.int32()), pa.array(side, pa.int32()), pa.array(near, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["fid", "frow", "place", "side", "near"])


def _cut(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in batches:
        for at, to in slices(batch.column(2).cast(pa.binary())):
            part = batch.slice(at, to - at)
            texts, removed, kept = [], [], []
            for packed, cuts in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                text = None if packed is None else unpack(packed).decode()
                spans = grown(text, cuts) if cuts else []
                texts.append(text)
                removed.append([{"a": a, "b": b} for a, b in spans])
                if spans:
                    edges = [0, *[x for s in spans for x in s], len(text)]
                    text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                kept.append(text)
            arrays = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(removed, span), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.field(0).name, "firsts", "text", "removed", "kept_text"])


def dedup_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: how much was removed and where, the documents that hold the kept copies, the kept text."""
    made = dedup(docs, id_col, text)
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["a"].cast("string"), x["b"].cast("string"))), ",")
    return made.select(
        id_col, F.size("removed").cast("long").alias("n_removed"), size.alias("removed_chars"), (F.size("removed") > 0).alias("has_repeats"),
        spans.alias("removed_spans"), F.col("firsts").alias("first_doc_ids"), "kept_text",
    )
