"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are made inside tasks.  Equal fingerprints are first gathered
into one node each, so copies never pair.  Two fingerprints that differ in at
most k bits agree on at least one of k + 1 bit blocks, hence distinct
fingerprints are dealt by (block, its bits); groups that are still large are
dealt again by blocks of their other bits, up to three times, after which at
most 2**19 fingerprints can share a group.  In each group a binary trie is
joined with itself: node pairs are walked together, differing bits add up, and
a pair over the error budget is pruned.  A group gives only a spanning forest
of its links, and components are joined across groups by alternating large-
and small-star steps.

Results for special cases: null and empty texts have fingerprint zero and link
like any other; a null doc_id keeps its row and can only be the component's
id if the whole component has no id; repeated rows each give a row; an empty
table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import forget, map_texts, materialise, sent

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED, WIDTH, BITS = 42, 3, 2
#: Two nodes of a trie with so many pairs of fingerprints, at most, are compared as leaves.
LEAF = 4096
#: Groups of more distinct fingerprints are dealt again by further bits.
GROUP_MOST = 2048
#: Bits of a fingerprint by level: three blocks at each, so that two flips leave one whole.
LEVELS = 3


def shingle_hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The 64-bit hashes of a UTF-8 text's runs of width words, in order; a shorter text is one run, an empty one none."""
    words = WORD.findall(text.translate(LOWER)) if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        line = b" ".join(words)
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        shingles = [line[a : b - 1] for a, b in zip(starts, starts[width:])]
    return np.array([hashed(s, SEED) for s in shingles], np.uint64)


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    return bits_of(shingle_hashes(text, width))


def bits_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * count > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Each row's columns keep and its fingerprint as a signed 64-bit integer, fp."""

    def start():
        def work(texts):
            return {"fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

        return work

    return map_texts(docs, text, "fp long", start, {c: c for c in keep})


# ---- the trie self-join of one group, in numpy


def _compared(fps: np.ndarray, pairs: np.ndarray, budget: int):
    """The index pairs i < j between the ranges of node pairs that differ in at most budget bits."""
    size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    part = np.cumsum(size) // 1_000_000  # some million comparisons at once
    for at in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(part)) + 1):
        a0, _, b0, b1, _ = pairs[at].T
        n = size[at]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(b1 - b0, n)
        i, j = np.repeat(a0, n) + k // width, np.repeat(b0, n) + k % width
        near = (np.bitwise_count(fps[i] ^ fps[j]) <= budget) & (i < j)
        if near.any():
            yield np.stack([i[near], j[near]], 1)


def trie_pairs(fps: np.ndarray, budget: int = BITS):
    """For sorted distinct uint64 fingerprints, arrays of index pairs that differ in at most budget bits.

    The trie's nodes are ranges of the sorted array that share a prefix; nodes
    with few fingerprints are leaves, whose fingerprints are compared directly.
    """
    # a stack of blocks of node pairs (a range, b range, bit reached, differing bits); a == b: a node with itself
    stack = [(np.array([[0, len(fps), 0, len(fps), 0]]), 63)]
    while stack:
        pairs, bit = stack.pop()
        if len(pairs) > 200_000:  # walk in parts, so that memory stays bounded
            half = len(pairs) // 2
            stack += [(pairs[:half], bit), (pairs[half:], bit)]
            continue
        a0, a1, b0, b1, d = pairs.T
        few = (a1 - a0) * (b1 - b0) <= LEAF
        if bit < 0:
            few[:] = True
        if few.any():
            yield from _compared(fps, pairs[few], budget)
            pairs = pairs[~few]
            if not len(pairs):
                continue
            a0, a1, b0, b1, d = pairs.T
        mask = np.uint64(1) << np.uint64(bit)
        ones = np.concatenate(([0], np.cumsum((fps & mask) != 0)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        made = [
            np.stack([a0, am, b0, bm, d], 1), np.stack([am, a1, bm, b1, d], 1),
            np.stack([a0, am, bm, b1, d + 1], 1), np.stack([am, a1, b0, bm, d + 1], 1)[~same],
        ]
        pairs = np.concatenate(made)
        alive = (pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2]) & (pairs[:, 4] <= budget)
        alive &= ~((pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] - pairs[:, 0] == 1))  # a leaf with itself
        if alive.any():
            stack.append((pairs[alive], bit - 1))


def trie_links(fps: np.ndarray, budget: int = BITS) -> np.ndarray:
    """For sorted distinct uint64 fingerprints, the smallest index linked to each, through any chain."""
    n = len(fps)
    parent = np.arange(n)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for near in trie_pairs(fps, budget):
        for i, j in near:
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return np.array([root(i) for i in range(n)], np.int64)


def _masks(free: int) -> list[int]:
    """free's set bits in three parts, as masks."""
    bits = [b for b in range(64) if free >> b & 1]
    cut = [len(bits) * i // 3 for i in range(4)]
    return [sum(1 << b for b in bits[cut[i] : cut[i + 1]]) for i in range(3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _frees(level: int) -> list[int]:
    """The bits not yet fixed after so many levels, by path (one of 3**level ways)."""
    frees = [(1 << 64) - 1]
    for _ in range(level):
        frees = [free & ~m for free in frees for m in _masks(free)]
    return frees


def _deal(groups: DataFrame, level: int) -> DataFrame:
    """Each fingerprint of a group (path, key, fp), dealt to three groups by parts of its free bits.

    Keys are hashed: should two collide, their groups are walked as one.
    """
    masks = F.array(*[F.array(*[F.lit(_signed(m)) for m in _masks(free)]) for free in _frees(level)])
    part = lambda i: F.col("fp").bitwiseAND(F.get(F.get("m", F.col("path")), F.lit(i)))
    rows = [
        F.struct((F.col("path") * 3 + i).alias("path"), F.xxhash64("key", F.lit(i), part(i)).alias("key"), F.col("fp").alias("fp"))
        for i in range(3)
    ]
    return groups.withColumn("m", masks).select(F.inline(F.array(*rows)))


def _walk_groups(batches):
    """Links within each run of equal keys of sorted rows; only one group is held at a time."""
    import pyarrow as pa

    held: list[tuple[int, np.ndarray]] = []

    def links(parts):
        fps = np.unique(np.concatenate(parts).view(np.uint64))
        if len(fps) < 2:
            return None
        to = trie_links(fps)
        linked = np.flatnonzero(to != np.arange(len(fps)))
        return (fps[linked].view(np.int64), fps[to[linked]].view(np.int64)) if len(linked) else None

    def batch_of(found):
        a, b = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        found = []
        if held and held[0][0] != keys[0]:
            found.append(links([x for _, x in held]))
            held = []
        if len(starts) > 1:
            found.append(links([*(x for _, x in held), fps[: ends[0]]]))
            held = []
            for s, e in zip(starts[1:-1], ends[1:-1]):
                if e - s > 1:
                    found.append(links([fps[s:e]]))
        held.append((keys[-1], fps[starts[-1] :]))
        found = [x for x in found if x]
        if found:
            yield batch_of(found)
    if held and (last := links([x for _, x in held])):
        yield batch_of([last])


def links(nodes: DataFrame, group_most: int = GROUP_MOST) -> DataFrame:
    """(a, b): for distinct fingerprints fp, a forest whose trees are the classes of linked ones."""
    groups = nodes.select(F.lit(0).alias("path"), F.lit(0).cast("long").alias("key"), "fp")
    out, used = None, []
    for level in range(LEVELS):
        dealt = _deal(groups, level)
        if level:  # these are few: groups that were too large
            dealt = materialise(dealt, "simhash-groups")
            used.append(dealt)
        large = None
        if level < LEVELS - 1:
            large = materialise(dealt.groupBy("key").count().filter(F.col("count") > group_most).select("key"), "simhash-large")
            used.append(large)
            if large.isEmpty():
                large = None
        small = dealt if large is None else dealt.join(large, "key", "left_anti")
        ordered = small.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
        found = materialise(ordered.mapInArrow(_walk_groups, "a long, b long"), "simhash-links")
        out = found if out is None else out.unionByName(found)
        if large is None:
            break
        groups = dealt.join(large, "key", "left_semi").select("path", "key", "fp")
    forget(*used)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", group_most: int = GROUP_MOST) -> DataFrame:
    """Each row's id, its fingerprint in hex, and component_id, the smallest id it reaches."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _classes(docs, id_col, text, group_most).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def _classes(docs: DataFrame, id_col: str, text: str, group_most: int) -> DataFrame:
    """(id, digest of the text, fp, root, component_id) of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), F.col(text).alias("t"))
    made = materialise(fingerprints(rows, ["id", "digest"], "t"), "simhash-fp")
    nodes = materialise(made.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    edges = links(nodes, group_most)
    roots = components(edges)
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "first", "root")
    of_root = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    alone = nodes.join(roots, nodes["fp"] == roots["node"], "left_anti").select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    classes = materialise(linked.join(of_root, "root").select("fp", "root", "component_id").unionByName(alone), "simhash-classes")
    forget(nodes, edges, roots)
    return made.join(classes, "fp")


def keep_one_each(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", group_most: int = GROUP_MOST, similarity: float | None = None, width: int = WIDTH
) -> DataFrame:
    """docs without the rows whose id isn't their component's; of a component's rows that share that id too, the first by text and other columns stays.

    With a similarity, texts are linked by the exact Jaccard similarity of
    their runs of width words (see similar) instead of by fingerprints.
    Rows without an id are kept, as no copy of them can be named.  A row is
    told from others of its id by a digest of its text.
    """
    if similarity is None:
        found = _classes(docs, id_col, text, group_most)
    else:
        from .similar import classes

        found = classes(docs, id_col, text, width, similarity)
    made = found
    found = materialise(found.select("id", "digest", "root", "component_id"), "simhash-found")
    forget(made)
    drop = materialise(found.filter("id <> component_id").select("id", "digest").distinct(), "simhash-drop")
    kept = docs.join(sent(drop), (docs[id_col] == drop["id"]) & (F.xxhash64(docs[text]) == drop["digest"]), "left_anti")
    twice = materialise(found.filter("id = component_id").groupBy("id", "root").count().filter("count > 1").select("id").distinct(), "simhash-twice")
    if twice.isEmpty():
        return kept
    roots = found.join(twice, "id", "left_semi").select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("root").alias("__root")).distinct()
    order = Window.partitionBy("__id", "__root").orderBy(text, F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
    again = kept.join(roots, (kept[id_col] == roots["__id"]) & (F.xxhash64(kept[text]) == roots["__digest"]))
    again = again.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(*[f"`{c}`" for c in docs.columns])
    return kept.join(twice, kept[id_col] == twice["id"], "left_anti").unionByName(again)
