"""SimHash near-duplicates of a given Jaccard similarity, links confirmed on whole sets.

At a Jaccard similarity of 0.8 some 10 of 64 bits differ, with a wide spread, so
blocks of equal bits can't deal the fingerprints as they do for 2 bits.  Texts
are dealt by shingles instead: two sets with a similarity of t or more share a
shingle among the first n - ceil(t n) + 1 of each, in any order that holds for
all texts (prefix filtering).  In each group the binary trie of fingerprints is
joined with itself under a budget of bits, and what is left is compared on
whole sets.  Fingerprints have 128 bits here, of which pairs at the limit
differ in 19, give or take 4, and unrelated ones in 64: a budget of 40 leaves
out such a pair about once in a million.

The order decides only the cost: shingles that are frequent in a sample come
last, so that a common line makes no large group.  First all texts of a group are
compared with its least one only; so a large group of near copies costs one
comparison each and not one for each pair.  Groups whose texts are not in one
component yet go through the trie.  Large ones are dealt to tasks of bounded
size: the largest component and the other texts are cut into parts, and each
part of the others meets each part of either.  Texts with a possible partner
are then compared inside the task, which gives links and never rows of pairs.

A sample does not see a shingle that few texts in ten thousand hold, yet at
10**9 texts it makes a group of very many unrelated ones.  So groups are
counted over all texts: a shingle whose group has more than CROWD texts outside
its largest component is put last as well, and the texts that had it in their
prefix get a new one.

Results for special cases: null and empty texts are copies of each other and
of nothing else; a text shorter than a shingle is one shingle; texts with
equal sets are one node.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import forget, map_texts, materialise, sent
from .simhash import bits_of, shingle_hashes, trie_pairs

WIDTH, SIMILARITY = 5, 0.8
#: Differing bits of 128, and of the first 64, at most.
BUDGET, HALF = 40, 28
#: The sample that frequent shingles are read from, how many of its texts hold one, and the most that are put last.
SAMPLE, FREQUENT, FREQUENT_MOST = 10_000, 2, 500_000
#: Texts of one group, and of one centre, that a task compares at once.
GROUP_MOST = 1024
#: Texts of a group outside its largest component from which its shingle counts as frequent, and how often prefixes are made anew.
CROWD, ROUNDS = 4096, 3
#: Sets that a task remembers between groups.
SETS_KEPT = 10_000


def prefix(shingles: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles (sorted, distinct) that any set of so much similarity shares one of; the frequent ones come last."""
    n = len(shingles)
    size = n - math.ceil(similarity * n - 1e-9) + 1
    if not n or not len(frequent):
        return shingles[:size]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    last = frequent[at] == shingles
    return np.concatenate((shingles[~last], shingles[last]))[:size]


def more_bits(hashes: np.ndarray) -> np.ndarray:
    """A second 64-bit hash of each hash (the finisher of splitmix64, an invertible mix)."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def frequent_shingles(docs: DataFrame, width: int, text: str = "text") -> np.ndarray:
    """Shingles that many texts of a sample hold."""

    def start():
        def work(texts):
            sets = [np.unique(shingle_hashes(t, width)) for t in texts]
            return {"": np.repeat(np.arange(len(sets)), [len(s) for s in sets]), "s": np.concatenate(sets).view(np.int64)}

        return work

    share = min(1.0, SAMPLE / max(1, docs.count()))
    made = map_texts(docs.sample(share, seed=1), text, "s long", start, expand=True)
    top = made.groupBy("s").count().filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "s").limit(FREQUENT_MOST)
    return np.sort(top.select("s").toArrow().column(0).to_numpy().view(np.uint64))


def _rows(docs: DataFrame, keep: dict[str, str], text: str, width: int, similarity: float, frequent: np.ndarray) -> DataFrame:
    """Columns keep, node (a digest of the text's set), its size n, its fingerprint in fp and gp, the shingles of its prefix, the packed text."""

    def start():
        pack = zstandard.ZstdCompressor(level=1).compress

        def work(texts):
            sets = [np.unique(shingle_hashes(t, width)) for t in texts]
            first = [prefix(s, frequent, similarity) for s in sets]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in first])))
            return {
                "node": np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64),
                "n": pa.array([len(s) for s in sets], pa.int64()), "fp": np.array([bits_of(s) for s in sets], np.uint64).view(np.int64),
                "gp": np.array([bits_of(more_bits(s)) for s in sets], np.uint64).view(np.int64),
                "keys": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(first).view(np.int64))),
                "packed": pa.array([pack(t or b"") for t in texts], pa.binary()),
            }

        return work

    return map_texts(docs, text, "node long, n long, fp long, gp long, keys array<bigint>, packed binary", start, keep)


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sizes and fingerprints allow so much similarity, each once."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias("n" + k), F.col("fp").alias("f" + k), F.col("gp").alias("g" + k))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    near = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) + F.bit_count(F.col("ga").bitwiseXOR(F.col("gb"))) <= BUDGET
    fits = F.least("na", "nb") >= F.lit(similarity - 1e-9) * F.greatest("na", "nb")
    return both.filter(near & fits).select("a", "b")


def _texts_of(asked: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, packed) of the nodes in asked, one text of each."""
    wanted = materialise(asked.select("node").distinct().join(nodes.select("node", "rid"), "node"), "similar-wanted")
    texts = materialise(rows.select("rid", "packed").join(sent(wanted), "rid").select("node", "packed"), "similar-texts")
    forget(wanted)
    return texts


def _confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are as similar; sets are made anew from one text of each node.

    The texts b of an a meet it in parts of at most some GROUP_MOST, however many there are.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_MOST).cast("int").alias("parts"))
    leaves = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("node"), F.lit(1).alias("leaf"))
    tops = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"), F.lit(0).alias("leaf"))
    asked = materialise(leaves.unionByName(tops), "similar-asked")
    texts = _texts_of(asked, nodes, rows)
    given = asked.join(texts, "node").select("a", "part", "leaf", "node", "packed")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        set_of = lambda packed: np.unique(shingle_hashes(unpack(packed), width))
        top = own = None
        for batch in batches:
            a, part, leaf, node, packed = (batch.column(i).to_pylist() for i in range(5))
            out = []
            for i in range(len(a)):
                if not leaf[i]:
                    top, own = (a[i], part[i]), set_of(packed[i])
                    continue
                other = set_of(packed[i])
                common = len(np.intersect1d(own, other, assume_unique=True))
                if common / (len(own) + len(other) - common) >= similarity:
                    out.append((top[0], node[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    ordered = given.repartition("a", "part").sortWithinPartitions("a", "part", "leaf")
    links = materialise(ordered.mapInArrow(run, "a long, b long"), "similar-links")
    forget(asked, texts)
    return links


def group_pairs(fp: np.ndarray, gp: np.ndarray, root: np.ndarray, side: np.ndarray | None = None):
    """Arrays (i, j, differing bits) of the rows of one group within the budget, of different roots (and sides, if given), i < j in no order."""
    values, which = np.unique(fp, return_inverse=True)
    order = np.argsort(which, kind="stable")
    ends = np.searchsorted(which[order], np.arange(len(values) + 1))
    same = np.flatnonzero(np.diff(ends) > 1)
    for found in (np.stack([same, same], 1), *trie_pairs(values, HALF)):
        for at in range(0, len(found), 65536):
            x, y = found[at : at + 65536].T
            n, m = ends[x + 1] - ends[x], ends[y + 1] - ends[y]
            k = np.arange((n * m).sum()) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            m = np.repeat(m, n * m)
            i, j = order[np.repeat(ends[x], n * (ends[y + 1] - ends[y])) + k // m], order[np.repeat(ends[y], n * (ends[y + 1] - ends[y])) + k % m]
            ok = (root[i] != root[j]) & ((fp[i] != fp[j]) | (i < j))
            if side is not None:
                ok &= side[i] != side[j]
            i, j = i[ok], j[ok]
            far = np.bitwise_count(fp[i] ^ fp[j]) + np.bitwise_count(gp[i] ^ gp[j])
            near = far <= BUDGET
            if near.any():
                yield i[near], j[near], far[near]


def _groups(batches, n_columns: int):
    """(key, part, columns) of each run of equal (key, part) in sorted batches; only one is held at a time."""
    held: list = []
    whole = lambda: (*held[0][0], [pa.concat_arrays([x[k] for _, x in held]) for k in range(n_columns - 2)])
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, parts = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        cuts = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(parts) != 0)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            key = (int(keys[s]), int(parts[s]))
            if held and held[0][0] != key:
                yield whole()
                held = []
            held.append((key, [batch.column(i)[s:e] for i in range(2, n_columns)]))
    if held:
        yield whole()


def _hopeful(batches):
    """Of sorted rows (key, part, side, cross, node, fp, gp, root): those with a possible partner of another root in their task, of the other side where cross is set."""
    for key, part, cols in _groups(batches, 8):
        side, fp, gp, root = (cols[k].to_numpy() for k in (0, 3, 4, 5))
        hope = np.zeros(len(fp), bool)
        for i, j, _ in group_pairs(fp.view(np.uint64), gp.view(np.uint64), root, side if cols[1][0].as_py() else None):
            hope[i] = hope[j] = True
        if hope.any():
            keep = pa.array(np.flatnonzero(hope))
            n = len(keep)
            made = [pa.array([key] * n), pa.array([part] * n, pa.int32()), *[cols[k].take(keep) for k in (0, 1, 2, 5)]]
            yield pa.RecordBatch.from_arrays(made, names=["key", "part", "side", "cross", "node", "root"])


def joined_sets(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray | None, similarity: float):
    """Pairs (i, j) of sets as similar, that join different roots (of different sides, if given); a forest of them.

    One set is held against all others at once, by its marks in the group's vocabulary.
    """
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    root = np.unique(root, return_inverse=True)[1]
    marks = np.zeros(flat.max() + 1, np.int32)
    for i in range(len(sets)):
        ask = root != root[i]
        if side is not None:
            ask &= side != side[i]
        if not ask.any():
            continue
        own = flat[begin[i] : begin[i] + size[i]]
        marks[own] = 1
        common = np.add.reduceat(marks[flat], begin)
        marks[own] = 0
        for j in np.flatnonzero(ask & (common >= similarity * (size + size[i] - common))).tolist():
            if root[i] != root[j]:
                yield i, j
                root[root == root[j]] = root[i]


def _linker(width: int, similarity: float):
    """Over sorted rows (key, part, side, cross, node, root, packed): links (a, b) of each task."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        known: dict[int, np.ndarray] = {}
        for _, _, cols in _groups(batches, 7):
            side, node, root = (cols[k].to_numpy() for k in (0, 2, 3))
            if len(known) > SETS_KEPT:
                known.clear()
            for x, packed in zip(node.tolist(), cols[4].to_pylist()):
                if x not in known:
                    known[x] = np.unique(shingle_hashes(unpack(packed), width))
            sets = [known[x] for x in node.tolist()]
            found = list(joined_sets(sets, root, side if cols[1][0].as_py() else None, similarity))
            if found:
                a, b = node[np.array(found).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


#: The tasks of a row: a group of one part each is one task; else parts of the largest component (p of them) meet those of the others (q), and
#: these each other. own is the row's part among its like; a task's sides are what must meet.
TASKS = """
CASE WHEN p = 1 AND q = 1 THEN array(struct(0 AS part, 0 AS side, false AS cross))
WHEN root = most THEN transform(sequence(0, q - 1), j -> struct(own * q + j AS part, 0 AS side, true AS cross))
ELSE concat(transform(sequence(0, p - 1), i -> struct(i * q + own AS part, 1 AS side, true AS cross)),
  transform(sequence(0, q - 1), j -> struct(p * q + least(own, j) * q + greatest(own, j) AS part, CASE WHEN own <= j THEN 0 ELSE 1 END AS side, own <> j AS cross))) END"""


def _rest(members: DataFrame, roots: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) between texts of a group that are not in one component yet."""
    placed = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    groups = placed.groupBy("key").agg(
        F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m"), F.bit_xor("node").alias("s"), F.bit_xor(F.xxhash64("node")).alias("t")
    )
    # groups with the same members are taken once
    mixed = groups.filter("x <> y").groupBy("m", "s", "t").agg(F.min("key").alias("key")).select("key")
    mixed = materialise(placed.join(mixed, "key"), "similar-mixed")
    counts = mixed.groupBy("key", "root").count().groupBy("key")
    sizes = counts.agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.max("count").alias("major"), F.sum("count").alias("m"))
    parts = lambda n: F.ceil(n / GROUP_MOST).cast("int")
    sizes = sizes.select("key", "most", parts(F.col("major")).alias("p"), parts(F.col("m") - F.col("major")).alias("q"))
    sizes = materialise(sizes, "similar-sizes")  # written, so that the join deals a hot group anew
    dealt = mixed.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("root") == F.col("most"), F.col("p")).otherwise(F.col("q"))).cast("int"))
    dealt = dealt.select("key", "node", "root", F.inline(F.expr(TASKS))).join(nodes.select("node", "fp", "gp"), "node")
    dealt = dealt.select("key", "part", "side", "cross", "node", "fp", "gp", "root").repartition("key", "part").sortWithinPartitions("key", "part")
    hopeful = materialise(dealt.mapInArrow(_hopeful, "key long, part int, side int, cross boolean, node long, root long"), "similar-hopeful")
    # tasks with the same members are taken once: a pair shares many shingles, and most of its groups hold no other possible partners
    alike = hopeful.groupBy("key", "part").agg(F.count("*").alias("m"), F.bit_xor("node").alias("s"), F.bit_xor(F.xxhash64("node", "side", "cross")).alias("t"))
    once = alike.groupBy("m", "s", "t").agg(F.min(F.struct("key", "part")).alias("one")).select("one.*")
    asked = materialise(hopeful.join(once, ["key", "part"]), "similar-asked")
    texts = _texts_of(asked, nodes, rows)
    given = asked.join(texts, "node").select("key", "part", "side", "cross", "node", "root", "packed").repartition("key", "part").sortWithinPartitions("key", "part")
    links = materialise(given.mapInArrow(_linker(width, similarity), "a long, b long"), "similar-links")
    forget(mixed, sizes, hopeful, asked, texts)
    return links


def _grouped(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, key) of all prefixes, (key, least, m) of the keys that several nodes have)."""
    dealt = nodes.select("node", F.explode("keys").alias("key"))
    groups = dealt.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("least")).filter("m > 1")
    return dealt, materialise(groups, "similar-groups")  # written, as in _rest


def crowded(dealt: DataFrame, groups: DataFrame, roots: DataFrame) -> np.ndarray:
    """The shingles whose groups have over CROWD texts outside their largest component; there are at most FREQUENT_MOST such."""
    large = groups.filter(F.col("m") > CROWD)
    total = large.agg(F.sum("m")).first()[0]
    if not total:
        return np.empty(0, np.uint64)
    placed = dealt.join(large.select("key"), "key").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    sizes = placed.groupBy("key", "root").count().groupBy("key").agg((F.sum("count") - F.max("count")).alias("others"))
    found = sizes.filter(F.col("others") > max(CROWD, total // FREQUENT_MOST)).select("key").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def _again(nodes: DataFrame, rows: DataFrame, new: np.ndarray, frequent: np.ndarray, width: int, similarity: float) -> DataFrame:
    """nodes with new prefixes for those that had one of the shingles new, which are among the frequent ones by now."""
    gone = nodes.sparkSession.createDataFrame([(int(x),) for x in new.view(np.int64)], "key long")
    touched = materialise(nodes.select("rid", F.explode("keys").alias("key")).join(F.broadcast(gone), "key").select("rid").distinct(), "similar-touched")
    texts = rows.select("rid", "packed").join(touched, "rid")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            first = [prefix(np.unique(shingle_hashes(unpack(x.as_py()), width)), frequent, similarity) for x in batch.column(1)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in first])))
            flat = np.concatenate(first).view(np.int64) if first else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["rid", "keys"])

    made = texts.mapInArrow(run, "rid long, keys array<bigint>")
    moved = nodes.drop("keys").join(made, "rid").select(*nodes.columns)
    out = materialise(nodes.join(touched, "rid", "left_anti").select(*nodes.columns).unionByName(moved), "similar-nodes")
    forget(touched)
    return out


def classes(docs: DataFrame, id_col: str, text: str, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(id, digest of the text, root, component_id) of each row."""
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), F.col(text).alias("t"))
    frequent = frequent_shingles(given, width, "t")
    rows = _rows(given, {"id": "id", "digest": "digest"}, "t", width, similarity, frequent).withColumn("rid", F.monotonically_increasing_id())
    rows = materialise(rows, "similar-rows")
    one = rows.filter("n > 0").groupBy("node").agg(F.min("rid").alias("rid")).select("rid")
    nodes = materialise(rows.select("rid", "node", "n", "fp", "gp", "keys").join(one, "rid", "left_semi"), "similar-nodes")
    dealt, groups = _grouped(nodes)
    starred = materialise(dealt.join(groups.select("key", "least"), "key"), "similar-starred")
    first = starred.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    first = materialise(_possible(first, nodes, similarity), "similar-first")
    links = _confirmed(first, nodes, rows, width, similarity)
    members = materialise(starred.select("key", "node"), "similar-members")
    forget(starred, first)
    roots = components(links)
    for _ in range(ROUNDS):
        new = np.setdiff1d(crowded(dealt, groups, roots), frequent)
        if not len(new):
            break
        frequent = np.union1d(frequent, new)
        calmer = _again(nodes, rows, new, frequent, width, similarity)
        forget(nodes, groups, members)
        nodes = calmer
        dealt, groups = _grouped(nodes)
        members = materialise(dealt.join(groups.select("key"), "key").select("key", "node"), "similar-members")
    links = links.unionByName(_rest(members, roots, nodes, rows, width, similarity))
    forget(members, groups, roots)
    roots = components(links)
    found = rows.join(roots, "node", "left").select("id", "digest", F.coalesce("root", "node").alias("root"))
    found = materialise(found, "similar-found")
    forget(rows, nodes, links, roots)
    return found.join(found.groupBy("root").agg(F.min("id").alias("component_id")), "root")
