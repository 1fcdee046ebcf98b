"""Near-duplicate vectors by lattice hashing: random projections decoded to points of E8.

Equal vectors of a label are first gathered into one class.  In each of several
tables a vector is projected at random to a few blocks of eight numbers, and
every block is decoded to the nearest point of the lattice E8; the points
together, with the label, are the vector's cell.  A vector also enters the
neighbouring cells in which blocks take their second nearest point.  Vectors
that share a cell are compared by cosine in double precision.

Cells with one member go at once, and of cells with the same members one stays.
Members of a large cell are split into parts, and pairs of parts are dealt out
as tasks of bounded size.  A pair that shares several cells is counted in the
first alone, which a task sees from the cells that its members carry; so a
task returns a number of links and one edge a member, never its pairs.

A pair at the threshold is found in a block with probability FOUND.  More
blocks make cells finer, so their number follows the rows of the largest label;
the number of tables makes up for it, so that a pair at the threshold is missed
less often than MISSED, and a closer one hardly ever.

Special cases: a null, empty or zero vector, one with a null or non-finite
component and one without a label link with nothing; vectors of different
lengths do not link; repeated rows each give a row and are links of each other;
a null vec_id can only be the component's id if the whole component has none.
An empty table gives an empty result; columns other than those named are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import forget, materialise

COSINE = 0.98
#: The standard deviation of a unit vector's projection, in units of the lattice; its nearest points are the square root of 2 apart.
SCALE = 4.5 / 8
#: Measured over random pairs at a cosine of 0.98: how often two vectors share a point in a block, and so many of random ones do.
FOUND, CROWD = 0.89, 0.007
#: The share of pairs at the threshold that may be missed, and the random members that a vector's cell may have.
MISSED, COMPANY = 0.001, 8
#: Members of a part of a large cell, and of a cell that is not split.
PART, WHOLE = 256, 512


def shape(most: int) -> tuple[int, int]:
    """(blocks, tables) for labels of so many rows at most."""
    blocks = max(2, math.ceil(math.log(max(most, 1) / COMPANY) / -math.log(CROWD)))
    return blocks, math.ceil(math.log(MISSED) / math.log(1 - FOUND**blocks))


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps from a point to its neighbours."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[[i, j]] = a, b
            out.append(v)
    halves = [np.array(s) for s in product((0.5, -0.5), repeat=8)]
    return np.array(out + [h for h in halves if np.count_nonzero(h < 0) % 2 == 0])


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points whose coordinates have an even sum."""
    near = np.rint(x)
    odd = np.nonzero(near.sum(1) % 2)[0]
    off = (x - near)[odd]
    worst = np.abs(off).argmax(1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which are those of D8 and of D8 moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def two_nearest(x: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """(rows, 2, 8): the nearest point, and the neighbour that comes next."""
    near = decode(x)
    return np.stack([near, near + steps[((x - near) @ steps.T).argmax(1)]], 1)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit number of two, well mixed (the finishing steps of SplitMix64 over their sum)."""
    z = a * np.uint64(0x9E3779B97F4A7C15) + b
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def units(x: np.ndarray) -> np.ndarray:
    """Vectors of one length, each divided by its norm; scaled first, so that nothing overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells(x: np.ndarray, label: np.ndarray, blocks: int, tables: int, seed: int = 13) -> np.ndarray:
    """(rows, tables * 2 ** blocks) of 64-bit names of the cells that unit vectors enter."""
    size, steps, out = x.shape[1], roots(), []
    rng = np.random.default_rng([seed, size])
    for t in range(tables):
        names = [_mixed(np.full(len(x), (t << 40) + size, np.uint64), label.view(np.uint64))]
        for _ in range(blocks):
            points = (2 * two_nearest(x @ rng.normal(0.0, SCALE, (size, 8)), steps)).astype(np.int64).view(np.uint64)
            grown = []
            for name in names:
                for k in range(2):
                    made = name
                    for i in range(8):
                        made = _mixed(made, points[:, k, i])
                    grown.append(made)
            names = grown
        out += names
    return np.stack(out, 1).view(np.int64)


def _entries(blocks: int, tables: int):
    """From classes to one row for each cell that a class enters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, label = batch.column("vector"), batch.column("lab").to_numpy()
            sizes = vectors.value_lengths().to_numpy()
            for size in np.unique(sizes):
                every = np.nonzero(sizes == size)[0]
                for rows in np.split(every, range(4096, len(every), 4096)):
                    flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                    named = cells(units(flat.reshape(len(rows), size)), label[rows], blocks, tables)
                    again = pa.array(np.repeat(rows, named.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(named.ravel()), batch.column("h1").take(again), batch.column("h2").take(again)], names=["cell", "h1", "h2"])

    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first row that it reaches."""
    root = np.full(len(linked), -1)
    for at in range(len(linked)):
        if root[at] < 0:
            reached = front = np.arange(len(linked)) == at
            while front.any():
                front = linked[front].any(0) & ~reached
                reached = reached | front
            root[reached] = at
    return root


def _linked(x: np.ndarray, label: np.ndarray, side: np.ndarray, cross: bool, names: list[np.ndarray], cell: int, cosine: float) -> np.ndarray:
    """Which members of a cell link there, and in no cell of a smaller name."""
    near = (x @ x.T >= cosine) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    if cross:
        near &= side[:, None] != side[None, :]
    if near.any():
        before = [n[n < cell] for n in names]
        all_names, at = np.unique(np.concatenate(before), return_inverse=True)
        if len(all_names):
            inside = np.zeros((len(x), len(all_names)), np.float32)
            inside[np.repeat(np.arange(len(x)), [len(b) for b in before]), at] = 1
            near &= inside @ inside.T == 0
    return near


def _groups(cosine: float):
    """From members sorted by task to (class, links, root) rows; a task's members fit into memory and may lie in two batches or more."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key = [t.column(c).to_numpy() for c in ("cell", "i", "j")]
        new = np.nonzero(np.any([k[1:] != k[:-1] for k in key], 0))[0] + 1
        column = {c: t.column(c).to_numpy() for c in ("h1", "h2", "lab", "p", "n")}
        vectors, names, ids = (t.column(c).combine_chunks() for c in ("vector", "cells", "id"))
        sizes = vectors.value_lengths().to_numpy()
        for at in np.split(np.arange(t.num_rows), new):
            for size in np.unique(sizes[at]):
                rows = at[sizes[at] == size]
                if len(rows) < 2:
                    continue
                flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                cell, i, j = (int(k[at[0]]) for k in key)
                own = [n.values.to_numpy() for n in names.take(pa.array(rows))]
                near = _linked(units(flat.reshape(len(rows), size)), column["lab"][rows], column["p"][rows], i != j, own, cell, cosine)
                links = near @ column["n"][rows]
                some = np.nonzero(links)[0]
                if len(some):
                    root = rows[_forest(near)[some]]
                    some = rows[some]
                    made = [pa.array(m) for m in (column["h1"][some], column["h2"][some], links[links > 0], column["h1"][root], column["h2"][root])]
                    yield pa.RecordBatch.from_arrays([*made, ids.take(pa.array(some)), ids.take(pa.array(root))], names=["h1", "h2", "links", "r1", "r2", "id", "rid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            last = np.nonzero(np.any([(k := held.column(c).to_numpy())[1:] != k[:-1] for c in ("cell", "i", "j")], 0))[0]
            if len(last):
                yield from work(held.slice(0, last[-1] + 1))
                held = held.slice(last[-1] + 1)
        if held is not None and held.num_rows:
            yield from work(held)

    return run


def usable(vector: Column, label: Column) -> Column:
    """Whether a row can link at all."""
    x = vector.cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(x) > 0) & ~odd & F.exists(x, lambda v: v != 0), F.lit(False))


def near_vectors(rows: DataFrame, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    given = rows.select(rows[vec_id].alias("vec_id"), rows[vector].cast("array<double>").alias("vector"), rows[label].alias("label"), usable(rows[vector], rows[label]).alias("usable"))
    named = given.withColumns({"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64(F.lit(1), "vector", "label"), "lab": F.xxhash64("label")})
    good = named.filter("usable")
    # a class is known by 128 bits; of its rows only their number and least id go on
    grouped = good.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("vec_id").alias("id"), F.first("lab").alias("lab"), F.first("vector").alias("vector"))
    classes = materialise(grouped, "classes")
    most = classes.groupBy("lab").count().agg(F.max("count")).first()[0] or 0
    entered = materialise(classes.select("h1", "h2", "lab", "vector").mapInArrow(_entries(*shape(most)), "cell long, h1 long, h2 long"), "cells")

    told = [F.bit_xor(c) for c in (F.col("h1"), F.col("h2"), F.xxhash64("h1", "h2"))]
    sized = entered.groupBy("cell").agg(F.count("*").alias("size"), *[x.alias(f"x{k}") for k, x in enumerate(told)]).filter("size > 1")
    kept = sized.groupBy("size", "x0", "x1", "x2").agg(F.min("cell").alias("cell")).select("cell", "size")
    inside = entered.join(kept, "cell").groupBy("h1", "h2").agg(F.collect_list(F.struct("cell", "size")).alias("at"))  # no more than a vector enters

    parts = F.when(F.col("size") <= WHOLE, 1).otherwise(F.ceil(F.col("size") / PART)).cast("int")
    members = classes.join(inside, ["h1", "h2"]).select("h1", "h2", "id", "lab", "n", "vector", F.col("at.cell").alias("cells"), F.explode("at").alias("one"))
    members = members.select("*", "one.*").withColumn("parts", parts).withColumn("p", F.pmod("h1", "parts").cast("int"))
    q = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")
    dealt = members.select("cell", "h1", "h2", "id", "lab", "n", "vector", "cells", "p", q).select(
        "cell", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "h1", "h2", "id", "lab", "n", "vector", "cells", "p"
    )
    tasks = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    kind = classes.schema["id"].dataType.simpleString()
    found = materialise(tasks.mapInArrow(_groups(cosine), f"h1 long, h2 long, links long, r1 long, r2 long, id {kind}, rid {kind}"), "links")

    links = found.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    # nodes are ordered by their ids, those without one last, so the least node of a component has its least id
    node = lambda i, a, b: F.struct(F.col(i).isNull().alias("z"), F.col(i).alias("id"), F.col(a).alias("h1"), F.col(b).alias("h2"))
    edges = found.select(node("id", "h1", "h2").alias("a"), node("rid", "r1", "r2").alias("b")).filter("a != b")
    root = components(edges).select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), F.col("root.id").alias("least"), F.lit(True).alias("joined"))
    ids = classes.select("h1", "h2", "n", "id")
    per_class = ids.join(links, ["h1", "h2"], "left").join(root, ["h1", "h2"], "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("joined"), F.col("least")).otherwise(F.col("id")).alias("component_id")
    )
    per_class = materialise(per_class, "classes")
    forget(classes, entered, found)
    linked = good.select("vec_id", "h1", "h2").join(per_class, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = given.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
