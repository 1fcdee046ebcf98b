"""Interaction of corpus filters: which documents each filter removes, under every order of the filters.

Exact duplicates are found by a sort: rows are dealt by ranges of (text
fingerprint, doc_id) and each range is sorted by fingerprint, full text and
doc_id, so that equal texts stand together and each row is compared with its
predecessor.  Ranges are cut by rows, not by texts, so a text with very many
copies fills several.  Where a fingerprint may go on across a boundary, the
texts at a range's end hand on their digest and least id, and the rows at a
range's start ask for theirs.  The same pass over the sorted texts tests the
other filters; texts are shuffled once and leave no task.

Every document ends as a mask of the filters that it fails.  Masks are counted
by part and label into counters, which add up in any order; all orders and
steps are read off these, of which a part has three sets of 32.

Special cases: a null text counts as empty; a null doc_id has no place among
the ids, so it neither makes a row a duplicate nor is one, and has no label;
rows that repeat a doc_id and text are duplicates only if a smaller id has the
text; of several labels of an id one that says 1 is enough; a null part counts
as the empty string.  An empty table gives no part.  Columns other than those
named are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import materialise, slices

#: The filters, the first with the lowest bit of a mask.
FILTERS = "ABCDE"
FEW_WORDS, DISTINCT, UPPER = 100, 80, 10
DUPLICATE = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)


def _marks(of: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(of)] = 1
    return out


CAPITALS, SYMBOLS, INNER = _marks(bytes(range(65, 91))), _marks(b"#$%&*|"), _marks(bytes(range(0x80, 0xC0)))


def _counts(marks: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    out, full = np.zeros(len(sizes), np.int64), sizes > 0
    if full.any():
        out[full] = np.add.reduceat(marks[data], starts[full], dtype=np.int64)
    return out


def masks(texts: pa.Array) -> np.ndarray:
    """Which of the filters A to D each text fails, as bits."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    n_words, n_distinct = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k, text in enumerate(texts):
        words = text.as_py().split()  # bytes.split() parts at ASCII white space, and only there
        n_words[k], n_distinct[k] = len(words), len(set(words))
    points = sizes - _counts(INNER, data, starts, sizes)
    failed = [
        n_words < FEW_WORDS, 100 * n_distinct < DISTINCT * n_words,
        100 * _counts(CAPITALS, data, starts, sizes) > UPPER * points, _counts(SYMBOLS, data, starts, sizes) > 0,
    ]
    return sum((f.astype(np.int32) << k for k, f in enumerate(failed)), np.zeros(len(sizes), np.int32))


def _compared(schema: pa.Schema):
    """A function over the batches of a sorted range; see marked()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = digest = begin = now = None  # of the row before: its text, that text's digest; the range's first fingerprint and the last seen
        least = None  # the least id of the row before's text
        tips: dict[str, object] = {}  # the texts of the fingerprint now, and their least ids
        for whole in batches:
            for a, b in slices(whole.column("text").cast(pa.large_binary())):
                part = whole.slice(a, b - a)
                texts, ids, prints = part.column("text").cast(pa.large_binary()), part.column("doc_id").to_pylist(), part.column("fp").to_pylist()
                same = [text is not None and texts[0].as_py() == text, *pc.equal(texts[1:], texts[:-1]).to_pylist()]
                newer, asks = [], []
                for k, (i, fp) in enumerate(zip(ids, prints)):
                    if not same[k]:
                        if fp != now:
                            now, tips = fp, {}
                            begin = fp if begin is None else begin
                        least, digest = i, hashlib.sha256(texts[k].as_py()).hexdigest()
                        tips[digest] = i
                    newer.append(i is not None and least is not None and i > least)
                    asks.append(digest if fp == begin else None)
                text = texts[len(ids) - 1].as_py()
                none = pa.nulls(len(ids), schema.field("least").type)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array(masks(texts)), pa.array(newer), pa.array(asks, pa.string()), none], schema=schema)
        if tips:
            rows = {"digest": list(tips), "least": list(tips.values())}
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(len(tips), f.type) for f in schema], schema=schema)

    return run


def marked(docs: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """(doc_id, part, mask) of every document."""
    given = docs.select(docs["doc_id"], F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.coalesce(docs[text], F.lit("")).alias("text"))
    given = given.withColumn("fp", F.xxhash64("text"))
    # the ranges' bounds are a sample of these columns that goes to the driver, so the text itself is only sorted within
    dealt = given.repartitionByRange("fp", F.col("doc_id").asc_nulls_last()).sortWithinPartitions("fp", "text", F.col("doc_id").asc_nulls_last())
    kind = given.schema["doc_id"].dataType
    made = f"doc_id {kind.simpleString()}, part string, mask int, newer boolean, digest string, least {kind.simpleString()}"
    schema = to_arrow_schema(given.sparkSession.createDataFrame([], made).schema)
    rows = materialise(dealt.mapInArrow(_compared(schema), made), "masks")
    tips = rows.filter("mask is null").groupBy("digest").agg(F.min("least").alias("before"))  # one row a range, or a few
    own = rows.filter("mask is not null").drop("least").join(F.broadcast(tips), "digest", "left")
    again = F.col("newer") | F.coalesce(F.col("doc_id") > F.col("before"), F.lit(False))
    return own.select("doc_id", "part", (F.col("mask") + F.when(again, DUPLICATE).otherwise(0)).alias("mask"))


def counters(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part: by mask the documents, the good and the toxic ones, in three arrays of longs."""
    told = labels.groupBy("doc_id").agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")])
    known = rows.join(told.filter("quality = 1 or toxic = 1"), "doc_id", "left")
    summed = known.groupBy("part", "mask").agg(F.count("*").alias("every"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("bad"))
    each = lambda c: F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(MASKS)]).alias(c)
    return summed.groupBy("part").agg(each("every"), each("good"), each("bad"))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, the filter's bit, the bits of those before it) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order, 1):
            out.append(("".join(FILTERS[i] for i in order), k, 1 << f, before))
            before |= 1 << f
    return out


def interaction(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """One row per part, order of the filters and step: what the filter of that step keeps and removes."""
    at = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(f).alias("own"), F.lit(b).alias("before")) for o, k, f, b in steps()])
    rows = counters(marked(docs, part, text), labels)
    each = rows.select("part", "every", "good", "bad", F.explode(at).alias("s")).select("part", "every", "good", "bad", "s.*")

    def total(name: str, counts: str, rule: str, times: str = "1"):
        """The counters of the masks m that rule picks, each so many times."""
        return F.expr(f"aggregate(filter(sequence(0, {MASKS - 1}), m -> {rule}), 0L, (s, m) -> s + {counts}[m] * {times})").alias(name)

    removed = "(m & before) = 0 and (m & own) != 0"
    orders = len(steps()) // len(FILTERS)
    return each.select(
        "part", "filter_order", "step",
        total("kept", "every", "(m & (before | own)) = 0"), total("removed", "every", removed),
        total("redundant", "every", "(m & before) != 0 and (m & own) != 0"), total("unique_fails", "every", "m = own"),
        total("good_lost", "good", removed), total("toxic_lost", "bad", removed),
        # in so many orders the filter comes first of those that a document of mask m fails
        total("shapley", "every", "(m & own) != 0", f"cast({orders} / bit_count(m) as long)"),
    )
