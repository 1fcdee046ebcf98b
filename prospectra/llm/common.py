"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import clear, forget, shared_dir  # noqa: F401
from ..operators.scratch import written as materialise  # noqa: F401

#: Rows, and bytes of text, that a function gets at once; a longer text comes alone.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20

#: Rows of a table of one or two numbers that may be sent to every task, some 30 MB there.
FEW = 500_000


def sent(table: DataFrame) -> DataFrame:
    """A written table of ids, marked to be sent to every task if a count shows that it has FEW rows; beyond, its join shuffles both sides."""
    return F.broadcast(table) if table.count() <= FEW else table


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of bounded numbers and bytes, in order."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(size):
        to = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(size, done + SLICE_BYTES, side="right"))))
        yield at, to
        at, done = to, int(size[to - 1])


def map_texts(
    df: DataFrame,
    text: str,
    schema: str,
    start: Callable[[], Callable[[list[bytes | None]], dict[str, list] | list]],
    keep: dict[str, str] | None = None,
    expand: bool = False,
) -> DataFrame:
    """Add Python-computed columns to rows, batch by batch, without a shuffle.

    ``start`` runs once in each task and returns a function from a batch of
    UTF-8 texts to lists of new columns.  ``keep`` maps output names to input
    columns carried along; ``schema`` describes the new columns.  With
    ``expand`` the function also returns, under the key ``""``, the row number
    that each of its rows belongs to, so a row may give none or many.
    """
    keep = keep or {}
    cols = [df[c].alias(f"k{i}") for i, c in enumerate(keep.values())]
    given = df.select(*cols, df[text].alias("t"))
    fields = [f"`{n}` {given.schema[f'k{i}'].dataType.simpleString()}" for i, n in enumerate(keep)]
    out_schema = ", ".join([*fields, schema])
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for whole in batches:
            column = whole.column(len(names)).cast(pa.binary())
            for a, b in slices(column):
                made = work(column[a:b].to_pylist())
                kept = [whole.column(i)[a:b] for i in range(len(names))]
                if expand:
                    rows = pa.array(made.pop(""), pa.int64())
                    kept = [k.take(rows) for k in kept]
                arrays = [v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=[*names, *made])

    return given.mapInArrow(run, out_schema)
