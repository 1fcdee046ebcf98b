"""Maximal periodic runs of words: a harmonic grid of longest common extensions.

A run of period p that holds two periods or more also holds two neighbours jp
and (j + 1)p of the grid of p's multiples.  So for each p every such pair is
asked how far the words from both on agree (a forward extension) and how far
those before both do (a backward one); together with p they make the run.
Extensions are range minima over the common prefixes of neighbours in the
suffix array of the words, and of the reversed words.  n words have about
n ln n grid pairs; a pair whose own words differ has the extension zero and is
not looked up.

Texts are handled in groups of about GROUP words.  Words are numbered anew in
each text, so no extension leaves its text, and one array serves the group.  A
longer text makes a group alone; it takes some 150 bytes a word.

Special cases: a null, empty or wordless text has no words, hence no run, and
collapses to an empty text; repeated rows each give a row; an empty table gives
an empty result.  A row keeps the columns named in ``keep``, whatever their
nulls; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: A run has at least so many words, and so many periods.
LEAST, TIMES = 6, 4
#: Words of texts that are handled together, and grid pairs that are looked up together.
GROUP, PAIRS = 1 << 16, 1 << 20
#: Windows of up to 2**STEP neighbours have their minima ready; longer ranges are made of blocks of that size.
STEP = 5

REPORT = (
    "n_runs long, start long, length long, period long, exponent_milli long, "
    "runs array<struct<start: long, length: long, period: long>>, collapsed string"
)


class Extensions:
    """How many words from two places on agree: a suffix array and range minima of its common prefixes."""

    def __init__(self, x: np.ndarray):
        self.n = n = len(x)
        levels = self._ranks(x)
        self.rank = levels[-1]
        order = np.empty(n, np.int32)
        order[self.rank] = np.arange(n, dtype=np.int32)
        self._windows(self._prefixes(levels, order[:-1].astype(np.int64), order[1:].astype(np.int64)))

    def _ranks(self, x: np.ndarray) -> list[np.ndarray]:
        """By prefix doubling: ranks of the prefixes of 1, 2, 4 ... words; equal prefixes share one. Only shared ranks are sorted again."""
        n, width = len(x), 1
        order = np.argsort(x, kind="stable")
        same = np.concatenate([[False], x[order][1:] == x[order][:-1]])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        rank = np.empty(n, np.int32)
        rank[order] = first
        levels, open_ = [rank], order[same | np.append(same[1:], False)]
        while len(open_):
            rank, after = levels[-1], open_ + width
            key = rank[open_].astype(np.int64) * (n + 1)
            key[after < n] += rank[after[after < n]] + 1
            turn = np.argsort(key, kind="stable")
            at, key = open_[turn], key[turn]
            old = rank[at]
            same = np.concatenate([[False], key[1:] == key[:-1]])
            here = np.arange(len(at))
            group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), here, 0))
            first = np.maximum.accumulate(np.where(same, 0, here))
            rank = rank.copy()
            rank[at] = old + (first - group)
            levels.append(rank)
            open_, width = at[same | np.append(same[1:], False)], width * 2
        return levels

    def _prefixes(self, levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common prefixes of suffixes a and b, from wide to narrow."""
        long = np.zeros(len(a), np.int32)
        for k in range(len(levels) - 1, -1, -1):
            u, v = a + long, b + long
            inside = np.nonzero((u < self.n) & (v < self.n))[0]
            hit = inside[levels[k][u[inside]] == levels[k][v[inside]]]
            long[hit] += 1 << k
        return long

    def _windows(self, common: np.ndarray) -> None:
        self.short = [common]
        for k in range(STEP):
            last, half = self.short[-1], 1 << k
            self.short.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last[:0])
        size = 1 << STEP
        whole = len(common) // size
        self.long = [common[: whole * size].reshape(whole, size).min(1)] if whole else []
        while self.long and len(self.long[-1]) > 1 << (len(self.long) - 1):
            last, half = self.long[-1], 1 << (len(self.long) - 1)
            self.long.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _log(count: np.ndarray) -> np.ndarray:
        return np.frexp(count.astype(np.float64))[1] - 1

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The extensions of places i and j, which differ."""
        u, v = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        a, b = np.minimum(u, v), np.maximum(u, v)  # the minimum of common[a:b]
        found = np.empty(len(a), np.int32)
        level = np.minimum(self._log(b - a), STEP)
        for k in range(STEP + 1):
            at = np.nonzero(level == k)[0]
            found[at] = np.minimum(self.short[k][a[at]], self.short[k][b[at] - (1 << k)])
        first, end = (a + (1 << STEP) - 1) >> STEP, b >> STEP
        far = np.nonzero((level == STEP) & (end > first))[0]
        if len(far):
            first, end = first[far], end[far]
            level = self._log(end - first)
            for k in np.unique(level):
                at = np.nonzero(level == k)[0]
                least = np.minimum(self.long[k][first[at]], self.long[k][end[at] - (1 << k)])
                found[far[at]] = np.minimum(found[far[at]], least)
        return found


def runs_of(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs in x, by start and period.

    x holds texts of the given sizes, the longest first, that share no number.
    """
    n, found = len(x), [np.empty((0, 3), np.int64)]
    ends = np.cumsum(sizes)
    top = int(sizes[0]) // TIMES if len(sizes) else 0
    forward = backward = None
    held: list[tuple[np.ndarray, int]] = []
    count = 0
    for p in range(1, top + 1):
        reach = int(ends[np.searchsorted(-sizes, -TIMES * p, side="right") - 1])  # of the texts that are long enough for p
        agree = np.nonzero(x[: reach - p : p] == x[p:reach:p])[0]
        if len(agree):
            held.append((agree * p, p))
            count += len(agree)
        if held and (count >= PAIRS or p == top):
            if forward is None:
                forward, backward = Extensions(x), Extensions(x[::-1])
            at = np.concatenate([i for i, _ in held])
            period = np.repeat([q for _, q in held], [len(i) for i, _ in held])
            ahead = forward(at, at + period).astype(np.int64)
            behind, inner = np.zeros(len(at), np.int64), np.nonzero(at > 0)[0]
            behind[inner] = backward(n - at[inner], n - at[inner] - period[inner])
            long = period + ahead + behind >= np.maximum(LEAST, TIMES * period)
            made = np.stack([(at - behind)[long], (at + period + ahead)[long], period[long]], 1)
            found.append(np.unique(made, axis=0))
            held, count = [], 0
    every = np.unique(np.concatenate(found), axis=0)
    # a stretch found with several periods has the smallest as its own, which divides the others
    own = np.concatenate([[True], (every[1:, :2] != every[:-1, :2]).any(1)]) if len(every) else np.empty(0, bool)
    every = every[own]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _groups(sizes: list[int]):
    """Rows in groups of about GROUP words, in order."""
    rows: list[int] = []
    total = 0
    for i, size in enumerate(sizes):
        if rows and total + size > GROUP:
            yield rows
            rows, total = [], 0
        rows.append(i)
        total += size
    if rows:
        yield rows


def text_runs(texts: list[bytes | None]) -> list[tuple[np.ndarray, list[bytes]]]:
    """For each text the (start, length, period) of its runs, by start and period, and its words."""
    words = [t.split() if t else [] for t in texts]  # bytes.split() parts at ASCII white space, and only there
    made: list[np.ndarray] = [np.empty((0, 3), np.int64)] * len(words)
    for rows in _groups([len(w) for w in words]):
        rows.sort(key=lambda i: -len(words[i]))
        rows = [i for i in rows if len(words[i]) >= LEAST]
        if not rows:
            continue
        parts, base = [], 0
        for i in rows:
            number = dict.fromkeys(words[i])
            for k, w in enumerate(number, base):
                number[w] = k
            base += len(number)
            parts.append(np.fromiter(map(number.__getitem__, words[i]), np.int32, len(words[i])))
        sizes = np.array([len(p) for p in parts])
        every = runs_of(np.concatenate(parts), sizes)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        cuts = np.searchsorted(every[:, 0], begins)
        for k, i in enumerate(rows):
            own = every[cuts[k] : cuts[k + 1]]
            made[i] = np.stack([own[:, 0] - begins[k], own[:, 1] - own[:, 0], own[:, 2]], 1)
    return list(zip(made, words))


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but for those of a run after its first period."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[i] for i in np.nonzero(np.cumsum(change)[:-1] == 0)[0])


def _report(texts: list[bytes | None]) -> dict[str, list | pa.Array]:
    found = text_runs(texts)
    best: list[list[int | None]] = []
    for runs, _ in found:
        if len(runs):  # quotients of such sizes are equal or differ in double precision too
            s, long, p = map(int, runs[np.lexsort((runs[:, 2], runs[:, 0], -(runs[:, 1] / runs[:, 2])))[0]])
            best.append([s, long, p, 1000 * long // p])
        else:
            best.append([None] * 4)
    flat = np.concatenate([r for r, _ in found]) if found else np.empty((0, 3), np.int64)
    spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    offsets = np.concatenate([[0], np.cumsum([len(r) for r, _ in found])]).astype(np.int32)
    return {
        "n_runs": [len(r) for r, _ in found],
        **{name: pa.array([b[k] for b in best], pa.int64()) for k, name in enumerate(("start", "length", "period", "exponent_milli"))},
        "runs": pa.ListArray.from_arrays(pa.array(offsets), spans),
        "collapsed": [collapse(words, runs).decode() for runs, words in found],
    }


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep and, per row, its runs, the one of the greatest exponent (four nulls without any) and the collapsed text."""
    keep = ["doc_id"] if keep is None else keep
    return map_texts(docs, text, REPORT, lambda: _report, {c: c for c in keep})


def digests(runs: DataFrame) -> DataFrame:
    """Runs and collapsed texts as SHA-256 digests of one line a run, and of the text."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = runs.withColumn("runs_sha256", F.sha2(F.array_join(line, ""), 256)).withColumn("collapsed_sha256", F.sha2("collapsed", 256))
    return out.drop("runs", "collapsed")


def repeating(docs: DataFrame) -> DataFrame:
    """(doc_id, text), the text made periodic from some word on in a tenth of all documents, which CRC-32 of the id picks; a null id picks none."""
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    split = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("words"))
    sized = split.select("*", F.size("words").cast("long").alias("n"), F.floor(F.col("h") / 10).alias("g"))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    a, n, words = F.col("a").cast("int"), F.col("n").cast("int"), F.col("words")
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    unit = F.slice(words, a + 1, F.least(p, n - a))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))
