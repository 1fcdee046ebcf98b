r"""Quality rules: a learned decision list over native text statistics.

The statistics are Spark expressions only.  The list is learned by sequential
covering from labelled rows: a rule is grown as a conjunction of thresholds by
information gain on the rows not covered yet, pruned on held-back rows, and
kept while it is precise there; the rows it covers leave.  The result is an
ordered list of conditions, emitted as one Spark CASE expression, so every
verdict can be read.

Only numbers of a bounded, documented sample of labelled rows come to the
driver (FIT_ROWS); statistics and verdicts cover every row.

Results for special cases: a null or empty text has no words, fails the base
rule and is not kept; an unlabelled or empty label table gives a list without
rules (everything that passes the base rule is kept); a row labelled more than
once takes its lowest label; equal rows each give a row; null ids pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise

SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = "[ \\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Labelled rows whose statistics the list is learned from, at most.
FIT_ROWS = 6_000
MIN_WORDS, MOST_REPEATED = 50, 50
FEATURES = ["symbol_ratio", "dup_line_ratio", "repeat_ratio", "mean_word", "upper_ratio", "mark_ratio", "digit_ratio", "distinct_ratio", "end_ratio"]
#: A rule must be right this often on held-back rows, and cover this many rows.
PRECISION, LEAST, MOST_RULES, MOST_TESTS = 0.9, 5, 12, 3


def _let(value: Column, body) -> Column:
    """body(value), evaluating value once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE_RE), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """How many words lie in a 3-word window that occurs more than once.

    Windows are compared by 64-bit hashes of their words.  Sorted by hash,
    repeated windows are neighbours; their starts, in order, each add the words
    that the next one doesn't.
    """
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    ordered = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))
    twice = lambda s: F.filter(
        F.transform(
            s,
            lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    starts = _let(ordered, lambda s: F.sort_array(twice(s)))
    total = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(w) >= 4, total).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, the base counts, and the ratios that rules may test."""
    t = F.coalesce(F.col(text), F.lit(""))
    less = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    letters = "".join(map(chr, range(65, 91)))
    marks, digits, ends = "!?|*", "0123456789", ".!?"
    both = _let(words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("distinct"),
    ))
    dup = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    held = docs.select(
        *keep, both.alias("__w"), dup.alias("__l"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"), less(SYMBOLS).cast("long").alias("n_symbols"),
        less(letters).alias("__upper"), less(marks).alias("__marks"), less(digits).alias("__digits"), less(ends).alias("__ends"),
    )
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n, chars = F.col("__w.n_words"), F.col("word_chars")
    return held.select(
        *keep, n.alias("n_words"), "word_chars", "n_symbols", F.col("__l.dup").alias("n_dup_lines"), F.col("__w.n_repeat_words").alias("n_repeat_words"),
        per(F.col("n_symbols"), chars).alias("symbol_ratio"), per(F.col("__l.dup"), F.col("__l.n")).alias("dup_line_ratio"),
        per(F.col("__w.n_repeat_words"), n).alias("repeat_ratio"), per(chars, n).alias("mean_word"),
        per(F.col("__upper"), chars).alias("upper_ratio"), per(F.col("__marks"), n).alias("mark_ratio"),
        per(F.col("__digits"), chars).alias("digit_ratio"), per(F.col("__w.distinct"), n).alias("distinct_ratio"),
        per(F.col("__ends"), n).alias("end_ratio"),
    )


def base_failed(min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


# ---- sequential covering, on the driver's bounded sample


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's information gain of covering p bad and n good rows, of p0 and n0."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _covers(rule, row) -> bool:
    return all(row[f] > x if op == ">" else row[f] <= x for f, op, x in rule)


def _grow(rows, names) -> list[tuple[str, str, float]]:
    """Add the threshold with the most gain until no good row is covered."""
    rule = []
    while len(rule) < MOST_TESTS:
        p0 = sum(r["bad"] for r in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for f in names:
            ordered = sorted(rows, key=lambda r: r[f])
            p = n = 0
            for a, b in zip(ordered, ordered[1:]):
                p, n = p + a["bad"], n + 1 - a["bad"]
                if a[f] == b[f]:
                    continue
                cut = (a[f] + b[f]) / 2
                for op, x, y in (("<=", p, n), (">", p0 - p, n0 - n)):
                    g = _gain(x, y, p0, n0)
                    if g > best[0] + 1e-9:
                        best = (g, (f, op, cut))
        if not best[1]:
            break
        rule.append(best[1])
        rows = [r for r in rows if _covers([best[1]], r)]
    return rule


def _worth(rule, rows) -> float:
    p = sum(r["bad"] for r in rows if _covers(rule, r))
    n = sum(1 - r["bad"] for r in rows if _covers(rule, r))
    return (p - n) / (p + n) if p + n else -1.0


def learn(rows: list[dict], names: list[str] = FEATURES) -> list[list[tuple[str, str, float]]]:
    """An ordered list of rules (conjunctions of thresholds) for bad rows.

    Two thirds of the rows grow rules and a third prunes them, dealt by turn.
    """
    rows = sorted(rows, key=lambda r: [r[f] for f in names] + [r["bad"]])
    grow, prune = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    rules: list = []
    while len(rules) < MOST_RULES and any(r["bad"] for r in grow):
        rule = _grow(grow, names)
        if not rule:
            break
        options = [rule[:k] for k in range(len(rule), 0, -1)]
        rule = max(options, key=lambda r: (_worth(r, prune), -len(r)))
        rest = prune + grow
        bad = sum(r["bad"] for r in rest if _covers(rule, r))
        all_ = sum(_covers(rule, r) for r in rest)
        if bad < LEAST or bad < PRECISION * all_ or _worth(rule, prune) < 2 * PRECISION - 1:
            break
        rules.append(rule)
        grow = [r for r in grow if not _covers(rule, r)]
        prune = [r for r in prune if not _covers(rule, r)]
    return rules


def rule_condition(rule) -> Column:
    out = F.lit(True)
    for f, op, x in rule:
        out = out & ((F.col(f) > x) if op == ">" else (F.col(f) <= x))
    return out


def decision(rules) -> Column:
    """The ordered list as one expression: the number of the first rule that fires, or 0."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule_condition(rule), F.lit(k)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> list:
    """Learn the list from at most rows labelled documents that pass the base rule.

    Which ones is decided by a hash of the id, the same at every size; of rows that share an id the least text counts.
    """
    marked = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label).alias("__y"))
    picked = marked.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    chosen = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(picked), "__id")
    chosen = chosen.groupBy("__id", "__y").agg(F.min("__t").alias("__t"))
    chosen = materialise(chosen, "quality-sample")  # so that statistics are made of these rows only, and once
    sample = statistics(chosen, ["__id", "__y"], "__t").filter(~base_failed())
    collected = sample.select((1 - F.col("__y")).cast("int").alias("bad"), *FEATURES).collect()
    forget(chosen)
    return learn([r.asDict() for r in collected])


def judge(docs: DataFrame, rules, keep: list[str], text: str = "text") -> DataFrame:
    """keep, the base counts, base_failed, kept, and the number of the rule that fired."""
    made = statistics(docs, keep, text).withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    kept = ~F.col("base_failed") & (F.col("rule") == 0)
    return made.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rule")


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return judge(docs, fit(docs, labels, id_col, text), [id_col], text)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that pass the base rule and the list, with their columns."""
    rules = fit(docs, labels, id_col, text)
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("t"))
    return judge(row, rules, ["row"], "t").filter("kept").select("row.*")
