"""Secret scans through a trigram inverted index.

Each rule's regular expression is analysed once into a Boolean query over
trigrams: a text that matches must satisfy it.  Each block of texts gets an
inverted index (trigram to the rows that hold it, lower case), the query is
answered by intersecting and uniting postings, and only candidate rows are
verified with the regular expression.  A rule without mandatory trigrams scans
every text.

Results for special cases: a null text counts as empty and has no secrets; a
rule reports leftmost non-overlapping matches that pass its length test; equal
rows each give a row; offsets are code points, end exclusive; texts are
searched whole.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as P
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: A key from its BEGIN through its END line; without an END, through the armour headers and base64 that follow: whole
#: lines (ended by a line feed or an escaped one) of any length, or runs of 20 characters and more.
PRIVATE_KEY = (
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:(?:[^-]|-(?!----(?:BEGIN|END) ))*+-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
    r"""|(?:(?:[\s>"',]|\\[nr])++(?:[A-Za-z][A-Za-z0-9-]*:\x20[^\n\\]*+(?=\n|\\n)|[A-Za-z0-9+/]{20,}+=*+|(?<=[\n>\x20\tnr])[A-Za-z0-9+/]++=*+(?=[\x20\t\r"',]*+(?:\n|\\[nr]|\Z))))*+)"""
)
#: kind, pattern, the group whose length counts, its least length. The first three are the base rules, in their order.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("map_key", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
    ("web_token", r"\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
    ("private_key", PRIVATE_KEY, 0, 1),
    ("url_login", r"://[^\s/:@]+:[^\s/:@]{3,}@[A-Za-z0-9.-]+", 0, 1),
]
#: Rules that are searched from their middle, as a search from the left would scan a long run of their first characters
#: anew at each: the characters that the part before may have, how it begins, and its least length.
BEFORE = {
    "web_token": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"), re.compile("eyJ"), 13),
    "url_login": (frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-"), re.compile("[a-z]"), 1),
}
BASE = ("assign", "access", "hex")
#: Sets of strings larger than this are given up for what they contain.
MOST = 64

# A query is True (all texts), or ("and" | "or", [queries]), or a trigram.


def _all(queries):
    queries = [q for q in queries if q is not True]
    return True if not queries else queries[0] if len(queries) == 1 else ("and", queries)


def _any(queries):
    return True if not queries or any(q is True for q in queries) else queries[0] if len(queries) == 1 else ("or", queries)


def _grams(strings):
    """The query that one of the strings occurs."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _literals(items):
    """The lower-case characters a class may match, or None if too many."""
    out = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 40:
            out.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(nodes):
    """(exact strings or None, query) of a sequence of parsed nodes."""
    done, run = [], {""}  # run: what the characters so far spell exactly
    whole = True

    def flush():
        nonlocal run
        done.append(_grams(run))
        run = {""}

    for op, arg in nodes:
        exact, query = None, True
        if op is C.LITERAL:
            exact = {chr(arg).lower()}
        elif op is C.IN:
            exact = _literals(arg)
        elif op is C.SUBPATTERN:
            exact, query = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            query = _any([q if e is None else _grams(e) for e, q in parts])
            if all(e is not None for e, _ in parts):
                exact = set().union(*(e for e, _ in parts))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, sub = arg
            e, q = _walk(sub)
            if e is not None and high == 1 and low == 0:
                exact = e | {""}
            elif e is not None and low == high and len(e) == 1:
                exact = {next(iter(e)) * low}
            elif low > 0:
                query = q if e is None else _grams(e)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = {a + b for a in run for b in exact}
            continue
        flush()
        whole = False
        if exact is not None and len(exact) <= MOST:
            run = exact
        else:
            done.append(query)
    if whole:
        return run, _grams(run)
    flush()
    return None, _all(done)


def trigram_query(pattern: str):
    """The Boolean trigram query that every match of pattern satisfies."""
    exact, query = _walk(P.parse(pattern))
    return query if exact is None else _grams(exact)


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class BlockIndex:
    """Postings of chosen trigrams over a block of texts."""

    CHUNK = 1 << 22

    def __init__(self, wanted: list[bytes]):
        self.table = np.full(1 << 24, -1, np.int16)
        self.wanted = wanted
        for i, g in enumerate(wanted):
            self.table[g[0] << 16 | g[1] << 8 | g[2]] = i
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each trigram, a mask of the texts that hold it."""
        found = np.zeros((len(self.wanted), len(texts)), bool)
        lengths = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(lengths)
        data = self.fold[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
        for at in range(0, max(len(data) - 2, 0), self.CHUNK):
            part = data[at : at + self.CHUNK + 2].astype(np.int32)
            which = self.table[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            where = np.flatnonzero(which >= 0)
            found[which[where], np.searchsorted(ends, where + at, side="right")] = True
        return found


def _answer(query, postings, number):
    if query is True:
        return np.ones(postings.shape[1], bool)
    if isinstance(query, str):
        return postings[number[query]]
    parts = [_answer(q, postings, number) for q in query[1]]
    return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def find(text: str, rules=None) -> list[tuple[str, int, int]]:
    """Every rule's matches in a text, without an index (for verifying)."""
    out = []
    for kind, regex, group, least in rules or _compiled():
        if kind in BEFORE:
            out += [(kind, a, b) for a, b in _from_the_middle(text, regex, *BEFORE[kind])]
        else:
            out += [(kind, *m.span()) for m in regex.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def _from_the_middle(text: str, regex, allowed, head, least):
    """Leftmost non-overlapping matches of a head, allowed characters (at least so many in all), and regex."""
    done = at = 0
    while m := regex.search(text, at):
        a = m.start()
        while a > done and text[a - 1] in allowed:
            a -= 1
        begin = head.search(text, a, m.start())
        if begin and m.start() - begin.start() >= least:
            yield begin.start(), m.end()
            done = at = m.end()
        else:
            at = m.start() + 1


def _compiled(rules=None):
    return [(k, re.compile(p, re.ASCII), g, n) for k, p, g, n in rules or RULES]


def scanner(rules=None):
    """A function from a batch of texts to each text's spans, by start and then rule order."""
    rules = rules or RULES
    compiled, rank = _compiled(rules), {k: i for i, (k, *_) in enumerate(rules)}
    queries = {k: trigram_query(p) for k, p, *_ in rules}
    names = sorted(set().union(*map(trigrams, queries.values())))
    index, number = BlockIndex([g.encode() for g in names]), {g: i for i, g in enumerate(names)}
    runs = re.compile(rb"[0-9a-f]{24}")  # a cheap test before the full scan of bytes as text

    def scan(texts: list[bytes | None]) -> list[list[tuple[str, int, int]]]:
        texts = [t or b"" for t in texts]
        postings = index.postings(texts)
        out: list[list] = [[] for _ in texts]
        for rule in compiled:
            query = queries[rule[0]]
            for i in np.flatnonzero(_answer(query, postings, number)):
                if rule[0] != "hex" or runs.search(texts[i]):
                    out[i] += find(texts[i].decode(), [rule])
        for spans in out:
            spans.sort(key=lambda s: (s[1], rank[s[0]]))
        return out

    return scan


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, the digest of their spans, all spans."""

    def start():
        scan = scanner()

        def work(texts):
            found = scan(texts)
            base = [[s for s in spans if s[0] in BASE] for spans in found]
            out = {f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in BASE}
            out["base_sha256"] = [sha256(joined(b).encode()).hexdigest() for b in base]
            out["spans"] = [joined(s) for s in found]
            return out

        return work

    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_texts(docs, text, schema, start, {id_col: id_col})


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """All columns of docs, with every secret in the text replaced by a mark.

    A text without secrets is untouched, null stays null.  Overlapping spans
    are replaced together.
    """

    def start():
        scan = scanner()

        def work(texts):
            out = []
            for text, spans in zip(texts, scan(texts)):
                if spans:
                    s, parts, at = text.decode(), [], 0
                    end = -1
                    for _, a, b in spans:
                        if a < end:
                            end = max(end, b)
                            continue
                        if end >= 0:
                            at = end
                        parts += [s[at:a], mark]
                        end = b
                    text = ("".join(parts) + s[end:]).encode()
                out.append(None if text is None else text.decode())
            return {"__new": out}

        return work

    names = docs.columns
    made = map_texts(docs, text, "`__new` string", start, {n: n for n in names if n != text})
    return made.select(*[made["__new"].alias(n) if n == text else made[n] for n in names])
