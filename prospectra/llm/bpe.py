"""BPE encoding by backtracking over longest matches, decoding by an offset table.

An Aho-Corasick automaton over the vocabulary finds every token that occurs in
a word.  The encoder takes the longest match at each place and checks it
against the token before it: a pair is compatible if merging in rank order
would keep that boundary, which the pair table (the merges) and the tokens'
own splits decide.  An incompatible match is replaced by the next shorter, or
the encoder steps back, never visiting a place twice.  So the merges are
exact and the time is linear in the word's length.

Words between ASCII white space are encoded independently of each other, so
their ids are remembered in a worker (a bounded table, refilled when full).

Results for special cases: a null text counts as empty (no ids, empty decoded
text); special tokens' strings inside a text become their ids, as in the
library; equal rows each give a row; texts are encoded whole.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import regex
from pyspark.sql import DataFrame

from .common import map_texts
from .token_counts import tokenizer_json

#: Words and pieces whose ids a worker remembers.
MEMO = 500_000
END = "\n"  # the end of a word, as a character that no token holds
NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    more = 256
    for b in range(256):
        if b not in shown:
            shown[b] = chr(more)
            more += 1
    return [shown[b] for b in range(256)]


class Remembered(dict):
    """Answers of a function of pairs, in a table that is emptied when full."""

    def __init__(self, f, most: int = 1 << 18):
        self.f, self.most = f, most

    def __missing__(self, pair):
        if len(self) >= self.most:
            self.clear()
        found = self[pair] = self.f(*pair)
        return found


class Bpe:
    """Encoder and decoder of a byte-level BPE tokenizer with word ends, from its JSON file."""

    def __init__(self, text: str, memo: int = MEMO):
        spec = json.loads(text)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        form = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        tokens = {form(t): i for t, i in vocab.items()}
        # rank 0..: the atoms, then the merges in their order
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {form(a + b) for a, b in merges}
        atoms = [t for t in tokens if t not in made]
        rank = {t: r for r, t in enumerate(atoms)}
        self.split = [(r, r) for r in range(len(atoms))]
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            r = len(self.split)
            pair = rank[form(a)], rank[form(b)]
            rank[form(a + b)] = r
            self.split.append(pair)
            self.pairs[pair] = r
        self.ids = [0] * len(rank)
        for t, r in rank.items():
            self.ids[r] = tokens[t]
        self.length = [0] * len(rank)
        self.automaton = ahocorasick.Automaton()
        for t, r in rank.items():
            self.length[r] = len(t)
            self.automaton.add_word(t, r)
        self.automaton.make_automaton()
        self.compatible = Remembered(self._compatible).__getitem__
        # the offset table: token i is blob[offsets[i]:offsets[i + 1]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: t for t, i in (vocab | special).items()}
        self.offsets, parts = [0], []
        for i in range(max(by_id) + 1):
            parts.append(by_id.get(i, "").encode())
            self.offsets.append(self.offsets[-1] + len(parts[-1]))
        self.blob = b"".join(parts)
        self.special = special
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
        self.alphabet = byte_alphabet()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word_re = regex.compile(pattern)
        self.memo: dict[bytes, tuple[bytes, bytes]] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.most = memo

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging in rank order keeps the boundary between tokens a and b."""
        pairs, split, limit = self.pairs, self.split, NEVER
        while True:
            if pairs.get((a, b), NEVER) < limit:
                return False
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        return True

    def encode_word(self, word: str) -> list[int]:
        """The ranks of one word (byte characters and END)."""
        n, length, compatible = len(word), self.length, self.compatible
        matches: list[list[int]] = [[] for _ in word]
        for end, r in self.automaton.iter(word):
            matches[end - length[r] + 1].append(r)  # ends ascend, so lengths do
        out: list[int] = []
        left: list[list[int]] = []  # for each token taken, the shorter matches at its place
        closed = set()
        at, last, here = 0, -1, matches[0]
        while True:
            while here:
                r = here[-1]
                if (last < 0 or compatible((last, r))) and at + length[r] not in closed:
                    break
                here.pop()
            if here:
                out.append(r)
                at += length[r]
                if at == n:
                    return out
                left.append(here)
                last = r
                here = matches[at][:]
            elif out:
                closed.add(at)
                at -= length[out.pop()]
                here = left.pop()
                last = out[-1] if out else -1
            else:
                raise ValueError("a symbol is not in the vocabulary")

    def _word(self, word: str) -> tuple[bytes, bytes]:
        """A word's ids and decoded text, remembered."""
        letters = word if word.isascii() and word.isprintable() else "".join([self.alphabet[b] for b in word.encode()])
        ids = [self.ids[r] for r in self.encode_word(letters + END)]
        if len(self.words) >= self.most:
            self.words.clear()
        found = self.words[word] = (little(ids), self.decode(ids))
        return found

    def encode_piece(self, piece: str) -> tuple[bytes, bytes]:
        """The ids and decoded text of any text, without the memo of pieces."""
        out = []
        get, slow = self.words.get, self._word
        for part in self.special_re.split(piece) if "<" in piece else [piece]:
            if part in self.special:
                i = [self.special[part]]
                out.append((little(i), self.decode(i)))
                continue
            text = part.lower()
            if not part.isascii():  # the library lowers each character by itself
                text = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", part))
                text = text.lower() if "\u03a3" not in text else "".join([c.lower() for c in text])
            if text.isalpha() and text.isascii():
                out.append(get(text) or slow(text))
            else:
                out += [get(w) or slow(w) for w in self.word_re.findall(text)]
        return out[0] if len(out) == 1 else (b"".join([x for x, _ in out]), b" ".join([y for _, y in out]))

    def _remembered(self, piece: bytes) -> tuple[bytes, bytes]:
        found = self.encode_piece(piece.decode())
        if len(self.memo) >= self.most:
            self.memo.clear()
        self.memo[piece] = found
        return found

    def encode(self, text: bytes | None) -> tuple[bytes, bytes]:
        """The ids as little-endian 32-bit integers, and the decoded text."""
        get, slow = self.memo.get, self._remembered
        found = [get(p) or slow(p) for p in (text or b"").split()]
        return b"".join([x for x, _ in found]), b" ".join([y for x, y in found if x])

    def decode(self, ids) -> bytes:
        """Tokens' strings from the offset table, joined as the library joins them without a decoder."""
        blob, offsets = self.blob, self.offsets
        return b" ".join([blob[offsets[i] : offsets[i + 1]] for i in ids])


@lru_cache(2)
def loaded(text: str) -> Bpe:
    """One encoder for each worker process, so that its memo outlives a task."""
    return Bpe(text)


def little(ids: list[int]) -> bytes:
    packed = array("I", ids)
    return packed.tobytes()


def bpe_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, carry: list[str] | None = None, ids: bool = False) -> DataFrame:
    """Per document: n_tokens and the digests of the ids and of the decoded text; with ids also the ids.

    carry: further columns to keep.
    """
    import numpy as np
    import pyarrow as pa

    given = docs.sparkSession.sparkContext.broadcast(tokenizer_json(path))

    def start():
        bpe = loaded(given.value)

        def work(texts):
            made = [bpe.encode(t) for t in texts]
            out = {
                "n_tokens": [len(x) // 4 for x, _ in made],
                "ids_sha256": [sha256(x).hexdigest() for x, _ in made],
                "decoded_sha256": [sha256(y).hexdigest() for _, y in made],
            }
            if ids:
                out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x, _ in made], pa.list_(pa.int32()))
            return out

        return work

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return map_texts(docs, text, schema, start, {id_col: id_col} | {c: c for c in carry or []})
