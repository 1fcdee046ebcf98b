"""Token counts that are exactly the tokenizer library's, for texts of any length.

A huge text is cut into overlapping chunks; each is encoded with offsets, and
the two encodings are spliced at a boundary in their overlap that is proven
stable: both have a token starting at the same place, one at which the
tokenizer always splits (after white space, or where two ASCII characters meet
that no piece holds together), and both go on with the same tokens to the end
of the overlap.  Where no such place exists, the overlap is widened, and then
the chunk doubled, so a text without any is encoded at most twice over.
Shorter texts are one chunk.  Between two such white spaces the encoding
depends on nothing else, so the counts of such pieces are remembered in a
worker (a bounded table, refilled when full) and the library is asked only for
pieces not seen before.

Results for special cases: a null text counts as empty: no bytes, no tokens;
special tokens' strings inside texts count as the library counts them; equal
rows each give a row.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_texts

#: Longer texts (in bytes) are cut into chunks of so many characters.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
#: Pieces whose counts a worker remembers.
MEMO = 400_000
LIMIT = 2048


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's file as text; its size is fixed, so it is broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    check_rules(text)
    return text


def load(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(text)
    tok.no_truncation()
    tok.no_padding()
    return tok


#: The only normaliser and pre-tokenizer for which splits are known.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def check_rules(text: str) -> None:
    """Refuse a tokenizer file whose rules for cutting texts are others."""
    spec = json.loads(text)
    cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    right = (spec.get("normalizer") or {}).get("normalizers") == NORMALISERS and cut[0].get("pattern") == {"Regex": PIECES} and len(cut) == 2 and cut[1].get("type") == "ByteLevel"
    if not right:
        raise ValueError("a tokenizer that normalises or cuts texts by other rules is not supported")


def _class(c: str) -> int:
    """Of an ASCII character: letter 1, digit 2, white space 3, other 4; 0 for any other character."""
    return 0 if c > "\x7f" else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 4


def is_stable(text: str, at: int, special: tuple[str, ...]) -> bool:
    """Whether the tokenizer always splits before text[at], whatever surrounds it."""
    a, b = text[at - 1], text[at]
    if a in " \n\t":
        return True
    x, y = _class(a), _class(b)
    if not x or not y or 3 in (x, y) or (x == y and x != 2) or (a == "'" and y == 1):
        return False
    return not any(s in text[max(0, at - len(s) + 1) : at + len(s) - 1] for s in special)


def encode_chunk(tok, text: str, start: int, end: int):
    """Ids and absolute starts of the tokens of text[start:end]."""
    e = tok.encode(text[start:end], add_special_tokens=False)
    return e.ids, [a + start for a, _ in e.offsets]


def splice(text: str, left, right, low: int, high: int, special: tuple[str, ...]):
    """Positions (i, j) where right may take over from left, or None.

    Both encodings must agree from there to the end of the left chunk, at
    least two pieces on, and the place must be stable.
    """
    lids, lat = left
    rids, rat = right
    rindex = {}
    for j, at in enumerate(rat):
        if at > high:
            break
        rindex.setdefault(at, j)
    for i in range(len(lat)):
        at = lat[i]
        if at <= low or at >= high or (i and lat[i - 1] == at) or not is_stable(text, at, special):
            continue
        j = rindex.get(at)
        if j is None:
            continue
        # the last piece of the left chunk may be cut; what precedes its last stable place must agree
        cut = high - 1
        while cut > at and not is_stable(text, cut, special):
            cut -= 1
        if cut <= at:
            return None
        n = sum(1 for a in lat[i:] if a < cut)
        if lids[i : i + n] == rids[j : j + n] and lat[i : i + n] == rat[j : j + n]:
            return i, j
    return None


def encode_long(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The ids of text, encoded in overlapping chunks and spliced."""
    special = tuple(t.content for t in tok.get_added_tokens_decoder().values())
    out: list[int] = []
    start, end = 0, min(chunk, len(text))
    left = encode_chunk(tok, text, start, end)
    while end < len(text):
        wide, seen, places = overlap, end, 0
        while True:
            begin = max(start, end - wide)
            places += sum(is_stable(text, p, special) for p in range(max(begin, 1), seen))
            seen = max(begin, 1)
            at = None
            if places > 1:  # else nothing can agree yet
                stop = min(len(text), max(end + 1, begin + chunk + wide))
                right = encode_chunk(tok, text, begin, stop)
                at = splice(text, left, right, begin, end, special)
            if at:
                out += left[0][: at[0]]
                left = (right[0][at[1] :], right[1][at[1] :])
                start, end = left[1][0] if left[1] else begin, stop
                break
            if begin == start:  # no place agrees: the chunk is doubled
                end = min(len(text), end + max(chunk, end - start))
                left = encode_chunk(tok, text, start, end)
                break
            wide *= 2
    return out + left[0]


@lru_cache(2)
def counter(tokenizer: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, memo: int = MEMO):
    """A function from UTF-8 texts to their numbers of tokens, one for each worker process."""
    tok = load(tokenizer)
    seen: dict[bytes, int] = {}

    def pieces(text: bytes) -> list[bytes]:
        return text.split()  # ASCII white space only, for bytes

    def count(texts: list[bytes | None]) -> list[int]:
        split = [None if t is None or len(t) > chunk else pieces(t) for t in texts]
        new = {p for ps in split if ps for p in ps if p not in seen}
        if len(seen) + len(new) > memo:
            seen.clear()
            new = {p for ps in split if ps for p in ps}
        new = list(new)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            found = tok.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)
            seen.update(zip(part, map(len, found)))
        out = []
        for text, ps in zip(texts, split):
            if ps is not None:
                out.append(sum(map(seen.__getitem__, ps)))
            else:
                out.append(len(encode_long(tok, text.decode(), chunk, overlap)) if text else 0)
        return out

    return count


def token_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Per document: n_bytes, n_tokens, and whether there are more tokens than limit."""
    given = docs.sparkSession.sparkContext.broadcast(tokenizer_json(path))

    def start():
        count = counter(given.value, chunk, overlap)

        def work(texts):
            n = count(texts)
            return {"n_bytes": [len(t or b"") for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return work

    return map_texts(docs, text, "n_bytes long, n_tokens long, over_limit boolean", start, {id_col: id_col})
