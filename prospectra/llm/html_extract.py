"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks, each with the path of tags above it (with
class, id and role words) and its text.  A bidirectional LSTM in numpy reads a
vector for each block in page order (hashed path, hashed words, length, link
share), so every block is classified with the whole page as context.  The
blocks it calls content are joined.

It is trained here, on a bounded sample: real pages labelled by the elements
that name their role (article or main against nav, footer, ad and the like),
and the same texts laid out anew in many made-up page frames, half of which
don't use those elements.

Results for special cases: null, empty and tag-less pages follow the same path
(a page without blocks gives an empty text); unclosed and stray tags never
fail; scripts, styles and comments are never blocks; character references are
decoded; white space inside a block becomes one space; equal rows each give a
row; pages are read whole.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Pages that the labeller is trained on, at most, the most blocks of one, and a length in characters that they stay under.
FIT_PAGES, FIT_BLOCKS, FIT_CHARS = 240, 60, 50_000
PATH, WORDS, HIDDEN = 64, 32, 16
INPUT = PATH + WORDS + 6
STEPS, BATCH, RATE = 140, 24, 0.02
#: Blocks that the labeller reads at once, over all pages of a batch.
BLOCKS = 4096

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile(r"[>\"']")
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that never end a block, that hold no text, and whose content is not text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg iframe object canvas math".split())
#: Those whose content isn't markup: whatever it holds, it ends at the first end tag of the name.
RAW_END = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)[^>]*>?", re.I) for n in ("script", "style", "noscript", "iframe")}
#: Elements that an opening tag of the same kind closes first.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: What names a block's role, for labels of real pages.
GOOD, BAD = {"article", "main"}, set("nav header footer aside form button select ad ads advert sidebar menu banner cookie notice comments comment promo title head".split())


class Tags:
    """The tags, comments and declarations of a page, in order and in linear time.

    A tag ends at the first > outside quotes; where there is none, its < is
    text.  A quote that leads to no end is remembered, as is the next stop, so
    no stretch is read twice for tags that begin before it.
    """

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}
        self.dead: set[int] = set()
        self.stop = -1

    def end(self, at: int) -> int:
        """The place after the > that ends a tag whose attributes begin at a place; -1 if none does."""
        page, opened = self.page, []
        while at <= self.last[">"]:
            if self.stop < at:
                self.stop = STOP.search(page, at).start()  # one comes, as a > does
            stop = self.stop
            if page[stop] == ">":
                return stop + 1
            if stop in self.dead or self.last[page[stop]] == stop:
                opened.append(stop)
                break
            opened.append(stop)
            at = page.find(page[stop], stop + 1) + 1
        self.dead.update(opened)
        self.stop = opened[0] if opened else -1
        return -1

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the first from a place on; comments and declarations have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", "", ""
            if start > self.last[">"]:  # only a comment can follow
                at = page.find("<!--", start)
                if at < 0:
                    return None
                continue
            if page[start + 1] in "!?":
                return start, page.find(">", start) + 1, "", "", ""
            m = NAME.match(page, start)
            end = self.end(m.end()) if m else -1
            if end >= 0:
                return start, end, m[1], m[2].lower(), page[m.end() : end - 1]
            at = start + 1
        return None


class Block:
    """path: the hashed marks of all elements above, as bits; role: 1 if one names content, 2 if one names something else."""

    __slots__ = ("path", "role", "text", "links")

    def __init__(self, path: int, role: int, text: str, links: int):
        self.path, self.role, self.text, self.links = path, role, text, links


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # the open elements, each with the path and role of what it holds
    open_ = Counter()
    parts: list[str] = []
    links = at = 0
    link = None  # how many elements were open where a link that is still open began
    skip = ""
    tags = Tags(page)

    def flush():
        nonlocal parts, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(*(stack[-1][1:] if stack else (0, 0)), text, links))
        parts, links = [], 0

    def close(to: int):
        nonlocal link
        for name, _, _ in stack[to:]:
            open_[name] -= 1
        del stack[to:]
        if link is not None and link > to:
            link = None

    while tag := tags.after(at):
        start, end, slash, name, attributes = tag
        if start > at and not skip:
            piece = page[at:start]
            parts.append(piece)
            links += len(piece) * (link is not None)
        at = end
        if not name:
            continue
        if name in RAW_END and not slash and not attributes.endswith("/"):
            raw = RAW_END[name].search(page, at)
            at = raw.end() if raw else len(page)
            if not skip:
                flush()
            continue
        if skip:
            if slash and name == skip:
                skip = ""
            continue
        if name in INLINE:
            if name == "a":
                link = None if slash else len(stack)
            continue
        flush()
        if slash:
            if open_[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                skip = name
            continue
        if name in VOID:
            continue
        if name in CLOSES:
            while stack and stack[-1][0] in CLOSES[name]:
                close(len(stack) - 1)
        elif stack and stack[-1][0] == "p":
            close(len(stack) - 1)  # a block element ends a paragraph
        path, role = stack[-1][1:] if stack else (0, 0)
        marks = {name}
        for groups in NAMES.findall(attributes):
            marks.update("." + w for w in re.split(r"[^a-z0-9]+", "".join(groups).lower()) if w)
        for mark in marks:
            path |= 1 << crc32(mark.encode()) % PATH
        plain = {mark.lstrip(".") for mark in marks}
        stack.append((name, path, role | bool(plain & GOOD) | 2 * bool(plain & BAD)))
        open_[name] += 1
    if not skip and at < len(page):
        parts.append(page[at:])
    flush()
    return out


def vectors(found: list[Block]) -> np.ndarray:
    """One input vector for each block."""
    x = np.zeros((len(found), INPUT), np.float32)
    paths = np.array([b.path for b in found], "<u8").reshape(-1, 1)
    x[:, :PATH] = np.unpackbits(paths.view(np.uint8), axis=1, bitorder="little")
    for i, b in enumerate(found):
        words = b.text.split()
        hashed = np.bincount(np.fromiter((crc32(w.lower().encode()) % WORDS for w in words), np.int64, len(words)), minlength=WORDS)
        x[i, PATH : PATH + WORDS] = np.log1p(hashed) / 3
        n = len(b.text)
        x[i, -6:] = (np.log1p(len(words)) / 4, min(1.0, b.links / max(n, 1)), b.text[-1:] in ".!?\"", b.text.count(",") / len(words), i / 50, 1.0)
    x[:, -2] = np.minimum(x[:, -2], 1)
    return x


def label(b: Block) -> int:
    """1 if the elements above a block of a real page say that it is content."""
    return int(b.role == 1)


# ---- made-up frames


def frame(rng: random.Random, texts: list[str], words: list[str]) -> tuple[str, list[int]]:
    """A page of paragraphs in a random frame, and each block's label in page order."""
    out, labels = [], []
    some = lambda a, b: " ".join(rng.choices(words, k=rng.randint(a, b)))
    esc = html.escape

    def add(markup, *ys):
        out.append(markup)
        labels.extend(ys)

    def menu(tag, cls):
        n = rng.randint(2, 6)
        add(f"<{tag}{cls}><ul>" + "".join(f'<li><a href="/x">{esc(some(1, 2))}</a></li>' for _ in range(n)) + f"</ul></{tag}>", *[0] * n)

    def box(kind):
        tag = rng.choice(["div", "section", "aside"])
        name = rng.choice(kind)
        attr = rng.choice(["class", "id"])
        n = rng.randint(1, 3)
        add(f'<{tag} {attr}="{name}">' + "".join(f"<p>{esc(some(3, 18))}</p>" for _ in range(n)) + f"</{tag}>", *[0] * n)

    add(f"<html><head><title>{esc(some(2, 6))}</title></head><body>", 0)
    if rng.random() < 0.5:
        add(f"<header><h1>{esc(some(1, 4))}</h1></header>", 0)
    if rng.random() < 0.8:
        menu(*rng.choice([("nav", ""), ("div", ' class="menu"'), ("div", ' id="navigation"')]))
    for kind in (["ad", "advert", "ad-banner", "sponsored", "promo"], ["sidebar", "widget", "related"], ["cookie-notice", "notice", "banner", "alert", "newsletter"]):
        if rng.random() < 0.4:
            box(kind)
    tag, cls = rng.choice([("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main-content"'), ("div", ' class="entry"'), ("section", ' class="article-body"')])
    add(f"<{tag}{cls}><h1>{esc(some(2, 8))}</h1>", 1)
    for t in texts:
        kind = rng.choice(["p", "p", "p", "h2", "li", "blockquote", "td"])
        add({"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>"}.get(kind, f"<{kind}>{{}}</{kind}>").format(esc(t)), 1)
        if rng.random() < 0.05:
            box(["ad", "advert", "share", "newsletter"])
    inside = rng.random() < 0.5
    if not inside:
        add(f"</{tag}>")
    if rng.random() < 0.4:
        n = rng.randint(1, 4)
        add(f'<{rng.choice(["section", "div"])} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "replies"])}">' + "".join(f'<div class="comment"><p>{esc(some(3, 20))}</p></div>' for _ in range(n)) + "</section></div>", *[0] * n)
    if inside:
        add(f"</{tag}>")
    if rng.random() < 0.3:
        add(f'<form><label>{esc(some(1, 3))}</label><button>{esc(some(1, 2))}</button></form>', 0, 0)
    if rng.random() < 0.3:
        box(["sidebar", "widget", "related", "ad"])
    add(f"<footer>&copy; {esc(some(2, 12))}</footer></body></html>" if rng.random() < 0.7 else f'<div class="footer">&copy; {esc(some(2, 12))}</div></body></html>', 0)
    return "".join(out), labels


# ---- the network


class BiLstm:
    """Two LSTMs of HIDDEN cells over a sequence, one from each end, and a logistic layer."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.15, (INPUT, 4 * HIDDEN)).astype(np.float32)
            self.p["h" + d] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p["c" + d] = bias
        self.p["o"] = rng.normal(0, 0.15, 2 * HIDDEN).astype(np.float32)
        self.p["z"] = np.zeros(1, np.float32)

    @staticmethod
    def _sig(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, x, mask, d, keep):
        """x: time x batch x INPUT. Hidden states, and with keep what training needs."""
        w, r, c0 = self.p["x" + d], self.p["h" + d], self.p["c" + d]
        steps, batch = x.shape[:2]
        z = x @ w + c0
        h = c = np.zeros((batch, HIDDEN), np.float32)
        states, saved = np.empty((steps, batch, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = z[t] + h @ r
            i, f, o = (self._sig(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = (f * c + i * u) * m
            s = np.tanh(c_new)
            h_new = o * s * m
            if keep:
                saved.append((t, h, c, i, f, o, u, s, m))
            h, c = h_new, c_new
            states[t] = h
        return states, saved

    def probabilities(self, x, mask):
        hf, _ = self._run(x, mask, "f", False)
        hb, _ = self._run(x, mask, "b", False)
        return self._sig(np.concatenate([hf, hb], -1) @ self.p["o"] + self.p["z"])

    def gradients(self, x, mask, y):
        hf, sf = self._run(x, mask, "f", True)
        hb, sb = self._run(x, mask, "b", True)
        both = np.concatenate([hf, hb], -1)
        q = self._sig(both @ self.p["o"] + self.p["z"])
        e = (q - y) * mask / mask.sum()
        g = {"o": (both * e[..., None]).sum((0, 1)), "z": np.array([e.sum()], np.float32)}
        dh = e[..., None] * self.p["o"]
        for d, saved, part in (("f", sf, dh[..., :HIDDEN]), ("b", sb, dh[..., HIDDEN:])):
            r = self.p["h" + d]
            gz = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            gr = np.zeros_like(r)
            nh = nc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h0, c0, i, f, o, u, s, m in reversed(saved):
                dht = (part[t] + nh) * m
                dc = (dht * o * (1 - s * s) + nc) * m
                dg = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dht * s * o * (1 - o), dc * i * (1 - u * u)], 1)
                gz[t] = dg
                gr += h0.T @ dg
                nh, nc = dg @ r.T, dc * f
            g["x" + d] = x.reshape(-1, INPUT).T @ gz.reshape(-1, 4 * HIDDEN)
            g["h" + d], g["c" + d] = gr, gz.sum((0, 1))
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, seed: int = 3) -> BiLstm:
        """Adam steps on batches of (vectors, labels)."""
        rng = np.random.default_rng(seed)
        a = {k: np.zeros_like(v) for k, v in self.p.items()}
        b = {k: np.zeros_like(v) for k, v in self.p.items()}
        for n in range(1, steps + 1):
            x, mask, y = padded([pages[i] for i in rng.integers(0, len(pages), BATCH)])
            for k, g in self.gradients(x, mask, y).items():
                a[k] = 0.9 * a[k] + 0.1 * g
                b[k] = 0.99 * b[k] + 0.01 * g * g
                self.p[k] = self.p[k] - RATE * (a[k] / (1 - 0.9**n)) / (np.sqrt(b[k] / (1 - 0.99**n)) + 1e-6)
        return self


def padded(pages):
    steps = max(len(x) for x, _ in pages)
    x = np.zeros((steps, len(pages), INPUT), np.float32)
    mask, y = np.zeros((steps, len(pages)), np.float32), np.zeros((steps, len(pages)), np.float32)
    for i, (v, w) in enumerate(pages):
        x[: len(v), i], mask[: len(v), i], y[: len(v), i] = v, 1, w
    return x, mask, y


def train(pages: list[str], seed: int = 5) -> BiLstm:
    """Fit the labeller on real pages and on frames made from their texts."""
    rng = random.Random(seed)
    real = [found for p in pages if (found := blocks(p)[:FIT_BLOCKS])]
    texts = [b.text for found in real for b in found if label(b)] or ["Some text to read."]
    words = [w for t in texts[:2000] for w in t.split()[:50]]
    data = [(vectors(f), np.array([label(b) for b in f], np.float32)) for f in real]
    for _ in range(max(120, len(real))):
        page, ys = frame(rng, rng.choices(texts, k=rng.randint(0, 10)), words)
        found = blocks(page)
        if len(found) == len(ys):
            data.append((vectors(found), np.array(ys, np.float32)))
    return BiLstm().fit(data)


def fit(pages: DataFrame, page_id: str = "page_id", page: str = "html", most: int = FIT_PAGES) -> BiLstm:
    """Train on at most ``most`` pages, those with the smallest hash of their id.

    Ids are chosen first, four times as many as some pages are null or too
    long, and only chosen pages are read out, so what the driver gets has the
    same bound at every size.
    """
    ids = pages.select(F.xxhash64(page_id).alias("h")).distinct().orderBy("h").limit(4 * most)
    some = pages.filter(F.col(page).isNotNull() & (F.length(page) < FIT_CHARS)).select(F.xxhash64(page_id).alias("h"), F.col(page).alias("p"))
    rows = some.join(F.broadcast(ids), "h").orderBy("h", "p").limit(most).collect()
    return train([r["p"] for r in rows])


def main_texts(model: BiLstm, pages: list[str]) -> list[str]:
    """The content of each page; pages of like length are read together, at most BLOCKS blocks at once but for a longer page."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if found[i]), key=lambda i: len(found[i]))
    while order:
        n = 1
        while n < min(32, len(order)) and (n + 1) * len(found[order[n]]) <= BLOCKS:
            n += 1
        part, order = order[:n], order[n:]
        x, mask, _ = padded([(vectors(found[i]), 0) for i in part])
        q = model.probabilities(x, mask)
        for k, i in enumerate(part):
            out[i] = " ".join([b.text for b, p in zip(found[i], q[:, k]) if p >= 0.5])
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", model: BiLstm | None = None) -> DataFrame:
    """Per page: page_id, url, the main text, and its length in code points."""
    weights = pages.sparkSession.sparkContext.broadcast((model or fit(pages, page_id, page)).p)

    def start():
        own = BiLstm()
        own.p = weights.value

        def work(texts):
            made = main_texts(own, [(t or b"").decode() for t in texts])
            return {"text": made, "n_chars": [len(m) for m in made]}

        return work

    return map_texts(pages, page, "text string, n_chars long", start, {page_id: page_id, url: url})
