"""Long and awkward texts take seconds and bounded memory, with the same results."""

import random
import re
import time

import numpy as np
import pytest

from prospectra.llm import html_extract, secret_scan, token_counts, toxicity

ALNUM = "[A-Za-z0-9_-]"


def within(seconds, f):
    began = time.time()
    found = f()
    assert time.time() - began < seconds
    return found


def test_letters_before_a_login_or_a_token():
    text = "a" * 1_000_000 + "://u:pass@host.example " + "eyJ" * 300_000 + ".eyJ" + "a" * 20 + "." + "b" * 20
    scan = secret_scan.scanner()
    (found,) = within(20, lambda: scan([text.encode()]))
    kinds = {k: text[a:b] for k, a, b in found}
    assert kinds["url_login"].endswith("@host.example") and len(kinds["url_login"]) > 1_000_000
    assert kinds["web_token"].startswith("eyJeyJ") and kinds["web_token"].endswith("b" * 20)


def test_the_middle_finds_what_the_left_finds():
    rng = random.Random(8)
    plain = {
        "web_token": re.compile(rf"eyJ{ALNUM}{{10,}}\.eyJ{ALNUM}{{10,}}\.{ALNUM}{{10,}}", re.ASCII),
        "url_login": re.compile(r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]{3,}@[A-Za-z0-9.-]+", re.ASCII),
    }
    bits = ["eyJ", "a" * 10, "b" * 7, ".", "://", "u", ":", "pwd", "@", "h.ex", " ", "9+", "é", "-", "_"]
    rules = [r for r in secret_scan._compiled() if r[0] in plain]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 30)))
        for rule in rules:
            assert [s[1:] for s in secret_scan.find(text, [rule])] == [m.span() for m in plain[rule[0]].finditer(text)], text


def test_spans_of_many_toxic_words():
    text = "bé " * 500_000
    q = np.tile([0.9, 0.9, 0.1, 0.6], 125_000)
    spans = within(10, lambda: toxicity.spans_of(text, q))
    assert spans[:3] == [[0, 5], [9, 14], [18, 23]][:1] + spans[1:3] and len(spans) == 250_000 // 2 + 1
    word = list(re.finditer("bé", text))
    assert spans[0] == [0, word[1].end()] and spans[1] == [word[3].start(), word[5].end()] and spans[-1] == [word[-1].start(), word[-1].end()]


def test_a_page_of_100_000_blocks():
    page = "<article>" + "<p>some words of text.</p>" * 100_000 + "</article>"
    model = html_extract.BiLstm()
    within(60, lambda: html_extract.main_texts(model, [page] + ["<p>short</p>"] * 200))
    deep = "<div class='a b c d e f g h i j'>" * 3000 + "<p>x</p>"
    within(30, lambda: html_extract.main_texts(model, [deep]))


def test_the_whole_path_is_read():
    found = html_extract.blocks('<nav class="menu"><div class="a b c d e f g h i j"><p>x</p></div></nav>')
    bare = html_extract.blocks('<div class="a b c d e f g h i j"><p>x</p></div>')
    assert (html_extract.vectors(found)[0] != html_extract.vectors(bare)[0]).any()


@pytest.mark.parametrize("piece", ["x", "ab1", "日本", "a,b;", "<|", "'s"])
def test_counts_without_blanks(piece):
    tok = token_counts.load(token_counts.tokenizer_json())
    text = (piece * 1_000_000)[:1_000_000]
    n = len(tok.encode(text, add_special_tokens=False).ids)
    assert within(40, lambda: token_counts.counter(token_counts.tokenizer_json())([text.encode()])) == [n]
