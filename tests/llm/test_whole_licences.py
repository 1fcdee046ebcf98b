"""Whole licence texts are found damaged, wrapped and inside other text, and told from each other."""

import random

import pytest

from prospectra.llm import license_scan

WHOLE = license_scan.whole_texts()
SCAN = license_scan.Templates(license_scan.TEMPLATES | WHOLE, wholes=WHOLE)


def damaged(text, rng, lost):
    """Some words lost, some replaced, lines wrapped anew as comments, a foreign line here and there."""
    words = [w if rng.random() > lost / 2 else "word" + str(rng.randint(0, 999)) for w in text.split() if rng.random() > lost / 2]
    out, at = [], 0
    while at < len(words):
        n = rng.randint(5, 14)
        out.append(rng.choice(["# ", " * ", "// ", ""]) + " ".join(words[at : at + n]))
        at += n
        if rng.random() < 0.02:
            out.append("Page %d of a foreign header" % at)
    return "Some words before it.\n" + "\n".join(out) + "\nand words after it"


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_found_when_damaged(name):
    rng = random.Random(name)
    for lost in (0, 0.02, 0.05):
        found = SCAN.find(damaged(WHOLE[name], rng, lost).encode())
        top = max(found, key=lambda f: f[3] - f[2])
        assert top[0] == name and top[3] - top[2] > 0.9 * len(WHOLE[name])


def test_apache_without_its_appendix():
    text = WHOLE["apache-2.0"].split("APPENDIX:")[0]
    assert [f[0] for f in SCAN.find(text.encode()) if f[3] - f[2] > 5000] == ["apache-2.0"]


def test_ordinary_text_has_none():
    words = " ".join(WHOLE.values()).split()
    rng = random.Random(1)
    assert SCAN.find(" ".join(rng.sample(words, 20_000)).encode()) == []
    half = WHOLE["gpl-2.0"].split()
    assert not [f for f in SCAN.find(" ".join(half[: len(half) // 2]).encode()) if f[0] == "gpl-2.0"]
