"""Licence runs against the coefficients of all runs of words."""

import random

import pytest

from prospectra.llm import license_scan as L


def brute(templates, t, text):
    """The best coefficient of any run of words with each template, where it reaches t."""
    words, out = L.words_of(text.encode()), {}
    for name, x in templates.items():
        g = L.bigrams(L.words_of(x.encode()))
        best = max((L.dice(g, L.bigrams(words[i:j])) for i in range(len(words)) for j in range(i + 2, len(words) + 1)), default=0.0)
        if best >= t:
            out[name] = best
    return out


def test_every_run_is_considered():
    rng = random.Random(2)
    for _ in range(300):
        vocabulary = [f"w{i}" for i in range(rng.randint(2, 9))]
        some = lambda n: " ".join(rng.choices(vocabulary, k=n))
        templates = {f"t{k}": some(rng.randint(2, 14)) for k in range(3)}
        text = " ".join([some(rng.randint(0, 6)), templates["t0"], some(rng.randint(0, 3)), *templates["t1"].split()[:-1], some(rng.randint(0, 5))])
        text = " ".join("zz" if rng.random() < 0.08 else w for w in text.split())
        scan = L.Templates(templates, 0.8)
        words = L.words_of(text.encode())
        grams = list(zip(words, words[1:]))
        got = {}
        for name in scan.grams:
            d = [x[0] for x in scan.runs(name, grams, [i for i, k in enumerate(grams) if k in scan.grams[name]])]
            if d:
                got[name] = max(d)
        want = brute(templates, 0.8, text)
        assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want), text
        found = scan.find(text.encode())
        assert bool(found) == bool(want)
        if want:
            assert abs(max(f[1] for f in found) - max(want.values())) < 1e-9
            assert all(a[3] <= b[2] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("text,want", [
    ("This file is Released under the MIT License and may be copied by anyone who likes to do so", ["mit-notice"]),
    ("a module which is licensed under the Apache License, Version 2.0, was added", ["apache-2.0-notice"]),
    ("Licensed under CC BY-NC 4.0. and then Released under the MIT License.", ["cc-by-nc-4.0-notice", "mit-notice"]),
    ("the work is under a licence of its own", []),
])
def test_notices_inside_sentences(text, want):
    assert [f[0] for f in L.Templates(L.TEMPLATES).find(text.encode())] == want


@pytest.mark.parametrize("name", sorted(L.TEMPLATES))
def test_each_template_is_found_broken_and_changed(name):
    rng = random.Random(name)
    words = L.TEMPLATES[name].split()
    if len(words) > 30:
        words = [w for w in words if rng.random() > 0.02]
        words.insert(len(words) // 2, "Copyright 2020 Someone\n\n Page 7")
    text = " ".join(rng.choices(["alpha", "beta", "gamma"], k=30)) + "\n" + " ".join(words) + " " + " ".join(rng.choices(["delta", "eps"], k=30))
    assert name in {f[0] for f in L.Templates(L.TEMPLATES).find(text.encode())}


def test_a_licence_over_and_over():
    text = (L.TEMPLATES["bsd-3-clause"] + "\nother words here\n") * 60
    found = L.Templates(L.TEMPLATES).find(text.encode())
    assert [f[0] for f in found] == ["bsd-3-clause"] * 60
