"""Cut-off and hostile pages are read in linear time; links go through the blocks that they hold."""

import time

import pytest

from prospectra.llm.html_extract import blocks

SIZE = 1_000_000


@pytest.mark.parametrize("unit", ["<a", '<a "', "<a '", "</", "<!", "<!-", "<a\"<b'", '<a b=\'" ', '<p class="', "<div>", "</x>", "<script>", '"<a'])
@pytest.mark.parametrize("tail", ["", ">", '">', "-->"])
def test_one_megabyte(unit, tail):
    began = time.time()
    blocks(unit * (SIZE // len(unit)) + tail)
    assert time.time() - began < 20


def test_stray_end_tags_below_a_deep_stack():
    began = time.time()
    blocks("<div>" * 100_000 + "</x>" * 100_000 + "</div>" * 100_000)
    assert time.time() - began < 20


def test_what_is_no_tag_is_text():
    assert [b.text for b in blocks('a < b <p title="x > y">c</p> <q"d')] == ["a < b", "c", '<q"d']
    assert [b.text for b in blocks("x <!-- <p>no</p> --> y<!DOCTYPE html>z<!-- open")] == ["x yz"]
    assert [b.text for b in blocks("<p>1<p>2<a href='>'>3</a></x></p>4")] == ["1", "23", "4"]


def test_links_go_through_blocks():
    found = blocks("<a href=x><div>all of it</div></a><p>none</p><p><a>one</a> of</p><p><a>open</p><p>none</p>")
    assert [(b.text, b.links) for b in found] == [("all of it", 9), ("none", 0), ("one of", 3), ("open", 4), ("none", 0)]
