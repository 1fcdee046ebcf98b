"""Selectors and pieces of cards and panes; hostile markup in linear time."""

import time

import pytest

from prospectra.functions import markup as M

CARD = """<div role="article"><a class="hfpxzc" href="https://maps.example/maps/place/X/@30.25,-97.5,14z/data=0x1:0xAbC" aria-label="n"></a>
<div class="a fontHeadlineSmall b">Joe&#39;s <b> Bar </b></div><span class="MW4etd">4,5</span><span class='UY7F9'>(1,204)</span>
<div class="W4Efsd"><span>Bar</span><span> · </span><span>12 Elm St</span></div><div class="W4Efsd">Open · <i>(512) 555-0100</i></div><script><div class="W4Efsd">9 No · No</div></script>
<a aria-label="Visit WEBSITE of it" href="https://joe.example/?a=1&amp;b=2">w</a></div>"""


def test_card(spark):
    rows = spark.createDataFrame([(1, CARD), (2, None), (3, "<p>no name</p>"), (4, "<div class=qBF1Pd>  </div><a class=hfpxzc>y</a>"), (5, "<a class=hfpxzc href=/maps/place/@x,1>y<span role=img>4.5</span>")], "id int, markup string")
    got = {r["id"]: r.asDict() for r in M.cards(rows, "markup").drop("markup").collect()}
    assert got[1] == {
        "id": 1, "name": "Joe'sBar", "category": "Bar |", "full_address": "| 12 Elm St", "phone": "(512) 555-0100", "rating": None, "reviews_count": 1204, "website_raw": "https://joe.example/?a=1&b=2",
        "maps_url": "https://maps.example/maps/place/X/@30.25,-97.5,14z/data=0x1:0xAbC", "latitude": 30.25, "longitude": -97.5, "place_id": "AbC",
    }
    assert set(got) == {1, 5} and got[5]["rating"] == 4.5 and got[5]["name"] == "y4.5" and got[5]["latitude"] is None


def test_detail(spark):
    pane = """<h1>Other</h1><h1 class="DUwDvf x">Caf&eacute;</h1><button jsaction="pane.category">Coffee</button><span aria-hidden="true">9</span><div class="F7nice"><span><span aria-hidden="true">4.7</span></span>
    <span aria-label="1,204 reviews">(1,204)</span></div><button data-item-id="address"><div></div><div>Address: 1 Main St, Austin, TX 78701</div></button><button data-item-id="phone:tel:+1512">Phone: +1 512-555-0199</button>
    <a data-item-id="authority" href="https://cafe.example">x</a><button data-item-id="oloc">7G+ Austin</button><span aria-label="Price: Moderate">$$</span><button aria-label="CLAIM THIS BUSINESS">c</button>"""
    rows = spark.createDataFrame([(1, pane, "https://m/@1.5,2.5,3z/0x0:0xff"), (2, "<h1>Plain</h1>", None), (3, "<h2>none</h2>", None)], "id int, markup string, url string")
    one, two = M.details(rows, "markup", "url").drop("markup", "url").orderBy("id").collect()
    assert tuple(one) == (1, "Café", "Coffee", 4.7, 1204, "1 Main St, Austin, TX 78701", "(512) 555-0199", "https://cafe.example", "7G+ Austin", "$$", "UNCLAIMED", 1.5, 2.5, "ff")
    assert tuple(two) == (2, "Plain", None, None, 0, None, None, None, None, None, "CLAIMED", None, None, None)


def test_ranges():
    page = M.read("<a><b>1<c>2</b>3</c><br>4<d/>5<b>6</a>7<!-- no -->8<b")
    text = lambda s: [page.text(e, ",") for e in page.all(s)]
    assert text("a") == ["1,2,3,4,5,6"] and text("b") == ["1,2", "6"] and text("c") == ["2"] and text("br") == [""]
    a = page.one(["a"])
    assert [e.name for e in page.all("b", a)] == ["b", "b"] and page.one(["x", "c"], a).name == "c" and page.strings[-1] == "8<b" or page.strings[-2:] == ["7", "8<b"]


@pytest.mark.parametrize("unit", ["<a", '<a "', "<a '", "</", "<!", "<!-", "<a\"<b'", '<a b=\'" ', '<p class="', "<div>", "</x>", "<script>", "<a =", "&amp", "<a b"])
@pytest.mark.parametrize("tail", ["", ">", '">', "'>"])
def test_one_megabyte(unit, tail):
    began = time.time()
    M.card_pieces(unit * (1_000_000 // len(unit)) + tail)
    assert time.time() - began < 20
