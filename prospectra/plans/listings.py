"""Cards and detail panes of listings. The fixtures put pieces of markup together by the key's rests, so the oracle says by rest what each piece gives."""

from __future__ import annotations

from ..functions import markup as M
from .fixtures import VIEWS, view
from .payloads import _case as _plain_case
from .payloads import _filled as _plain_filled
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


def _case(rule: str, *texts: str) -> str:
    """Pieces by a rest of the key; ^ stands for an apostrophe until _filled."""
    return _plain_case(rule, *[t.replace("'", "^") for t in texts])


def _filled(text: str) -> str:
    return f"replace({_plain_filled(text)}, '^', chr(39))"


_NAME = _case("k % 7", '<div class="x fontHeadlineSmall"> Shop <b>#</b> </div>', "<DIV CLASS=other>no</DIV><span class='a qBF1Pd'>Bar &amp; #</span>", "", '<div class="qBF1Pd"></div>', "<!-- <div class=fontHeadlineSmall>no</div> --><p class=qBF1Pd>Caf&eacute; #</p>", '<div class="fontHeadlineSmall">First #</div><div class="qBF1Pd">no</div>', "<em class=\"qBF1Pdx\">no</em>")
_LINK = _case("k % 5", '<a class="hfpxzc" href="https://m.example/maps/place/@30.25,-#.5,14z/0x1:0xaB#">In link #</a>', "", '<a href="/maps/place/#/@x,-1">far</a>', "<a class=hfpxzc>Bare #</a>", '<a href="/other"></a><a class="b hfpxzc" href="/maps/place/@1.5,2..5/0xg:0x1">Odd #</a>')
_SCORE = _case("k % 6", '<span class="MW4etd">4.5</span>', '<span role="img"> 3 </span>', "<span class='MW4etd'>n/a</span>", "", '<span class="MW4etd"></span><span role="img">2</span>', '<div class="MW4etd">5</div><span role="img">1e1</span>') 
_REVIEWS = _case("k % 4", '<span class="UY7F9">(1,#)</span>', "<span class='UY7F9'>#</span>", "<span class=UY7F9>many</span>", "")
_INFO = _case("k % 8", '<div class="W4Efsd"><span>Florist · # Elm St</span></div><div class="W4Efsd">Open · (512) 555-0100</div>', '<div class="W4Efsd">A category with a name of more than forty letters · Short</div>', "", '<div class=W4Efsd><span>12</span><span>Road</span></div>',
              '<div class="W4Efsd">Call 512.555.0199 now</div><script><div class="W4Efsd">Never</div></script>', '<div class="W4Efsd"> · </div>', '<div class="W4Efsd"><div class="W4Efsd">Inner</div> 5 Outer</div>', '<span class="W4Efsd">no</span>')
_SITE = _case("k % 9", '<a data-value="Website" href="https://s#.example">w</a>', "<a aria-label='Visit WEBSITE' href='http://v#.example?a=1&amp;b=2'>w</a>", "", '<a data-value="website" href="no">w</a>', '<a data-value="Website">w</a><a aria-label="website" href="no">w</a>', "<button data-value='Website' href=no></button>", '<a aria-label="my website of <b>" href="x#">', '<a data-value=Website href=y#>', "<a")
VIEWS["listing_cards"] = f"SELECT k AS id, {_filled(f'concat({_NAME}, {_LINK}, {_SCORE}, {_REVIEWS}, {_INFO}, {_SITE})')} AS markup FROM (SELECT c_custkey AS k FROM {{customer}}) c"

_TITLE = _case("k % 5", "<h1>Side</h1><h1 class='DUwDvf'>Shop #</h1>", "<h1> Plain # </h1>", "<h2>no</h2>", "<h1 class=DUwDvf>X<i> y</i></h1>", "<h1></h1>")
_KIND = _case("k % 4", '<button jsaction="a.category;b">Florist</button>', "<button class='DkEaL z'>Bar</button>", "", "<div class=DkEaL>no</div>")
_SCORES = _case("k % 7", '<div class="F7nice"><span aria-hidden="true">4.#</span><span aria-label="# reviews">(1,#)</span></div>', '<span aria-hidden="true">1</span><div class="F7nice"></div>', "", '<div class="F7nice"><span><span aria-hidden="true">x</span></span><span aria-label="5 stars">5</span></div>', '<div class="F7nice"><span aria-label="9 reviews">none</span></div><span aria-hidden="true">2</span>',
                '<div class=F7nice><span aria-hidden=true>3</span><span aria-label="2 reviews">2</span></div>', '<div class="F7nice"><span aria-hidden="false">3</span></div>')
_PLACE = _case("k % 6", '<button data-item-id="address">Address: # Main St</button>', "<button aria-label='Address: x'># Oak</button>", "", "<button data-item-id='address2'>no</button>", '<button aria-label="The Address:">no</button>', '<button aria-label="Address:">second</button><button data-item-id="address"><i>1</i> <b>2</b></button>')
_CALL = _case("k % 5", '<button data-item-id="phone:tel:1">Phone: +1 512-555-0123</button>', "<button aria-label='Phone: 1'>Phone: none</button>", "", '<button data-item-id="telephone:">no</button>', '<button data-item-id="phone:"></button>')
_MORE = _case("k % 8", '<a data-item-id="authority" href="https://a#.example"></a><button data-item-id="oloc">8X+#</button>', "<a aria-label='Website: b' href='https://b#.example'>b</a>", '<button data-item-id="merchant">m</button>', '<a aria-label="CLAIM THIS business now">c</a><span aria-label="The Price: low">$</span>', "<button aria-label='claim this business'></button>", "<span aria-label='Price: x'>$$</span>", "", "<a data-item-id='authority'>x</a><span aria-label=price:>no</span>")
VIEWS["listing_panes"] = f"SELECT k AS id, {_filled(f'concat({_TITLE}, {_KIND}, {_SCORES}, {_PLACE}, {_CALL}, {_MORE})')} AS markup, {_filled(_case('k % 3', 'https://m.example/@31.5,-97.#,3z/0x0:0xff#', '/none', '/@1,2'))} AS url FROM (SELECT c_custkey AS k FROM {{customer}}) c"

_ID = "CAST(id AS VARCHAR)"


@query(f"""WITH x AS (SELECT id, CASE id % 7 WHEN 0 THEN 'Shop' || {_ID} WHEN 1 THEN 'Bar & ' || {_ID} WHEN 4 THEN 'Café ' || {_ID} WHEN 5 THEN 'First ' || {_ID} WHEN 3 THEN '' ELSE CASE id % 5 WHEN 0 THEN 'In link ' || {_ID} WHEN 3 THEN 'Bare ' || {_ID} WHEN 4 THEN 'Odd ' || {_ID} END END AS name,
  CASE id % 5 WHEN 0 THEN 'https://m.example/maps/place/@30.25,-' || {_ID} || '.5,14z/0x1:0xaB' || {_ID} WHEN 2 THEN '/maps/place/' || {_ID} || '/@x,-1' WHEN 4 THEN '/maps/place/@1.5,2..5/0xg:0x1' END AS maps_url FROM listing_cards)
SELECT id, name, CASE id % 8 WHEN 0 THEN 'Florist' WHEN 1 THEN 'Short' WHEN 6 THEN 'Inner' END AS category,
  CASE id % 8 WHEN 0 THEN {_ID} || ' Elm St' WHEN 3 THEN '12 | Road' WHEN 4 THEN 'Call 512.555.0199 now' WHEN 6 THEN 'Inner | 5 Outer' END AS full_address,
  CASE id % 8 WHEN 0 THEN '(512) 555-0100' WHEN 4 THEN '(512) 555-0199' END AS phone, CASE id % 6 WHEN 0 THEN 4.5 WHEN 1 THEN 3 WHEN 5 THEN 10 END::DOUBLE AS rating,
  CASE id % 4 WHEN 0 THEN CAST('1' || {_ID} AS BIGINT) WHEN 1 THEN id ELSE 0 END AS reviews_count,
  CASE id % 9 WHEN 0 THEN 'https://s' || {_ID} || '.example' WHEN 1 THEN 'http://v' || {_ID} || '.example?a=1&b=2' WHEN 6 THEN 'x' || {_ID} WHEN 7 THEN 'y' || {_ID} END AS website_raw, maps_url,
  CASE id % 5 WHEN 0 THEN 30.25 WHEN 4 THEN 1.5 END::DOUBLE AS latitude, CASE WHEN id % 5 = 0 THEN -CAST({_ID} || '.5' AS DOUBLE) END AS longitude, CASE WHEN id % 5 = 0 THEN 'aB' || {_ID} END AS place_id
FROM x WHERE name <> ''""")
def card_fields(spark, sf_dir):
    return M.cards(view(spark, sf_dir, "listing_cards"), "markup").drop("markup")


@query(f"""WITH x AS (SELECT id, CASE id % 5 WHEN 0 THEN 'Shop ' || {_ID} WHEN 1 THEN 'Plain ' || {_ID} WHEN 3 THEN 'Xy' END AS name FROM listing_panes)
SELECT id, name, CASE id % 4 WHEN 0 THEN 'Florist' WHEN 1 THEN 'Bar' END AS category, CASE id % 7 WHEN 0 THEN CAST('4.' || {_ID} AS DOUBLE) WHEN 5 THEN 3 END::DOUBLE AS rating, CASE id % 7 WHEN 0 THEN CAST('1' || {_ID} AS BIGINT) WHEN 5 THEN 2 ELSE 0 END AS reviews_count,
  CASE id % 6 WHEN 0 THEN {_ID} || ' Main St' WHEN 1 THEN {_ID} || ' Oak' WHEN 5 THEN '12' END AS full_address, CASE id % 5 WHEN 0 THEN '(512) 555-0123' WHEN 1 THEN 'none' END AS phone,
  CASE id % 8 WHEN 0 THEN 'https://a' || {_ID} || '.example' WHEN 1 THEN 'https://b' || {_ID} || '.example' END AS website_raw, CASE WHEN id % 8 = 0 THEN '8X+' || {_ID} END AS plus_code, CASE id % 8 WHEN 3 THEN '$' WHEN 5 THEN '$$' END AS price_level,
  CASE WHEN id % 8 IN (2, 3, 4) THEN 'UNCLAIMED' ELSE 'CLAIMED' END AS is_claimed, CASE id % 3 WHEN 0 THEN 31.5 WHEN 2 THEN 1 END::DOUBLE AS latitude, CASE id % 3 WHEN 0 THEN -CAST('97.' || {_ID} AS DOUBLE) WHEN 2 THEN 2 END::DOUBLE AS longitude,
  CASE WHEN id % 3 = 0 THEN 'ff' || {_ID} END AS place_id
FROM x WHERE name <> ''""")
def detail_fields(spark, sf_dir):
    return M.details(view(spark, sf_dir, "listing_panes"), "markup", "url").drop("markup", "url")
