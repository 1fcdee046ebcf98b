"""Fields of listing cards and detail panes by simple selectors.

Markup is read once, as tags and strings in order: an element is a range of
strings and a range of elements, so no tree is built and text and descendants
are slices.  Tags that never end, stray end tags and unclosed elements do no
harm; reading takes time in proportion to the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

# A tag's attributes hold no < outside quotes, so each search ends at the next one.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
# Elements without an end tag, and those whose content is no text of the page.
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = {"script", "style", "template"}

# The selectors of a card and of a detail pane; of several the first that matches anything counts.
CARD_NAME = ["div.fontHeadlineSmall", ".qBF1Pd", "a.hfpxzc"]
CARD_LINK, CARD_RATING, CARD_REVIEWS, CARD_INFO = ["a.hfpxzc", "a[href*='/maps/place/']"], ["span.MW4etd", "span[role='img']"], ["span.UY7F9"], "div.W4Efsd"
CARD_SITE = ["a[data-value='Website']", "a[aria-label*='website' i]"]
TITLE, CATEGORY, SCORES, SCORE, COUNT = ["h1.DUwDvf", "h1"], ["button[jsaction*='category']", "button.DkEaL"], ["div.F7nice"], ["span[aria-hidden='true']"], ["span[aria-label*='reviews']"]
ADDRESS, PHONE, SITE = ["button[data-item-id='address']", "button[aria-label^='Address:']"], ["button[data-item-id^='phone:']", "button[aria-label^='Phone:']"], ["a[data-item-id='authority']", "a[aria-label^='Website:']"]
PLUS_CODE, PRICE = ["button[data-item-id='oloc']"], ["span[aria-label*='Price:']"]
CLAIM = ["button[data-item-id='merchant']", "a[aria-label*='Claim this business' i]", "button[aria-label*='Claim this business' i]"]


@dataclass
class Element:
    name: str
    attributes: dict[str, str]
    strings: list[int]  # from, to
    inside: list[int]  # elements from, to


@dataclass
class Page:
    strings: list[str]
    elements: list[Element]

    def text(self, e: Element, between: str = "") -> str:
        """The element's strings without the white space around each."""
        return between.join(s for x in self.strings[slice(*e.strings)] if (s := x.strip()))

    def all(self, selector: str, within: Element | None = None) -> Iterator[Element]:
        rule = _rule(selector)
        return (e for e in (self.elements[slice(*within.inside)] if within else self.elements) if rule(e))

    def one(self, selectors: list[str], within: Element | None = None) -> Element | None:
        return next((e for s in selectors for e in self.all(s, within)), None)


SELECTOR = re.compile(r"([a-z0-9]*)(?:\.([\w-]+))?(?:\[([\w-]+)([*^]?)='([^']*)'( i)?\])?")
_rules: dict = {}


def _rule(selector: str):
    """A test of an element: name, one class, one attribute that equals, begins with or holds a text."""
    if selector not in _rules:
        name, cls, attribute, how, value, any_case = SELECTOR.fullmatch(selector).groups()
        fold = str.lower if any_case else str
        test = {"": lambda x: x == fold(value), "^": lambda x: x.startswith(fold(value)), "*": lambda x: fold(value) in x}[how or ""]
        _rules[selector] = lambda e: (
            (not name or e.name == name) and (not cls or cls in e.attributes.get("class", "").split())
            and (not attribute or attribute in e.attributes and test(fold(e.attributes[attribute])))
        )
    return _rules[selector]


def read(markup: str) -> Page:
    """The strings and elements of a piece of markup, in order."""
    page, stack, at, open_ = Page([], []), [], 0, {}

    def text(end: int) -> None:
        if end > at and not any(n in open_ for n in HIDDEN):
            page.strings.append(html.unescape(markup[at:end]))

    def close(e: Element) -> None:
        e.strings[1], e.inside[1] = len(page.strings), len(page.elements)
        open_[e.name] -= 1
        if not open_[e.name]:
            del open_[e.name]

    for m in TAG.finditer(markup):
        text(m.start())
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            while open_.get(name):
                close(last := stack.pop())
                if last.name == name:
                    break
            continue
        attributes: dict[str, str] = {}
        for a in ATTRIBUTE.finditer(m[3]):
            attributes[a[1].lower()] = html.unescape(next((g for g in a.groups()[1:] if g is not None), ""))
        e = Element(name, attributes, [len(page.strings)] * 2, [len(page.elements) + 1] * 2)
        page.elements.append(e)
        if name not in EMPTY and not m[3].endswith("/"):
            stack.append(e)
            open_[name] = open_.get(name, 0) + 1
    text(len(markup))
    for e in reversed(stack):
        close(e)
    return page


def _text(page: Page, selectors: list[str], within: Element | None = None) -> str | None:
    e = page.one(selectors, within)
    return None if e is None else page.text(e)


def card_pieces(markup: str) -> dict:
    """The texts and links of a card that its fields are made of."""
    page = read(markup)
    link, site = page.one(CARD_LINK), page.one(CARD_SITE)
    return {
        "name": _text(page, CARD_NAME), "maps_url": link and link.attributes.get("href"), "rating": _text(page, CARD_RATING), "reviews": _text(page, CARD_REVIEWS),
        "infos": [page.text(e, " | ") for e in page.all(CARD_INFO)], "website_raw": site and site.attributes.get("href"),
    }


def detail_pieces(markup: str) -> dict:
    """The same of a detail pane."""
    page = read(markup)
    scores, site = page.one(SCORES), page.one(SITE)
    return {
        "name": _text(page, TITLE), "category": _text(page, CATEGORY), "rating": scores and _text(page, SCORE, scores), "reviews": scores and _text(page, COUNT, scores), "full_address": _text(page, ADDRESS),
        "phone": _text(page, PHONE), "website_raw": site and site.attributes.get("href"), "plus_code": _text(page, PLUS_CODE), "price_level": _text(page, PRICE), "claim": page.one(CLAIM) is not None,
    }


CARD = "name string, maps_url string, rating string, reviews string, infos array<string>, website_raw string"
DETAIL = "name string, category string, rating string, reviews string, full_address string, phone string, website_raw string, plus_code string, price_level string, claim boolean"


def pieces(markup: str, of: Callable[[str], dict], schema: str) -> Column:
    """A struct of the pieces of each row's markup, read in Arrow batches; null counts as empty."""
    names = [c.split()[0] for c in schema.split(", ")]

    def batch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of(x or "") for x in texts], columns=names)

    return F.pandas_udf(batch, schema)(markup)


#: A tag or comment as TAG finds it, without its parts, and any element whose content is hidden.
BETWEEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|</?[a-zA-Z][^\s/<>]*(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>", re.S)
HIDES = re.compile("<(?:" + "|".join(sorted(HIDDEN)) + ")", re.I)


def visible(fragment: str) -> str:
    """The strings of a piece of markup, parted by blanks; it may begin and end inside a tag.

    Where nothing is hidden, elements don't matter: the strings are what stands between tags.
    """
    if not HIDES.search(fragment):
        if "&" in fragment:
            return " ".join(s for x in BETWEEN.split(fragment) if (s := html.unescape(x).strip()))
        return " ".join(s for x in BETWEEN.split(fragment) if (s := x.strip()))
    return " ".join(s for x in read(fragment).strings if (s := x.strip()))


def contexts(markup: Column, address: str, radius: int) -> Column:
    """array<struct<email, context>>: each address that the pattern finds, in order, with the visible text of so many characters on both sides.

    A text is searched once, so many addresses take time in proportion; null and texts without any give an empty list.
    """
    pattern = re.compile(address)

    def near(x: str | None) -> list[dict]:
        return [{"email": m[0], "context": visible(x[max(0, m.start() - radius) : m.end() + radius])} for m in pattern.finditer(x or "")]

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([near(x) for x in texts], dtype=object)

    return F.pandas_udf(batch, "array<struct<email:string,context:string>>")(markup)


def url_fields(url: Column) -> dict[str, Column]:
    """Position and id inside a place's address; a position whose numbers are malformed is none."""
    part = lambda i: F.nullif(F.regexp_extract(url, r"@([0-9.-]+),([0-9.-]+)", i), F.lit(""))
    return {
        "latitude": part(1).try_cast("double"), "longitude": F.when(part(1).try_cast("double").isNotNull(), part(2).try_cast("double")),
        "place_id": F.nullif(F.regexp_extract(url, "0x[0-9a-fA-F]+:0x([0-9a-fA-F]+)", 1), F.lit("")),
    }


def whole(x: Column) -> Column:
    return F.coalesce(F.when(X.stripped(x).rlike(r"^[+-]?\d+$"), X.stripped(x)).try_cast("long"), F.lit(0).cast("long"))


def cards(rows: DataFrame, markup: str) -> DataFrame:
    """Rows of cards that have a name, with its fields: a card's lines are split at middle dots into segments."""
    read_ = rows.withColumn("p", pieces(markup, card_pieces, CARD)).filter("p.name <> ''")
    parts = F.filter(F.transform(F.flatten(F.transform("p.infos", lambda t: F.split(t, "·"))), lambda s: X.stripped(s)), lambda s: s != "")
    read_ = read_.withColumn("segments", parts)
    digit = lambda s: s.rlike(r"\p{Nd}")
    called = F.transform(F.filter("p.infos", lambda t: t.rlike(PHONE_RE)), lambda t: X.phone_display(F.regexp_extract(t, PHONE_RE, 0)))
    return read_.select(
        *rows.columns, "p.name", F.get(F.filter("segments", lambda s: ~digit(s) & (F.length(s) < 40)), F.lit(0)).alias("category"), F.get(F.filter("segments", digit), F.lit(0)).alias("full_address"), F.get(called, F.lit(0)).alias("phone"),
        F.col("p.rating").try_cast("double").alias("rating"), whole(F.regexp_replace("p.reviews", "[(),]", "")).alias("reviews_count"), "p.website_raw", "p.maps_url",
        *[c.alias(n) for n, c in url_fields(F.col("p.maps_url")).items()],
    )


PHONE_RE = r"(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})"


def details(rows: DataFrame, markup: str, url: str) -> DataFrame:
    """Rows of detail panes that have a title, with its fields; a pane that offers to claim the business is unclaimed."""
    read_ = rows.withColumn("p", pieces(markup, detail_pieces, DETAIL)).filter("p.name <> ''")
    return read_.select(
        *rows.columns, "p.name", "p.category", F.col("p.rating").try_cast("double").alias("rating"), whole(F.regexp_replace("p.reviews", "[^0-9]", "")).alias("reviews_count"),
        F.replace("p.full_address", F.lit("Address: "), F.lit("")).alias("full_address"), X.phone_display(F.replace("p.phone", F.lit("Phone: "), F.lit(""))).alias("phone"), "p.website_raw", "p.plus_code", "p.price_level",
        F.when(F.col("p.claim"), "UNCLAIMED").otherwise("CLAIMED").alias("is_claimed"), *[c.alias(n) for n, c in url_fields(F.col(url)).items()],
    )
