"""Whether an e-mail address found beside a business belongs to it: built-in expressions over captured text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .text import digits, email_domain, email_local, tokens_of

GENERIC = [*V.GENERIC_BUSINESS_TOKENS, *V.GENERIC_INDUSTRY_TOKENS]


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def distinctive(name: Column, category: Column) -> Column:
    """Words of a name that neither its trade nor common business words explain."""
    return F.filter(tokens_of(name), lambda t: (F.length(t) > 2) & ~t.isin(GENERIC) & ~F.array_contains(tokens_of(category), t))


def acronyms(name: Column) -> Column:
    """Stand-alone upper-case words of two to five letters, in lower case."""
    found = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"(?<![A-Za-z'’])[A-Z]{2,5}(?![A-Za-z])"), F.lit(0))
    return F.filter(F.transform(found, F.lower), lambda t: ~t.isin(GENERIC))


def core(name: Column) -> Column:
    """A name's words without legal endings and particles."""
    return F.filter(tokens_of(name), lambda t: ~t.isin(V.CORPORATE_SUFFIXES + V.NAME_PARTICLES))


def matches_brand(identity: Column, name: Column, category: Column) -> Column:
    """Whether a mailbox or domain label names the business, not only its trade."""
    own = F.regexp_replace(F.lower(identity), "[^a-z0-9]", "")
    words, telling = core(name), distinctive(name, category)
    whole, brand, one = F.array_join(words, ""), F.array_join(telling, ""), F.get(telling, F.lit(0))
    hits = F.size(F.array_distinct(F.filter(telling, lambda t: F.contains(own, t))))
    single = one.rlike("[0-9]") | ((F.length(one) >= 4) & ~one.isin(V.AMBIGUOUS_BRANDS))
    return _any(
        (F.size(words) >= 2) & (F.length(whole) >= 6) & F.contains(own, whole), hits >= 2,
        (F.size(telling) >= 2) & (F.length(brand) >= 6) & F.contains(own, brand),
        (F.size(telling) == 1) & single & F.contains(own, one), F.exists(acronyms(name), lambda t: F.contains(own, t)),
    )


def name_confirmed(context: Column, name: Column, category: Column) -> Column:
    """Whether a text names the business: its core words in a row, or three quarters (two at least) of its telling words."""
    seen, whole, telling = tokens_of(context), F.array_join(core(name), " "), F.array_distinct(distinctive(name, category))
    needed = F.greatest(F.lit(2), F.floor((3 * F.size(telling) + 3) / 4))
    return _any((whole != "") & F.contains(F.array_join(seen, " "), whole), (F.size(telling) >= 2) & (F.size(F.array_intersect(telling, seen)) >= needed))


def category_confirmed(context: Column, category: Column) -> Column:
    """Whether a long word of the trade and one of the text begin alike."""
    stems = lambda c: F.transform(F.filter(tokens_of(c), lambda t: F.length(t) >= 5), lambda t: F.left(t, F.lit(5)))
    return F.coalesce(F.arrays_overlap(stems(context), stems(category)), F.lit(False))


def source_host(url: Column) -> Column:
    """A page's host, without user, port, leading www and last dot; '' if there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(rest), "^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(F.regexp_replace(host, "\\.+$", ""), "^www\\.", "")


def owned_by(email: Column, name: Column, category: Column, phone: Column, city: Column, near: Column, result: Column, url: Column, by_phone: Column, local_only: Column) -> Column:
    """Whether an address belongs to the business.

    near is the text around the address, result that of the search result.  A
    site's own mailbox needs the business in its domain.  The business's phone
    near the address decides where by_phone allows it and the result names the
    business; else the mailbox (of a free provider) or the domain must name it
    and so must the text; a one-word name also needs the city or the trade.
    With local_only the phone or city must be near on any other site.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    local, domain = email_local(F.lower(email)), email_domain(F.lower(email))
    brand_domain = matches_brand(F.split_part(domain, F.lit("."), F.lit(1)), name, category)
    host = source_host(url)
    own_site = (host != "") & ((host == domain) | host.endswith(F.concat(F.lit("."), domain)))
    number, town = digits(phone), F.array_join(tokens_of(city), " ")
    phone_near = (F.length(number) >= 7) & F.contains(digits(near), F.right(number, F.lit(10)))
    both = F.concat_ws(" ", blank(near), blank(result))
    town_near = (town != "") & F.contains(F.array_join(tokens_of(both), " "), town)
    brand_local, named = matches_brand(local, name, category), name_confirmed(both, name, category)
    local_enough = ~local_only | own_site | phone_near | town_near
    by_domain = named & ((F.size(core(name)) > 1) | town_near | category_confirmed(both, category))
    decided = (
        F.when(own_site & ~brand_domain, False).when(~local_enough, False).when(by_phone & phone_near & name_confirmed(result, name, category), True)
        .when(domain.isin(V.FREE_PROVIDERS), brand_local & named).when(brand_domain, by_domain).otherwise(False)
    )
    return F.coalesce(decided, F.lit(False))


def result_relevant(text: Column, name: Column, phone: Column, category: Column) -> Column:
    """Whether a search result is about the business: its whole name, its phone, or two telling words."""
    seen, telling, number = tokens_of(text), distinctive(name, category), digits(phone)
    whole = F.array_join(tokens_of(name), " ")
    called = (F.length(number) >= 7) & F.contains(digits(text), F.right(number, F.lit(10)))
    named = (whole != "") & F.contains(F.array_join(seen, " "), whole)
    return F.when(named, (F.size(telling) > 0) | (F.size(acronyms(name)) > 0) | called).otherwise(called | (F.size(F.array_intersect(telling, seen)) >= 2))
