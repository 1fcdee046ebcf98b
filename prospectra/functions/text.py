"""Column builders for names, phones, postcodes, addresses, URLs and e-mail addresses.

All are built-in expressions, so they run inside whole-stage code and prune
and push down like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(c) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def name_key(c) -> Column:
    """Lower case letters and digits of a name; '' for null."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]", "")


def digits(c) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^0-9]", "")


def zip5(c) -> Column:
    return F.left(digits(c), F.lit(5))


def phone_key(c) -> Column:
    """The last ten digits, or null if there aren't ten."""
    d = digits(c)
    ok = F.length(d) >= 10
    return F.when(ok, F.right(d, F.lit(10)))


def email_key(c, mailto: bool = True) -> Column:
    x = col(c)
    return F.lower(F.trim(F.regexp_replace(x, "(?i)^mailto:", "") if mailto else x))


def email_domain(c, null_if_absent: bool = False) -> Column:
    x = col(c)
    part = F.split_part(x, F.lit("@"), F.lit(2))
    return F.when(F.instr(x, "@") > 0, part) if null_if_absent else part


def email_local(c) -> Column:
    return F.split_part(col(c), F.lit("@"), F.lit(1))


def loose_valid(c) -> Column:
    return col(c).rlike(V.LOOSE_EMAIL_RE)


def strict_valid(c) -> Column:
    x = col(c)
    return x.rlike(V.STRICT_EMAIL_RE) & (F.length(x) <= 254) & (F.length(email_local(x)) <= 64)


def is_placeholder(c) -> Column:
    x = col(c)
    return email_local(x).isin(V.PLACEHOLDER_LOCALS) | email_domain(x).isin(V.PLACEHOLDER_DOMAINS)


def is_usable(c) -> Column:
    return strict_valid(c) & ~is_placeholder(c)


def url_host(c) -> Column:
    """The lower-case host, without user, port and a leading www."""
    x = F.regexp_replace(F.lower(F.trim(col(c))), "^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(x, "^([^/?#]*)", 1), "^.*@", "")
    return F.regexp_replace(F.regexp_replace(host, ":[0-9]*$", ""), "^www\\.", "")


def under_domain(host: Column, domains: list[str]) -> Column:
    """Whether host is one of domains or a name below one."""
    return reduce(lambda a, b: a | b, [(host == d) | host.endswith("." + d) for d in domains])


def clean_url(c) -> Column:
    """Null words and blanks to null; the target of a search redirect, as it stands; a scheme added."""
    x = stripped(c)
    x = F.when(~F.lower(x).isin("", "null", "none", "n/a", "undefined"), x)
    inner = F.regexp_extract(x, "[?&]q=([^&]+)", 1)
    x = F.when(F.contains(x, F.lit("google.com/url?")) & (inner != ""), inner).otherwise(x)
    return F.when(x.startswith("http://") | x.startswith("https://"), x).otherwise(F.concat(F.lit("https://"), x))


def root_domain(url) -> Column:
    """The lower-case text between the slashes and a path or port, without a leading www."""
    host = F.lower(F.regexp_extract(col(url), "^https?://([^/?#:]*)", 1))
    return F.regexp_replace(host, "^www\\.", "")


def website_class(c) -> Column:
    """(type, has_website) of a URL; the order of the rules is their meaning."""
    host = root_domain(clean_url(c))
    out = lambda t, has: F.struct(F.lit(t).alias("type"), F.lit(has).alias("has_website"))
    return (
        F.when(host.isNull() | (host == ""), out("none", False))
        .when(host.endswith(".business.site") | host.endswith(".negocio.site"), out("google_site", False))
        .when(under_domain(host, V.CHAIN_DOMAINS), out("corporate_chain", True))
        .when(under_domain(host, V.SOCIAL_DOMAINS), out("social_media", False))
        .when(under_domain(host, V.BUILDER_DOMAINS), out("free_builder", True))
        .otherwise(out("custom_domain", True))
    )


def is_target_lead(website_type: Column, social: bool = True, site: bool = True) -> Column:
    return website_type.isin(["none", *(["social_media"] if social else []), *(["google_site"] if site else [])])


def phone_display(c) -> Column:
    """The first ten-digit number inside the text as (XXX) XXX-XXXX, else the text itself; blank to null."""
    pattern = r"(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})"
    x, part = col(c), lambda i: F.regexp_extract(col(c), pattern, i)
    shown = F.concat(F.lit("("), part(1), F.lit(") "), part(2), F.lit("-"), part(3))
    return F.when(x != "", F.when(x.rlike(pattern), shown).otherwise(stripped(x)))


def us_address(c) -> Column:
    """street, city, state and zip of a one-line address: a last country goes, the first two parts are street and city."""
    x = F.when(col(c) != "", stripped(F.regexp_replace(stripped(c), r"(?i),?\s*(?:United States|USA|US)$", "")))
    parts = F.filter(F.transform(F.split(x, ","), stripped), lambda p: p != "")
    zip_ = F.regexp_extract(x, r"\b([0-9]{5})(?:-[0-9]{4})?\b", 1)
    state = F.upper(F.regexp_extract(x, r"(?i)\b(" + "|".join(V.US_STATES) + r")\b", 1))
    return F.struct(
        F.get(parts, F.lit(0)).alias("street"), F.get(parts, F.lit(1)).alias("city"),
        F.nullif(state, F.lit("")).alias("state"), F.nullif(zip_, F.lit("")).alias("zip"),
    )


def clean_email(c) -> Column:
    """A usable address in lower case, or null."""
    x = F.lower(F.btrim(col(c), F.lit(" .\t\r\n'\"<>(),;:#*[]{}|")))
    local, domain = email_local(x), email_domain(x)
    tld = F.regexp_extract(domain, "\\.([^.]*)$", 1)
    good = (
        (F.length(F.regexp_replace(col(c), "[^@]", "")) == 1) & (F.length(x) <= 254) & F.length(local).between(1, 64) & (F.length(domain) >= 3)
        & domain.contains(".") & ~local.startswith(".") & ~local.endswith(".") & ~local.contains("..") & local.rlike(r"^[a-z0-9.!#$%&'*+/=?^_`{|}~-]+\z")
        & F.forall(F.split(domain, "\\."), lambda p: p.rlike("^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\\z")) & (F.length(tld) >= 2) & ~tld.rlike("^[0-9]+$")
        & ~tld.isin(V.ASSET_EXTENSIONS) & ~under_domain(domain, V.BLACKLIST_DOMAINS) & ~F.split_part(local, F.lit("+"), F.lit(1)).isin(V.SYSTEM_PREFIXES)
    )
    return F.when(good, x)


def email_confidence(email: Column, name: Column, city: Column) -> Column:
    """0.65, more for name tokens, the city and a free provider; at most 0.98."""
    local, domain = email_local(email), email_domain(email)
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9\s]", "")
    tokens = F.filter(F.split(plain, r"\s+"), lambda t: (F.length(t) > 2) & ~t.isin(V.CONFIDENCE_STOPS))
    hits = F.size(F.filter(tokens, lambda t: local.contains(t) | domain.contains(t)))
    score = (
        F.lit(0.65) + F.when(hits >= 2, 0.25).when(hits == 1, 0.15).otherwise(0.0)
        + F.when((F.coalesce(city, F.lit("")) != "") & local.contains(F.lower(city)), 0.10).otherwise(0.0)
        + F.when(domain.isin(V.FREE_PROVIDERS), 0.05).otherwise(0.0)
    )
    return F.round(F.least(score, F.lit(0.98)), 6)


def tokens_of(c) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Metres on a sphere of 6 371 008.8 m; null if anything is."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2))
    return 2 * 6371008.8 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def geo_band(metres: Column) -> Column:
    return F.when(metres <= 250, 1.0).when(metres <= 1000, 0.85).when(metres <= 5000, 0.60).when(metres <= 25000, 0.25).otherwise(0.0)


def two_digit_date(c) -> Column:
    """DD-MON-YY, with years nearest to 2020 as the registry's database reads them."""
    d = F.try_to_timestamp(col(c), F.lit("dd-MMM-yy")).cast("date")
    return F.when(F.year(d) >= 2070, F.add_months(d, -1200)).otherwise(d)


def price(c) -> Column:
    """Money text to decimal(12,2); blank or malformed to null."""
    x = F.trim(col(c))
    return F.when(x.rlike("^[0-9]{1,10}([.][0-9]{1,2})?$"), x.try_cast("decimal(12,2)"))


def slug(c) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))


def lead_identifier(place: Column, name: Column, phone: Column, address: Column) -> Column:
    e = F.lit("")
    made = F.concat(F.lit("custom_"), F.sha2(F.concat_ws("\x1f", F.coalesce(name, e), F.coalesce(phone, e), F.coalesce(address, e)), 256))
    return F.coalesce(F.nullif(place, e), made)


def profile_url(c) -> Column:
    """The canonical URL of a social account, or null: numbers, handles, and links to account pages."""
    raw = F.trim(col(c))
    x = F.regexp_replace(raw, "^@", "")
    base = F.lit("https://www.facebook.com/")
    handle = "^[A-Za-z0-9._-]{2,200}$"
    url = F.regexp_replace(x, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^([^/?#]*)", 1)), "\\.$", "")
    path = F.regexp_extract(url, "^[^/?#]*/*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    number = F.regexp_extract(url, "[?&]id=([0-9]+)(?:&|#|$)", 1)
    account = F.when(F.lower(first) == "pg", F.get(parts, F.lit(1))).otherwise(first)
    ok = account.rlike(handle) & ~F.lower(account).isin(V.NOT_PROFILES)
    return (
        F.when((raw == "") | (F.length(raw) > 4096), None)
        .when(x.rlike("^[0-9]+$") | x.rlike(handle), F.concat(base, x))
        .when(~host.isin(V.PROFILE_HOSTS) | (first == "") | F.lower(first).isin(V.NOT_PROFILES), None)
        .when(F.lower(first) == "profile.php", F.when(number != "", F.concat(base, F.lit("profile.php?id="), number)))
        .when(F.lower(first) == "pages", F.when((F.size(parts) >= 3) & F.element_at(parts, -1).rlike("^[0-9]+$"), F.concat(base, F.array_join(F.slice(parts, 1, 3), "/"))))
        .when(ok, F.concat(base, account))
    )


def post_times(document, checked: Column) -> Column:
    """Distinct plausible epoch seconds of posts in a captured document, ascending."""
    quote = '(?:\\\\?"|&quot;)'
    pattern = f"{quote}(?:creation_time|publish_time|creation_timestamp){quote}\\s*:\\s*{quote}?([0-9]{{9,13}})"
    found = F.transform(F.regexp_extract_all(F.coalesce(col(document), F.lit("")), F.lit(pattern), F.lit(1)), lambda e: e.cast("long"))
    seconds = F.transform(found, lambda e: F.when(e > 10_000_000_000, F.floor(e / 1000)).otherwise(e))
    return F.array_sort(F.array_distinct(F.filter(seconds, lambda e: e.between(V.EARLIEST_POST, F.unix_timestamp(checked) + 86400))))


def document_status(final_url: Column, status: Column, document: Column, checked: Column, most: int) -> Column:
    """The class of a captured document; the order of the rules is their meaning."""
    low = F.lower(document)
    rest = F.regexp_replace(final_url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?#:]*)", 1))
    path = F.lower(F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)?", 1))
    has = lambda markers: reduce(lambda a, b: a | b, [low.contains(m) for m in markers])
    return (
        F.when(F.octet_length(document) > most, "document_too_large")
        .when(status == 429, "rate_limited")
        .when((host != "facebook.com") & ~host.endswith(".facebook.com"), "access_denied")
        .when(path.contains("/checkpoint") | path.contains("/captcha"), "challenge")
        .when((path == "/login") | path.startswith("/login/"), "login_required")
        .when(status.isin(401, 403), "access_denied")
        .when(status == 404, "not_found")
        .when(status >= 400, "http_error")
        .when(F.size(post_times(document, checked)) > 0, "ok")
        .when(has(V.RATE_MARKERS), "rate_limited")
        .when(has(V.CHALLENGE_MARKERS), "challenge")
        .when(has(V.UNAVAILABLE_MARKERS), "unavailable")
        .otherwise("no_post_timestamp")
    )


def retry_state(status: Column, attempts: Column, most: int) -> Column:
    """(state, minutes until the next attempt or null) after an outcome."""
    out = lambda s, m=None: F.struct(F.lit(s).alias("state"), F.lit(m).cast("long").alias("minutes"))
    wait = F.least(F.lit(1440), 5 * F.pow(F.lit(2), attempts)).cast("long")
    return (
        F.when(status == "ok", out("succeeded"))
        .when(status == "no_post_timestamp", out("no_data"))
        .when(status.isin("not_found", "unavailable"), out("unavailable"))
        .when(status == "login_required", out("restricted"))
        .when(status.isin("rate_limited", "challenge", "access_denied"), out("retry", 0))
        .when(status == "document_too_large", out("failed"))
        .when(attempts >= most, out("failed"))
        .otherwise(F.struct(F.lit("retry").alias("state"), wait.alias("minutes")))
    )
