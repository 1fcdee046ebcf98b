"""Place arrays inside framed answers: positional JSON, read as VARIANT.

Slots may be missing, shifted or of another type than expected; every reader
checks the type before it takes a value, and gives null otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import written
from . import text as X

# The guard before an answer, the mark of a result, and the slots of a place array.
GUARD, RESULT = ")]}'", "wrb.fr"
NAME, CATEGORIES, OTHER_CATEGORIES, RATING, REVIEWS, REVIEW_TEXT = "$[11]", "$[13]", "$[76]", "$[4][7]", "$[4][8]", "$[4][3][1]"
ADDRESS, ADDRESS_LINE, PHONES, SITE, SITE_AGAIN, PLACE_ID, DATA_ID = "$[39]", "$[2][0]", "$[178][0]", "$[7][0]", "$[7][1]", "$[78]", "$[10]"
LATITUDE, LONGITUDE, HOURS, CLOSURE, OWNER, LAST = "$[9][2]", "$[9][3]", "$[203][0]", "$[88][0]", "$[57][1]", "$[178]"
ID_PREFIX, MAPS = "ChIJ", "https://www.google.com/maps/search/?api=1&query="
#: JSON of more nested arrays than this is refused by the parser, so a walk ends.
DEEPEST = 1000
#: Levels that the walk goes down between two tables.
LEVELS = 8


def slot(v: Column, path: str) -> Column:
    return F.variant_get(v, path, "variant")


def kind(v: Column, path: str) -> Column:
    """The type in a slot: STRING, BIGINT, VOID and so on; null if there is no slot."""
    return F.schema_of_variant(slot(v, path))


def text_at(v: Column, path: str) -> Column:
    """A slot's string, and nothing else."""
    return F.when(kind(v, path) == "STRING", F.variant_get(v, path, "string"))


def list_at(v: Column, path: str = "$") -> Column:
    """A slot's array; null for anything else."""
    return F.try_variant_get(v, path, "array<variant>")


def number_at(v: Column, path: str) -> Column:
    """A slot's number, or the number that its text is."""
    plain = kind(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(plain, F.try_variant_get(v, path, "double")).otherwise(F.trim(text_at(v, path)).try_cast("double"))


def strings_in(items: Column) -> Column:
    """The strings of an array, in order."""
    return F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))


# ---- frames


def unguarded(raw: Column) -> Column:
    """An answer without white space and the guard before it."""
    text = F.regexp_replace(raw, r"^\s+", "")
    return F.when(text.startswith(GUARD), F.regexp_replace(F.substring(text, len(GUARD) + 1, 2**31 - 1), r"^[\r\n]+", "")).otherwise(text)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def frames(raw: Column) -> Column:
    """(declared, body) of an answer's frames: lines that hold an array, with the number on the line before, if it is one."""
    lines = F.transform(F.split(once(raw, unguarded), r"\r\n|\r|\n"), lambda x: F.trim(x))
    frame = lambda n, x: F.struct(F.when(n.rlike(r"^\d{1,9}$"), n.try_cast("int")).alias("declared"), x.alias("body"))
    made = once(lines, lambda ls: F.transform(ls, lambda x, i: frame(F.get(ls, i - 1), x)))
    return F.filter(made, lambda f: f["body"].startswith("["))


def honest(frame: Column) -> Column:
    """Whether a frame is as long as declared: its UTF-16 units and the line ends on both sides of it."""
    units = F.length(frame["body"]) + F.regexp_count(frame["body"], F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.coalesce(frame["declared"] == units + 2, F.lit(False))


def results(all_frames: Column, rpc: str) -> Column:
    """(payload, framed) of the results of one call, in order; framed tells whether the frame's length holds."""
    entries = lambda f: F.coalesce(list_at(F.try_parse_json(f["body"])), F.array().cast("array<variant>"))
    read = F.transform(all_frames, lambda f: F.struct(entries(f).alias("es"), honest(f).alias("framed")))
    every = F.flatten(F.transform(read, lambda f: F.transform(f["es"], lambda e: F.struct(e.alias("e"), f["framed"].alias("framed")))))
    mine = F.filter(every, lambda r: F.coalesce((text_at(r["e"], "$[0]") == RESULT) & (text_at(r["e"], "$[1]") == rpc) & slot(r["e"], "$[2]").isNotNull(), F.lit(False)))
    return F.transform(mine, lambda r: F.struct(text_at(r["e"], "$[2]").alias("payload"), r["framed"].alias("framed")))


# ---- the walk


def is_place(v: Column) -> Column:
    """The shape of a place: over 178 slots, a name, a position of four slots or more, and an id."""
    shape = slot(v, LAST).isNotNull() & (text_at(v, NAME) != "") & slot(v, LONGITUDE).isNotNull() & text_at(v, PLACE_ID).startswith(ID_PREFIX)
    return F.coalesce(shape, F.lit(False))


def _arrays(items: Column, path: Callable[[Column], Column]) -> Column:
    """(path, v, place) of the elements that are arrays and not empty."""
    made = F.transform(items, lambda v, i: F.when(slot(v, "$[0]").isNotNull(), F.struct(path(i).alias("path"), v.alias("v"), is_place(v).alias("place"))))
    return F.array_compact(made)


def places_in(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, place_id, path, place) of the place arrays anywhere inside nested arrays, each id where a depth-first walk meets it first.

    The walk goes down some levels at a time, all rows at once, and never below
    a place; then the places and the open arrays are written, so nothing is read
    twice.  The path, the positions from the top, orders what the walk finds.
    """
    none = F.array().cast("array<int>")
    level = rows.select(F.col(key).alias("key"), F.inline(_arrays(F.array(value), lambda i: none)))
    found = None
    for _ in range(0, DEEPEST, LEVELS):
        for _ in range(LEVELS):
            deeper = _arrays(list_at(F.col("v")), lambda i: F.array_append("path", i))
            level = level.select("key", F.inline(F.when(F.col("place"), F.array(F.struct("path", "v", "place"))).otherwise(deeper)))
        level = written(level, "walk")
        here = level.filter("place").select("key", "path", F.col("v").alias("place"))
        found = here if found is None else found.unionByName(here)
        level = level.filter("not place")
        if level.isEmpty():
            break
    named = found.withColumn("place_id", text_at(F.col("place"), PLACE_ID))
    first = named.groupBy("key", "place_id").agg(F.min("path").alias("path"))
    return named.join(first, ["key", "place_id", "path"]).select(F.col("key").alias(key), "place_id", "path", "place")


# ---- one place


def reviews(v: Column) -> Column:
    """The number of reviews: its slot's whole number, else the number in the text of another."""
    t = kind(v, REVIEWS)
    whole = F.when(t == "BIGINT", F.try_variant_get(v, REVIEWS, "bigint")).when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, REVIEWS, "double").cast("long"))
    whole = whole.when(F.trim(text_at(v, REVIEWS)).rlike(r"^[+-]?\d+$"), F.trim(text_at(v, REVIEWS)).try_cast("long"))
    told = F.regexp_extract(text_at(v, REVIEW_TEXT), r"(?i)(\d[\d,]*)\s+reviews?", 1)
    return F.coalesce(whole, F.replace(told, F.lit(","), F.lit("")).try_cast("long"))


def customer_id(data_id: Column) -> Column:
    """The second half of a pair of hexadecimal numbers as a decimal text; of 64 bits at most, unsigned."""
    digits = F.regexp_extract(data_id, "^0x[0-9a-fA-F]+:0x0*([0-9a-fA-F]{1,16})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10))


def opening_hours(v: Column) -> Column:
    """Map of days to times; of a day that comes twice the last counts."""
    days = F.transform(
        F.filter(list_at(v, HOURS), lambda d: slot(d, "$[3]").isNotNull()),
        lambda d: F.struct(text_at(d, "$[0]").alias("day"), F.when(list_at(d, "$[3][0]").isNotNull(), text_at(d, "$[3][0][0]")).alias("time")),
    )
    kept = F.filter(days, lambda d: (d["day"] != "") & (d["time"] != ""))
    none = F.array().cast("array<struct<day:string,time:string>>")
    last = F.aggregate(kept, none, lambda done, d: F.array_append(F.filter(done, lambda x: x["day"] != d["day"]), d))
    return F.map_from_entries(F.coalesce(last, none))


def quoted(x: Column) -> Column:
    """Text in a query string: blanks become +, and of marks only -._~ stay."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def place_fields(v: Column) -> list[Column]:
    """The columns of one place array."""
    listed = F.when(list_at(v, CATEGORIES).isNotNull(), strings_in(list_at(v, CATEGORIES))).when(kind(v, CATEGORIES) == "STRING", F.array(text_at(v, CATEGORIES)))
    categories = F.coalesce(listed, strings_in(list_at(v, OTHER_CATEGORIES)), F.array().cast("array<string>"))
    name, place_id, n = text_at(v, NAME), text_at(v, PLACE_ID), reviews(v)
    phone = F.coalesce(text_at(v, PHONES + "[0]"), text_at(v, PHONES))
    web = lambda path: F.when(text_at(v, path).startswith("http"), text_at(v, path))
    pair = number_at(v, LATITUDE).isNotNull() & number_at(v, LONGITUDE).isNotNull()
    state = F.upper(text_at(v, CLOSURE))
    status = F.when(state.contains("CLOSED"), F.when(state.contains("TEMP"), "CLOSED_TEMPORARILY").otherwise("CLOSED_PERMANENTLY")).otherwise("OPERATIONAL")
    return [
        name.alias("name"), F.get(categories, F.lit(0)).alias("category"), categories.alias("all_categories"), number_at(v, RATING).alias("rating"),
        F.coalesce(n, F.lit(0)).alias("reviews_count"), n.isNotNull().alias("review_count_available"), F.coalesce(text_at(v, ADDRESS), text_at(v, ADDRESS_LINE)).alias("full_address"),
        X.phone_display(phone).alias("phone"), F.coalesce(web(SITE), web(SITE_AGAIN)).alias("website_raw"), F.when(pair, number_at(v, LATITUDE)).alias("latitude"),
        F.when(pair, number_at(v, LONGITUDE)).alias("longitude"), customer_id(text_at(v, DATA_ID)).alias("cid"), opening_hours(v).alias("operating_hours"), status.alias("business_status"),
        F.coalesce(text_at(v, OWNER).contains("(Owner)"), F.lit(False)).alias("is_claimed_owner"), F.concat(F.lit(MAPS), quoted(name), F.lit("&query_place_id="), place_id).alias("maps_url"),
    ]


