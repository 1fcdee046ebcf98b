"""Submitted requests whose arguments are JSON arrays: checked as a whole, exploded only if every element holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payloads as P
from ..operators.scratch import written
from .fixtures import VIEWS, view
from .payloads import _case, _filled
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

# Limits of the arguments.
PLANS, MOST_OFFERINGS, MOST_ASSETS, NOTE, MORE_NOTES = ["starter", "pro"], 20, 8, 3000, 5000
TITLE, DESCRIPTION, FILE_NAME, MOST_BYTES = (2, 100), (2, 1000), (1, 255), 8388608
PRICE, TYPES = r"^\d{1,10}(\.\d{1,2})?$", ["image/jpeg", "image/png", "image/webp", "image/avif"]
REASONS = ["plan", "offerings_count", "assets_count", "notes", "offering", "asset"]

_GOOD = "{~title~:~Cut #~,~description~:~A cut~,~price~:~25.00~}"
_PHOTO = "{~original_filename~:~a.jpg~,~mime_type~:~image/jpeg~,~size_bytes~:#,~storage_path~:~u#/a.jpg~}"
_OFFERINGS = _case(
    "k % 13", f"[{_GOOD},{{~title~:~ Wash ~,~description~:~Hot~,~price~:30}}]", "[]", "[" + ",".join([_GOOD] * 21) + "]", "{~a~:1}", f"[{_GOOD},~text~,7]", "[{~title~:~ x ~,~description~:~one letter~}]",
    f"[{_GOOD},{{~title~:~Odd~,~description~:~price~,~price~:~abc~}}]", "[{~title~:12,~description~:~no price~},{~title~:~Blank~,~description~:~price~,~price~:~ ~},{~title~:~Null~,~description~:~price~,~price~:null}]",
    "[{~title~:~No description~,~price~:1}]", "[{", "[{~title~:~Big~,~description~:~price~,~price~:~12345678901~},{~title~:~Fine~,~description~:~cents~,~price~:1.234}]",
    "[" + ",".join([_GOOD] * 20) + "]", "[{~title~:~Ten~,~description~:~ digits ~,~price~:9999999999.99}]",
)
_ASSETS = _case(
    "k % 9", "[]", f"[{_PHOTO}]", "null", "[" + ",".join([_PHOTO] * 9) + "]", f"[{_PHOTO.replace('jpeg', 'gif')}]", f"[{_PHOTO.replace(':#,', ':0,')}]", f"[{_PHOTO.replace('u#/', 'u1#/')}]", f"[{_PHOTO.replace(':#,', ':~8388608~,')},{_PHOTO}]",
    f"[{_PHOTO.replace(':#,', ':8388609,')},5]",
)
VIEWS["raw_requests"] = f"""
SELECT k AS id, concat('u', {_filled("'#'")}) AS user_id, CASE WHEN k % 19 = 0 THEN 'gold' WHEN k % 2 = 0 THEN 'pro' WHEN k % 23 <> 0 THEN 'starter' END AS plan_id, CASE WHEN k % 29 <> 0 THEN {_filled(_OFFERINGS)} END AS offerings,
  CASE WHEN k % 31 <> 0 THEN {_filled(_ASSETS)} END AS assets, CASE WHEN k % 17 = 0 THEN repeat('é', 3001) WHEN k % 17 = 1 THEN concat(' ', repeat('n', 3000)) END AS photo_brief, CASE WHEN k % 37 = 5 THEN repeat('n', 5001) END AS additional_notes
FROM (SELECT c_custkey AS k FROM {{customer}}) c"""
VIEWS["stored_photos"] = "SELECT concat('u', CAST(c_custkey AS VARCHAR(20)), '/a.jpg') AS name, concat('u', CAST(c_custkey AS VARCHAR(20))) AS owner_id FROM {customer} WHERE c_custkey % 5 <> 0"


def _field(v: Column, name: str) -> Column:
    """A field of an object as text, whatever scalar it is."""
    return F.try_variant_get(v, f"$.{name}", "string")


def _object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _sized(x: Column, limits: tuple[int, int]) -> Column:
    return F.coalesce(F.length(x).between(*limits), F.lit(False))


def offering(v: Column, position: Column) -> Column:
    """One element: its values, and the names of those that are not valid."""
    title, description = F.trim(_field(v, "title")), F.trim(_field(v, "description"))
    price = F.nullif(F.trim(_field(v, "price")), F.lit(""))
    wrong = [(~_object(v), "object"), (~_sized(title, TITLE), "title"), (~_sized(description, DESCRIPTION), "description"), (~F.coalesce(price.isNull() | price.rlike(PRICE), F.lit(False)), "price")]
    errors = F.array_compact(F.array(*[F.when(bad, name) for bad, name in wrong]))
    return F.struct(position.cast("int").alias("position"), title.alias("title"), description.alias("description"), price.try_cast("decimal(12,2)").alias("price"), errors.alias("errors"))


def asset(v: Column, user: Column) -> Column:
    """One file: its values, and whether they hold but for its being stored."""
    name, mime, size, path = (_field(v, c) for c in ("original_filename", "mime_type", "size_bytes", "storage_path"))
    bytes_ = F.when(size.rlike(r"^\d{1,18}$"), size.try_cast("long"))
    good = _object(v) & _sized(name, FILE_NAME) & mime.isin(TYPES) & bytes_.between(1, MOST_BYTES) & path.startswith(F.concat(user, F.lit("/")))
    return F.struct(path.alias("path"), name.alias("name"), mime.alias("mime"), bytes_.alias("bytes"), F.coalesce(good, F.lit(False)).alias("good"))


def read_requests(requests: DataFrame) -> DataFrame:
    """Requests with their offerings and files read: the lists o and a, null where the text is no list."""
    read = requests.withColumns({"o": P.list_at(F.try_parse_json("offerings")), "a": P.list_at(F.try_parse_json("assets"))})
    return read.withColumns({"o": F.transform("o", offering), "a": F.transform("a", lambda v: asset(v, F.col("user_id")))})


def judged(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, o, a, reason): requests with their offerings and files, and the first reason to refuse each, if any.

    All that a request tells by itself is judged first, so the search for its
    files moves no texts.
    """
    long = lambda c, n: F.coalesce(F.length(F.trim(c)) > n, F.lit(False))
    tests = [
        ~F.coalesce(F.col("plan_id").isin(PLANS), F.lit(False)), ~F.coalesce(F.size("o").between(1, MOST_OFFERINGS), F.lit(False)), ~F.coalesce(F.col("a").isNotNull() & (F.size("a") <= MOST_ASSETS), F.lit(False)),
        long("photo_brief", NOTE) | long("additional_notes", MORE_NOTES), F.exists("o", lambda x: F.size(x["errors"]) > 0), F.exists("a", lambda x: ~x["good"]),
    ]
    alone = F.coalesce(*[F.when(t, name) for t, name in zip(tests, REASONS)])
    read = written(read_requests(requests).select("id", "user_id", "o", "a", alone.alias("alone")), "requests")
    files = read.filter(F.size("a") <= MOST_ASSETS).select("id", "user_id", F.explode("a.path").alias("path"))
    kept = stored.select(F.col("owner_id").alias("user_id"), F.col("name").alias("path")).distinct()
    lost = files.join(kept, ["user_id", "path"], "left_anti").select("id").distinct().withColumn("lost", F.lit(REASONS[-1]))
    return read.join(lost, "id", "left").select("id", "o", "a", F.coalesce("alone", "lost").alias("reason"))


def _judged(spark, sf_dir) -> DataFrame:
    return judged(view(spark, sf_dir, "raw_requests"), view(spark, sf_dir, "stored_photos"))


_OBJ = "json_type(v) = 'OBJECT'"
_READ = r"""
WITH j AS (SELECT *, CASE WHEN json_valid(offerings) AND json_type(offerings) = 'ARRAY' THEN CAST(offerings AS JSON) END AS o, CASE WHEN json_valid(assets) AND json_type(assets) = 'ARRAY' THEN CAST(assets AS JSON) END AS a FROM raw_requests),
oi AS (SELECT id, i, json_extract(o, '$[' || i || ']') AS v FROM (SELECT id, o, unnest(range(CAST(json_array_length(o) AS BIGINT))) AS i FROM j WHERE o IS NOT NULL)),
ov AS (SELECT id, CAST(i AS INTEGER) AS position, trim(v ->> '$.title') AS title, trim(v ->> '$.description') AS description, nullif(trim(v ->> '$.price'), '') AS price, v FROM oi),
oe AS (SELECT id, position, title, description, price, list_filter([CASE WHEN json_type(v) <> 'OBJECT' THEN 'object' END, CASE WHEN NOT coalesce(length(title) BETWEEN 2 AND 100, FALSE) THEN 'title' END,
  CASE WHEN NOT coalesce(length(description) BETWEEN 2 AND 1000, FALSE) THEN 'description' END, CASE WHEN NOT regexp_full_match(price, '\d{1,10}(\.\d{1,2})?') THEN 'price' END], lambda x: x IS NOT NULL) AS errors FROM ov),
ai AS (SELECT id, user_id, i, json_extract(a, '$[' || i || ']') AS v FROM (SELECT id, user_id, a, unnest(range(CAST(json_array_length(a) AS BIGINT))) AS i FROM j WHERE a IS NOT NULL)),
av AS (SELECT id, i, user_id, v ->> '$.storage_path' AS path, v ->> '$.original_filename' AS name, v ->> '$.mime_type' AS mime, v ->> '$.size_bytes' AS bytes, json_type(v) = 'OBJECT' AS object FROM ai),
ae AS (SELECT id, i, path, name, mime, bytes, coalesce(object AND length(name) BETWEEN 1 AND 255 AND mime IN ('image/jpeg', 'image/png', 'image/webp', 'image/avif') AND regexp_full_match(bytes, '\d{1,18}') AND TRY_CAST(bytes AS BIGINT) BETWEEN 1 AND 8388608
  AND starts_with(path, user_id || '/') AND EXISTS (SELECT 1 FROM stored_photos s WHERE s.name = path AND s.owner_id = user_id), FALSE) AS good FROM av),
judged AS (SELECT id, CASE WHEN coalesce(plan_id NOT IN ('starter', 'pro'), TRUE) THEN 'plan' WHEN o IS NULL OR json_array_length(o) NOT BETWEEN 1 AND 20 THEN 'offerings_count' WHEN a IS NULL OR json_array_length(a) > 8 THEN 'assets_count'
  WHEN coalesce(length(trim(photo_brief)) > 3000, FALSE) OR coalesce(length(trim(additional_notes)) > 5000, FALSE) THEN 'notes' WHEN EXISTS (SELECT 1 FROM oe WHERE oe.id = j.id AND len(errors) > 0) THEN 'offering'
  WHEN EXISTS (SELECT 1 FROM ae WHERE ae.id = j.id AND NOT good) THEN 'asset' END AS reason FROM j)
"""


@query(_READ + "SELECT id, reason IS NULL AS accepted, reason FROM judged")
def request_decisions(spark, sf_dir):
    """Whether each request is taken, and the first reason against it: one bad element refuses the whole."""
    return _judged(spark, sf_dir).select("id", F.col("reason").isNull().alias("accepted"), "reason")


@query(_READ + "SELECT o.id, position, title, description, CAST(price AS DECIMAL(12, 2)) AS price FROM oe o JOIN judged g ON g.id = o.id WHERE reason IS NULL")
def request_offerings(spark, sf_dir):
    """The offerings of the requests that were taken, by position; a blank price is null."""
    rows = _judged(spark, sf_dir).filter("reason is null").select("id", F.explode("o").alias("x"))
    return rows.select("id", "x.position", "x.title", "x.description", "x.price")


@query(_READ + "SELECT a.id, path, name, mime, CAST(bytes AS BIGINT) AS bytes FROM ae a JOIN judged g ON g.id = a.id WHERE reason IS NULL")
def request_assets(spark, sf_dir):
    return _judged(spark, sf_dir).filter("reason is null").select("id", F.explode("a").alias("x")).select("id", "x.path", "x.name", "x.mime", "x.bytes")


@query(_READ + "SELECT id, position, array_to_string(errors, ',') AS errors FROM oe WHERE len(errors) > 0")
def offering_errors(spark, sf_dir):
    """Each element that is not valid, with what is wrong in it."""
    rows = read_requests(view(spark, sf_dir, "raw_requests")).select("id", F.explode(F.filter("o", lambda x: F.size(x["errors"]) > 0)).alias("x"))
    return rows.select("id", "x.position", F.array_join("x.errors", ",").alias("errors"))
