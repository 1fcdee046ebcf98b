"""Captured answers of a listing service: framed results, place arrays anywhere inside them, their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payloads as P
from .fixtures import VIEWS, view
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query
RPC = "qv9Egd"

# Answers of customers. A place array has 204 slots, most of them null; kinds of slots change with the key, so that all fallbacks occur.
_Q = "chr(34)"
_K = "CAST(k AS VARCHAR(20))"


def _json(*parts: str) -> str:
    """SQL of a text in which ~ stands for a double quote and # for the key; braces are doubled, as views are templates."""
    plain = lambda p: "'" + p.replace("{", "{{").replace("}", "}}") + "'"
    return "concat(" + ", ".join(p if p.startswith("CASE") else plain(p) for p in parts) + ")"


def _case(rule: str, *texts: str) -> str:
    return f"CASE {rule} " + " ".join(f"WHEN {i} THEN {_json(t)[7:-1]}" for i, t in enumerate(texts)) + " END"


def _filled(text: str, key: str = _K) -> str:
    return f"replace(replace({text}, '~', {_Q}), '#', {key})"


_PLACE = _json(
    "[null,null,", _case("k % 4", '[~# Line St~,~Austin~]', "[]", "7", "[null]"), ",null,",
    _case("k % 9", "[0,0,0,[~u~,~1,#2 Reviews~],0,0,0,4.5,27]", "[0,0,0,null,0,0,0,~3.25~,~#~]", "[0,0,0,[~u~,~9 reviews~]]", "null", "[0,0,0,[~u~,~none~],0,0,0,null,null]",
          "[0,0,0,[~u~,~1 review~],0,0,0,~x~,~2.5~]", "~4~", "[0,0,0,0,0,0,0,5,12.9]", "[0,0,0,null,0,0,0,[1],{~a~:1}]"),
    ",null,null,", _case("k % 5", '[~https://shop#.example.net~,~shop~]', '[~shop#.example.net~,~http://again#.example.net~]', "[]", "null", "[3,~ftp://x~]"),
    ",null,", _case("k % 6", "[null,null,30.25,-97.5]", "[null,null,~30.5~,~-97~]", "[1,2,3,null]", "[1,2,~x~,4,5]", "[null,null,31,-98,7]", "[0,0,0,0]"),
    ",", _case("k % 7", "~0x1:0xff#~", "~0x12:0xFFFFFFFFFFFFFFFF~", "~0xg:0x1~", "null", "~0x1:0x000000000000000000a#~", "~0x1:0x11111111111111111~", "5"),
    ",", _case("k % 11", "~Café No. # & Co~", "~Shop #~", "~Bar~", "~A*b ~", "~Shop + #~", "~S~", "~Shop #~", "~x/y~", "~~", "5", "~Last~"), ",null,",
    _case("k % 5", "[~Florist~,3,~Shop~]", "~Bakery~", "null", "[]", "{~a~:1}"), "," + "null," * 25, _case("k % 3", "~# Full Rd, Dallas, TX 75001~", "null", "4"), "," + "null," * 17,
    _case("k % 4", "[0,~Ann (Owner)~]", "[0,~Ann~]", "[~(Owner)~]", "null"), "," + "null," * 18, _case("k % 2", "[~Other~,~More~]", "null"), ",null,",
    _case("k % 13", "~ChIJ#~", "~ChIJsame~", "~ChIJ#a~", "~ChIJ#b~", "~chij#~", "~ChIJ#c~", "null", "~ChIJ#d~", "~ChIJ#e~", "~ChIJ#f~", "~ChIJ#g~", "~ChIJ#h~", "~ChIJ#i~"),
    "," + "null," * 9, _case("k % 5", "[~Temporarily closed~]", "[~CLOSED~]", "[~Open~]", "null", "~closed~"), "," + "null," * 89,
    _case("k % 6", "[[~(512) 555-0#~,1]]", "[~512-555-1234~]", "[]", "null", "[[5]]", "[[~+44 20~]]"), "," + "null," * 24,
    _case("k % 5", "[[[~Mon~,1,2,[[~9 to 5~,8]]],[~Tue~,1,2,[]],[~Mon~,1,2,[[~10 to 4~]]],[3,1,2,[[~x~]]],~Wed~,[~Sun~,0,0,[[~Closed~]]]]]", "null", "[5]", "[[]]", "[[[~Fri~,0,0,[~y~]]]]"), "]",
)
_SHORT = _json("[~x~,[~ChIJ#~],", "CASE WHEN k % 2 = 0 THEN '{{}}' ELSE 'null' END", "]")
VIEWS["rpc_places"] = f"""
SELECT k AS id, CASE k % 4 WHEN 0 THEN concat('[', place, ',[[[', place, ',', twin, ']]]]') WHEN 1 THEN concat('[[], [', other, ',[1,[[', twin, ']],', other, ']]]') WHEN 2 THEN concat('[[[[[[', place, ']]]],', other, '],', twin, ']') ELSE concat('[', other, CASE WHEN k % 3 = 0 THEN ',' ELSE ']' END) END AS payload
FROM (SELECT k, {_filled("p")} AS place, {_filled("p", "CAST(k + 1 AS VARCHAR(20))")} AS twin, {_filled(_SHORT)} AS other FROM (SELECT c_custkey AS k, {_PLACE.replace("k % ", "c_custkey % ")} AS p FROM {{customer}}) c) t"""
_INNER = f"replace(payload, {_Q}, concat(chr(92), {_Q}))"
_FRAME = f"concat('[[', {_Q}, 'wrb.fr', {_Q}, ',', {_Q}, CASE WHEN id % 5 = 0 THEN 'other' ELSE '{RPC}' END, {_Q}, ',', CASE WHEN id % 7 = 3 THEN 'null' ELSE concat({_Q}, {_INNER}, {_Q}) END, CASE WHEN id % 11 = 4 THEN '' ELSE ',null]' END, CASE WHEN id % 11 = 4 THEN ',4' ELSE ',[5]]' END)"
VIEWS["rpc_answers"] = f"""
SELECT id, concat(CASE WHEN id % 3 = 0 THEN concat(')]}}}}', chr(39), chr(10), chr(10)) WHEN id % 3 = 1 THEN '  ' ELSE '' END,
  CASE WHEN id % 4 = 0 THEN concat('5', chr(10), '[[1', chr(10)) ELSE '' END, CAST(length(body) + CASE WHEN id % 6 = 5 THEN 9 ELSE 2 END AS VARCHAR(20)), chr(13), chr(10), CASE WHEN id % 9 = 8 THEN left(body, length(body) - 3) ELSE body END, chr(10),
  '25', chr(10), '[[', {_Q}, 'e', {_Q}, ',4,null,null,141]]') AS raw
FROM (SELECT id, {_FRAME} AS body FROM ({VIEWS["rpc_places"]}) p) t"""


@query(f"""WITH l AS (SELECT id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i, lines FROM (
  SELECT id, list_transform(string_split_regex(CASE WHEN starts_with(ltrim(raw), ')]}}''') THEN ltrim(substr(ltrim(raw), 5), chr(13) || chr(10)) ELSE ltrim(raw) END, '\\r\\n|\\r|\\n'), lambda x: trim(x)) AS lines FROM rpc_answers)),
f AS (SELECT id, i, CASE WHEN i > 1 AND regexp_full_match(lines[i - 1], '[0-9]{{1,9}}') THEN CAST(lines[i - 1] AS INT) END AS declared, line FROM l WHERE starts_with(line, '[')),
e AS (SELECT id, i, j, declared = length(line) + 2 AS framed, json_extract(line, '$[' || j || ']') AS e FROM (SELECT *, unnest(range(CAST(json_array_length(line) AS BIGINT))) AS j FROM f WHERE json_valid(line))),
hit AS (SELECT id, arg_min({{'p': CASE WHEN json_type(e, '$[2]') = 'VARCHAR' THEN e ->> '$[2]' END, 'f': coalesce(framed, FALSE)}}, i * 1000 + j) AS r FROM e
  WHERE json_type(e) = 'ARRAY' AND json_array_length(e) >= 3 AND json_type(e, '$[0]') = 'VARCHAR' AND e ->> '$[0]' = 'wrb.fr' AND json_type(e, '$[1]') = 'VARCHAR' AND e ->> '$[1]' = '{RPC}' GROUP BY id)
SELECT a.id, hit.id IS NOT NULL AS answered, md5(r.p) AS payload_md5, r.f AS framed, (SELECT count(*) FROM f WHERE f.id = a.id) AS n_frames, (SELECT count(*) FROM f WHERE f.id = a.id AND NOT coalesce(declared = length(line) + 2, FALSE)) AS n_lying
FROM rpc_answers a LEFT JOIN hit USING (id)""")
def rpc_results(spark, sf_dir):
    """The first result of one call in each answer, and how many frames are not as long as they say."""
    a = view(spark, sf_dir, "rpc_answers").select("id", P.frames(F.col("raw")).alias("f"))
    r = F.get(P.results(F.col("f"), RPC), F.lit(0))
    return a.select("id", r.alias("r"), F.size("f").cast("long").alias("n_frames"), F.size(F.filter("f", lambda f: ~P.honest(f))).cast("long").alias("n_lying")).select(
        "id", F.col("r").isNotNull().alias("answered"), F.md5("r.payload").alias("payload_md5"), "r.framed", "n_frames", "n_lying"
    )


_IS_PLACE = """(json_type(v) = 'ARRAY' AND json_array_length(v) > 178 AND json_type(v, '$[11]') = 'VARCHAR' AND v ->> '$[11]' <> '' AND json_type(v, '$[9]') = 'ARRAY' AND json_array_length(v, '$[9]') > 3
    AND json_type(v, '$[78]') = 'VARCHAR' AND starts_with(v ->> '$[78]', 'ChIJ'))"""
WALK = f"""WITH RECURSIVE top AS (SELECT id, CAST(payload AS JSON) AS v FROM rpc_places WHERE json_valid(payload)),
walk AS (SELECT id, CAST([] AS INT[]) AS path, v, {_IS_PLACE} AS place FROM top
  UNION ALL SELECT id, path, v, {_IS_PLACE} FROM (SELECT id, list_append(path, CAST(i AS INT)) AS path, json_extract(v, '$[' || i || ']') AS v FROM (SELECT *, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS i FROM walk WHERE NOT place AND json_type(v) = 'ARRAY'))
  WHERE json_type(v) = 'ARRAY'),
found AS (SELECT id, v ->> '$[78]' AS place_id, path, v FROM walk WHERE place QUALIFY row_number() OVER (PARTITION BY id, v ->> '$[78]' ORDER BY path) = 1)
"""


def found_places(spark, sf_dir) -> DataFrame:
    rows = view(spark, sf_dir, "rpc_places").select("id", F.try_parse_json("payload").alias("v"))
    return P.places_in(rows, "id", "v")


@query(WALK + "SELECT id, place_id, array_to_string(path, '.') AS path FROM found")
def place_arrays_found(spark, sf_dir):
    """Where in each answer a place array stands, whatever is around it."""
    return found_places(spark, sf_dir).select("id", "place_id", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))


def _text(path: str) -> str:
    return f"CASE WHEN json_type(v, '{path}') = 'VARCHAR' THEN v ->> '{path}' END"


def _number(path: str) -> str:
    return f"CASE WHEN json_type(v, '{path}') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN CAST(v ->> '{path}' AS DOUBLE) WHEN json_type(v, '{path}') = 'VARCHAR' THEN TRY_CAST(trim(v ->> '{path}') AS DOUBLE) END"


def _strings(path: str) -> str:
    return f"list_transform(list_filter(range(CAST(json_array_length(v, '{path}') AS BIGINT)), lambda i: json_type(v, '{path}[' || i || ']') = 'VARCHAR'), lambda i: v ->> ('{path}[' || i || ']'))"


_PHONE = r"(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})"


@query(WALK + f""", p AS (SELECT id, place_id, v, {_text(P.NAME)} AS name, {_number(P.LATITUDE)} AS lat, {_number(P.LONGITUDE)} AS lng,
  CASE WHEN json_type(v, '$[13]') = 'ARRAY' THEN {_strings(P.CATEGORIES)} WHEN json_type(v, '$[13]') = 'VARCHAR' THEN [v ->> '$[13]'] WHEN json_type(v, '$[76]') = 'ARRAY' THEN {_strings(P.OTHER_CATEGORIES)} ELSE [] END AS cats,
  coalesce(CASE json_type(v, '$[4][8]') WHEN 'UBIGINT' THEN CAST(v ->> '$[4][8]' AS BIGINT) WHEN 'BIGINT' THEN CAST(v ->> '$[4][8]' AS BIGINT) WHEN 'DOUBLE' THEN CAST(trunc(CAST(v ->> '$[4][8]' AS DOUBLE)) AS BIGINT)
      WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(v ->> '$[4][8]'), '[+-]?[0-9]+') THEN CAST(trim(v ->> '$[4][8]') AS BIGINT) END END,
    TRY_CAST(replace(regexp_extract({_text(P.REVIEW_TEXT)}, '([0-9][0-9,]*)\\s+reviews?', 1, 'i'), ',', '') AS BIGINT)) AS n,
  coalesce({_text(P.PHONES + '[0]')}, {_text(P.PHONES)}) AS ph, coalesce(CASE WHEN starts_with({_text(P.SITE)}, 'http') THEN v ->> '{P.SITE}' END, CASE WHEN starts_with({_text(P.SITE_AGAIN)}, 'http') THEN v ->> '{P.SITE_AGAIN}' END) AS web,
  regexp_extract({_text(P.DATA_ID)}, '^0x[0-9a-fA-F]+:0x0*([0-9a-fA-F]{{1,16}})$', 1) AS hex, upper({_text(P.CLOSURE)}) AS closure FROM found),
d AS (SELECT id, place_id, x ->> '$[0]' AS day, x ->> '$[3][0][0]' AS time, i FROM (SELECT id, place_id, i, json_extract(v, '$[203][0][' || i || ']') AS x FROM (SELECT id, place_id, v, unnest(range(CAST(json_array_length(v, '$[203][0]') AS BIGINT))) AS i FROM found WHERE json_type(v, '$[203][0]') = 'ARRAY'))
  WHERE json_type(x, '$[0]') = 'VARCHAR' AND json_type(x, '$[3][0]') = 'ARRAY' AND json_type(x, '$[3][0][0]') = 'VARCHAR' AND x ->> '$[0]' <> ''),
h AS (SELECT id, place_id, string_agg(day || '=' || time, ';' ORDER BY day) AS hours FROM (SELECT id, place_id, day, arg_max(time, i) AS time FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT id, place_id, name, cats[1] AS category, array_to_string(cats, '|') AS all_categories, {_number(P.RATING)} AS rating, coalesce(n, 0) AS reviews_count, n IS NOT NULL AS review_count_available,
  coalesce({_text(P.ADDRESS)}, {_text(P.ADDRESS_LINE)}) AS full_address,
  CASE WHEN ph <> '' THEN CASE WHEN regexp_matches(ph, '{_PHONE}') THEN '(' || regexp_extract(ph, '{_PHONE}', 1) || ') ' || regexp_extract(ph, '{_PHONE}', 2) || '-' || regexp_extract(ph, '{_PHONE}', 3) ELSE trim(ph) END END AS phone,
  web AS website_raw, CASE WHEN lng IS NOT NULL THEN lat END AS latitude, CASE WHEN lat IS NOT NULL THEN lng END AS longitude, CASE WHEN hex <> '' THEN CAST(CAST('0x' || hex AS UBIGINT) AS VARCHAR) END AS cid, coalesce(hours, '') AS hours,
  CASE WHEN contains(closure, 'CLOSED') THEN CASE WHEN contains(closure, 'TEMP') THEN 'CLOSED_TEMPORARILY' ELSE 'CLOSED_PERMANENTLY' END ELSE 'OPERATIONAL' END AS business_status,
  coalesce(contains({_text(P.OWNER)}, '(Owner)'), FALSE) AS is_claimed_owner, '{P.MAPS}' || replace(replace(url_encode(name), '%20', '+'), '*', '%2A') || '&query_place_id=' || place_id AS maps_url
FROM p LEFT JOIN h USING (id, place_id)""")
def place_array_fields(spark, sf_dir):
    """Each found place's fields by position, with their fallbacks."""
    v = F.col("place")
    made = found_places(spark, sf_dir).select("id", "place_id", *P.place_fields(v))
    hours = F.array_join(F.transform(F.array_sort(F.map_entries("operating_hours")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return made.withColumn("hours", hours).withColumn("all_categories", F.array_join("all_categories", "|")).drop("operating_hours")
