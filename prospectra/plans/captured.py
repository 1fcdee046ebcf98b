"""Captured answers: fetch outcomes, redirects, page metadata, mails, offers, reviews, DNS records, releases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import captured as C
from ..functions import values as V
from ..sources import tables
from .fixtures import view
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


@query("""WITH h AS (SELECT id, url, coalesce(code, 0) AS code, lower(error) AS e, lower(regexp_extract(url, '^(?i:https?)://([^/?#@]*@)?([^/?#:]*)', 2)) AS host FROM captures),
b AS (SELECT *, host IN ('', 'localhost') OR ends_with(host, '.local') AS bad FROM h)
SELECT id, CASE WHEN url <> '' THEN NOT bad AND e IS NULL AND code BETWEEN 200 AND 399 END AS live, CASE WHEN url IS NULL OR url = '' THEN NULL WHEN bad THEN 'invalid_url'
  WHEN contains(e, 'timeout') OR contains(e, 'timed out') THEN 'timeout' WHEN regexp_matches(e, 'ssl|tls|certificate') THEN 'tls_error' WHEN contains(e, 'redirect') THEN 'too_many_redirects' WHEN e IS NOT NULL THEN 'network_error'
  WHEN code BETWEEN 200 AND 399 THEN 'live' WHEN code = 0 THEN 'http_unknown' ELSE 'http_' || code END AS status FROM b""")
def website_outcome(spark, sf_dir):
    return view(spark, sf_dir, "captures").select("id", C.fetch_outcome("url", "code", "error").alias("o")).select("id", "o.live", "o.status")


@query("""WITH b AS (SELECT id, coalesce(href, '') AS h, replace(replace(regexp_extract(href, '[?&]u=a1([^&#]*)', 1), '-', '+'), '_', '/') AS c FROM captures)
SELECT id, CASE WHEN contains(h, 'bing.com/ck/a') AND regexp_matches(h, '[?&]u=a1') THEN coalesce(TRY(decode(from_base64(c || repeat('=', (4 - length(c) % 4) % 4)))), h) ELSE h END AS target FROM b""")
def redirect_decode(spark, sf_dir):
    return view(spark, sf_dir, "captures").select("id", C.redirect_target("href").alias("target"))


@query(r"""WITH d AS (SELECT id, trim(regexp_extract(page, '<meta[^>]*property=["'']og:description["''][^>]*content=["'']([^"'']+)["'']', 1, 'i')) AS d FROM captures),
n AS (SELECT id, regexp_extract(d, '([0-9,]+)\s+likes?', 1, 'i') AS a, regexp_extract(d, '([0-9,]+)\s+talking about this', 1, 'i') AS b, regexp_extract(d, '([0-9,]+)\s+were here', 1, 'i') AS c,
  CASE WHEN contains(d, '.') THEN trim(string_split(d, '.')[-1]) END AS last FROM d)
SELECT id, TRY_CAST(replace(a, ',', '') AS BIGINT) AS likes, TRY_CAST(replace(b, ',', '') AS BIGINT) AS talking, TRY_CAST(replace(c, ',', '') AS BIGINT) AS were_here,
  CASE WHEN last <> '' AND length(last) < 60 AND NOT regexp_matches(last, '[0-9]') THEN last END AS category FROM n""")
def page_metadata(spark, sf_dir):
    return view(spark, sf_dir, "captures").select("id", C.page_metadata("page").alias("m")).select("id", "m.*")


@query(r"""WITH a AS (SELECT id, mail, regexp_replace(regexp_replace(coalesce(mail, ''), '<script.*?</script>', '', 'gis'), '<style.*?</style>', '', 'gis') AS x FROM captures),
b AS (SELECT id, mail, url_decode(replace(regexp_replace(regexp_replace(x, '<br\s*/?>|</p>|</div>', chr(10), 'gi'), '<[^>]+>', '', 'g'), '&nbsp;', ' ')) AS x FROM a),
c AS (SELECT id, x, string_split(regexp_split_to_array(mail, '\n(?:On .{5,120} wrote:|-{2,} ?Original Message|From: .+\nSent: )')[1], chr(10)) AS lines FROM b)
SELECT id, trim(regexp_replace(x, '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS plain, trim(array_to_string(list_filter(lines, lambda l: NOT starts_with(l, '>')), chr(10)), ' ' || chr(10)) AS reply FROM c""")
def mail_texts(spark, sf_dir):
    return view(spark, sf_dir, "captures").select("id", C.html_text("mail").alias("plain"), C.new_part("mail").alias("reply"))


@query(r"""WITH a AS (SELECT id, trim(price) AS raw, replace(regexp_replace(trim(price), '^\$\s*', ''), ',', '') AS amount FROM captures), b AS (SELECT *, raw = '' OR regexp_full_match(amount, '[0-9]{1,10}([.][0-9]{1,2})?') AS ok FROM a)
SELECT id, CASE WHEN ok THEN amount ELSE '' END AS price, CASE WHEN ok THEN ' Offer ' || id ELSE 'Offer ' || id || chr(10) || chr(10) || 'Price: ' || raw END AS description FROM b""")
def offer_tidy(spark, sf_dir):
    rows = view(spark, sf_dir, "captures").select("id", "price", F.concat(F.lit(" Offer "), F.col("id").cast("string")).alias("description"))
    return rows.select("id", C.tidy_offer("price", "description").alias("o")).select("id", "o.price", "o.description")


@query(f"""WITH j AS (SELECT id, CASE WHEN json_valid(payload) THEN payload::JSON END AS p FROM captures), f AS (SELECT id, p, TRY_CAST(json_extract_string(p, '{V.REVIEW_MICROS}') AS BIGINT) AS us FROM j)
SELECT id, CASE WHEN p IS NOT NULL THEN json_extract(p, '$[2][0]') IS NOT NULL END AS has_reviews, CASE WHEN us > 0 THEN us // 1000000 END AS newest_s,
  CASE WHEN json_type(p, '{V.REVIEW_RELATIVE}') = 'VARCHAR' THEN json_extract_string(p, '{V.REVIEW_RELATIVE}') END AS relative,
  CASE WHEN p IS NOT NULL THEN coalesce(json_extract_string(p, '$[5]') = 'true', false) END AS exhausted FROM f""")
def review_payloads(spark, sf_dir):
    made = view(spark, sf_dir, "captures").select("id", C.newest_review("payload").alias("r"))
    return made.select("id", "r.has_reviews", F.unix_seconds("r.at").alias("newest_s"), "r.relative", "r.exhausted")


_LIST = "CASE WHEN {0} = 'none' THEN NULL WHEN {0} = '' THEN [] ELSE string_split({0}, '|') END AS {0}"
_OURS = "len({0}) > 0 AND len(list_filter({0}, lambda z: NOT regexp_matches(z, '" + V.HOST_IP_RE + "'))) = 0"


@query(f"""WITH r AS (SELECT id, {', '.join(map(_LIST.format, ['ns', 'apex', 'cname', 'www']))} FROM dns_answers),
n AS (SELECT id, ns IS NULL AND apex IS NULL AS unavailable, coalesce(ns, []) AS ns, coalesce(apex, []) AS apex, coalesce(cname, []) AS cname, coalesce(www, []) AS www FROM r),
s AS (SELECT id, unavailable, len(ns) + len(apex) > 0 AS registered, {_OURS.format('apex')} AS apex_connected, len(list_filter(cname, lambda z: regexp_matches(z, '{V.HOST_NAME_RE}'))) > 0 OR ({_OURS.format('www')}) AS www_connected,
  len(list_filter(apex || cname || www, lambda z: regexp_matches(z, '{V.PARKING_RE}'))) > 0 AS parking FROM n)
SELECT *, registered AND (apex_connected OR www_connected) AS ready FROM s""")
def domain_state(spark, sf_dir):
    answers = lambda c: F.when(F.col(c) == "none", None).when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\|")).alias(c)
    rows = view(spark, sf_dir, "dns_answers").select("id", *map(answers, ["ns", "apex", "cname", "www"]))
    return rows.select("id", C.domain_state("ns", "apex", "cname", "www").alias("s")).select("id", "s.*")


@query(f"""WITH c AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN ['x', '{V.NONCOMMERCIAL["City"]}'] WHEN 1 THEN ['{V.NONCOMMERCIAL["Taxi"]}'] WHEN 2 THEN ['x'] END AS ids FROM customer)
SELECT id, coalesce(len(list_filter(ids, lambda z: z IN ({', '.join(map(repr, V.NONCOMMERCIAL.values()))}))) > 0, false) AS noncommercial FROM c""")
def noncommercial_places(spark, sf_dir):
    k = F.col("c_custkey")
    ids = F.when(k % 4 == 0, F.array(F.lit("x"), F.lit(V.NONCOMMERCIAL["City"]))).when(k % 4 == 1, F.array(F.lit(V.NONCOMMERCIAL["Taxi"]))).when(k % 4 == 2, F.array(F.lit("x")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), C.noncommercial(ids).alias("noncommercial"))


@query(r"""WITH d AS (SELECT *, regexp_extract(path, 'dt=([^/]+)', 1) AS release FROM release_files)
SELECT release, regexp_extract(path, 'places_[0-9]+\.parquet', 0) AS source_file, CAST(count(*) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes
FROM d WHERE release = (SELECT max(release) FROM d) GROUP BY ALL""")
def latest_release_files(spark, sf_dir):
    """The newest release of a listing, by data file."""
    rows = tables.latest_release(view(spark, sf_dir, "release_files")).withColumn("source_file", F.regexp_extract("path", r"places_[0-9]+\.parquet", 0))
    return rows.groupBy("release", "source_file").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
