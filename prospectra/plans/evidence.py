"""Rules of single records: source-specific addresses, lead filters, halts of runs, observations, resets, safe labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import captured as C
from ..functions import ownership as O
from ..functions import text as X
from ..functions import values as V
from ..operators import merge
from .fixtures import VIEWS, view
from .registry import Registry
from .warehouse import _in, usable

REGISTRY = Registry()
query = REGISTRY.query

# ---- addresses of the registry: case does not count, and any of some beginnings makes a role account

_T = "VARCHAR(20)"
VIEWS["registry_emails"] = f"""
SELECT c_custkey AS id, replace(v.x, '#', CAST(c_custkey AS {_T})) AS raw FROM {{customer}} JOIN (VALUES (0, ' Info.Sales#@Acme-#.COM '), (1, 'INFO@x.org'), (2, 'infos@x.org'), (3, 'Sales+#@A.B-c.Co'), (4, 'dispatch_#@x-.com'), (5, 'Joe#@-x.com'), (6, 'hello-#@X.io'),
  (7, 'no at sign'), (8, 'service@@x.com'), (9, 'CustomerService@Big.example.NET'), (10, ''), (11, 'a#@b'), (12, 'operations.#@ok.example.org')) v(i, x) ON c_custkey % 13 = v.i"""


@query(f"""WITH t AS (SELECT id, trim(raw) AS x FROM registry_emails)
SELECT id, lower(x) AS normalized_email, lower(split_part(x, '@', 2)) AS email_domain, regexp_full_match(lower(x), '{V.STRICT_EMAIL_RE.replace("^", "", 1).replace(chr(92) + "z", "").replace("'", "''")}') AS is_valid,
  regexp_matches(lower(split_part(x, '@', 1)), '{V.ROLE_PREFIX_RE}') AS is_role FROM t""")
def registry_email_kinds(spark, sf_dir):
    x = F.trim("raw")
    return view(spark, sf_dir, "registry_emails").select(
        "id", F.lower(x).alias("normalized_email"), F.lower(F.split_part(x, F.lit("@"), F.lit(2))).alias("email_domain"), x.rlike("(?i)" + V.STRICT_EMAIL_RE).alias("is_valid"),
        F.lower(F.split_part(x, F.lit("@"), F.lit(1))).rlike(V.ROLE_PREFIX_RE).alias("is_role"),
    )


# ---- qualified places of the second source

_CATS = [*list(V.NONCOMMERCIAL.values())[:7], "x", "y"]
VIEWS["closing_places"] = f"""
SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN '2026-01-02' END AS date_closed, concat(CASE c_custkey % 11 {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATS))} ELSE 'z' END, '|other') AS category_ids,
  CASE c_custkey % 7 WHEN 0 THEN 'Closed|x' WHEN 1 THEN 'fine' WHEN 2 THEN 'PRIVATEVENUE' END AS flags, CASE c_custkey % 5 WHEN 0 THEN 'test@shop.example.net' WHEN 1 THEN 'bad@' ELSE concat('me', CAST(c_custkey AS {_T}), '@shop.example.net') END AS email
FROM {{customer}}"""


@query(f"""SELECT id, email FROM closing_places WHERE date_closed IS NULL AND len(list_filter(string_split(category_ids, '|'), lambda c: c IN ({_in(V.NONCOMMERCIAL.values())}))) = 0
AND coalesce(len(list_filter(string_split(flags, '|'), lambda f: lower(f) IN ({_in(V.DISQUALIFYING_FLAGS)}))), 0) = 0 AND {usable('email')}""")
def qualified_open_places(spark, sf_dir):
    """Places that have not closed, sell something, carry no bad flag and have a usable address."""
    flagged = F.coalesce(F.exists(F.split("flags", r"\|"), lambda f: F.lower(f).isin(V.DISQUALIFYING_FLAGS)), F.lit(False))
    rows = view(spark, sf_dir, "closing_places").filter(F.col("date_closed").isNull() & ~C.noncommercial(F.split("category_ids", r"\|")) & ~flagged & X.is_usable("email"))
    return rows.select("id", "email")


# ---- exported leads

VIEWS["scraped_leads"] = f"""
SELECT c_custkey AS lead_id, c_name AS name, CASE c_custkey % 5 WHEN 0 THEN 'Coffee Shop' WHEN 1 THEN 'coffee_roaster' WHEN 2 THEN 'Florist' WHEN 3 THEN 'Bar 100%' END AS category, CASE c_custkey % 3 WHEN 0 THEN 'TX' WHEN 1 THEN 'OR' ELSE 'tx' END AS state,
  c_custkey % 4 = 0 AS has_website, c_custkey % 90 AS reviews_count, CASE c_custkey % 3 WHEN 0 THEN 'unclaimed' WHEN 1 THEN 'claimed' ELSE 'unknown' END AS is_claimed, date '2026-01-01' + CAST(c_custkey % 50 AS INT) AS scraped_at, c_acctbal AS unused
FROM {{customer}}"""
#: The columns of an export, in order.
EXPORT = [
    "name", "category", "phone", "full_address", "street", "city", "state", "zip_code", "has_website", "website_type",
    "website_raw", "website_explanation", "is_claimed", "rating", "reviews_count", "price_level", "maps_url", "search_keyword", "search_location", "scraped_at",
]


def leads_where(leads: DataFrame, no_website: bool = True, state: str = "", category: str = "", min_reviews: int = 0, unclaimed: bool = False) -> DataFrame:
    """Leads by the conditions that are given, the newest first."""
    tests = [
        ~F.col("has_website") if no_website else None, F.col("state") == state.upper() if state else None, F.col("category").ilike(f"%{category}%") if category else None,
        F.col("reviews_count") >= min_reviews if min_reviews > 0 else None, F.col("is_claimed") == "unclaimed" if unclaimed else None,
    ]
    return leads.filter(reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))).orderBy(F.desc("scraped_at"))


def flat(leads: DataFrame) -> DataFrame:
    """The columns of an export, those that a lead has not as nulls; others are left out."""
    return leads.select(*[F.col(c) if c in leads.columns else F.lit(None).cast("string").alias(c) for c in EXPORT])


@query("""SELECT name, category, NULL::VARCHAR AS phone, NULL::VARCHAR AS full_address, NULL::VARCHAR AS street, NULL::VARCHAR AS city, state, NULL::VARCHAR AS zip_code, has_website, NULL::VARCHAR AS website_type, NULL::VARCHAR AS website_raw, NULL::VARCHAR AS website_explanation, is_claimed, NULL::VARCHAR AS rating, reviews_count, NULL::VARCHAR AS price_level, NULL::VARCHAR AS maps_url, NULL::VARCHAR AS search_keyword, NULL::VARCHAR AS search_location, scraped_at FROM scraped_leads
WHERE NOT has_website AND state = 'TX' AND category ILIKE '%coffee%' AND reviews_count >= 20 AND is_claimed = 'unclaimed'""")
def exported_leads(spark, sf_dir):
    """All filters of an export at once, as its fixed columns."""
    return flat(leads_where(view(spark, sf_dir, "scraped_leads"), state="tx", category="coffee", min_reviews=20, unclaimed=True))


# ---- the most complete member

VIEWS["members"] = f"""
SELECT o_custkey AS entity_id, concat('p', CAST(o_orderkey AS {_T})) AS place_id, CASE WHEN o_orderkey % 2 = 0 THEN concat('Shop ', CAST(o_orderkey AS {_T})) END AS name, CASE WHEN o_orderkey % 3 <> 0 THEN '1 Elm' END AS address, CASE WHEN o_orderkey % 5 <> 0 THEN '555' END AS telephone,
  CASE WHEN o_orderkey % 7 <> 0 THEN '12345' END AS postcode, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS date_refreshed FROM {{orders}}"""


@query("""SELECT entity_id, place_id, name FROM members QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY CAST(name IS NOT NULL AS INT) + CAST(address IS NOT NULL AS INT) + CAST(telephone IS NOT NULL AS INT) + CAST(postcode IS NOT NULL AS INT) DESC, date_refreshed DESC NULLS LAST, place_id) = 1""")
def most_complete_members(spark, sf_dir):
    """The member with the most fields, then the newest, one without a date last."""
    full = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in ("name", "address", "telephone", "postcode")])
    newest = -F.unix_date(F.col("date_refreshed").cast("date"))
    rows = view(spark, sf_dir, "members")
    return merge.first_per_key(rows, ["entity_id"], -full, F.col("date_refreshed").isNull(), newest, F.col("place_id")).select("entity_id", "place_id", "name")


# ---- halts: the first event of a worker at which a run would stop

VIEWS["worker_log"] = """
SELECT event_id, user_id % 8 AS worker, ts, CASE WHEN user_id % 2 = 0 THEN event_id % 1000 BETWEEN 300 AND 499 ELSE event_id % 5 < 2 END AS throttled,
  CASE WHEN event_id % 4000 = 3999 THEN 'rate_limited' WHEN event_id % 1000 BETWEEN 600 AND 899 AND event_id % 13 <> 0 THEN 'no_data' WHEN event_id % 11 = 0 THEN 'blocked' WHEN event_id % 7 = 0 THEN 'unavailable' WHEN event_id % 3 = 0 THEN 'no_data' ELSE 'succeeded' END AS state
FROM {events}"""


def aborts(log: DataFrame, last: int = 100, least: int = 30, rate: float = 0.35, in_a_row: int = 15) -> DataFrame:
    """(worker, event_id, reason) of each worker's first event at which so many were throttled in a row, or so large a share of the last ones."""
    order = W.partitionBy("worker").orderBy("ts", "event_id")
    seen = log.withColumns({"n": F.count("*").over(order.rowsBetween(1 - last, 0)), "bad": F.count_if("throttled").over(order.rowsBetween(1 - last, 0)), "island": F.count_if(~F.col("throttled")).over(order)})
    row = F.count_if("throttled").over(W.partitionBy("worker", "island").orderBy("ts", "event_id"))
    seen = seen.withColumn("row", row)
    reason = F.when(F.col("row") >= in_a_row, F.concat(F.lit("consecutive:"), "row")).when((F.col("n") >= least) & (F.col("bad") >= rate * F.col("n")), F.concat(F.lit("rate:"), "bad", F.lit("/"), "n"))
    hit = seen.withColumn("reason", reason).filter("reason is not null")
    return hit.groupBy("worker").agg(F.min_by(F.struct("event_id", "reason"), F.struct("ts", "event_id")).alias("h")).select("worker", "h.*")


@query("""WITH s AS (SELECT *, count(*) OVER l AS n, count(*) FILTER (WHERE throttled) OVER l AS bad, count(*) FILTER (WHERE NOT throttled) OVER o AS island FROM worker_log
  WINDOW l AS (PARTITION BY worker ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), o AS (PARTITION BY worker ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, count(*) FILTER (WHERE throttled) OVER (PARTITION BY worker, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT worker, event_id, CASE WHEN k >= 15 THEN 'consecutive:' || k ELSE 'rate:' || bad || '/' || n END AS reason FROM r WHERE k >= 15 OR (n >= 30 AND bad >= 0.35 * n) QUALIFY row_number() OVER (PARTITION BY worker ORDER BY ts, event_id) = 1""")
def throttle_aborts(spark, sf_dir):
    """Where each worker's run stops, by either rule."""
    return aborts(view(spark, sf_dir, "worker_log"))


def halts(log: DataFrame, budget: int, most_empty: int = 20, hard: tuple[str, ...] = ("rate_limited",)) -> DataFrame:
    """What each worker did before its run ended: at its budget, at a hard outcome, or after so many without data since the last that had some.

    Blocked outcomes neither count as empty nor end a row of empty ones.
    """
    order = W.partitionBy("worker").orderBy("ts", "event_id")
    n = log.withColumns({"n": F.row_number().over(order), "group": F.count_if(F.col("state").isin("succeeded", "unavailable")).over(order)}).filter(F.col("n") <= budget)
    n = n.withColumn("empty", F.count_if(F.col("state") == "no_data").over(W.partitionBy("worker", "group").orderBy("ts", "event_id")))
    reason = F.when(F.col("state").isin(*hard), F.col("state")).when((F.col("empty") >= most_empty) & (F.col("state") == "no_data"), F.concat(F.lit("consecutive_no_data:"), "empty"))
    ends = n.withColumn("reason", reason).withColumn("end", F.min(F.when(F.col("reason").isNotNull(), F.col("n"))).over(W.partitionBy("worker")))
    done = ends.filter(F.col("end").isNull() | (F.col("n") <= F.col("end")))
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return done.groupBy("worker").agg(F.count("*").alias("claimed"), count("succeeded"), count("no_data"), count("unavailable"), count("blocked"), F.max("reason").alias("halted_reason"))


@query("""WITH n AS (SELECT *, row_number() OVER o AS n, count(*) FILTER (WHERE state IN ('succeeded', 'unavailable')) OVER o AS g FROM worker_log WINDOW o AS (PARTITION BY worker ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, count(*) FILTER (WHERE state = 'no_data') OVER (PARTITION BY worker, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS empty FROM n WHERE n <= 900),
r AS (SELECT *, CASE WHEN state = 'rate_limited' THEN state WHEN empty >= 20 AND state = 'no_data' THEN 'consecutive_no_data:' || empty END AS reason FROM e),
f AS (SELECT worker, min(n) AS stop FROM r WHERE reason IS NOT NULL GROUP BY 1)
SELECT worker, count(*) AS claimed, count(*) FILTER (WHERE state = 'succeeded') AS succeeded, count(*) FILTER (WHERE state = 'no_data') AS no_data, count(*) FILTER (WHERE state = 'unavailable') AS unavailable, count(*) FILTER (WHERE state = 'blocked') AS blocked, max(reason) AS halted_reason
FROM r LEFT JOIN f USING (worker) WHERE stop IS NULL OR n <= stop GROUP BY 1""")
def budget_halts(spark, sf_dir):
    return halts(view(spark, sf_dir, "worker_log"), 900)


# ---- observations of matches

VIEWS["match_results"] = f"""
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'ambiguous' ELSE 'not_found' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN concat('https://r', CAST(o_orderkey AS {_T}), '.example') END AS review_url,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('https://l', CAST(o_orderkey AS {_T}), '.example') END AS listed_url FROM {{orders}}"""


def observation(status: Column, review_url: Column, listed_url: Column) -> list[Column]:
    """What a decision says of a business: whether it exists, its site, and what is to be checked."""
    matched = status == "matched"
    url = F.coalesce(review_url, F.when(matched, listed_url))
    found = matched & url.isNotNull()
    return [
        matched.alias("exists_there"), url.alias("website_url"), found.alias("website_found"), F.when(found, "queued").otherwise("not_applicable").alias("check_state"),
        F.when(~found, F.lit(False)).alias("website_verified"), F.when(matched & ~found, "not_listed_on_google").when(~matched, "business_not_found_on_google").alias("website_status"),
    ]


@query("""SELECT id, status = 'matched' AS exists_there, coalesce(review_url, CASE WHEN status = 'matched' THEN listed_url END) AS website_url, status = 'matched' AND coalesce(review_url, listed_url) IS NOT NULL AS website_found,
  CASE WHEN status = 'matched' AND coalesce(review_url, listed_url) IS NOT NULL THEN 'queued' ELSE 'not_applicable' END AS check_state, CASE WHEN NOT (status = 'matched' AND coalesce(review_url, listed_url) IS NOT NULL) THEN FALSE END AS website_verified,
  CASE WHEN status <> 'matched' THEN 'business_not_found_on_google' WHEN coalesce(review_url, listed_url) IS NULL THEN 'not_listed_on_google' END AS website_status FROM match_results""")
def match_observations(spark, sf_dir):
    return view(spark, sf_dir, "match_results").select("id", *observation(F.col("status"), F.col("review_url"), F.col("listed_url")))


# ---- labels without credentials

VIEWS["connection_labels"] = f"""
SELECT s_suppkey AS id, replace(v.x, '#', CAST(s_suppkey AS {_T})) AS url FROM {{supplier}} JOIN (VALUES (0, 'postgresql://me:secret#@Db.example:5432/leads?x=1#f'), (1, 'postgresql://me@db.example/leads'), (2, 'http://:p@h/'), (3, 'http://u:@h:80/a:b@c'), (4, 'plain text: a@b'), (5, 'socks5://user:pa:ss@1.2.3.4:99'), (6, 'https://h/p?q=u:p@x')) v(i, x) ON s_suppkey % 7 = v.i"""


def display_url(url: Column) -> Column:
    """An address safe to print: with a password, the user, *** and the host in lower case; else as it is."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:@]*):([^/?#]*)@([^/?#@:]*)(:[0-9]+)?([/?#].*)?$"
    part = lambda i: F.regexp_extract(url, parts, i)
    shown = F.concat(F.lower(part(1)), F.lit("://"), part(2), F.lit(":***@"), F.lower(part(4)), part(5), part(6))
    return F.when(url.rlike(parts), shown).otherwise(url)


@query("""SELECT id, CASE id % 7 WHEN 0 THEN 'postgresql://me:***@db.example:5432/leads?x=1' || CAST(id AS VARCHAR) || 'f' WHEN 2 THEN 'http://:***@h/' WHEN 3 THEN 'http://u:***@h:80/a:b@c' WHEN 5 THEN 'socks5://user:***@1.2.3.4:99' ELSE url END AS url FROM connection_labels""")
def safe_urls(spark, sf_dir):
    return view(spark, sf_dir, "connection_labels").select("id", display_url(F.col("url")).alias("url"))


# ---- search results

VIEWS["search_hits"] = f"""
SELECT c_custkey AS id, v.name, v.phone, v.category, replace(v.hit, '#', CAST(c_custkey AS {_T})) AS hit, v.ok FROM {{customer}} JOIN (VALUES (0, 'Bluebird Cafe', '(512) 555-0100', 'Cafe', 'Bluebird Cafe # menu', true), (1, 'Bluebird Cafe', '(512) 555-0100', 'Cafe', 'call 512.555.0100 now', true), (2, 'Bluebird Cafe', '', 'Cafe', 'a bluebird # sings', false),
  (3, 'Silver Fern Florist', '', 'Florist', 'fern and silver #', true), (4, 'The Company', '', '', 'the company #', false), (5, 'Silver Fern Florist', '555', 'Florist', 'silver 555 #', false), (6, 'Service Center', '5125550111', '', 'service center 5125550111', true), (7, '', '', '', 'anything', false)) v(i, name, phone, category, hit, ok) ON c_custkey % 8 = v.i"""


@query("SELECT id, ok AS relevant FROM search_hits")
def relevant_results(spark, sf_dir):
    """Whether a search result is about the business; the expected values stand in the fixture."""
    return view(spark, sf_dir, "search_hits").select("id", O.result_relevant(F.col("hit"), F.col("name"), F.col("phone"), F.col("category")).alias("relevant"))


# ---- a campaign's reset


def reset_queue(queue: DataFrame, leads: DataFrame, campaign: int) -> DataFrame:
    """(campaign_id, place_id, status, attempts) after a reset: the campaign's rows anew, one for each lead without a site, the others as they were."""
    fresh = leads.filter(~F.col("has_website")).select(F.lit(campaign).cast("long").alias("campaign_id"), "place_id", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts")).distinct()
    return queue.filter(F.col("campaign_id") != campaign).select("campaign_id", "place_id", "status", F.col("attempts").cast("long").alias("attempts")).unionByName(fresh)


def reset_searches(searches: DataFrame, campaign: int) -> DataFrame:
    """Work in progress of the campaign waits again, without its error."""
    mine = (F.col("campaign_id") == campaign) & (F.col("status") == "in_progress")
    return searches.withColumns({"error_message": F.when(~mine, F.col("error_message")), "status": F.when(mine, "pending").otherwise(F.col("status"))})


@query("""SELECT campaign_id, place_id, status, CAST(attempts AS BIGINT) AS attempts FROM email_queue WHERE campaign_id <> 2 UNION ALL SELECT DISTINCT CAST(2 AS BIGINT), place_id, 'pending', CAST(0 AS BIGINT) FROM leads WHERE NOT has_website""")
def campaign_reset_queue(spark, sf_dir):
    q = view(spark, sf_dir, "email_queue").withColumn("campaign_id", F.col("campaign_id").cast("long"))
    return reset_queue(q, view(spark, sf_dir, "leads"), 2)


@query("""SELECT id, campaign_id, CASE WHEN campaign_id = 2 AND status = 'in_progress' THEN 'pending' ELSE status END AS status, CASE WHEN NOT (campaign_id = 2 AND status = 'in_progress') THEN error_message END AS error_message FROM email_queue""")
def campaign_reset_searches(spark, sf_dir):
    return reset_searches(view(spark, sf_dir, "email_queue").select("id", "campaign_id", "status", "error_message"), 2)
