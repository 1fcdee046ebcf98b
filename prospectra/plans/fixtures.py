"""Lead-shaped views over the driver's tables, as SQL that Spark and DuckDB both read.

Each is one narrow or aggregated query; ids come from the keys themselves, so
no global numbering is needed: an entity's id is its source's rank times
10**9 plus its key, hence lower ids belong to earlier sources.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators.spread import spread

VIEWS: dict[str, str] = {
    # three sources of business entities
    "ent": """
SELECT rnk * 1000000000 + k AS entity_id, src AS source, rnk, k, concat(src, CAST(k AS VARCHAR(20))) AS place_id,
  concat('Shop ', CAST(CASE WHEN k % 2 = 0 THEN k ELSE k + 1000000 * rnk END AS VARCHAR(20))) AS name,
  lpad(CAST(k * 13 % 97 AS VARCHAR(20)), 5, '1') AS postcode,
  CASE WHEN k % 50 = 7 THEN '555-000-0000' ELSE concat('+1 ', CAST(2000000000 + CASE WHEN src = 'b' AND k % 4 <> 3 THEN k + 1 ELSE k END AS VARCHAR(20))) END AS phone,
  CASE WHEN k % 5 <> 0 THEN concat(CASE WHEN k % 7 = 0 THEN 'mailto:' ELSE '' END, 'M', CAST(k AS VARCHAR(20)), '@mail', CAST(k % 8 AS VARCHAR(20)), '.example.net') END AS email
FROM (SELECT 'a' AS src, CAST(0 AS BIGINT) AS rnk, c_custkey AS k FROM {customer}
      UNION ALL SELECT 'b', CAST(1 AS BIGINT), p_partkey FROM {part}
      UNION ALL SELECT 'c', CAST(2 AS BIGINT), 3 * s_suppkey FROM {supplier}) t""",
    # places as a source delivers them: lists are text with bars
    "places": """
SELECT concat('p', CAST(c_custkey AS VARCHAR(20))) AS place_id, c_name AS name,
  CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN concat('info@m', CAST(c_custkey AS VARCHAR(20)), '.example.net|MAILTO:Sales', CAST(c_custkey % 50 AS VARCHAR(20)), '@shared.example.net')
       WHEN c_custkey % 4 = 1 THEN 'test@test.com' ELSE concat('owner', CAST(c_custkey % 200 AS VARCHAR(20)), '@biz', CAST(c_custkey % 8 AS VARCHAR(20)), '.example.net') END AS emails,
  CASE WHEN c_custkey % 6 = 0 THEN 'https://x.example.org' END AS websites,
  CASE WHEN c_custkey % 10 = 3 THEN 'Old Road 1;Toronto;ON;CA|Main St 2;Austin;TX;US' WHEN c_custkey % 10 = 4 THEN 'Rue 3;Paris;;FR' ELSE concat('Elm St ', CAST(c_custkey AS VARCHAR(20)), ';Dallas;TX;US') END AS addresses,
  CASE WHEN c_custkey % 3 = 0 THEN 'shopping|retail|florist' WHEN c_custkey % 3 = 1 THEN 'structure_and_geography|park' END AS hierarchy,
  CASE WHEN c_custkey % 11 = 0 THEN 'Q42' END AS brand,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 100 AS DOUBLE) / 100 END AS confidence,
  CASE WHEN c_custkey % 13 = 0 THEN 'permanently_closed' WHEN c_custkey % 13 = 1 THEN 'open' END AS operating_status,
  CASE WHEN c_custkey % 17 = 0 THEN 'Duplicate|other' END AS flags,
  CASE WHEN c_custkey % 5 = 0 THEN concat('https://www.facebook.com/shop', CAST(c_custkey AS VARCHAR(20))) END AS facebook,
  CASE WHEN c_custkey % 5 = 1 THEN concat('https://instagram.com/shop', CAST(c_custkey AS VARCHAR(20))) END AS instagram,
  CASE WHEN c_custkey % 10 = 2 THEN 'http://x.com/shop' WHEN c_custkey % 10 = 7 THEN 'https://netflix.com/title' END AS twitter
FROM {customer}""",
    "leads": """
SELECT concat('p', CAST(c_custkey AS VARCHAR(20))) AS place_id, c_name AS name,
  CASE WHEN c_custkey % 7 <> 0 THEN concat('(512) 555-', lpad(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0')) END AS phone,
  n_name AS city, r_name AS state, c_custkey % 4 = 0 AS has_website,
  CASE c_custkey % 6 WHEN 0 THEN concat('https://m.facebook.com/shop', CAST(c_custkey AS VARCHAR(20))) WHEN 1 THEN 'http://linktr.ee/x' WHEN 2 THEN 'shop.business.site'
    WHEN 3 THEN 'https://stores.walmart.com/9' WHEN 4 THEN concat('https://www.s', CAST(c_custkey AS VARCHAR(20)), '.example.net/home?a=b') END AS website_raw,
  c_custkey % 300 AS reviews_count
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "email_queue": """
SELECT o_orderkey AS id, 1 + o_orderkey % 5 AS campaign_id, concat('p', CAST(o_custkey AS VARCHAR(20))) AS place_id,
  CASE WHEN o_orderkey % 17 = 0 THEN 'failed' WHEN o_orderkey % 19 = 0 THEN 'in_progress' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'no_email' ELSE 'pending' END AS status,
  o_orderdate AS created_at, o_orderkey % 4 AS attempts,
  CASE WHEN o_orderkey % 17 = 0 AND o_orderkey % 2 = 0 THEN concat('timeout ', CAST(o_orderkey % 3 AS VARCHAR(20))) END AS error_message
FROM {orders}""",
    "lead_emails": """
SELECT place_id, email, max(conf) AS confidence, min(src) AS source_type, min(found_at) AS discovered_at, max(free) AS is_free_provider
FROM (SELECT concat('p', CAST(o_custkey AS VARCHAR(20))) AS place_id,
  concat('m', CAST(CASE WHEN o_custkey % 9 = 0 THEN o_custkey % 3 ELSE o_custkey END AS VARCHAR(20)), '_', CAST(o_orderkey % 3 AS VARCHAR(20)), CASE WHEN o_custkey % 8 = 0 THEN '@gmail.com' ELSE concat('@mail', CAST(o_custkey % 8 AS VARCHAR(20)), '.example.org') END) AS email,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN 0.65 WHEN 1 THEN 0.75 WHEN 2 THEN 0.85 ELSE 0.95 END AS DOUBLE) AS conf,
  CASE WHEN o_orderkey % 2 = 0 THEN 'search_snippet' ELSE 'contextual_landing_page' END AS src, o_orderdate AS found_at, o_custkey % 8 = 0 AS free
  FROM {orders} WHERE o_orderstatus = 'F') t GROUP BY place_id, email""",
    # the outcome of each business's extraction, with the time it was processed
    "extraction": """
SELECT concat('p', CAST(o_custkey AS VARCHAR(20))) AS place_id,
  CASE WHEN o_custkey % 31 = 0 THEN 'error' WHEN max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 THEN 'completed' ELSE 'no_email' END AS status,
  count(*) AS emails_found_count, max(o_orderdate) AS processed_at
FROM {orders} WHERE o_custkey % 10 <> 1 GROUP BY o_custkey""",
    # awkward values as pages and profiles have them: # stands for the key, ~ for an apostrophe
    "raw_addresses": """
SELECT c_custkey AS id, CASE WHEN v.x <> 'none' THEN replace(v.x, '#', CAST(c_custkey AS VARCHAR(20))) END AS raw FROM {customer} JOIN (VALUES
  (0, '# Main St, Austin, TX 78701, USA'), (1, '# Main St, Suite 4, Round Rock, tx 78664-1234'), (2, '# NW Elm St, Portland'), (3, '  # Oak Ave , Reno, nv 89501, United States '),
  (4, 'Lone Star Rd'), (5, ''), (6, 'none'), (7, '12 Indiana Ave, Springfield, IL, 6270'), (8, ',, 5 Pine St,, Bend, OR,'), (9, '90210 Hill Rd, Beverly Hills, CA 90211, US'), (10, 'Me and Co, Bangor ME')
) v(i, x) ON c_custkey % 11 = v.i""",
    "raw_phones": """
SELECT c_custkey AS id, CASE WHEN v.x <> 'none' THEN replace(v.x, '#', lpad(CAST(c_custkey % 10000 AS VARCHAR(20)), 4, '0')) END AS raw FROM {customer} JOIN (VALUES
  (0, '(512) 555-#'), (1, '+1 512.555.#'), (2, 'Call (512) 555-# ext 9'), (3, '512555#'), (4, ' 555-# '), (5, ''), (6, 'none'), (7, '1-512-555-#x'), (8, '+44 20 7946 #'), (9, 'tel:512 555# / 512 556#')
) v(i, x) ON c_custkey % 10 = v.i""",
    "raw_emails": """
SELECT c_custkey AS id, CASE WHEN v.x <> 'none' THEN replace(replace(v.x, '#', CAST(c_custkey AS VARCHAR(20))), '~', chr(39)) END AS raw FROM {customer} JOIN (VALUES
  (0, 'Info@Acme#.IO'), (1, 'o~brien#@acme.io'), (2, 'a&b@acme#.io'), (3, ' <sales+west@shop#.photography>, '), (4, 'a@acme.co'), (5, 'no-reply@acme#.co'), (6, 'noreply+x@acme#.co'), (7, 'logo#@2x.png'),
  (8, 'x@mail.yelp.com'), (9, 'two@at@acme.co'), (10, 'dots..in#@acme.co'), (11, '.lead@acme.co.'), (12, 'x@-bad.co'), (13, 'x@acme.123'), (14, 'x@nodot'), (15, 'none'), (16, ''), (17, 'testimonials#@acme.co'), (18, 'x@acme.co;y')
) v(i, x) ON c_custkey % 19 = v.i""",
    "raw_websites": """
SELECT c_custkey AS id, CASE WHEN v.x <> 'none' THEN replace(v.x, '#', CAST(c_custkey AS VARCHAR(20))) END AS raw FROM {customer} JOIN (VALUES
  (0, 'https://www.shop#.example.net/a?b=c'), (1, 'm.facebook.com/shop#'), (2, 'HTTP://X.com/y'), (3, 'https://www.google.com/url?sa=t&q=https://shop#.example.net/&u=1'), (4, 'https://www.google.com/url?q=100%zz'),
  (5, 'shop#.business.site'), (6, 'http://stores.walmart.com:8080/#'), (7, ' N/A '), (8, 'undefined'), (9, ''), (10, 'none'), (11, 'http://linktr.ee/shop'), (12, 'https://notfacebook.com'), (13, 'https://Shop.WixSite.com/x'),
  (14, 'https:///path'), (15, 'https://x.com'), (16, 'https://www.google.com/url?sa=t'), (17, 'negocio.site')
) v(i, x) ON c_custkey % 18 = v.i""",
    "raw_profiles": """
SELECT c_custkey AS id, CASE WHEN v.x <> 'none' THEN replace(v.x, '#', CAST(c_custkey AS VARCHAR(20))) END AS raw FROM {customer} JOIN (VALUES
  (0, '10000#'), (1, '@shop.#'), (2, 'https://m.facebook.com/shop#/?ref=x'), (3, 'facebook.com/groups/#'), (4, 'https://www.facebook.com/profile.php?v=1&id=9#'), (5, 'https://facebook.com/profile.php?id=x'),
  (6, 'https://www.facebook.com/pages/Shop/9#'), (7, 'https://example.org/shop#'), (8, 'https://web.facebook.com/pg/shop#/about'), (9, ' '), (10, 'none'), (11, 'https://facebook.com/'), (12, '//business.facebook.com/a'), (13, 'https://facebook.com/Events/#')
) v(i, x) ON c_custkey % 14 = v.i""",
    "raw_documents": """
SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS checked, v.url AS final_url, v.status AS http_status, replace(replace(v.doc, '~', chr(39)), '#', CAST(event_id % 100000 AS VARCHAR(20))) AS document FROM {events} JOIN (VALUES
  (0, 'https://www.facebook.com/shop', 200, '"creation_time":1300000000,"publish_time":1300000100000,"creation_time":9999999999'), (1, 'https://www.facebook.com/shop', 200, 'Too Many Requests'),
  (2, 'https://facebook.com/shop', 200, 'please CONFIRM you~re human'), (3, 'https://www.facebook.com/shop', 200, 'This content isn~t available #'), (4, 'https://facebook.com.example.org/x', 200, 'x'),
  (5, 'https://m.facebook.com/login/?next=x', 200, '"creation_time":1300000000'), (6, 'https://m.facebook.com/x', 404, 'too many requests'), (7, 'https://m.facebook.com/x', 429, ''), (8, 'https://m.facebook.com/Checkpoint/1', 500, ''),
  (9, 'https://m.facebook.com/x', 503, ''), (10, 'https://m.facebook.com/x', 403, '"creation_time":1300000000'), (11, 'https://FACEBOOK.com:443/login', 200, ''), (12, 'https://www.facebook.com/shop', 200, '&quot;creation_timestamp&quot; : &quot;1300000000123&quot; "publish_time":12345678, "publish_time":999999999'),
  (13, 'https://www.facebook.com/loginhelp', 200, 'plain #'), (14, 'https://www.facebook.com/shop', 200, 'a long document that is over the limit ........................................................................................')
) v(i, url, status, doc) ON event_id % 15 = v.i""",
    # addresses found beside businesses; the last column is what the rule says of the case
    "found_addresses": """
SELECT c_custkey AS id, v.* FROM {customer} JOIN (VALUES
  (0, 'jo.smith@gmail.com', 'Zenith Roofing', 'Roofer', '512-555-0100', 'Austin', 'Call 512-555-0100 or jo.smith@gmail.com', 'Zenith Roofing, Austin', 'https://list.test/z', true, false, true),
  (1, 'jo.smith@gmail.com', 'Zenith Roofing', 'Roofer', '512-555-0100', 'Austin', 'Call 512-555-0100 or jo.smith@gmail.com', 'Puppies for sale', 'https://list.test/z', true, false, false),
  (2, 'help@list.test', 'Zenith Roofing', 'Roofer', '512-555-0100', 'Austin', 'Zenith Roofing 512-555-0100', '', 'https://www.list.test/z', true, false, false),
  (3, 'hello@tacotruck.test', 'Al Taco Truck', 'Taco truck', '', '', '', 'Al Taco Truck', 'https://tacotruck.test/', true, false, false),
  (4, 'hello@silverpineroofing.test', 'Silver Pine Roofing', 'Roofing contractor', '', '', '', 'Silver Pine Roofing contact', 'https://silverpineroofing.test/c', true, false, true),
  (5, 'info@grandvalet.test', 'Valet', 'Dry cleaner', '', '', '', 'Grand Valet', 'https://grandvalet.test/', true, false, false),
  (6, 'hi@cafelumo.test', 'Lumo', 'Cleaners', '', 'Dover', '', 'Cafe Lumo coffee', 'https://cafelumo.test/', true, false, false),
  (7, 'hi@lumo.test', 'Lumo', 'Cleaners', '', 'Dover', '', 'Lumo cleaning in Dover', 'https://lumo.test/', true, false, true),
  (8, 'zenithroofing@proton.me', 'Zenith Roofing', 'Roofer', '', 'Austin', '', 'Zenith Roofing in Austin', 'https://list.test/z', true, false, true),
  (9, 'zenithroofing@proton.me', 'Zenith Roofing', 'Roofer', '512-555-0100', 'Austin', 'Zenith Roofing, Trinity', 'Zenith Roofing LLC', 'https://list.test/z', false, true, false),
  (10, 'annlee@bigbank.test', 'Ann Lee CPA', 'Accountant', '512-555-0100', 'Dover', 'Ann Lee CPA 512-555-0100', 'Ann Lee CPA in Dover', 'https://list.test/a', false, true, false),
  (11, 'book.move4u@gmail.com', 'Move4U Towing', 'Towing service', '', 'Dover', '', 'Move4U Towing in Dover', 'https://list.test/m', false, true, true)
) v(i, email, name, category, phone, city, near, result, url, by_phone, local_only, owned) ON c_custkey % 12 = v.i""",
    # an all-text registry file
    "registry": """
SELECT CAST(s_suppkey + 7000000 AS VARCHAR(20)) AS dot_number, concat('Shop ', CAST(3 * s_suppkey AS VARCHAR(20)), ' LLC') AS legal_name,
  CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN concat('Shop ', CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 1000000 END AS VARCHAR(20))) ELSE concat('Shop ', CAST(s_suppkey AS VARCHAR(20))) END AS dba_name,
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('(', substr(CAST(2000000000 + s_suppkey AS VARCHAR(20)), 1, 3), ') ', substr(CAST(2000000000 + s_suppkey AS VARCHAR(20)), 4, 3), '-', substr(CAST(2000000000 + s_suppkey AS VARCHAR(20)), 7, 4)) END AS phone,
  CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE concat(' M', CAST(s_suppkey AS VARCHAR(20)), '@mail', CAST(s_suppkey % 8 AS VARCHAR(20)), '.example.net ') END AS email_address,
  lpad(CAST(s_suppkey * 13 % 97 AS VARCHAR(20)), 5, '1') AS phy_zip, CASE WHEN s_suppkey % 20 = 0 THEN 'CA' ELSE 'US' END AS phy_country,
  CASE WHEN s_suppkey % 9 = 0 THEN 'x' ELSE CAST(s_suppkey % 14 AS VARCHAR(20)) END AS power_units, CAST(s_suppkey % 25 AS VARCHAR(20)) AS total_drivers,
  CASE WHEN s_suppkey % 6 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN 'Y' ELSE 'N' END AS hm_flag,
  CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE concat(lpad(CAST(1 + s_suppkey % 28 AS VARCHAR(20)), 2, '0'), '-', CASE s_suppkey % 4 WHEN 0 THEN 'JAN' WHEN 1 THEN 'MAY' WHEN 2 THEN 'OCT' ELSE 'DEC' END, '-', lpad(CAST(s_suppkey % 100 AS VARCHAR(20)), 2, '0')) END AS add_date
FROM {supplier}""",
    # captured answers of fetches, searches, pages, mails and reviews: # is the key, ~ an apostrophe, ^ a line feed, none a null
    "captures": """
SELECT c_custkey AS id, nullif(replace(v.url, '#', CAST(c_custkey AS VARCHAR(20))), 'none') AS url, v.code, nullif(v.error, 'none') AS error, nullif(v.href, 'none') AS href,
  nullif(replace(replace(v.page, '~', chr(39)), '#', CAST(c_custkey AS VARCHAR(20))), 'none') AS page, nullif(replace(v.mail, '^', chr(10)), 'none') AS mail, v.price, nullif(v.payload, 'none') AS payload
FROM {customer} JOIN (VALUES
  (0, 'https://shop#.test/a', 200, 'none', 'https://www.bing.com/ck/a?p=1&u=a1aHR0cHM6Ly9hY21lLnRlc3QvYQ&ntb=1', '<meta property="og:description" content="Shop #. 1,234 likes, 12 talking about this, 56 were here. Coffee shop">', '<p>Hi</p><script>x<b</script>Yes, 50%25 + more&nbsp;now', '$ 1,200', '[null,null,[[[0,[0,0,0,"1700000000123456",0,0,"2 days ago"]]]],0,0,true]'),
  (1, 'http://Localhost:80/#', 200, 'none', 'https://shop.test/?u=a1x', '<META name=x property=~og:description~ content=~1 like. Open 24 hours~>', 'Thanks!^> old^Fine.^On Mon 1 May someone wrote:^> ask', '12.50', '[null,null,[[[0,[0,0,0,1700000000000000,0,0,7]]]]]'),
  (2, 'https://u:p@printer.local/', 200, 'none', 'https://www.bing.com/ck/a?u=a1A', '<meta property="og:title" content="x">', 'Ok^----- Original Message^old', 'from $20', '[null,null,[]]'),
  (3, 'ftp://shop#.test', 200, 'none', 'none', 'none', 'none', '', 'broken ['),
  (4, 'https://shop#.test', 404, 'none', 'https://www.bing.com/ck/a?u=b1aHR0', '<meta property="og:description" content="no full stop">', '<style>p</style>a<br/>b<BR>^^^^c</div>', ' 7 ', 'none'),
  (5, 'https://shop#.test', 0, 'ReadTimeout: timed out', '', '<meta property="og:description" content=". ">', '', '12.345', '[null,null,[[[0,[0,0,0,"soon",0,0,null]]]],0,0,false]'),
  (6, 'https://shop#.test', 0, 'SSLError certificate', 'https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9hLmIvP3g9MQ', 'plain', 'From: a^Sent: b', '99999999999', '[null,null,[[[0,[0,0,0,-5,0,0,"now"]]]],0,0,true]'),
  (7, 'https://shop#.test', 0, 'too many Redirects', 'x', 'x', 'x^From: Bo Li^Sent: today^rest', '1', '[]'),
  (8, 'https://shop#.test', 0, 'connection reset', 'x', 'x', '>all', '1', '[]'), (9, 'none', 0, 'none', 'x', 'x', 'x', 'x', '[]'), (10, 'https:///x', 0, 'none', 'x', 'x', 'x', 'x', '[]'), (11, 'HTTPS://shop#.test', 0, 'none', 'x', 'x', 'x', 'x', '[]')
) v(i, url, code, error, href, page, mail, price, payload) ON c_custkey % 12 = v.i""",
    "dns_answers": """
SELECT s_suppkey AS id, v.ns, v.apex, v.cname, v.www FROM {supplier} JOIN (VALUES
  (0, 'ns1.x.test', '76.76.21.21|216.150.1.1', '', ''), (1, 'ns1.x.test', '76.76.21.21|1.2.3.4', 'cname.vercel-dns.com', ''), (2, '', '', 'none', 'none'), (3, 'none', 'none', 'none', 'none'),
  (4, 'ns1.x.test', '44.1.2.3', 'uixie.porkbun.com', '44.1.2.3'), (5, 'none', '216.198.7.7', 'notvercel-dns.com', '216.199.1.1'), (6, '', '', 'a.vercel-dns-016.com', '216.198.7.7')
) v(i, ns, apex, cname, www) ON s_suppkey % 7 = v.i""",
    # the files of a dataset's releases
    "release_files": """
SELECT CASE WHEN o_orderkey % 10 = 0 THEN concat('release/notes-', CAST(o_orderkey AS VARCHAR(20)), '.md')
  ELSE concat('release/dt=2026-0', CAST(1 + o_orderkey % 9 AS VARCHAR(20)), '-11/places/places_', CAST(o_orderkey % 100 AS VARCHAR(20)), '.parquet') END AS path, o_orderkey AS bytes FROM {orders}""",
    # lifecycle events of requests
    "request_events": """
SELECT event_id, user_id AS request_id, ts AS processed_at,
  CASE event_type WHEN 'click' THEN 'demo_set' WHEN 'view' THEN 'ticket_opened' WHEN 'purchase' THEN 'paid' WHEN 'error' THEN 'payment_failed' ELSE 'ticket_completed' END AS kind
FROM {events}""",
}

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


#: Views that make long texts of narrow rows.
WIDE = {"rpc_places", "rpc_answers", "dd_rows", "raw_requests", "listing_cards", "listing_panes"}


def needs(name: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in VIEWS[name]]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame; those of WIDE take their rows from all cores."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in needs(name)}
    if name in WIDE:
        tables = {t: spread(rows) for t, rows in tables.items()}
    return spark.sql(VIEWS[name], **tables)


def ctes(*names: str) -> str:
    """The fixtures as the WITH clause of an oracle query."""
    fill = {t: t for t in TABLES}
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(**fill)})" for n in names)


def with_views(sql: str) -> str:
    """An oracle query with the fixtures that it names put before it."""
    used = [n for n in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b|,\s*{n}\b(?!\s*\.)", sql)]
    body = sql.strip()
    if not used:
        return body
    head = ctes(*used)
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + head[5:] + ",\n" + body[14:]
    return head + (",\n" + body[5:] if body.upper().startswith("WITH ") else "\n" + body)
