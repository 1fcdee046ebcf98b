"""The warehouse: candidates, matching, canonical entities, registry, deduplication, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import graph, match, merge
from .fixtures import view
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


def _in(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


STRICT = V.STRICT_EMAIL_RE.replace(r"\z", "$").replace("'", "''")
USABLE = (
    "(regexp_matches({e}, '" + STRICT + "') AND length({e}) <= 254 AND length(split_part({e}, '@', 1)) <= 64 AND split_part({e}, '@', 1) NOT IN ("
    + _in(V.PLACEHOLDER_LOCALS) + ") AND split_part({e}, '@', 2) NOT IN (" + _in(V.PLACEHOLDER_DOMAINS) + "))"
)


def usable(e: str) -> str:
    """SQL for a usable address in column e."""
    return USABLE.replace("{e}", e)


KEYED = """
k AS (SELECT entity_id, source, place_id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS name_key, left(regexp_replace(postcode, '[^0-9]', '', 'g'), 5) AS zip5,
  right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone_key, lower(trim(regexp_replace(email, '^mailto:', '', 'i'))) AS email_key FROM ent)"""
PAIRS = (
    KEYED + """,
ph AS (SELECT phone_key FROM k GROUP BY 1 HAVING count(DISTINCT entity_id) BETWEEN 2 AND 5),
em AS (SELECT email_key, name_key FROM k WHERE length(name_key) >= 5 AND """ + usable("email_key") + """ GROUP BY 1, 2 HAVING count(DISTINCT entity_id) BETWEEN 2 AND 5),
nz AS (SELECT name_key, zip5 FROM k WHERE length(name_key) >= 5 AND length(zip5) = 5 GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 10),
arms AS (
  SELECT a.entity_id AS left_id, b.entity_id AS right_id, 'phone' AS reason FROM k a JOIN k b USING (phone_key) JOIN ph USING (phone_key) WHERE b.entity_id > a.entity_id AND a.source <> b.source
  UNION SELECT a.entity_id, b.entity_id, 'email_name' FROM k a JOIN k b USING (email_key, name_key) JOIN em USING (email_key, name_key) WHERE b.entity_id > a.entity_id AND a.source <> b.source
  UNION SELECT a.entity_id, b.entity_id, 'name_zip' FROM k a JOIN k b USING (name_key, zip5) JOIN nz USING (name_key, zip5) WHERE b.entity_id > a.entity_id AND a.source <> b.source),
pairs AS (SELECT left_id, right_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM arms GROUP BY 1, 2)"""
)


# ---- candidates of one source


def candidates(places: DataFrame, country: str | None = "US") -> DataFrame:
    """Places with an address in the country, an e-mail, and no website; flags and tiers."""
    lists = places.withColumns({
        "emails": F.split("emails", "\\|"), "websites": F.split("websites", "\\|"), "hierarchy": F.split("hierarchy", "\\|"), "flags": F.split("flags", "\\|"),
        "addresses": F.transform(F.split("addresses", "\\|"), lambda a: F.struct(*[F.nullif(F.get(F.split(a, ";"), F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(["freeform", "locality", "region", "country"])])),
    })
    there = (lambda a: a["country"] == country) if country else (lambda a: F.lit(True))
    address = F.get(F.filter("addresses", there), F.lit(0))
    known = F.coalesce(F.col("brand").isNotNull(), F.lit(False))
    root = F.get("hierarchy", F.lit(0))
    kept = lists.filter((F.coalesce(F.size("emails"), F.lit(0)) > 0) & (F.coalesce(F.size("websites"), F.lit(0)) <= 0) & F.exists("addresses", there))
    c = F.col("confidence")
    return kept.select(
        "place_id", "name", address["locality"].alias("locality"), address["region"].alias("region"), root.alias("root_category"),
        known.alias("is_known_brand"), (~known & F.coalesce(root.isin(V.SMALL_BUSINESS_ROOTS), F.lit(False))).alias("is_probable_small_business"),
        F.when(c >= 0.8, "high").when(c >= 0.5, "medium").when(c.isNull(), "unknown").otherwise("low").alias("quality_tier"),
        F.coalesce(F.exists(F.coalesce("flags", F.array().cast("array<string>")), lambda f: F.lower(f).isin(V.DISQUALIFYING_FLAGS)), F.lit(False)).alias("has_disqualifying_flag"),
        "operating_status", "emails",
    )


def email_rows(cands: DataFrame) -> DataFrame:
    e = cands.select("place_id", F.explode("emails").alias("raw")).select("place_id", X.email_key("raw").alias("email")).distinct()
    return e.select(
        "place_id", "email", X.email_domain("email", null_if_absent=True).alias("email_domain"), X.strict_valid("email").alias("is_valid"),
        X.is_placeholder("email").alias("is_placeholder"), X.email_local("email").isin(V.ROLE_LOCALS_A).alias("is_role_account"), X.is_usable("email").alias("is_usable"),
    )


CANDS = """
WITH cands AS (
  SELECT place_id, name, list_filter(string_split(addresses, '|'), lambda x: split_part(x, ';', 4) = 'US')[1] AS address, string_split(hierarchy, '|')[1] AS root_category,
    brand IS NOT NULL AS is_known_brand, confidence, flags, operating_status, string_split(emails, '|') AS emails
  FROM places WHERE emails IS NOT NULL AND websites IS NULL AND len(list_filter(string_split(addresses, '|'), lambda x: split_part(x, ';', 4) = 'US')) > 0),
emails AS (SELECT DISTINCT place_id, lower(trim(regexp_replace(raw, '^mailto:', '', 'i'))) AS email FROM (SELECT place_id, unnest(emails) AS raw FROM cands))
"""


@query(CANDS + f"""
SELECT place_id, name, nullif(split_part(address, ';', 2), '') AS locality, nullif(split_part(address, ';', 3), '') AS region, root_category, is_known_brand,
  NOT is_known_brand AND coalesce(root_category IN ({_in(V.SMALL_BUSINESS_ROOTS)}), false) AS is_probable_small_business,
  CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence IS NULL THEN 'unknown' ELSE 'low' END AS quality_tier,
  coalesce(len(list_filter(string_split(flags, '|'), lambda x: lower(x) IN ({_in(V.DISQUALIFYING_FLAGS)}))) > 0, false) AS has_disqualifying_flag, operating_status
FROM cands""")
def place_candidates(spark, sf_dir):
    return candidates(view(spark, sf_dir, "places")).drop("emails")


@query(CANDS + f"""
SELECT place_id, email, CASE WHEN contains(email, '@') THEN split_part(email, '@', 2) END AS email_domain,
  regexp_matches(email, '{STRICT}') AND length(email) <= 254 AND length(split_part(email, '@', 1)) <= 64 AS is_valid,
  split_part(email, '@', 1) IN ({_in(V.PLACEHOLDER_LOCALS)}) OR split_part(email, '@', 2) IN ({_in(V.PLACEHOLDER_DOMAINS)}) AS is_placeholder,
  split_part(email, '@', 1) IN ({_in(V.ROLE_LOCALS_A)}) AS is_role_account, {usable('email')} AS is_usable,
  count(*) OVER (PARTITION BY email) AS places_using_email
FROM emails""")
def usable_email_reuse(spark, sf_dir):
    rows = email_rows(candidates(view(spark, sf_dir, "places")))
    uses = rows.groupBy("email").agg(F.count("*").alias("places_using_email"))  # a grouped count: no window over a hot address
    return rows.join(uses, "email").select(*rows.columns, "places_using_email")


@query(CANDS + f"""
SELECT place_id, name, (SELECT count(*) FROM emails e WHERE e.place_id = c.place_id AND {usable('e.email')}) AS usable_emails
FROM cands c WHERE coalesce(operating_status, 'open') <> 'permanently_closed' AND NOT coalesce(len(list_filter(string_split(flags, '|'), lambda x: lower(x) IN ({_in(V.DISQUALIFYING_FLAGS)}))) > 0, false)
  AND EXISTS (SELECT 1 FROM emails e WHERE e.place_id = c.place_id AND {usable('e.email')})""")
def qualified_leads(spark, sf_dir):
    c = candidates(view(spark, sf_dir, "places"))
    usable = email_rows(c).filter("is_usable").groupBy("place_id").agg(F.count("*").alias("usable_emails"))
    open_ = (F.coalesce("operating_status", F.lit("open")) != "permanently_closed") & ~F.col("has_disqualifying_flag")
    return c.filter(open_).join(usable, "place_id").select("place_id", "name", "usable_emails")


# ---- matching of two sources


def _source(spark, sf_dir, name):
    return view(spark, sf_dir, "ent").filter(F.col("source") == name)


MATCHES = "WITH " + KEYED.strip() + f""",
l AS (SELECT * FROM k WHERE source = 'b'), r AS (SELECT * FROM k WHERE source = 'a'),
arms AS (
  SELECT l.place_id AS left_id, r.place_id AS right_id, true AS email_match, false AS phone_match, true AS name_match, l.zip5 = r.zip5 AND l.zip5 <> '' AS postcode_match
  FROM l JOIN r USING (email_key, name_key) WHERE length(name_key) >= 4 AND {usable('email_key')}
  UNION ALL SELECT l.place_id, r.place_id, false, true, false, false FROM l JOIN r USING (phone_key) WHERE length(phone_key) = 10
  UNION ALL SELECT l.place_id, r.place_id, false, false, true, true FROM l JOIN r USING (name_key, zip5) WHERE length(name_key) >= 4 AND length(zip5) = 5),
m AS (SELECT left_id, right_id, bool_or(email_match) AS email_match, bool_or(phone_match) AS phone_match, bool_or(name_match) AS name_match, bool_or(postcode_match) AS postcode_match FROM arms GROUP BY 1, 2),
best AS (SELECT *, concat_ws('+', CASE WHEN phone_match THEN 'phone' END, CASE WHEN name_match AND postcode_match THEN 'name_postcode' END, CASE WHEN email_match THEN 'email_name' END) AS match_method
  FROM m QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY phone_match DESC, name_match DESC, postcode_match DESC, email_match DESC, right_id) = 1)
"""


@query(MATCHES + "SELECT * FROM m")
def source_match_candidates(spark, sf_dir):
    return match.source_matches(_source(spark, sf_dir, "b"), _source(spark, sf_dir, "a"))


@query(MATCHES + "SELECT * FROM best")
def best_source_match(spark, sf_dir):
    return match.best_match(match.source_matches(_source(spark, sf_dir, "b"), _source(spark, sf_dir, "a"), best_only=True))


@query(MATCHES + "SELECT place_id, name_key FROM l WHERE NOT EXISTS (SELECT 1 FROM best WHERE left_id = place_id)")
def unmatched_source_leads(spark, sf_dir):
    left = _source(spark, sf_dir, "b")
    best = match.source_matches(left, _source(spark, sf_dir, "a"), best_only=True).select(F.col("left_id").alias("place_id")).distinct()
    return match.keyed(left).join(best, "place_id", "left_anti").select("place_id", "name_key")


# ---- canonical entities


def membership(ent: DataFrame) -> DataFrame:
    """(entity_id, source, place_id, match_method): places of the second source attach to their best match, others stand alone."""
    a, b = ent.filter("source = 'a'"), ent.filter("source = 'b'")
    best = match.best_match(match.source_matches(b, a, best_only=True)).select(F.col("left_id").alias("place_id"), "right_id", "match_method")
    parents = a.select(F.col("place_id").alias("right_id"), F.col("entity_id").alias("parent"))
    joined = ent.join(best.join(parents, "right_id"), "place_id", "left")
    return joined.select(F.coalesce("parent", "entity_id").alias("entity_id"), "source", "place_id", "match_method")


MEMBERS = MATCHES + """, members AS (SELECT coalesce(p.entity_id, e.entity_id) AS entity_id, e.source, e.place_id, b.match_method, e.email, e.phone, e.name, e.postcode
  FROM ent e LEFT JOIN best b ON b.left_id = e.place_id LEFT JOIN ent p ON p.place_id = b.right_id)
"""


@query(MEMBERS + """SELECT m.entity_id, count(*) AS source_count, string_agg(DISTINCT m.source, ',' ORDER BY m.source) AS sources, max(m.match_method) AS match_method
FROM members m GROUP BY 1""")
def canonical_entities(spark, sf_dir):
    m = membership(view(spark, sf_dir, "ent"))
    return m.groupBy("entity_id").agg(
        F.count("*").alias("source_count"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max("match_method").alias("match_method")
    )


@query(MEMBERS + f""", e AS (SELECT entity_id, source, lower(trim(regexp_replace(email, '^mailto:', '', 'i'))) AS normalized_email, email FROM members WHERE email IS NOT NULL)
SELECT entity_id, normalized_email, min(email) AS display_email, count(DISTINCT source) AS source_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
  bool_or({usable('normalized_email')}) AS is_usable FROM e GROUP BY 1, 2""")
def entity_email_rollup(spark, sf_dir):
    ent = view(spark, sf_dir, "ent")
    rows = membership(ent).join(ent.select("place_id", "email"), "place_id").filter(F.col("email").isNotNull()).withColumn("normalized_email", X.email_key("email"))
    return rows.groupBy("entity_id", "normalized_email").agg(
        F.min("email").alias("display_email"), F.count_distinct("source").alias("source_count"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.bool_or(X.is_usable("normalized_email")).alias("is_usable"),
    )


@query(MEMBERS + """SELECT entity_id, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS normalized_phone, min(phone) AS display_phone, count(DISTINCT source) AS source_count
FROM members WHERE length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 GROUP BY 1, 2""")
def entity_phone_rollup(spark, sf_dir):
    ent = view(spark, sf_dir, "ent")
    rows = membership(ent).join(ent.select("place_id", "phone"), "place_id").withColumn("normalized_phone", X.phone_key("phone")).filter("normalized_phone IS NOT NULL")
    return rows.groupBy("entity_id", "normalized_phone").agg(F.min("phone").alias("display_phone"), F.count_distinct("source").alias("source_count"))


def socials(places: DataFrame) -> DataFrame:
    """(place_id, url, platform): a row for each profile field that is filled."""
    fields = F.filter(F.array("facebook", "instagram", "twitter"), lambda u: u.isNotNull())
    u = F.col("url")
    platform = F.when(u.like("%facebook.com%"), "facebook").when(u.like("%instagram.com%"), "instagram").when(u.like("%twitter.com%") | u.like("%x.com%"), "twitter").otherwise("other")
    return places.select("place_id", F.explode(fields).alias("url")).distinct().withColumn("platform", platform)


SOCIALS = """
WITH s AS (SELECT DISTINCT place_id, url, CASE WHEN url LIKE '%facebook.com%' THEN 'facebook' WHEN url LIKE '%instagram.com%' THEN 'instagram' WHEN url LIKE '%twitter.com%' OR url LIKE '%x.com%' THEN 'twitter' ELSE 'other' END AS platform
  FROM (SELECT place_id, unnest([facebook, instagram, twitter]) AS url FROM places) WHERE url IS NOT NULL)
"""


@query(SOCIALS + "SELECT place_id, url, platform, lower(regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/]+)', 1)) AS host FROM s")
def entity_social_unpivot(spark, sf_dir):
    return socials(view(spark, sf_dir, "places")).withColumn("host", X.url_host("url"))


@query(SOCIALS + """SELECT platform, count(*) AS profiles, count(DISTINCT place_id) AS places, CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS DOUBLE) AS pct FROM s GROUP BY 1""")
def social_platform_share(spark, sf_dir):
    by = socials(view(spark, sf_dir, "places")).groupBy("platform").agg(F.count("*").alias("profiles"), F.count_distinct("place_id").alias("places"))
    total = by.agg(F.sum("profiles").alias("total"))  # one row instead of a window over everything
    return by.crossJoin(total).select("platform", "profiles", "places", F.round(100.0 * F.col("profiles") / F.col("total"), 4).alias("pct"))


@query("""SELECT place_id, CAST(i AS INTEGER) AS ordinality, ids[i] AS category_id, upper(ids[i]) AS label, i = 1 AS is_primary
FROM (SELECT place_id, string_split(hierarchy, '|') AS ids, unnest(range(1, len(string_split(hierarchy, '|')) + 1)) AS i FROM places WHERE hierarchy IS NOT NULL)""")
def entity_category_ordinality(spark, sf_dir):
    p = view(spark, sf_dir, "places").select("place_id", F.split("hierarchy", "\\|").alias("ids"), F.split(F.upper("hierarchy"), "\\|").alias("labels"))
    rows = p.select("place_id", F.posexplode(F.arrays_zip("ids", "labels")).alias("pos", "c"))
    return rows.select("place_id", (F.col("pos") + 1).alias("ordinality"), F.col("c.ids").alias("category_id"), F.col("c.labels").alias("label"), (F.col("pos") == 0).alias("is_primary"))


@query(MEMBERS + """, ranked AS (SELECT entity_id, email, phone, row_number() OVER (PARTITION BY entity_id ORDER BY CAST(email IS NOT NULL AS INT) + CAST(phone IS NOT NULL AS INT) DESC, place_id) AS n FROM members WHERE match_method IS NOT NULL)
SELECT e.entity_id, coalesce(e.email, r.email) AS email, coalesce(e.phone, r.phone) AS phone FROM ent e LEFT JOIN ranked r ON r.entity_id = e.entity_id AND r.n = 1 WHERE e.source = 'a'""")
def fill_missing_entity(spark, sf_dir):
    ent = view(spark, sf_dir, "ent")
    attached = membership(ent).filter("match_method IS NOT NULL").join(ent.select("place_id", "email", "phone"), "place_id")
    full = F.col("email").isNotNull().cast("int") + F.col("phone").isNotNull().cast("int")
    best = merge.first_per_key(attached, ["entity_id"], -full, F.col("place_id"))
    return merge.fill_missing(ent.filter("source = 'a'").select("entity_id", "email", "phone"), best, ["entity_id"], ["email", "phone"])


# ---- the registry


def registry_typed(staging: DataFrame) -> DataFrame:
    """Text to types; malformed numbers become null and are counted by the profile."""
    n = lambda c, t: F.nullif(F.trim(c), F.lit("")).try_cast(t)
    flag = F.nullif(F.trim("hm_flag"), F.lit(""))
    return staging.select(
        n("dot_number", "bigint").alias("dot_number"), "legal_name", F.coalesce(F.nullif("dba_name", F.lit("")), "legal_name").alias("display_name"), "dba_name", "phone",
        F.lower(F.trim("email_address")).alias("email"), "phy_zip", "phy_country", n("power_units", "int").alias("power_units"), n("total_drivers", "int").alias("total_drivers"),
        (flag == "Y").alias("hm_flag"), X.two_digit_date(F.initcap(F.nullif("add_date", F.lit("")))).alias("add_date"),
    )


REG = """
WITH reg AS (SELECT CAST(dot_number AS BIGINT) AS dot_number, legal_name, coalesce(nullif(dba_name, ''), legal_name) AS display_name, dba_name, phone, lower(trim(email_address)) AS email, phy_zip, phy_country,
  TRY_CAST(power_units AS INTEGER) AS power_units, TRY_CAST(total_drivers AS INTEGER) AS total_drivers, nullif(hm_flag, '') = 'Y' AS hm_flag,
  CASE WHEN add_date <> '' THEN make_date(CAST(right(add_date, 2) AS INT) + CASE WHEN CAST(right(add_date, 2) AS INT) >= 70 THEN 1900 ELSE 2000 END,
    CASE substr(add_date, 4, 3) WHEN 'JAN' THEN 1 WHEN 'MAY' THEN 5 WHEN 'OCT' THEN 10 ELSE 12 END, CAST(left(add_date, 2) AS INT)) END AS add_date FROM registry)
"""


@query(REG + "SELECT dot_number, display_name, email, power_units, total_drivers, hm_flag, CAST(add_date AS VARCHAR) AS add_date FROM reg")
def registry_typed_rows(spark, sf_dir):
    r = registry_typed(view(spark, sf_dir, "registry"))
    return r.select("dot_number", "display_name", "email", "power_units", "total_drivers", "hm_flag", F.col("add_date").cast("string").alias("add_date"))


@query("""SELECT count(*) AS row_count, count(DISTINCT dot_number) AS distinct_ids, count(*) FILTER (WHERE NOT regexp_matches(dot_number, '^[0-9]+$')) AS invalid_ids,
  count(*) FILTER (WHERE trim(email_address) = '') AS blank_emails, count(*) FILTER (WHERE power_units <> '' AND TRY_CAST(power_units AS INT) IS NULL) AS malformed_units,
  count(*) FILTER (WHERE NOT (phy_country = 'US' AND TRY_CAST(power_units AS INT) BETWEEN 1 AND 10 AND TRY_CAST(total_drivers AS INT) BETWEEN 1 AND 20)) AS filter_violations FROM registry""")
def staging_validation_profile(spark, sf_dir):
    s = view(spark, sf_dir, "registry")
    units, drivers = F.col("power_units").try_cast("int"), F.col("total_drivers").try_cast("int")
    ok = (F.col("phy_country") == "US") & units.between(1, 10) & drivers.between(1, 20)
    return s.agg(
        F.count("*").alias("row_count"), F.count_distinct("dot_number").alias("distinct_ids"), F.count_if(~F.col("dot_number").rlike("^[0-9]+$")).alias("invalid_ids"),
        F.count_if(F.trim("email_address") == "").alias("blank_emails"), F.count_if((F.col("power_units") != "") & units.isNull()).alias("malformed_units"), F.count_if(~ok).alias("filter_violations"),
    )


def registry_matches(reg: DataFrame, ent: DataFrame) -> DataFrame:
    """(dot_number, entity_id, score, label) where exactly one entity has the best score: e-mail and phone 100, e-mail and name 80, phone, name and zip 70."""
    k = match.keyed(ent)
    r = reg.select(
        "dot_number", X.name_key("legal_name").alias("legal_key"), X.name_key("dba_name").alias("dba_key"), X.zip5("phy_zip").alias("r_zip"),
        X.phone_key("phone").alias("r_phone"), F.when(X.is_usable("email"), F.col("email")).alias("r_email"),
    )
    named = ((F.col("name_key") == F.col("legal_key")) | (F.col("name_key") == F.col("dba_key"))) & (F.col("name_key") != "")
    zipped = (F.col("zip5") == F.col("r_zip")) & (F.col("zip5") != "")
    called = F.coalesce(F.col("r_phone") == F.col("phone_key"), F.lit(False))
    by_mail = r.join(k, r["r_email"] == k["email_key"]).select("dot_number", "entity_id", F.lit(True).alias("e"), called.alias("p"), named.alias("n"), zipped.alias("z"))
    # a phone alone scores nothing, so phones meet together with the zip and a name: a shared phone makes no pairs
    by_name = lambda name: r.join(k, (r["r_phone"] == k["phone_key"]) & (r["r_zip"] == k["zip5"]) & (r[name] == k["name_key"])).filter(named & zipped)
    both = by_mail
    for name in ("legal_key", "dba_key"):
        both = both.unionByName(by_name(name).select("dot_number", "entity_id", F.lit(False).alias("e"), *[F.lit(True).alias(c) for c in "pnz"]))
    flags = both.groupBy("dot_number", "entity_id").agg(*[F.bool_or(c).alias(c) for c in "epnz"])
    e, p, n, z = (F.col(c) for c in "epnz")
    scored = flags.withColumn("score", F.when(e & p, 100).when(e & n, 80).when(p & n & z, 70)).filter("score IS NOT NULL")
    label = F.when(F.col("score") == 100, "email_phone").when(F.col("score") == 80, "email_name").otherwise("phone_name_zip")
    return match.unique_best(scored, "dot_number", "score").select("dot_number", "entity_id", "score", label.alias("label"))


REG_MATCH = REG + ", " + KEYED.strip() + f""",
rk AS (SELECT dot_number, regexp_replace(lower(legal_name), '[^a-z0-9]', '', 'g') AS legal_key, regexp_replace(lower(dba_name), '[^a-z0-9]', '', 'g') AS dba_key, left(phy_zip, 5) AS r_zip,
  CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) END AS r_phone, CASE WHEN {usable('email')} THEN email END AS r_email FROM reg),
flags AS (SELECT dot_number, entity_id, bool_or(r_email = email_key) AS e, bool_or(r_phone = phone_key) AS p, bool_or(name_key IN (legal_key, dba_key) AND name_key <> '') AS n, bool_or(zip5 = r_zip AND zip5 <> '') AS z
  FROM (SELECT * FROM rk JOIN k ON r_email = email_key UNION SELECT * FROM rk JOIN k ON r_phone = phone_key) GROUP BY 1, 2),
scored AS (SELECT *, CASE WHEN e AND p THEN 100 WHEN e AND n THEN 80 WHEN p AND n AND z THEN 70 END AS score FROM flags),
top AS (SELECT * FROM scored WHERE score IS NOT NULL QUALIFY score = max(score) OVER (PARTITION BY dot_number)),
matched AS (SELECT dot_number, entity_id, score, CASE score WHEN 100 THEN 'email_phone' WHEN 80 THEN 'email_name' ELSE 'phone_name_zip' END AS label FROM top QUALIFY count(*) OVER (PARTITION BY dot_number) = 1)
"""


@query(REG_MATCH + "SELECT * FROM matched")
def registry_match_scored(spark, sf_dir):
    return registry_matches(registry_typed(view(spark, sf_dir, "registry")), view(spark, sf_dir, "ent").filter("source <> 'z'"))


@query(REG_MATCH + """SELECT coalesce(m.entity_id, 3000000000 + r.dot_number) AS entity_id, r.dot_number, r.display_name, coalesce(m.label, 'new_entity') AS attached_by,
  CAST(row_number() OVER (PARTITION BY m.entity_id, m.entity_id IS NULL, CASE WHEN m.entity_id IS NULL THEN r.dot_number END ORDER BY r.dot_number) = 1 AS BOOLEAN) AS fills_entity
FROM reg r LEFT JOIN matched m USING (dot_number)""")
def registry_attach(spark, sf_dir):
    """Carriers attach to their match or become entities; the smallest number of an entity's carriers fills its fields."""
    reg = registry_typed(view(spark, sf_dir, "registry"))
    m = registry_matches(reg, view(spark, sf_dir, "ent"))
    rows = reg.join(m, "dot_number", "left").select(
        F.coalesce("entity_id", F.lit(3000000000) + F.col("dot_number")).alias("entity_id"), "dot_number", "display_name", F.coalesce("label", F.lit("new_entity")).alias("attached_by")
    )
    first = rows.groupBy("entity_id").agg(F.min("dot_number").alias("first"))
    return rows.join(first, "entity_id").select(*rows.columns, (F.col("dot_number") == F.col("first")).alias("fills_entity"))


@query(REG + """SELECT dot_number, is_current FROM (SELECT dot_number, true AS is_current FROM reg WHERE dot_number % 3 <> 0
UNION ALL SELECT dot_number, false FROM reg WHERE dot_number % 2 = 0 AND dot_number % 3 = 0)""")
def snapshot_currency(spark, sf_dir):
    reg = registry_typed(view(spark, sf_dir, "registry")).select("dot_number")
    return merge.snapshot_currency(reg.filter("dot_number % 2 = 0"), reg.filter("dot_number % 3 <> 0"), "dot_number")


@query(REG + f"""SELECT count(*) AS matching, count(*) FILTER (WHERE {usable('email')}) AS with_email, count(*) = count(DISTINCT dot_number) AS is_ready FROM reg""")
def snapshot_readiness(spark, sf_dir):
    r = registry_typed(view(spark, sf_dir, "registry"))
    return r.agg(F.count("*").alias("matching"), F.count_if(X.is_usable("email")).alias("with_email"), (F.count("*") == F.count_distinct("dot_number")).alias("is_ready"))


# ---- deduplication


@query("WITH " + PAIRS.strip() + " SELECT * FROM pairs")
def duplicate_pairs(spark, sf_dir):
    p = match.duplicate_pairs(view(spark, sf_dir, "ent"))
    return p.select("left_id", "right_id", F.array_join("reasons", ",").alias("reasons"))


CLOSURE = "WITH RECURSIVE " + PAIRS.strip() + """,
undirected AS (SELECT left_id AS a, right_id AS b FROM pairs UNION SELECT right_id, left_id FROM pairs),
reach AS (SELECT a, b FROM undirected UNION SELECT r.a, e.b FROM reach r JOIN undirected e ON e.a = r.b),
merged AS (SELECT a AS entity_id, min(b) AS winner_id FROM reach GROUP BY 1 HAVING min(b) < a)
"""


def merge_map(ent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((entity_id, winner_id) of entities that another absorbs, the pairs): the lowest id of a component wins."""
    pairs = graph.written(match.duplicate_pairs(ent), "pairs")
    roots = graph.components(pairs, "left_id", "right_id")
    return roots.filter("node <> root").select(F.col("node").alias("entity_id"), F.col("root").alias("winner_id")), pairs


@query(CLOSURE + "SELECT * FROM merged")
def merge_map_components(spark, sf_dir):
    return merge_map(view(spark, sf_dir, "ent"))[0]


@query(CLOSURE + """SELECT m.entity_id AS merged_entity_id, m.winner_id, coalesce(string_agg(DISTINCT r.reason, ',' ORDER BY r.reason), 'transitive_component') AS reasons
FROM merged m LEFT JOIN (SELECT left_id AS id, reason FROM arms UNION SELECT right_id, reason FROM arms) r ON r.id = m.entity_id GROUP BY 1, 2""")
def merge_log_reasons(spark, sf_dir):
    merged, pairs = merge_map(view(spark, sf_dir, "ent"))
    reasons = match.explode_edges(pairs).select("entity_id", F.explode_outer("reasons").alias("reason"))
    log = merged.join(reasons, "entity_id", "left").groupBy("entity_id", "winner_id").agg(F.array_sort(F.collect_set("reason")).alias("r"))
    text = F.when(F.size("r") > 0, F.array_join("r", ",")).otherwise("transitive_component")
    return log.select(F.col("entity_id").alias("merged_entity_id"), "winner_id", text.alias("reasons"))


def deduplicated(ent: DataFrame) -> DataFrame:
    """Winners with nulls filled from their losers, and the number of places behind each."""
    merged, _ = merge_map(ent)
    rows = ent.join(merged, "entity_id", "left").withColumn("winner_id", F.coalesce("winner_id", "entity_id"))
    own = F.col("winner_id") == F.col("entity_id")
    pick = lambda c: F.coalesce(F.max(F.when(own, F.col(c))), F.min(c)).alias(c)
    return rows.groupBy(F.col("winner_id").alias("entity_id")).agg(
        F.count("*").alias("source_count"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), pick("name"), pick("email"), pick("phone"), pick("postcode")
    )


WINNERS = CLOSURE + """, won AS (SELECT coalesce(m.winner_id, e.entity_id) AS winner_id, e.* FROM ent e LEFT JOIN merged m USING (entity_id)),
final AS (SELECT winner_id AS entity_id, count(*) AS source_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
  coalesce(max(name) FILTER (WHERE winner_id = entity_id), min(name)) AS name, coalesce(max(email) FILTER (WHERE winner_id = entity_id), min(email)) AS email,
  coalesce(max(phone) FILTER (WHERE winner_id = entity_id), min(phone)) AS phone, coalesce(max(postcode) FILTER (WHERE winner_id = entity_id), min(postcode)) AS postcode FROM won GROUP BY winner_id)
"""


@query(WINNERS + "SELECT * FROM final")
def deduplicated_entities(spark, sf_dir):
    return deduplicated(view(spark, sf_dir, "ent"))


@query(WINNERS + """SELECT count(*) AS entities, count(*) FILTER (WHERE source_count > 1) AS cross_source, count(*) FILTER (WHERE email IS NOT NULL) AS with_email,
  count(*) FILTER (WHERE phone IS NOT NULL) AS with_phone, CAST(max(source_count) AS BIGINT) AS largest, CAST(sum(source_count) AS BIGINT) AS memberships FROM final""")
def lead_summary(spark, sf_dir):
    d = deduplicated(view(spark, sf_dir, "ent"))
    return d.agg(
        F.count("*").alias("entities"), F.count_if(F.col("source_count") > 1).alias("cross_source"), F.count("email").alias("with_email"), F.count("phone").alias("with_phone"),
        F.max("source_count").alias("largest"), F.sum("source_count").alias("memberships"),
    )


@query(WINNERS + """SELECT (SELECT count(*) FROM merged m WHERE EXISTS (SELECT 1 FROM final f WHERE f.entity_id = m.entity_id)) AS losers_left,
  (SELECT count(*) FROM merged m WHERE NOT EXISTS (SELECT 1 FROM final f WHERE f.entity_id = m.winner_id)) AS orphan_winners,
  (SELECT count(*) - count(DISTINCT entity_id) FROM final) AS duplicate_keys, (SELECT CAST(sum(source_count) AS BIGINT) FROM final) - (SELECT count(*) FROM ent) AS membership_mismatch""")
def dedup_checks(spark, sf_dir):
    ent = view(spark, sf_dir, "ent")
    merged, _ = merge_map(ent)
    merged = graph.written(merged, "merged")
    final = ent.join(merged, "entity_id", "left").groupBy(F.coalesce("winner_id", "entity_id").alias("entity_id")).agg(F.count("*").alias("n"))
    final = graph.written(final, "final")
    losers = merged.join(final, "entity_id", "left_semi").agg(F.count("*").alias("losers_left"))
    orphans = merged.join(final.select(F.col("entity_id").alias("winner_id")), "winner_id", "left_anti").agg(F.count("*").alias("orphan_winners"))
    keys = final.agg((F.count("*") - F.count_distinct("entity_id")).alias("duplicate_keys"), F.sum("n").alias("s"))
    total = ent.agg(F.count("*").alias("t"))
    return losers.crossJoin(orphans).crossJoin(keys).crossJoin(total).select("losers_left", "orphan_winners", "duplicate_keys", (F.col("s") - F.col("t")).alias("membership_mismatch"))


# ---- merges


def _queue_rows(spark, sf_dir):
    return view(spark, sf_dir, "email_queue").select("place_id", "id", F.col("attempts").cast("long").alias("attempts"), "status", "error_message")


@query("""SELECT place_id, arg_max(status, id) AS status, arg_max(error_message, id) FILTER (WHERE error_message IS NOT NULL) AS error_message, max(attempts) AS attempts, min(id) AS id FROM email_queue GROUP BY 1""")
def upsert_coalesce_greatest(spark, sf_dir):
    """A sequence of upserts in the order of ids: status overwritten, message kept unless given, attempts greatest, id least."""
    policy = {"error_message": "new_or_old", "attempts": "greatest", "id": "least"}
    rows = _queue_rows(spark, sf_dir).withColumn("seq", F.col("id"))
    return merge.fold(rows, ["place_id"], ["seq"], policy).select("place_id", "status", "error_message", "attempts", "id")


@query("""WITH o AS (SELECT place_id, list_sort(list_distinct(list(status))) AS s, bool_or(status = 'completed') AS done FROM email_queue WHERE campaign_id <= 2 GROUP BY 1),
n AS (SELECT place_id, list_sort(list_distinct(list(status))) AS s, bool_or(status = 'completed') AS done FROM email_queue WHERE campaign_id > 2 GROUP BY 1)
SELECT place_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.s, []), coalesce(n.s, [])))), ',') AS statuses, coalesce(o.done, false) OR coalesce(n.done, false) AS done,
  CAST(len(list_distinct(list_concat(coalesce(o.s, []), coalesce(n.s, [])))) AS BIGINT) AS n_statuses FROM o FULL OUTER JOIN n USING (place_id)""")
def array_set_merge(spark, sf_dir):
    q = view(spark, sf_dir, "email_queue")
    side = lambda cond: q.filter(cond).groupBy("place_id").agg(F.array_sort(F.collect_set("status")).alias("statuses"), F.bool_or(F.col("status") == "completed").alias("done"))
    m = merge.upsert(side("campaign_id <= 2"), side("campaign_id > 2"), ["place_id"], {"statuses": "union", "done": "or"})
    return m.select("place_id", F.array_join("statuses", ",").alias("statuses"), F.coalesce("done", F.lit(False)).alias("done"), F.size("statuses").cast("long").alias("n_statuses"))


@query("""SELECT id, place_id FROM email_queue WHERE campaign_id = 1 QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY id) = 1
UNION ALL SELECT id, place_id FROM email_queue q WHERE campaign_id = 2 AND NOT EXISTS (SELECT 1 FROM email_queue o WHERE o.campaign_id = 1 AND o.place_id = q.place_id) QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY id) = 1""")
def insert_ignore(spark, sf_dir):
    q = view(spark, sf_dir, "email_queue").select("id", "place_id", "campaign_id")
    old = merge.first_per_key(q.filter("campaign_id = 1"), ["place_id"], F.col("id"))
    return merge.insert_ignore(old, q.filter("campaign_id = 2"), ["place_id"], F.col("id")).select("id", "place_id")


@query("""SELECT q.id, q.place_id FROM email_queue q WHERE NOT EXISTS (SELECT 1 FROM extraction s WHERE s.place_id = q.place_id AND s.status = 'completed')""")
def delete_using(spark, sf_dir):
    done = view(spark, sf_dir, "extraction").filter("status = 'completed'").select("place_id")
    return merge.delete_using(view(spark, sf_dir, "email_queue").select("id", "place_id"), done, ["place_id"])


@query(KEYED.strip().join(["WITH ", ""]) + f""", r AS (SELECT dot_number, CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) END AS p, lower(trim(email_address)) AS e, regexp_replace(lower(legal_name), '[^a-z0-9]', '', 'g') AS n FROM registry),
hit AS (SELECT dot_number, 0 AS priority, entity_id FROM r JOIN k ON r.e = k.email_key UNION ALL SELECT dot_number, 1, entity_id FROM r JOIN k ON r.p = k.phone_key UNION ALL SELECT dot_number, 2, entity_id FROM r JOIN k ON r.n = k.name_key)
SELECT dot_number, CAST(priority AS INTEGER) AS priority, min(entity_id) AS entity_id FROM hit WHERE (dot_number, priority) IN (SELECT dot_number, min(priority) FROM hit GROUP BY 1) GROUP BY 1, 2""")
def priority_lookup(spark, sf_dir):
    """Registry rows looked up by e-mail, else phone, else name."""
    r = view(spark, sf_dir, "registry").select("dot_number", X.email_key("email_address", mailto=False).alias("e"), X.phone_key("phone").alias("p"), X.name_key("legal_name").alias("n"))
    k = match.keyed(view(spark, sf_dir, "ent"))
    return match.priority_lookup(r, k, [("e", "email_key"), ("p", "phone_key"), ("n", "name_key")], "dot_number", "entity_id")
