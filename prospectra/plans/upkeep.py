"""Upkeep of match results and reports: label backfills, rows returned by an insert, listing identities, address contexts, alert keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..operators import merge
from ..operators.spread import spread
from .fixtures import view
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

#: The statuses of a finished search, the statuses that keep a listing, and the labels that backfills write.
SEARCHED = ["matched", "ambiguous", "not_found"]
LISTED = ["matched", "queued", "in_progress"]
LEGACY, NOT_LISTED, NOT_FOUND = "legacy_multiclass_v1", "not_listed_on_google", "business_not_found_on_google"


def backfilled(rows: DataFrame) -> DataFrame:
    """Match results with the fields that older rows lack; a second run changes nothing.

    Takes status, policy, score, candidates, searched, found, url, verified and
    website_status.  A score is filled where a search was known to have had no
    candidates, before the search signal itself is filled.
    """
    done, matched = F.col("status").isin(SEARCHED), F.col("status") == "matched"
    negative = F.col("website_status").isNull() & ((matched & F.col("url").isNull()) | (F.col("status") == "not_found"))
    return rows.withColumns({
        "policy": F.when(F.col("policy").isNull() & done, LEGACY).otherwise(F.col("policy")),
        "score": F.when(F.col("score").isNull() & F.col("searched") & (F.col("candidates") == 0), 0.0).otherwise(F.col("score")),
        "found": F.when(~F.col("searched") & done, F.when(matched, F.col("url").isNotNull()).when(F.col("status") == "not_found", False)).otherwise(F.col("found")),
        "searched": F.col("searched") | done,
        "verified": F.when(negative, False).otherwise(F.col("verified")),
        "website_status": F.when(negative, F.when(matched, NOT_LISTED).otherwise(NOT_FOUND)).otherwise(F.col("website_status")),
        "url": F.when(F.col("status").isin(LISTED), F.col("url")),
    })


_RESULTS = """SELECT id, CASE status WHEN 'completed' THEN 'matched' WHEN 'no_email' THEN 'not_found' WHEN 'failed' THEN 'ambiguous' ELSE status END AS status,
  CASE WHEN id % 3 = 0 THEN 'v2' END AS policy, CASE WHEN id % 5 = 0 THEN CAST(0.5 AS DOUBLE) END AS score, id % 2 AS candidates, id % 4 < 2 AS searched,
  CASE WHEN id % 4 < 2 THEN id % 8 = 0 END AS found, CASE WHEN id % 7 < 4 THEN concat('https://s', CAST(id AS VARCHAR(20)), '.example.org') END AS url,
  CASE WHEN id % 11 = 0 THEN true END AS verified, CASE WHEN id % 11 = 0 THEN 'live' END AS website_status FROM {email_queue}"""


def _results(spark, sf_dir) -> DataFrame:
    return spark.sql(_RESULTS, email_queue=view(spark, sf_dir, "email_queue"))


_DONE = "status IN ('matched', 'ambiguous', 'not_found')"


@query(f"""WITH r AS ({_RESULTS.format(email_queue='email_queue')}), n AS (SELECT *, website_status IS NULL AND (status = 'matched' AND url IS NULL OR status = 'not_found') AS negative FROM r)
SELECT id, status, CASE WHEN policy IS NULL AND {_DONE} THEN 'legacy_multiclass_v1' ELSE policy END AS policy, CASE WHEN score IS NULL AND searched AND candidates = 0 THEN 0.0 ELSE score END AS score, candidates,
  CASE WHEN NOT searched AND {_DONE} THEN CASE status WHEN 'matched' THEN url IS NOT NULL WHEN 'not_found' THEN false END ELSE found END AS found, searched OR {_DONE} AS searched, CASE WHEN negative THEN false ELSE verified END AS verified,
  CASE WHEN negative THEN CASE status WHEN 'matched' THEN 'not_listed_on_google' ELSE 'business_not_found_on_google' END ELSE website_status END AS website_status,
  CASE WHEN status IN ('matched', 'queued', 'in_progress') THEN url END AS url FROM n""")
def label_backfill(spark, sf_dir):
    return backfilled(_results(spark, sf_dir))


@query("""WITH d AS (SELECT place_id FROM leads l WHERE EXISTS (SELECT 1 FROM lead_emails e WHERE e.place_id = l.place_id) AND NOT EXISTS (SELECT 1 FROM email_queue q WHERE q.place_id = l.place_id AND campaign_id = 3) ORDER BY place_id LIMIT 200)
SELECT place_id, 'queued' AS status, count(*) OVER () AS enqueued FROM d""")
def enqueue_returning(spark, sf_dir):
    """The first places with an address that a campaign lacks, as an insert returns them, each with the number of rows written."""
    queued = view(spark, sf_dir, "email_queue").filter("campaign_id = 3").select("place_id")
    new = view(spark, sf_dir, "leads").select("place_id").join(view(spark, sf_dir, "lead_emails").select("place_id"), "place_id", "left_semi")
    delta = new.join(queued, "place_id", "left_anti").orderBy("place_id").limit(200).select("place_id", F.lit("queued").alias("status"))
    return delta.crossJoin(delta.agg(F.count("*").alias("enqueued")))  # one row


def listing_identity(place_id: Column, cid: Column, *described: Column) -> Column:
    """A listing's place id, else its other id, else what describes it."""
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in described])
    return F.coalesce(F.nullif(place_id, F.lit("")), F.nullif(cid, F.lit("")), text)


_SEEN = """SELECT o_custkey % 40 AS viewport, o_orderkey AS position, CASE o_orderkey % 4 WHEN 0 THEN concat('p', CAST(o_orderkey % 300 AS VARCHAR(20))) WHEN 1 THEN '' END AS place_id,
  CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderkey % 90 AS VARCHAR(20)) END AS cid, concat('Shop ', CAST(o_orderkey % 50 AS VARCHAR(20))) AS name, CASE WHEN o_orderkey % 3 = 0 THEN '555-0100' END AS phone FROM {orders}"""


@query(f"""WITH s AS (SELECT *, coalesce(nullif(place_id, ''), nullif(cid, ''), name || '|' || coalesce(phone, '')) AS identity FROM ({_SEEN.format(orders='orders')}) x),
f AS (SELECT viewport, identity, min(position) AS position FROM s GROUP BY 1, 2) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY viewport ORDER BY position) <= 120""")
def viewport_listings(spark, sf_dir):
    """The first 120 distinct listings of each viewport, in the order that they were seen."""
    seen = spark.sql(_SEEN, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    first = seen.groupBy("viewport", listing_identity(F.col("place_id"), F.col("cid"), F.col("name"), F.col("phone")).alias("identity")).agg(F.min("position").alias("position"))
    return merge.top_per_key(first, ["viewport"], 120, F.col("position")).select("viewport", "identity", "position")


#: Addresses as they are found in page source, and how far around one its context reaches.
ADDRESS, RADIUS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 350


_HTML = """SELECT event_id AS id, CASE WHEN event_id % 9 <> 0 THEN concat('<p>Shop ', CAST(event_id AS VARCHAR(20)), '</p>', repeat('<i>pad</i> ', CAST(event_id % 60 AS INT)), CASE WHEN event_id % 3 = 0 THEN 'Fish &amp; Chips' ELSE '' END, '<b>a', CAST(event_id AS VARCHAR(20)), '@x.example.org</b>',
  repeat('<u> far </u>', CAST(event_id % 50 AS INT)), CASE WHEN event_id % 2 = 0 THEN 'or me@y.example.net' ELSE '' END, '</div>') END AS html FROM {events}"""


@query(rf"""WITH h AS ({_HTML.format(events='events')}), m AS (SELECT id, html, unnest(regexp_extract_all(html, '{ADDRESS}')) AS email FROM h),
p AS (SELECT *, instr(html, email) - 1 AS pos FROM m), c AS (SELECT id, email, substr(html, greatest(pos - 350, 0) + 1, pos + length(email) + 350 - greatest(pos - 350, 0)) AS part FROM p)
SELECT id, email, array_to_string(list_filter(list_transform(string_split_regex(part, '<[^>]*>'), lambda t: trim(replace(t, '&amp;', '&'))), lambda t: t <> ''), ' ') AS context FROM c""")
def email_contexts(spark, sf_dir):
    pages = spark.sql(_HTML, events=spread(spark.read.parquet(f"{sf_dir}/events.parquet")))
    return pages.select("id", F.inline(markup.contexts(F.col("html"), ADDRESS, RADIUS)))


def alert_key(mode: str, *parts: Column) -> Column:
    """A key that is the same for the same content: a digest of the parts, each of them JSON, as a JSON list."""
    listed = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    return F.concat(F.lit(f"ops-{mode}-"), F.substring(F.sha2(listed, 256), 1, 32))


@query("""WITH d AS (SELECT created_at AS day, list(id ORDER BY id) FILTER (WHERE status = 'failed') AS f, list(id ORDER BY id) FILTER (WHERE status = 'pending') AS p FROM email_queue GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, CAST(coalesce(len(f), 0) AS BIGINT) AS n_failed, 'ops-event-' || substr(sha256('[false,[' || coalesce(array_to_string(f, ','), '') || '],[],[],[' || coalesce(array_to_string(p, ','), '') || '],""]'), 1, 32) AS alert_key
FROM d WHERE f IS NOT NULL OR p IS NOT NULL""")
def daily_alerts(spark, sf_dir):
    """One alert for each day with failed or waiting rows; a day's rows bound its lists."""
    q = view(spark, sf_dir, "email_queue").filter(F.col("status").isin("failed", "pending"))
    ids = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("id"))))
    days = q.groupBy(F.col("created_at").cast("string").alias("day")).agg(ids("failed").alias("f"), ids("pending").alias("p"))
    key = alert_key("event", F.lit("false"), F.to_json("f"), F.lit("[]"), F.lit("[]"), F.to_json("p"), F.lit('""'))
    return days.select("day", F.size("f").cast("long").alias("n_failed"), key.alias("alert_key"))


@query("""SELECT source, count(*) AS entities, count(email) AS with_email FROM ent WHERE list_contains(['a', 'c'], source) GROUP BY 1""")
def restricted_sources(spark, sf_dir):
    """Entities of the named sources only."""
    return view(spark, sf_dir, "ent").filter(F.col("source").isin("a", "c")).groupBy("source").agg(F.count("*").alias("entities"), F.count("email").alias("with_email"))
