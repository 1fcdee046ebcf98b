"""Record upkeep: replacements, guarded updates, resets, eligibility, payloads and labels of leads and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import merge
from .fixtures import view
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


@query("SELECT place_id, upper(trim(state)) AS state FROM leads WHERE website_raw IS NULL OR trim(website_raw) = ''")
def blank_website_leads(spark, sf_dir):
    rows = view(spark, sf_dir, "leads")
    return rows.filter(F.coalesce(F.trim("website_raw"), F.lit("")) == "").select("place_id", F.upper(F.trim("state")).alias("state"))


@query("""SELECT n.id, n.error_message FROM email_queue n JOIN email_queue o ON o.id = n.id - 1 WHERE n.error_message IS DISTINCT FROM o.error_message""")
def changed_messages(spark, sf_dir):
    """Rows whose message differs from that of the row before, nulls being equal to each other only."""
    q = view(spark, sf_dir, "email_queue").select("id", "error_message")
    before = q.select((F.col("id") + 1).alias("id"), F.col("error_message").alias("old"))
    return q.join(before, "id").filter(~F.col("error_message").eqNullSafe(F.col("old"))).select("id", "error_message")


@query("""SELECT source_type, round(avg(confidence) FILTER (WHERE is_free_provider), 4) AS free_confidence, round(avg(confidence) FILTER (WHERE NOT is_free_provider), 4) AS own_confidence FROM lead_emails GROUP BY 1""")
def confidence_by_kind(spark, sf_dir):
    mean = lambda c: F.round(F.avg(F.when(c, F.col("confidence"))), 4)
    free = F.col("is_free_provider")
    return view(spark, sf_dir, "lead_emails").groupBy("source_type").agg(mean(free).alias("free_confidence"), mean(~free).alias("own_confidence"))


@query("""SELECT request_id, CAST(epoch(max(CAST(processed_at AS TIMESTAMP)) FILTER (WHERE kind = 'demo_set')) AS BIGINT) AS last_demo_s, count(*) FILTER (WHERE kind = 'demo_set') AS demos, count(*) AS events FROM request_events GROUP BY 1""")
def last_demo_rollup(spark, sf_dir):
    e = view(spark, sf_dir, "request_events")
    demo = F.col("kind") == "demo_set"
    at = F.round(F.unix_micros(F.max(F.when(demo, F.col("processed_at").cast("timestamp")))) / 1e6).cast("long")
    return e.groupBy("request_id").agg(at.alias("last_demo_s"), F.count_if(demo).alias("demos"), F.count("*").alias("events"))


@query("""WITH n AS (SELECT * FROM email_queue WHERE campaign_id = 2 QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY id) = 1), o AS (SELECT * FROM email_queue WHERE campaign_id = 1 QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY id) = 1)
SELECT place_id, id, status FROM n UNION ALL SELECT place_id, id, status FROM o WHERE place_id NOT IN (SELECT place_id FROM n)""")
def insert_or_replace(spark, sf_dir):
    q = view(spark, sf_dir, "email_queue").select("place_id", "id", "status", "campaign_id")
    side = lambda k: merge.first_per_key(q.filter(F.col("campaign_id") == k), ["place_id"], F.col("id")).drop("campaign_id")
    return merge.upsert(side(1), side(2), ["place_id"], {})


def guarded_update(rows: DataFrame, wanted: DataFrame, key: str, guard: Column, changes: dict[str, Column]) -> DataFrame:
    """(key, outcome and changed fields) of each wanted key: updated where the guard holds, else refused, or not_found."""
    found = wanted.select(key).distinct().join(rows.withColumn("__there", F.lit(True)), key, "left")
    ok = F.coalesce(guard, F.lit(False))
    outcome = F.when(F.col("__there").isNull(), "not_found").when(ok, "updated").otherwise("refused")
    return found.select(key, outcome.alias("outcome"), *[F.when(ok, new).otherwise(F.col(c)).alias(c) for c, new in changes.items()])


@query("""WITH w AS (SELECT DISTINCT o_orderkey + 3 AS id FROM orders)
SELECT id, CASE WHEN q.place_id IS NULL THEN 'not_found' WHEN status = 'pending' THEN 'updated' ELSE 'refused' END AS outcome, CASE WHEN status = 'pending' THEN 'in_progress' ELSE status END AS status,
  CASE WHEN status = 'pending' THEN attempts + 1 ELSE attempts END AS attempts FROM w LEFT JOIN email_queue q USING (id)""")
def guarded_claims(spark, sf_dir):
    """Compare-and-set as a new snapshot of the rows asked for, each with its outcome."""
    asked = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") + 3).alias("id"))
    changes = {"status": F.lit("in_progress"), "attempts": F.col("attempts") + 1}
    return guarded_update(view(spark, sf_dir, "email_queue"), asked, "id", F.col("status") == "pending", changes)


@query("""SELECT (SELECT count(*) FROM lead_emails) AS emails_to_drop, (SELECT count(*) FROM extraction) AS outcomes_to_drop, count(*) FILTER (WHERE status <> 'pending') AS rows_to_requeue, count(*) AS queue_rows FROM email_queue""")
def reset_dry_run(spark, sf_dir):
    """What a campaign reset would do, counted and not done."""
    q = view(spark, sf_dir, "email_queue").agg(F.count_if(F.col("status") != "pending").alias("rows_to_requeue"), F.count("*").alias("queue_rows"))
    n = lambda name, c: view(spark, sf_dir, name).agg(F.count("*").alias(c))
    return n("lead_emails", "emails_to_drop").crossJoin(n("extraction", "outcomes_to_drop")).crossJoin(q)  # one row each


@query("""SELECT q.id, q.place_id, l.name, l.phone, q.attempts + 1 AS attempts FROM email_queue q JOIN leads l USING (place_id) WHERE q.status = 'pending' OR (q.status = 'failed' AND q.attempts < 3)""")
def claims_with_payload(spark, sf_dir):
    from .queues import claimable

    q = claimable(view(spark, sf_dir, "email_queue")).select("id", "place_id", (F.col("attempts") + 1).alias("attempts"))
    return q.join(view(spark, sf_dir, "leads").select("place_id", "name", "phone"), "place_id").select("id", "place_id", "name", "phone", "attempts")


@query("""WITH t AS (SELECT max(CAST(created_at AS TIMESTAMP)) AS now FROM email_queue)
SELECT id, status = 'in_progress' AS was_stale FROM email_queue, t WHERE attempts < 3 AND status IN ('failed', 'in_progress') AND CAST(created_at AS TIMESTAMP) < now - INTERVAL 30 MINUTE""")
def retry_eligible(spark, sf_dir):
    """Failed rows of under three attempts, and stale work, over half an hour old at the newest row's time."""
    q = view(spark, sf_dir, "email_queue").withColumn("at", F.col("created_at").cast("timestamp"))
    now = q.agg(F.max("at").alias("now"))  # one row
    late = q.crossJoin(now).filter((F.col("attempts") < 3) & F.col("status").isin("failed", "in_progress") & (F.col("at") < F.col("now") - F.expr("INTERVAL 30 MINUTES")))
    return late.select("id", (F.col("status") == "in_progress").alias("was_stale"))


@query("""SELECT place_id, email, confidence FROM lead_emails QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY confidence >= 0.9 DESC, is_free_provider, email) = 1""")
def preferred_email(spark, sf_dir):
    e = view(spark, sf_dir, "lead_emails").select("place_id", "email", "confidence", "is_free_provider")
    return merge.first_per_key(e, ["place_id"], F.col("confidence") < 0.9, F.col("is_free_provider"), F.col("email")).drop("is_free_provider")


@query("""SELECT place_id, '[' || string_agg('{"email":"' || email || '","confidence":' || CAST(round(confidence, 2) AS VARCHAR) || '}', ',' ORDER BY confidence DESC, email) || ']' AS top
FROM (SELECT * FROM lead_emails QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY confidence DESC, email) <= 5) GROUP BY 1""")
def top_candidates_json(spark, sf_dir):
    """The five best of each place as one JSON list, numbers rounded."""
    e = merge.top_per_key(view(spark, sf_dir, "lead_emails"), ["place_id"], 5, F.desc("confidence"), F.col("email"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "email", F.round("confidence", 2).alias("confidence")))), lambda x: F.struct(x["email"].alias("email"), x["confidence"].alias("confidence")))
    return e.groupBy("place_id").agg(F.to_json(items).alias("top"))


@query("""SELECT id, coalesce(CASE WHEN phone <> '' THEN '"' || name || '" ("(' || substr(p, 1, 3) || ') ' || substr(p, 4, 3) || '-' || substr(p, 7, 4) || '" OR "' || p || '")' END,
  '"' || name || '"' || CASE WHEN city <> '' THEN ' "' || city || '"' ELSE '' END || ' (email OR contact)') AS first_query, CAST(CASE WHEN phone <> '' THEN 3 ELSE 1 END AS BIGINT) AS n_queries,
  trim(name || ' ' || city) AS place_query FROM (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS p FROM found_addresses)""")
def search_queries(spark, sf_dir):
    f = view(spark, sf_dir, "found_addresses").withColumn("q", queries_of(F.col("name"), F.col("phone"), F.col("city")))
    return f.select("id", F.get("q", F.lit(0)).alias("first_query"), F.size("q").cast("long").alias("n_queries"), F.trim(F.concat_ws(" ", "name", F.nullif("city", F.lit("")))).alias("place_query"))


def queries_of(name: Column, phone: Column, city: Column) -> Column:
    """Up to three search strings of a business, the most precise first, none twice."""
    d = X.digits(phone)
    shown = F.when(F.length(d) == 10, F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))).otherwise(phone)
    called, quoted = F.coalesce(phone, F.lit("")) != "", F.concat(F.lit('"'), name, F.lit('"'))
    town = F.when(F.coalesce(city, F.lit("")) != "", F.concat(F.lit(' "'), city, F.lit('"'))).otherwise("")
    made = [
        F.when(called, F.concat(quoted, F.lit(' ("'), shown, F.lit('" OR "'), d, F.lit('")'))), F.concat(quoted, town, F.lit(" (email OR contact)")),
        F.when(called, F.concat(F.lit('"'), shown, F.lit('" ("@gmail.com" OR "@yahoo.com" OR "@outlook.com" OR email)'))),
    ]
    return F.slice(F.array_distinct(F.filter(F.array(*made), lambda q: q.isNotNull())), 1, 3)


@query("""SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 7 END AS kind, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'v' || event_id END AS name FROM events""")
def guarded_payloads(spark, sf_dir):
    """Responses behind a guard prefix, read as JSON; malformed ones give nulls."""
    e = F.col("event_id")
    body = F.concat(F.lit(")]}'\n"), F.when(e % 4 == 0, "[broken").otherwise(F.concat(F.lit('{"kind":'), (e % 7).cast("string"), F.lit(',"name":"v'), e.cast("string"), F.lit('"}'))))
    read = decoded(body, "kind bigint, name string")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(e.alias("id"), read.alias("r")).select("id", "r.kind", "r.name")


def decoded(body: Column, schema: str) -> Column:
    """A response's JSON without its guard prefix; fields are null where it is malformed."""
    return F.from_json(F.regexp_replace(body, r"^\)\]\}'\s*", ""), schema, {"mode": "PERMISSIVE"})


@query("""SELECT id, '#' || CASE WHEN id < 1000 THEN lpad(CAST(id AS VARCHAR), 4, '0') ELSE CAST(id AS VARCHAR) END AS label, left(near || ' ' || result, 20) AS note, json_extract_string('{"runtime":{"n":' || id || '}}', '$.runtime.n') AS n FROM found_addresses""")
def labels_and_notes(spark, sf_dir):
    """Zero-padded labels, cut notes, and a nested JSON field."""
    f = view(spark, sf_dir, "found_addresses")
    summary = F.concat(F.lit('{"runtime":{"n":'), F.col("id").cast("string"), F.lit("}}"))
    number = F.col("id").cast("string")
    label = F.concat(F.lit("#"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))
    return f.select("id", label.alias("label"), F.left(F.concat("near", F.lit(" "), "result"), F.lit(20)).alias("note"), F.get_json_object(summary, "$.runtime.n").alias("n"))
