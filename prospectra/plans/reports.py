"""Reports and small merges: lists zipped with padding, shares by dataset, progress, labels, approvals, warehouse checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import merge
from .fixtures import VIEWS, view
from .registry import Registry
from .warehouse import usable

REGISTRY = Registry()
query = REGISTRY.query
_T = "VARCHAR(20)"

# ---- lists of different lengths

VIEWS["category_lists"] = f"""
SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'c1|c2|c3' WHEN 1 THEN 'c1' WHEN 2 THEN 'c4|c5' WHEN 3 THEN NULL ELSE 'c6' END AS ids,
  CASE c_custkey % 4 WHEN 0 THEN 'Food > Cafe|Shop' WHEN 1 THEN 'Food > Cafe > Espresso Bar' WHEN 2 THEN 'A > B|C|D > E' ELSE NULL END AS labels FROM {{customer}}"""


@query("""WITH z AS (SELECT id, string_split(ids, '|') AS a, string_split(labels, '|') AS b FROM category_lists)
SELECT id, CAST(i AS INTEGER) AS ordinality, a[i] AS category_id, b[i] AS label, array_to_string(list_transform(string_split(b[i], ' > '), lambda x: upper(x)), '/') AS hierarchy, i = 1 AS is_primary
FROM (SELECT *, unnest(range(1, CAST(greatest(coalesce(len(a), 0), coalesce(len(b), 0)) AS BIGINT) + 1)) AS i FROM z)""")
def zipped_categories(spark, sf_dir):
    """Ids and labels side by side; the shorter list is padded with nulls, a missing one is empty."""
    none = F.array().cast("array<string>")
    rows = view(spark, sf_dir, "category_lists").select("id", F.coalesce(F.split("ids", r"\|"), none).alias("category_id"), F.coalesce(F.split("labels", r"\|"), none).alias("label"))
    each = rows.select("id", F.posexplode(F.arrays_zip("category_id", "label")).alias("pos", "c"))
    hierarchy = F.array_join(F.transform(F.split("c.label", " > "), lambda x: F.upper(x)), "/")
    return each.select("id", (F.col("pos") + 1).alias("ordinality"), "c.category_id", "c.label", hierarchy.alias("hierarchy"), (F.col("pos") == 0).alias("is_primary"))


# ---- shares and coverage by dataset

VIEWS["dataset_socials"] = f"""
SELECT src AS dataset, k, concat(src, CAST(k AS {_T})) AS place_id, CASE WHEN k % 3 = 0 THEN 'facebook' WHEN k % 3 = 1 AND src = 'a' THEN 'instagram' WHEN k % 5 = 0 THEN 'twitter' END AS platform
FROM (SELECT 'a' AS src, c_custkey AS k FROM {{customer}} UNION ALL SELECT 'b', p_partkey FROM {{part}} UNION ALL SELECT 'c', s_suppkey FROM {{supplier}}) t"""


@query("""SELECT dataset, platform, count(*) AS profiles, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY dataset), 4)::DOUBLE AS pct FROM dataset_socials WHERE platform IS NOT NULL GROUP BY 1, 2""")
def platform_share_by_dataset(spark, sf_dir):
    """The share of each platform within its dataset: totals are a second, smaller grouping."""
    by = view(spark, sf_dir, "dataset_socials").filter("platform is not null").groupBy("dataset", "platform").agg(F.count("*").alias("profiles"))
    total = by.groupBy("dataset").agg(F.sum("profiles").alias("total"))
    return by.join(total, "dataset").select("dataset", "platform", "profiles", F.round(100.0 * F.col("profiles") / F.col("total"), 4).alias("pct"))


@query("""SELECT dataset, count(*) AS places, count(platform) AS with_social, round(100.0 * count(platform) / nullif(count(*), 0), 2)::DOUBLE AS coverage_pct FROM dataset_socials GROUP BY 1""")
def social_coverage(spark, sf_dir):
    by = view(spark, sf_dir, "dataset_socials").groupBy("dataset").agg(F.count("*").alias("places"), F.count("platform").alias("with_social"))
    return by.withColumn("coverage_pct", F.round(100.0 * F.col("with_social") / F.col("places"), 2))


# ---- one JSON list a request, empty ones too


@query("""WITH r AS (SELECT DISTINCT request_id FROM request_events)
SELECT request_id, coalesce('[' || string_agg('{"id":' || event_id || ',"kind":"' || kind || '"}', ',' ORDER BY event_id) FILTER (WHERE kind = 'ticket_opened' AND event_id % 3 = 0) || ']', '[]') AS tickets FROM r LEFT JOIN request_events USING (request_id) GROUP BY 1""")
def tickets_of_requests(spark, sf_dir):
    """Opened tickets of every request as JSON; [] where there is none."""
    e = view(spark, sf_dir, "request_events")
    opened = F.when((F.col("kind") == "ticket_opened") & (F.col("event_id") % 3 == 0), F.struct(F.col("event_id").alias("id"), "kind"))
    return e.groupBy("request_id").agg(F.to_json(F.array_sort(F.collect_list(opened))).alias("tickets"))  # collect_list leaves nulls out


# ---- merges


@query("""WITH o AS (SELECT o_custkey AS k, max(o_orderkey) AS last_order, max(o_orderstatus) AS status FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), n AS (SELECT o_custkey AS k, min(o_orderkey) AS last_order, CASE WHEN o_custkey % 4 <> 0 THEN min(o_orderstatus) END AS status FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT k, CASE WHEN n.last_order IS NOT NULL THEN n.last_order ELSE o.last_order END AS last_order, CASE WHEN n.last_order IS NOT NULL THEN n.status ELSE o.status END AS status FROM o FULL OUTER JOIN n USING (k)""")
def upsert_replaces(spark, sf_dir):
    """On conflict every column takes the new value, nulls included."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_custkey").alias("k")
    old = o.filter("o_orderkey % 2 = 0").groupBy(k).agg(F.max("o_orderkey").alias("last_order"), F.max("o_orderstatus").alias("status"))
    new = o.filter("o_orderkey % 3 = 0").groupBy(k).agg(F.min("o_orderkey").alias("last_order"), F.min("o_orderstatus").alias("status"))
    return merge.upsert(old, new.withColumn("status", F.when(F.col("k") % 4 != 0, F.col("status"))), ["k"], {})


VIEWS["candidates"] = """
SELECT o_custkey AS record, o_orderkey AS place, o_orderkey % 10 AS position, CAST(o_orderkey % 4 AS DOUBLE) / 4 AS score FROM {orders}"""


@query("""SELECT record, arg_max(place, {'s': score, 'p': -position, 'k': -place}) AS place, max(score) AS score FROM candidates GROUP BY 1""")
def first_best_candidate(spark, sf_dir):
    """The candidate with the best score of each record; of equal ones the first."""
    best = F.max_by("place", F.struct("score", (-F.col("position")).alias("p"), (-F.col("place")).alias("k")))
    return view(spark, sf_dir, "candidates").groupBy("record").agg(best.alias("place"), F.max("score").alias("score"))


# ---- progress and labels

VIEWS["run_progress"] = """
SELECT 1 + o_orderkey % 40 AS run_id, count(*) AS total, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done, 60 * (1 + o_orderkey % 40) * (1 + o_orderkey % 40) AS elapsed_s FROM {orders} GROUP BY o_orderkey % 40"""


def clock(seconds: Column) -> Column:
    """Whole seconds as hours, minutes and seconds; hours may have more than two digits."""
    s = seconds.cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    return F.concat_ws(":", F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), two(F.floor(s % 3600 / 60)), two(s % 60))


_CLOCK = "CASE WHEN {0} // 3600 < 100 THEN lpad(CAST({0} // 3600 AS VARCHAR), 2, '0') ELSE CAST({0} // 3600 AS VARCHAR) END || ':' || lpad(CAST({0} % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')"


@query(f"""WITH p AS (SELECT run_id, CAST(done AS BIGINT) AS done, total, CAST(elapsed_s AS BIGINT) AS e, CASE WHEN done > 0 THEN CAST(floor(CAST(elapsed_s AS DOUBLE) * (total - done) / done) AS BIGINT) END AS left_s FROM run_progress)
SELECT run_id, done, total, round(100.0 * done / nullif(total, 0), 2)::DOUBLE AS pct, round(60.0 * done / nullif(e, 0), 3)::DOUBLE AS per_minute, {_CLOCK.format("e")} AS elapsed, CASE WHEN left_s IS NOT NULL THEN {_CLOCK.format("left_s")} END AS eta FROM p""")
def progress_lines(spark, sf_dir):
    """What a run has done, how fast, since when, and the time it still needs."""
    p = view(spark, sf_dir, "run_progress").select("run_id", F.col("done").cast("long").alias("done"), "total", F.col("elapsed_s").cast("long").alias("e"))
    left = F.floor(F.when(F.col("done") > 0, F.col("e").cast("double") * (F.col("total") - F.col("done")) / F.col("done")))
    return p.select(
        "run_id", "done", "total", F.round(100.0 * F.col("done") / F.col("total"), 2).alias("pct"), F.round(60.0 * F.col("done") / F.col("e"), 3).alias("per_minute"), clock(F.col("e")).alias("elapsed"), F.when(left.isNotNull(), clock(left)).alias("eta")
    )


@query("""SELECT c_custkey AS id, '#' || CASE WHEN c_custkey < 10000 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END AS label, CASE WHEN c_custkey % 7 <> 0 THEN '$' || printf('%.2f', CAST(c_custkey AS DECIMAL(12, 2)) / 4) END AS price FROM customer""")
def request_labels(spark, sf_dir):
    """Numbers as #0001 and prices as $25.00; no price, no text."""
    k = F.col("c_custkey")
    price = (k.cast("decimal(12,2)") / 4).cast("decimal(12,2)")
    label = F.when(k < 10000, F.lpad(k.cast("string"), 4, "0")).otherwise(k.cast("string"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), F.concat(F.lit("#"), label).alias("label"), F.when(k % 7 != 0, F.concat(F.lit("$"), price.cast("string"))).alias("price"))


# ---- approvals

VIEWS["ops_items"] = f"""
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'email_reply' WHEN 1 THEN 'revision' WHEN 2 THEN 'demo' ELSE 'other' END AS kind, CASE WHEN o_orderkey % 6 = 0 THEN 'approved' WHEN o_orderkey % 11 = 0 THEN 'sent' ELSE 'pending' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('draft ', CAST(o_orderkey AS {_T})) END AS final_body FROM {{orders}}"""
VIEWS["ops_decisions"] = """
SELECT o_orderkey + 1 AS id, CASE o_orderkey % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'approve' WHEN 3 THEN 'later' ELSE 'reject' END AS decision, CASE WHEN o_orderkey % 3 = 0 THEN '  yes ' WHEN o_orderkey % 3 = 1 THEN '   ' WHEN o_orderkey % 51 = 2 THEN repeat('x', 10001) END AS body,
  CASE WHEN o_orderkey % 77 = 0 THEN repeat('n', 4001) WHEN o_orderkey % 2 = 0 THEN ' note' END AS note FROM {orders} WHERE o_orderkey % 2 = 0 OR o_orderkey % 7 = 0"""
NEEDS_BODY, BODY, NOTE = ["email_reply", "revision"], 10_000, 4_000


def decided(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each decision's outcome, and the item as it is then: one for each id; only pending items are decided, and some need a message."""
    d = decisions.withColumns({"body": F.nullif(F.trim("body"), F.lit("")), "note": F.nullif(F.trim("note"), F.lit(""))})
    both = d.join(items.withColumn("there", F.lit(True)), "id", "left")
    long = F.coalesce((F.length("body") > BODY) | (F.length("note") > NOTE), F.length("body") > BODY, F.length("note") > NOTE, F.lit(False))
    outcome = (
        F.when(~F.col("decision").isin("approve", "reject"), "unknown decision").when(F.col("there").isNull(), "not found").when(F.col("status") != "pending", "already handled")
        .when((F.col("decision") == "approve") & F.col("kind").isin(NEEDS_BODY) & F.col("body").isNull(), "needs a message").when(long, "too long").otherwise("ok")
    )
    both = both.withColumn("outcome", outcome)
    ok = F.col("outcome") == "ok"
    return both.select(
        "id", "outcome", F.when(ok, F.when(F.col("decision") == "approve", "approved").otherwise("rejected")).otherwise(F.col("status")).alias("status"),
        F.when(ok, F.coalesce("body", "final_body")).otherwise(F.col("final_body")).alias("final_body"), F.when(ok, F.col("note")).alias("reviewer_note"),
    )


@query("""WITH d AS (SELECT id, decision, nullif(trim(body), '') AS body, nullif(trim(note), '') AS note FROM ops_decisions),
o AS (SELECT d.*, i.status, i.final_body, CASE WHEN decision NOT IN ('approve', 'reject') THEN 'unknown decision' WHEN i.id IS NULL THEN 'not found' WHEN status <> 'pending' THEN 'already handled' WHEN decision = 'approve' AND kind IN ('email_reply', 'revision') AND body IS NULL THEN 'needs a message'
  WHEN coalesce(length(body), 0) > 10000 OR coalesce(length(note), 0) > 4000 THEN 'too long' ELSE 'ok' END AS outcome FROM d LEFT JOIN ops_items i USING (id))
SELECT id, outcome, CASE WHEN outcome = 'ok' THEN CASE decision WHEN 'approve' THEN 'approved' ELSE 'rejected' END ELSE status END AS status, CASE WHEN outcome = 'ok' THEN coalesce(body, final_body) ELSE final_body END AS final_body, CASE WHEN outcome = 'ok' THEN note END AS reviewer_note FROM o""")
def approval_decisions(spark, sf_dir):
    return decided(view(spark, sf_dir, "ops_items"), view(spark, sf_dir, "ops_decisions"))


@query("""SELECT id, CASE WHEN status <> 'approved' THEN 'refused' WHEN id % 4 = 3 THEN 'unknown status' ELSE 'ok' END AS outcome, CASE WHEN status = 'approved' AND id % 4 <> 3 THEN CASE WHEN id % 4 = 0 THEN 'sent' ELSE 'failed' END ELSE status END AS status,
  CASE WHEN status = 'approved' AND id % 4 <> 3 THEN left(repeat('r', CAST(id % 3000 AS INT)), 2000) END AS result FROM ops_items""")
def approval_outcomes(spark, sf_dir):
    """The outcome of what was approved: only approved items can be sent or fail, and results are cut at 2,000 characters."""
    said = F.when(F.col("id") % 4 == 0, "sent").when(F.col("id") % 4 == 3, "odd").otherwise("failed")
    valid, approved = said.isin("sent", "failed"), F.col("status") == "approved"
    outcome = F.when(~approved, "refused").when(~valid, "unknown status").otherwise("ok")
    return view(spark, sf_dir, "ops_items").select(
        "id", outcome.alias("outcome"), F.when(approved & valid, said).otherwise(F.col("status")).alias("status"), F.when(approved & valid, F.left(F.repeat(F.lit("r"), (F.col("id") % 3000).cast("int")), F.lit(2000))).alias("result")
    )


# ---- checks of the warehouse


@query(f"""WITH e AS (SELECT entity_id, count(*) AS n, count(*) FILTER (WHERE {usable("lower(trim(regexp_replace(email, '^mailto:', '', 'i')))")}) AS mails FROM ent WHERE k % 97 <> 0 GROUP BY 1),
c AS (SELECT concat('c', CAST(c_custkey AS VARCHAR)) AS place_id, c_nationkey FROM customer)
SELECT (SELECT count(*) FROM ent p WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.entity_id = p.entity_id)) AS orphan_places, (SELECT count(*) FROM e WHERE mails = 0) AS entities_without_email,
  (SELECT count(*) FROM (SELECT name, postcode FROM ent GROUP BY ALL HAVING count(*) > 1)) AS repeated_names, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name <> 'NATION_1') AS outside_country""")
def warehouse_checks(spark, sf_dir):
    """Places without an entity, entities without a usable address, names that repeat at a postcode, records of another country."""
    ent = view(spark, sf_dir, "ent")
    e = ent.filter("k % 97 <> 0").groupBy("entity_id").agg(F.count_if(X.is_usable(X.email_key("email"))).alias("mails"))
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_name <> 'NATION_1'").select(F.col("n_nationkey").alias("c_nationkey"))
    counts = {
        "orphan_places": ent.join(e, "entity_id", "left_anti"), "entities_without_email": e.filter("mails = 0"), "repeated_names": ent.groupBy("name", "postcode").count().filter("count > 1"),
        "outside_country": spark.read.parquet(f"{sf_dir}/customer.parquet").join(nation, "c_nationkey"),
    }
    return reduce(lambda a, b: a.crossJoin(b), [t.agg(F.count("*").alias(name)) for name, t in counts.items()])  # one row each


# ---- snapshots

VIEWS["old_carriers"] = f"SELECT s_suppkey AS k, concat('old ', CAST(s_suppkey AS {_T})) AS name, s_suppkey % 4 <> 0 AS is_current FROM {{supplier}} WHERE s_suppkey % 5 <> 0"
VIEWS["new_carriers"] = f"SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN concat('old ', CAST(s_suppkey AS {_T})) WHEN s_suppkey % 7 <> 0 THEN concat('new ', CAST(s_suppkey AS {_T})) END AS name, CASE WHEN s_suppkey % 6 <> 1 THEN concat('m', CAST(s_suppkey AS {_T}), '@x.example.net') END AS email FROM {{supplier}} WHERE s_suppkey % 4 <> 1"


@query("""SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.name ELSE o.name END AS name, n.k IS NOT NULL AS is_current, CASE WHEN n.k IS NULL THEN 'retired' WHEN o.k IS NULL THEN 'new' WHEN n.name IS DISTINCT FROM o.name THEN 'changed' WHEN NOT o.is_current THEN 'returned' ELSE 'kept' END AS change
FROM new_carriers n FULL OUTER JOIN old_carriers o ON n.k = o.k""")
def snapshot_changes(spark, sf_dir):
    """A table after its next snapshot: rows of the snapshot are current with their new fields, nulls included, all others are not."""
    old, new = view(spark, sf_dir, "old_carriers"), view(spark, sf_dir, "new_carriers").select("k", "name")
    made = merge.snapshot_currency(old, new, "k")
    was = old.select("k", F.col("name").alias("was"), F.col("is_current").alias("was_current"), F.lit(True).alias("there"))
    change = (
        F.when(~F.col("is_current"), "retired").when(F.col("there").isNull(), "new").when(~F.col("name").eqNullSafe(F.col("was")), "changed").when(~F.col("was_current"), "returned").otherwise("kept")
    )
    return made.join(was, "k", "left").select("k", "name", "is_current", change.alias("change"))


@query("""WITH t AS (SELECT coalesce(n.k, o.k) AS k, n.k IS NOT NULL AS is_current FROM new_carriers n FULL OUTER JOIN old_carriers o ON n.k = o.k)
SELECT (SELECT count(*) FROM new_carriers WHERE email IS NOT NULL) AS matching, (SELECT count(*) FROM t WHERE is_current) AS current_rows, (SELECT count(DISTINCT email) FROM new_carriers) AS emails,
  (SELECT count(*) FROM new_carriers WHERE email IS NOT NULL) = (SELECT count(*) FROM t WHERE is_current) AND (SELECT count(*) FROM t WHERE is_current) = (SELECT count(DISTINCT email) FROM new_carriers) AS is_ready""")
def snapshot_counts_agree(spark, sf_dir):
    """Whether staged rows, current rows and their addresses are equally many."""
    new = view(spark, sf_dir, "new_carriers")
    made = merge.snapshot_currency(view(spark, sf_dir, "old_carriers"), new.select("k", "name"), "k")
    one = new.agg(F.count("email").alias("matching"), F.count_distinct("email").alias("emails")).crossJoin(made.agg(F.count_if("is_current").alias("current_rows")))  # one row each
    agree = (F.col("matching") == F.col("current_rows")) & (F.col("current_rows") == F.col("emails"))
    return one.select("matching", "current_rows", "emails", agree.alias("is_ready"))
