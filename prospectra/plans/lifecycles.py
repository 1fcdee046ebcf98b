"""Requests and outcomes over event logs, in batch and as streams that are run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import adopt, shared_dir
from ..streaming import events as S
from ..streaming import lifecycle
from .fixtures import VIEWS
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

_ARGS = """CASE kind WHEN 'set_domain' THEN CASE event_id % 5 WHEN 0 THEN 'not a domain' WHEN 1 THEN '  Shop.Example.NET ' ELSE 'a-b.example.org' END
    WHEN 'set_demo' THEN CASE event_id % 4 WHEN 0 THEN 'http://plain.example.net' ELSE ' https://demo.example.net' END
    WHEN 'set_status' THEN CASE event_id % 7 WHEN 0 THEN 'paid' WHEN 1 THEN 'live' WHEN 2 THEN 'launching' WHEN 3 THEN 'cancelled' WHEN 4 THEN NULL WHEN 5 THEN 'in_progress' ELSE 'in_review' END
    WHEN 'ticket_set' THEN CASE event_id % 3 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'completed' ELSE 'completed' END
    WHEN 'checkout.session.completed' THEN CASE event_id % 3 WHEN 0 THEN 'unpaid' ELSE 'paid' END
    WHEN 'customer.subscription.updated' THEN CASE event_id % 4 WHEN 0 THEN 'trialing' WHEN 1 THEN 'unpaid' WHEN 2 THEN 'canceled' ELSE 'odd' END END"""
_KINDS = [
    "set_demo", "ticket_opened", "ticket_set", "approve", "set_domain", "begin_checkout", "checkout.session.async_payment_failed", "approve", "set_domain", "ticket_set",
    "begin_checkout", "checkout.session.completed", "set_status", "invoice.payment_failed", "customer.subscription.updated", "invoice.paid", "set_domain", "approve", "unknown", "customer.subscription.deleted",
    "set_domain", "ticket_set", "approve",
]
VIEWS["site_events"] = f"""
SELECT request_id, event_id, happened_at, kind, {_ARGS} AS arg, CASE WHEN event_id % 2 = 0 THEN 'https://live.example.net' END AS url, event_id % 2 AS ticket_id, event_id % 3 <> 0 AS flag
FROM (SELECT user_id * 2 + event_id % 2 AS request_id, event_id, ts AS happened_at, CASE CAST(floor(event_id / 8) AS BIGINT) % {len(_KINDS)} {" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS))} END AS kind, 1 AS n FROM {{events}}
      UNION ALL SELECT user_id * 2 + event_id % 2, event_id, ts, CASE CAST(floor(event_id / 8) AS BIGINT) % {len(_KINDS)} {" ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS))} END, 2 FROM {{events}} WHERE event_id % 10 = 3) t"""


def _list(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_L = lifecycle
MOVE = f"""SELECT f.*, e.kind, e.arg, e.url, e.ticket_id, coalesce(e.flag, FALSE) AS flag,
    e.kind = 'approve' AND len(f.open) = 0 AND f.status IN {_list(_L.APPROVABLE)} AS approve,
    e.kind = 'set_domain' AND length(trim(e.arg)) <= 253 AND regexp_full_match(lower(trim(e.arg)), '{_L.DOMAIN_RE}') AND f.approved AND f.status IN {_list(_L.DOMAIN_OPEN)} AS dom,
    e.kind = 'begin_checkout' AND f.approved AND f.domain AND f.status = 'payment_pending' AND f.payment IN {_list(_L.CHECKOUT_OPEN)} AS checkout,
    e.kind = 'set_demo' AND trim(e.arg) LIKE 'https://%' AND length(trim(e.arg)) <= 2048 AND f.status NOT IN {_list(_L.DEMO_OVER)} AS demo,
    e.kind = 'set_status' AND coalesce(e.arg IN {_list(_L.BY_HAND)} AND (e.arg <> 'live' OR coalesce(e.url LIKE 'https://%', FALSE)), FALSE) AS hand,
    e.kind = 'ticket_opened' AND NOT list_contains(f.known, e.ticket_id) AS opened, e.kind = 'ticket_set' AND e.arg IN ('in_progress', 'completed') AND list_contains(f.known, e.ticket_id) AS worked,
    e.kind IN {_list(_L.PAID_EVENTS)} AND e.arg IN {_list(_L.PAID)} AS paid, list_filter(f.open, lambda t: t <> e.ticket_id) AS others"""
FOLD = f"""WITH RECURSIVE log AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY happened_at, event_id) AS n FROM (SELECT DISTINCT * FROM site_events)),
f AS (
  SELECT request_id, CAST(0 AS BIGINT) AS n, 'submitted' AS status, 'not_ready' AS payment, 'not_selected' AS hosting, FALSE AS wants, FALSE AS approved, FALSE AS domain, CAST([] AS BIGINT[]) AS open, CAST([] AS BIGINT[]) AS known, CAST(0 AS BIGINT) AS refused
  FROM log WHERE n = 1
  UNION ALL
  SELECT request_id, n + 1,
    CASE WHEN approve THEN 'domain_pending' WHEN dom THEN 'payment_pending' WHEN demo OR (worked AND arg = 'completed' AND len(others) = 0 AND status = 'changes_requested') THEN 'demo_ready' WHEN hand THEN arg
         WHEN opened AND status = 'demo_ready' THEN 'changes_requested' WHEN paid THEN 'paid' ELSE status END,
    CASE WHEN approve THEN 'not_ready' WHEN dom THEN 'ready' WHEN checkout THEN 'pending' WHEN paid THEN 'paid' WHEN kind = 'checkout.session.async_payment_failed' AND payment <> 'paid' THEN 'failed' ELSE payment END,
    CASE WHEN dom THEN CASE WHEN flag THEN 'pending' ELSE 'not_selected' END WHEN NOT wants THEN hosting
         WHEN paid OR kind = 'invoice.paid' OR (kind = 'customer.subscription.updated' AND arg IN {_list(_L.RUNNING)}) THEN 'active'
         WHEN kind = 'invoice.payment_failed' OR (kind = 'customer.subscription.updated' AND arg IN {_list(_L.OVERDUE)}) THEN 'past_due'
         WHEN kind = 'customer.subscription.deleted' OR (kind = 'customer.subscription.updated' AND arg IN {_list(_L.ENDED)}) THEN 'cancelled' ELSE hosting END,
    CASE WHEN dom THEN flag ELSE wants END, approved OR approve, domain OR coalesce(dom, FALSE),
    CASE WHEN opened OR (worked AND arg = 'in_progress') THEN list_append(others, ticket_id) WHEN worked THEN others ELSE open END, CASE WHEN opened THEN list_append(known, ticket_id) ELSE known END,
    refused + CASE WHEN approve OR dom OR checkout OR demo OR hand OR opened OR worked OR kind IN {_list(_L.PAYMENT_EVENTS)} THEN 0 ELSE 1 END
  FROM ({MOVE} FROM f JOIN log e ON e.request_id = f.request_id AND e.n = f.n + 1))
SELECT request_id, arg_max(status, n) AS status, arg_max(payment, n) AS payment, arg_max(hosting, n) AS hosting, CAST(len(arg_max(open, n)) AS INTEGER) AS open_tickets, arg_max(refused, n) AS refused, max(n) AS events
FROM f GROUP BY 1"""


def site_events(events: DataFrame) -> DataFrame:
    """Events of requests, some of them twice, made of the rows of events; the same for a stream and a table."""
    doubled = events.withColumn("n", F.explode(F.when(F.col("event_id") % 10 == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.floor(F.col("event_id") / 8) % len(_KINDS)).cast("int"))
    made = doubled.select((F.col("user_id") * 2 + F.col("event_id") % 2).alias("request_id"), "event_id", F.col("ts").cast("timestamp").alias("happened_at"), kind.alias("kind"))
    return made.select(
        "*", F.expr(_ARGS).alias("arg"), F.when(F.col("event_id") % 2 == 0, "https://live.example.net").alias("url"), (F.col("event_id") % 2).alias("ticket_id"), (F.col("event_id") % 3 != 0).alias("flag")
    )


@query(FOLD)
def request_lifecycles(spark, sf_dir):
    """The state of every request after its whole log."""
    return lifecycle.folded(site_events(spark.read.parquet(f"{sf_dir}/events.parquet")))


def to_the_end(spark: SparkSession, made: DataFrame, name: str) -> DataFrame:
    """All that a stream gives for the files there now, as a table in the shared folder."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    adopt(at, f"{at}-progress")
    S.run_to_table(made, at, f"{at}-progress")
    return spark.read.schema(made.schema).parquet(at)


@query(FOLD)
def request_lifecycle_stream(spark, sf_dir):
    """The same by a keyed stateful stream."""
    with S.rocksdb(spark):
        rows = to_the_end(spark, lifecycle.streamed(site_events(S.read(spark, f"{sf_dir}/events.parquet"))), "requests")
    return lifecycle.newest(rows)


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS hits FROM events
GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def hourly_outcome_stream(spark, sf_dir):
    """Hourly counts of the windows that the watermark has closed."""
    rows = to_the_end(spark, S.outcomes(S.read(spark, f"{sf_dir}/events.parquet")), "outcomes")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH m AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, TRUE) AS new FROM events),
s AS (SELECT user_id, ts, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def session_stream(spark, sf_dir):
    """Sessions of each user that the watermark has closed."""
    rows = to_the_end(spark, S.sessions(S.read(spark, f"{sf_dir}/events.parquet")), "sessions")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})
