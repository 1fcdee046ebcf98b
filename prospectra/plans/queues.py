"""Work queues, breakers and request lifecycles over snapshots: every step takes the time it is asked for as an argument."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .fixtures import view
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

AS_OF = "1998-01-01 00:00:00"


def claimable(queue: DataFrame, most_attempts: int = 3) -> DataFrame:
    s = F.col("status")
    return queue.filter((s == "pending") | ((s == "failed") & (F.col("attempts") < most_attempts)))


@query("""SELECT id, place_id, attempts + 1 AS attempts, CAST(id % 8 AS INTEGER) AS worker FROM email_queue WHERE status = 'pending' OR (status = 'failed' AND attempts < 3)""")
def claim_assignment(spark, sf_dir):
    """Eligible rows dealt to workers by their id: no locks, no global order, each row has one owner."""
    q = claimable(view(spark, sf_dir, "email_queue"))
    return q.select("id", "place_id", (F.col("attempts") + 1).alias("attempts"), F.pmod("id", F.lit(8)).cast("int").alias("worker"))


def leased_claims(queue: DataFrame, as_of: str, lease_s: int, most_attempts: int) -> DataFrame:
    """Rows that are due, or whose lease has run out, with their next lease."""
    now = F.lit(as_of).cast("timestamp")
    due = F.col("status").isin("pending", "failed") & (F.col("next_at") <= now)
    expired = (F.col("status") == "in_progress") & (F.col("lease_until") < now)
    return queue.filter((due | expired) & (F.col("attempts") < most_attempts)).select(
        "id", expired.alias("reclaimed"), (F.col("attempts") + 1).alias("attempts"), (F.unix_timestamp(now) + lease_s).alias("lease_until_s")
    )


@query(f"""SELECT id, status = 'in_progress' AS reclaimed, attempts + 1 AS attempts, CAST(epoch(TIMESTAMP '{AS_OF}') AS BIGINT) + 900 AS lease_until_s FROM email_queue
WHERE attempts < 3 AND ((status IN ('pending', 'failed') AND created_at + INTERVAL 1 DAY <= TIMESTAMP '{AS_OF}') OR (status = 'in_progress' AND created_at + INTERVAL 2 DAY < TIMESTAMP '{AS_OF}'))""")
def lease_reclaim(spark, sf_dir):
    at = F.col("created_at").cast("timestamp")
    q = view(spark, sf_dir, "email_queue").withColumns({"next_at": at + F.expr("INTERVAL 1 DAY"), "lease_until": at + F.expr("INTERVAL 2 DAYS")})
    return leased_claims(q, AS_OF, 900, 3)


OUTCOMES = ["ok", "no_post_timestamp", "not_found", "login_required", "rate_limited", "document_too_large", "http_error"]


@query(f"""WITH o AS (SELECT id, attempts, list_value({", ".join(f"'{o}'" for o in OUTCOMES)})[id % 7 + 1] AS outcome FROM email_queue)
SELECT id, outcome, CASE WHEN outcome = 'ok' THEN 'succeeded' WHEN outcome = 'no_post_timestamp' THEN 'no_data' WHEN outcome = 'not_found' THEN 'unavailable' WHEN outcome = 'login_required' THEN 'restricted'
    WHEN outcome = 'rate_limited' THEN 'retry' WHEN outcome = 'document_too_large' OR attempts >= 3 THEN 'failed' ELSE 'retry' END AS state,
  CASE WHEN outcome = 'rate_limited' THEN 0 WHEN outcome = 'http_error' AND attempts < 3 THEN CAST(least(1440, 5 * pow(2, attempts)) AS BIGINT) END AS minutes FROM o""")
def retry_backoff(spark, sf_dir):
    q = view(spark, sf_dir, "email_queue")
    outcome = F.get(F.array(*map(F.lit, OUTCOMES)), F.pmod("id", F.lit(7)).cast("int"))
    made = q.select("id", outcome.alias("outcome"), "attempts").withColumn("r", X.retry_state(F.col("outcome"), F.col("attempts"), 3))
    return made.select("id", "outcome", "r.state", "r.minutes")


@query("""SELECT id, CASE WHEN status = 'in_progress' THEN 'pending' WHEN status = 'failed' AND attempts >= 3 THEN 'pending' ELSE status END AS status,
  CASE WHEN status = 'failed' AND attempts >= 3 THEN 0 ELSE attempts END AS attempts FROM email_queue""")
def resume_queue(spark, sf_dir):
    """After a stop: work in progress is pending again; what failed for good gets a new round."""
    s, final = F.col("status"), (F.col("status") == "failed") & (F.col("attempts") >= 3)
    return view(spark, sf_dir, "email_queue").select(
        "id", F.when((s == "in_progress") | final, "pending").otherwise(s).alias("status"), F.when(final, 0).otherwise(F.col("attempts")).alias("attempts")
    )


# ---- breakers: windows are per worker, so that no window spans the whole table

_EVENTS = "SELECT event_id, user_id % 64 AS worker, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id % 64 ORDER BY ts, event_id) AS n FROM events"


def worker_events(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.pmod("user_id", F.lit(64)).alias("worker"), "ts", (F.col("event_type") == "error").alias("bad"))


def throttled(events: DataFrame, rate: float, last: int = 100, least: int = 30) -> DataFrame:
    """Events at which the share of bad ones among a worker's last ones reaches rate."""
    w = W.partitionBy("worker").orderBy("ts", "event_id").rowsBetween(1 - last, 0)
    seen = events.withColumns({"n": F.count("*").over(w), "n_bad": F.count_if("bad").over(w)})
    return seen.filter((F.col("n") >= least) & (F.col("n_bad") >= rate * F.col("n"))).select("worker", "event_id", "n", "n_bad")


@query(f"""SELECT worker, event_id, m AS n, n_bad FROM (SELECT worker, event_id, count(*) OVER w AS m, count(*) FILTER (WHERE bad) OVER w AS n_bad FROM ({_EVENTS})
  WINDOW w AS (PARTITION BY worker ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)) WHERE m >= 30 AND n_bad >= 0.27 * m""")
def throttle_rolling_window(spark, sf_dir):
    return throttled(worker_events(spark, sf_dir), 0.27)


def runs(events: DataFrame, least: int) -> DataFrame:
    """Runs of least or more bad events in a row of one worker (gaps and islands)."""
    order = W.partitionBy("worker").orderBy("ts", "event_id")
    marked = events.withColumn("island", F.count_if(~F.col("bad")).over(order)).filter("bad")
    return marked.groupBy("worker", "island").agg(F.count("*").alias("run"), F.min("event_id").alias("first_id")).filter(F.col("run") >= least).drop("island")


@query(f"""SELECT worker, count(*) AS run, min(event_id) AS first_id FROM (SELECT *, count(*) FILTER (WHERE NOT bad) OVER (PARTITION BY worker ORDER BY ts, event_id) AS island FROM ({_EVENTS}))
WHERE bad GROUP BY worker, island HAVING count(*) >= 2""")
def consecutive_breaker(spark, sf_dir):
    return runs(worker_events(spark, sf_dir), 2)


@query(f"""SELECT worker, count(*) FILTER (WHERE bad) AS bad, CAST(least(300, 5 * pow(2, greatest(count(*) FILTER (WHERE bad) - 1, 0))) AS BIGINT) AS cooldown_s, count(*) FILTER (WHERE bad) >= 8 AS broken FROM ({_EVENTS}) GROUP BY 1""")
def exponential_cooldown(spark, sf_dir):
    n = F.count_if("bad")
    by = worker_events(spark, sf_dir).groupBy("worker").agg(n.alias("bad"))
    wait = F.least(F.lit(300.0), 5 * F.pow(F.lit(2.0), F.greatest(F.col("bad") - 1, F.lit(0)))).cast("long")
    return by.select("worker", "bad", wait.alias("cooldown_s"), (F.col("bad") >= 8).alias("broken"))


# ---- request lifecycles

STEP = """CASE WHEN kind = 'paid' THEN 'paid' WHEN state = 'paid' THEN 'paid' WHEN kind = 'payment_failed' THEN 'payment_failed' WHEN kind = 'demo_set' THEN 'demo_ready'
  WHEN kind = 'ticket_opened' AND state = 'demo_ready' THEN 'changes_requested' WHEN kind = 'ticket_completed' AND state = 'changes_requested' THEN 'demo_ready' ELSE state END"""


def lifecycle(events: DataFrame) -> DataFrame:
    """Each request's state after its events, each counted once, in the order of (time, id).

    A repeated event id is ignored; a step that its state does not allow changes
    nothing.  The fold runs over one request's events at a time.
    """
    once = events.groupBy("request_id", "event_id").agg(F.min("processed_at").alias("at"), F.min("kind").alias("kind"))
    steps = once.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", "kind"))).alias("steps"))

    def step(state, e):
        k = e["kind"]
        return (
            F.when((k == "paid") | (state == "paid"), "paid").when(k == "payment_failed", "payment_failed").when(k == "demo_set", "demo_ready")
            .when((k == "ticket_opened") & (state == "demo_ready"), "changes_requested").when((k == "ticket_completed") & (state == "changes_requested"), "demo_ready").otherwise(state)
        )

    last = F.element_at("steps", -1)
    return steps.select("request_id", F.aggregate("steps", F.lit("submitted"), step).alias("state"), F.size("steps").cast("long").alias("n_events"), last["at"].alias("last_at"))


@query(f"""WITH RECURSIVE o AS (SELECT request_id, kind, processed_at, row_number() OVER (PARTITION BY request_id ORDER BY processed_at, event_id) AS n FROM request_events),
f AS (SELECT request_id, CAST(0 AS BIGINT) AS n, 'submitted' AS state FROM o WHERE n = 1 UNION ALL SELECT f.request_id, o.n, {STEP} FROM f JOIN o ON o.request_id = f.request_id AND o.n = f.n + 1)
SELECT request_id, arg_max(state, n) AS state, max(n) AS n_events FROM f GROUP BY 1""")
def event_log_fold(spark, sf_dir):
    return lifecycle(view(spark, sf_dir, "request_events")).drop("last_at")


@query("""WITH last AS (SELECT request_id, max(processed_at) AS newest, arg_max(kind, struct_pack(a := processed_at, b := event_id)) AS kind FROM request_events GROUP BY 1),
now AS (SELECT max(processed_at) AS t FROM request_events)
SELECT request_id, kind, CAST(epoch(t - newest) AS BIGINT) AS quiet_s, CASE WHEN kind = 'ticket_opened' THEN 'changes' WHEN kind = 'payment_failed' THEN 'failed' ELSE 'stalled' END AS reason
FROM last, now WHERE kind <> 'paid' AND newest < t - INTERVAL 24 HOUR""")
def stuck_work_report(spark, sf_dir):
    """Requests whose newest event is over a day before the newest of all, with why."""
    e = view(spark, sf_dir, "request_events").withColumn("processed_at", F.col("processed_at").cast("timestamp"))
    last = e.groupBy("request_id").agg(F.max("processed_at").alias("at"), F.max_by("kind", F.struct("processed_at", "event_id")).alias("kind"))
    now = e.agg(F.max("processed_at").alias("t"))  # one row
    quiet = F.round((F.unix_micros("t") - F.unix_micros("at")) / 1e6).cast("long")
    why = F.when(F.col("kind") == "ticket_opened", "changes").when(F.col("kind") == "payment_failed", "failed").otherwise("stalled")
    late = last.crossJoin(now).filter((F.col("kind") != "paid") & (F.col("at") < F.col("t") - F.expr("INTERVAL 24 HOURS")))
    return late.select("request_id", "kind", quiet.alias("quiet_s"), why.alias("reason"))


@query("""SELECT request_id, '[' || string_agg('{"id":' || event_id || ',"kind":"' || kind || '"}', ',' ORDER BY event_id) || ']' AS items FROM request_events WHERE event_id % 5 = 0 GROUP BY 1""")
def tickets_json(spark, sf_dir):
    """One JSON list of each request's events, by id."""
    e = view(spark, sf_dir, "request_events").filter("event_id % 5 = 0")
    return e.groupBy("request_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), "kind")))).alias("items"))
