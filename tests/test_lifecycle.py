"""The stream in several triggers with a restart, the batch fold and the plain rules give one result."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from prospectra.plans import lifecycles
from prospectra.streaming import events as S
from prospectra.streaming import lifecycle as L

BEGIN = datetime(2024, 1, 1)
KINDS = ["approve", "set_domain", "begin_checkout", "set_demo", "set_status", "ticket_opened", "ticket_set", *L.PAYMENT_EVENTS, None, "odd"]
ARGS = [None, "", "shop.example.net", " SHOP.example.net ", "no domain", "https://x", "http://x", *L.STATUSES, "completed", "active", "unpaid", "canceled", "no_payment_required"]


def random_events(rng, n, requests=12):
    # steps that follow each other are likelier, so that requests go far
    likely = [("set_demo", "https://x"), ("approve", None), ("set_domain", "shop.example.net"), ("begin_checkout", None), ("checkout.session.completed", "paid"), ("ticket_opened", None), ("ticket_set", "completed")]
    out = []
    for i in range(n):
        kind, arg = rng.choice(likely) if rng.random() < 0.7 else (rng.choice(KINDS), rng.choice(ARGS))
        out.append((rng.randrange(requests), i, BEGIN + timedelta(minutes=5 * i), kind, arg, rng.choice([None, "https://y", "y"]), rng.choice([1, 2, 2, None]), rng.choice([True, False, None])))
    return out


def plain(rows):
    """REPORT by request of rows in order, each id once."""
    states, seen = {}, set()
    for request, event_id, *rest in sorted(rows, key=lambda r: (r[2], r[1])):
        if (request, event_id) not in seen:
            seen.add((request, event_id))
            L.moved(states.setdefault(request, L.start()), dict(zip(("happened_at", "kind", "arg", "url", "ticket_id", "flag"), rest)))
    return sorted((r, s["status"], s["payment"], s["hosting"], len(s["open"]), s["refused"], s["events"]) for r, s in states.items())


def test_fold_equals_the_rules(spark):
    rng = random.Random(3)
    rows = random_events(rng, 2500, requests=300)
    rows += rng.sample(rows, 200)
    got = sorted(map(tuple, L.folded(spark.createDataFrame(rows, L.EVENT)).collect()))
    assert got == plain(rows)
    assert len({r[1] for r in got}) > 6 and len({r[2] for r in got}) > 3 and len({r[3] for r in got}) > 2
    assert L.folded(spark.createDataFrame([], L.EVENT)).count() == 0


@pytest.fixture
def stream(spark, tmp_path):
    """Writes rows as one more file of a source and returns the newest reports of all files so far."""
    src, out, progress = (f"{tmp_path}/{x}" for x in ("src", "out", "progress"))

    def more(rows):
        spark.createDataFrame(rows, L.EVENT).coalesce(1).write.mode("append").parquet(src)
        with S.rocksdb(spark):
            # a new query each time: it goes on from the state that the last one left
            S.run_to_table(L.streamed(spark.readStream.schema(L.EVENT).parquet(src)), out, progress)
        return sorted(map(tuple, L.newest(spark.read.parquet(out)).collect()))

    return more


def test_stream_equals_fold_over_restarts(spark, stream):
    rng = random.Random(5)
    rows = random_events(rng, 240)
    for at in range(0, 240, 80):
        part = rows[at : at + 80]
        copies = rng.sample(rows[max(0, at - 5) : at + 80], 20)  # of this part and of the last minutes of the part before
        got = stream(part + copies)
        assert got == plain(rows[: at + 80])
    assert got == sorted(map(tuple, L.folded(spark.createDataFrame(rows, L.EVENT)).collect()))


def test_late_events_change_nothing(stream):
    at = lambda m, i, kind, arg=None: (1, i, BEGIN + timedelta(minutes=m), kind, arg, None, None, None)
    stream([at(0, 1, "set_demo", "https://x"), at(300, 2, "odd")])
    stream([at(301, 3, "odd")])  # the watermark is now at 240 minutes
    (got,) = stream([at(100, 4, "approve"), at(250, 5, "approve"), at(302, 3, "odd")])
    assert got == (1, "domain_pending", "not_ready", "not_selected", 0, 2, 4)


def test_closed_windows(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/events.parquet")
    edges = rows.approxQuantile("event_id", [0.3, 0.6], 0.0)
    for part in (F.col("event_id") < edges[0], F.col("event_id").between(edges[0], edges[1] - 1), F.col("event_id") >= edges[1]):  # ids follow the time
        rows.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    out = lifecycles.to_the_end(spark, S.outcomes(S.read(spark, f"{tmp_path}/events")), "outcomes-test")
    end = rows.agg(F.max("ts")).first()[0] - timedelta(hours=1)
    want = rows.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n")).filter(F.col("w.end") <= F.lit(end).cast("timestamp"))
    assert sorted((r["start"], r["n"]) for r in out.collect()) == sorted((r["w"]["start"], r["n"]) for r in want.collect())
