"""Requests for a website from submission to launch: a state for each, moved by events that may repeat or be refused.

The same rules run in two forms.  Over a whole log, events of a request are
sorted and folded by built-in functions.  Over a stream, a keyed state holds
the request and the ids of its events that the watermark has not passed; Spark
drops an event before the watermark.  As long as events come in their order,
both give the same states.

An event that its state does not allow is refused: it changes nothing but the
count of refusals.  Null kinds and arguments are refused; an event without an
id can't be told from a copy and is counted each time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The states of a request, those that guards name, and what payment events are called.
STATUSES = [
    "submitted", "in_review", "in_progress", "demo_ready", "changes_requested", "approved", "domain_pending", "payment_pending", "paid", "launching", "live", "cancelled",
]
BY_HAND = ["in_review", "in_progress", "launching", "live", "cancelled"]
APPROVABLE = ["demo_ready", "changes_requested"]
DOMAIN_OPEN = ["approved", "domain_pending", "payment_pending"]
DEMO_OVER = ["paid", "launching", "live", "cancelled"]
CHECKOUT_OPEN = ["ready", "pending", "failed"]
PAID_EVENTS = ["checkout.session.completed", "checkout.session.async_payment_succeeded"]
PAID = ["paid", "no_payment_required"]
RUNNING, OVERDUE, ENDED = ["active", "trialing"], ["past_due", "unpaid"], ["canceled", "incomplete_expired"]
PAYMENT_EVENTS = [*PAID_EVENTS, "checkout.session.async_payment_failed", "invoice.paid", "invoice.payment_failed", "customer.subscription.deleted", "customer.subscription.updated"]
DOMAIN_RE = r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$"

#: Events: kind says which; arg is the domain, address, status or payment state; flag whether hosting is wanted.
EVENT = "request_id long, event_id long, happened_at timestamp, kind string, arg string, url string, ticket_id long, flag boolean"
STATE = "status string, payment string, hosting string, hosting_selected boolean, approved boolean, domain boolean, open array<bigint>, known array<bigint>, refused bigint, events bigint"
REPORT = "request_id long, status string, payment string, hosting string, open_tickets int, refused long, events long"


def _in(x: Column, values: list[str]) -> Column:
    return F.coalesce(x.isin(values), F.lit(False))


def _is(x: Column, value: str) -> Column:
    return x.eqNullSafe(F.lit(value))


def step(s: Column, e: Column) -> Column:
    """The state after one event, as an expression."""
    kind, arg, status = e["kind"], e["arg"], s["status"]
    secure = lambda u: F.coalesce(F.trim(u).startswith("https://"), F.lit(False))
    name = F.lower(F.trim(arg))
    known = F.coalesce(F.array_contains(s["known"], e["ticket_id"]), F.lit(False))
    no_open = F.size(s["open"]) == 0

    approve = _is(kind, "approve") & no_open & _in(status, APPROVABLE)
    domain = _is(kind, "set_domain") & F.coalesce((F.length(name) <= 253) & name.rlike(DOMAIN_RE), F.lit(False)) & s["approved"] & _in(status, DOMAIN_OPEN)
    checkout = _is(kind, "begin_checkout") & s["approved"] & s["domain"] & _is(status, "payment_pending") & _in(s["payment"], CHECKOUT_OPEN)
    demo = _is(kind, "set_demo") & secure(arg) & F.coalesce(F.length(F.trim(arg)) <= 2048, F.lit(False)) & ~_in(status, DEMO_OVER)
    by_hand = _is(kind, "set_status") & _in(arg, BY_HAND) & (~_is(arg, "live") | secure(e["url"]))
    opened = _is(kind, "ticket_opened") & e["ticket_id"].isNotNull() & ~known
    worked = _is(kind, "ticket_set") & _in(arg, ["in_progress", "completed"]) & known
    paid = _in(kind, PAID_EVENTS) & _in(arg, PAID)
    ok = approve | domain | checkout | demo | by_hand | opened | worked | _in(kind, PAYMENT_EVENTS)

    one = F.array(e["ticket_id"])
    open_ = (
        F.when(opened | (worked & _is(arg, "in_progress")), F.array_union(s["open"], one))
        .when(worked & _is(arg, "completed"), F.array_except(s["open"], one)).otherwise(s["open"])
    )
    all_done = worked & _is(arg, "completed") & (F.size(F.array_except(s["open"], one)) == 0) & _is(status, "changes_requested")
    new_status = (
        F.when(approve, "domain_pending").when(domain, "payment_pending").when(demo | all_done, "demo_ready").when(by_hand, arg)
        .when(opened & _is(status, "demo_ready"), "changes_requested").when(paid, "paid").otherwise(status)
    )
    payment = (
        F.when(approve, "not_ready").when(domain, "ready").when(checkout, "pending").when(paid, "paid")
        .when(_is(kind, "checkout.session.async_payment_failed") & ~_is(s["payment"], "paid"), "failed").otherwise(s["payment"])
    )
    wants, updated = s["hosting_selected"], _is(kind, "customer.subscription.updated")
    hosting = (
        F.when(domain, F.when(F.coalesce(e["flag"], F.lit(False)), "pending").otherwise("not_selected"))
        .when(wants & (paid | _is(kind, "invoice.paid") | (updated & _in(arg, RUNNING))), "active")
        .when(wants & (_is(kind, "invoice.payment_failed") | (updated & _in(arg, OVERDUE))), "past_due")
        .when(wants & (_is(kind, "customer.subscription.deleted") | (updated & _in(arg, ENDED))), "cancelled").otherwise(s["hosting"])
    )
    made = {
        "status": new_status, "payment": payment, "hosting": hosting,
        "hosting_selected": F.when(domain, F.coalesce(e["flag"], F.lit(False))).otherwise(s["hosting_selected"]), "approved": s["approved"] | approve, "domain": s["domain"] | domain,
        "open": open_, "known": F.when(opened, F.array_union(s["known"], one)).otherwise(s["known"]),
        "refused": s["refused"] + F.when(ok, 0).otherwise(1), "events": s["events"] + 1,
    }
    return F.struct(*[c.alias(n) for n, c in made.items()]).cast(f"struct<{STATE.replace(' ', ':').replace(',:', ',')}>")


def start(status: str = "submitted") -> dict:
    """A request before its first event; one that starts beyond its approval counts as approved."""
    return {
        "status": status, "payment": "not_ready", "hosting": "not_selected", "hosting_selected": False, "approved": status in DOMAIN_OPEN, "domain": False,
        "open": [], "known": [], "refused": 0, "events": 0,
    }


def folded(events: DataFrame) -> DataFrame:
    """REPORT of every request in a whole log: copies of an event count once, the rest in the order of (happened_at, event_id)."""
    rows = events.filter("request_id is not null").select(*[c.split()[0] for c in EVENT.split(", ")])
    rest = [c for c in rows.columns if c not in ("request_id", "event_id")]
    # copies of an event agree; the least is taken if they do not
    keyed = rows.withColumn("copy", F.when(F.col("event_id").isNull(), F.uuid()))
    once = keyed.groupBy("request_id", "event_id", "copy").agg(F.min(F.struct("happened_at", *[c for c in rest if c != "happened_at"])).alias("r")).select("request_id", "event_id", "r.*")
    one = F.struct("happened_at", "event_id", *[c for c in rest if c != "happened_at"])
    steps = once.groupBy("request_id").agg(F.array_sort(F.collect_list(one)).alias("steps"))
    kind = f"struct<{STATE.replace(' ', ':').replace(',:', ',')}>"
    begin = F.from_json(F.lit('{"status":"submitted","payment":"not_ready","hosting":"not_selected","hosting_selected":false,"approved":false,"domain":false,"open":[],"known":[],"refused":0,"events":0}'), kind)
    end = steps.select("request_id", F.aggregate("steps", begin, step).alias("s"))
    return end.select(
        "request_id", "s.status", "s.payment", "s.hosting", F.size("s.open").alias("open_tickets"), "s.refused", "s.events"
    )


def moved(s: dict, e: dict) -> None:
    """The state s after one event, by the same rules as step."""
    kind, arg, ticket = e["kind"], e["arg"], e["ticket_id"]
    status, known, ok = s["status"], ticket is not None and ticket in s["known"], True
    trimmed = arg.strip(" ") if arg is not None else ""
    if kind == "approve" and not s["open"] and status in APPROVABLE:
        s |= {"status": "domain_pending", "approved": True, "payment": "not_ready"}
    elif kind == "set_domain" and len(trimmed) <= 253 and re.search(DOMAIN_RE, trimmed.lower()) and not trimmed.endswith("\n") and s["approved"] and status in DOMAIN_OPEN:
        s |= {"status": "payment_pending", "domain": True, "payment": "ready", "hosting_selected": bool(e["flag"]), "hosting": "pending" if e["flag"] else "not_selected"}
    elif kind == "begin_checkout" and s["approved"] and s["domain"] and status == "payment_pending" and s["payment"] in CHECKOUT_OPEN:
        s["payment"] = "pending"
    elif kind == "set_demo" and trimmed.startswith("https://") and len(trimmed) <= 2048 and status not in DEMO_OVER:
        s["status"] = "demo_ready"
    elif kind == "set_status" and arg in BY_HAND and (arg != "live" or (e["url"] or "").strip(" ").startswith("https://")):
        s["status"] = arg
    elif kind == "ticket_opened" and ticket is not None and not known:
        s["open"].append(ticket)
        s["known"].append(ticket)
        s["status"] = "changes_requested" if status == "demo_ready" else status
    elif kind == "ticket_set" and arg in ("in_progress", "completed") and known:
        s["open"] = [t for t in s["open"] if t != ticket] + [ticket] * (arg == "in_progress")
        if arg == "completed" and not s["open"] and status == "changes_requested":
            s["status"] = "demo_ready"
    elif kind in PAYMENT_EVENTS:
        paid = kind in PAID_EVENTS and arg in PAID
        if paid:
            s |= {"status": "paid", "payment": "paid"}
        elif kind == "checkout.session.async_payment_failed" and s["payment"] != "paid":
            s["payment"] = "failed"
        changed = kind == "customer.subscription.updated"
        if s["hosting_selected"]:
            if paid or kind == "invoice.paid" or changed and arg in RUNNING:
                s["hosting"] = "active"
            elif kind == "invoice.payment_failed" or changed and arg in OVERDUE:
                s["hosting"] = "past_due"
            elif kind == "customer.subscription.deleted" or changed and arg in ENDED:
                s["hosting"] = "cancelled"
    else:
        ok = False
    s["refused"] += not ok
    s["events"] += 1


class Lifecycle(StatefulProcessor):
    """The state of one request at a time.  Ids of events that the watermark has passed are forgotten, as their copies are late.

    A request and its ids are one value: each read or write of a state is a
    call to the executor's JVM, so a call for every event would cost more than
    its step.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.request = handle.getValueState("request", f"{STATE}, ids array<bigint>, times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        was = self.request.get() if self.request.exists() else None
        s = dict(zip(start(), was)) if was is not None else start()
        s["open"], s["known"] = list(s["open"]), list(s["known"])
        seen = dict(zip(*was[-2:])) if was is not None else {}
        edge = timers.getCurrentWatermarkInMs()
        events = [{c: None if pd.isna(v) else v for c, v in e.items()} for part in rows for e in part.to_dict("records")]
        for e in events:  # pandas makes numbers with gaps floats
            e |= {c: None if e[c] is None else int(e[c]) for c in ("event_id", "ticket_id")}
        events.sort(key=lambda e: (e["happened_at"], e["event_id"] is not None, e["event_id"] or 0))
        for e in events:
            if e["event_id"] is None:
                moved(s, e)
            elif e["event_id"] not in seen:
                seen[e["event_id"]] = int(e["happened_at"].timestamp() * 1000)
                moved(s, e)
        kept = {i: ms for i, ms in seen.items() if ms >= edge}
        self.request.update((*s.values(), list(kept), list(kept.values())))
        made = {"request_id": [key[0]], **{c: [s[c]] for c in ("status", "payment", "hosting")}, "open_tickets": [len(s["open"])], **{c: [s[c]] for c in ("refused", "events")}}
        yield pd.DataFrame(made).astype({"open_tickets": "int32"})

    def close(self) -> None:
        pass


def streamed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """REPORT of each request that a trigger has events of; the newest row has the most events.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    watched = events.filter("request_id is not null and happened_at is not null").withWatermark("happened_at", late)
    return watched.groupBy("request_id").transformWithStateInPandas(Lifecycle(), REPORT, "Append", "EventTime")


def newest(reports: DataFrame) -> DataFrame:
    """The last report of each request."""
    rest = [c for c in reports.columns if c != "request_id"]
    return reports.groupBy("request_id").agg(F.max_by(F.struct(*rest), "events").alias("r")).select("request_id", "r.*")
