"""Duplicate entities of several sources merged until nothing merges any more.

An entity carries a set of sources; two may be one business only if their sets
are disjoint.  A merge unites sets, e-mails and phones, so it can make a block
small enough, or a name known, for a further merge: hence passes.  From the
second pass on only blocks that hold a winner of the pass before are looked at,
as all others give the pairs that they gave before, none of which is left.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import components
from .scratch import forget, written

#: Rules by which a child table's rows of one key become one: see merged_children.
Policy = dict[str, str]


def source_sets(places: DataFrame) -> DataFrame:
    return places.groupBy("entity_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def disjoint_pairs(rows: DataFrame, keys: list[str], low: int, high: int, reason: str, touched: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, reason): entities of a block of low to high with disjoint sets of sources.

    rows has the keys, entity_id and sources.  The blocks' sizes are counted
    first, so a block that many share gives no pair.  With touched, only blocks
    with one of these entities count.
    """
    rows = rows.select(*keys, "entity_id", "sources").distinct()
    blocks = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n").between(low, high)).select(*keys)
    if touched is not None:
        blocks = blocks.join(rows.join(touched, "entity_id", "left_semi").select(*keys).distinct(), keys, "left_semi")
    # a block has high members at most, so its pairs are made where it is gathered
    block = rows.join(blocks, keys).groupBy(*keys).agg(F.collect_list(F.struct("entity_id", "sources")).alias("m"))
    apart = lambda a, b: (b["entity_id"] > a["entity_id"]) & ~F.arrays_overlap(a["sources"], b["sources"])
    of = lambda a: F.transform(F.filter("m", lambda b: apart(a, b)), lambda b: F.struct(a["entity_id"].alias("left_id"), b["entity_id"].alias("right_id")))
    return block.select(F.inline(F.flatten(F.transform("m", of)))).withColumn("reason", F.lit(reason))


def entity_pairs(state: dict[str, DataFrame], touched: DataFrame | None = None) -> DataFrame:
    """(left_id, right_id, reasons) by phone, by e-mail with name and by name with postcode."""
    sets = source_sets(state["places"])
    identity = state["entities"].select("entity_id", X.name_key("name").alias("name_key"), X.zip5("postcode").alias("postcode_key")).join(sets, "entity_id", "left")
    named = identity.filter(F.length("name_key") >= 5)
    phones = state["phones"].select("entity_id", "normalized_phone").filter(F.length("normalized_phone") == 10).join(sets, "entity_id", "left")
    emails = state["emails"].filter("is_usable").select("entity_id", "normalized_email").join(named, "entity_id")
    arms = [
        disjoint_pairs(phones, ["normalized_phone"], 2, 5, "phone_exact", touched),
        disjoint_pairs(emails, ["normalized_email", "name_key"], 2, 5, "email+name_exact", touched),
        disjoint_pairs(named.filter(F.length("postcode_key") == 5), ["name_key", "postcode_key"], 2, 10, "name+postcode_exact", touched),
    ]
    every = arms[0].unionByName(arms[1]).unionByName(arms[2])
    return every.groupBy("left_id", "right_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def merge_map(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, winner_id) of the entities that the least of their component absorbs, if that one stands."""
    roots = components(pairs, "left_id", "right_id").filter("node <> root")
    lost = roots.select(F.col("node").alias("entity_id"), F.col("root").alias("winner_id"))
    return lost.join(entities.select(F.col("entity_id").alias("winner_id")), "winner_id", "left_semi").select("entity_id", "winner_id")


def merge_log(merged: DataFrame, pairs: DataFrame, sets: DataFrame, number: int) -> DataFrame:
    """A row per absorbed entity: the reasons of its own pairs, or that only others link it, and its sources."""
    ends = pairs.select(F.explode(F.array("left_id", "right_id")).alias("entity_id"), "reasons").select("entity_id", F.explode("reasons").alias("reason"))
    own = merged.join(ends, "entity_id", "left").groupBy("entity_id", "winner_id").agg(F.array_sort(F.collect_set("reason")).alias("r"))
    reasons = F.when(F.size("r") > 0, F.col("r")).otherwise(F.array(F.lit("transitive_component")))
    return own.join(sets, "entity_id").select(F.lit(number).alias("pass"), "winner_id", F.col("entity_id").alias("merged_id"), reasons.alias("reasons"), F.col("sources").alias("merged_sources"))


def repointed(child: DataFrame, merged: DataFrame) -> DataFrame:
    """The child's rows at their winner; __moved tells which were another's, __was whose."""
    rows = child.join(merged, "entity_id", "left")
    return rows.select(
        F.coalesce("winner_id", "entity_id").alias("entity_id"), *[c for c in child.columns if c != "entity_id"],
        F.col("winner_id").isNotNull().alias("__moved"), F.col("entity_id").alias("__was"),
    )


def _own(c: str) -> Column:
    """The value of a row that was there, else the least of those that came."""
    return F.coalesce(F.min(F.when(~F.col("__moved"), F.col(c))), F.min(F.when(F.col("__moved"), F.col(c))))


SETTLE = {
    "own": _own,
    "or": lambda c: F.bool_or(c),
    "greatest": lambda c: F.max(c),
    "least": lambda c: F.min(c),
    "union": lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))),
}


def merged_children(child: DataFrame, merged: DataFrame, keys: list[str], policy: Policy | None = None) -> DataFrame:
    """A child table after its entities merged, one row of each key.

    Without a policy a key keeps the row that its winner had, else that of the
    least loser.  With one, each column is settled by its rule: own (the
    winner's value, else the least of the losers'), or, greatest, least, union.
    """
    rows = repointed(child, merged)
    rest = [c for c in child.columns if c not in keys]
    if policy is None:
        picked = rows.groupBy(*keys).agg(F.min(F.struct("__moved", "__was", *rest)).alias("r"))
        return picked.select(*[c if c in keys else F.col(f"r.{c}").alias(c) for c in child.columns])
    return rows.groupBy(*keys).agg(*[SETTLE[policy[c]](c).alias(c) for c in rest]).select(*child.columns)


def merged_entities(entities: DataFrame, merged: DataFrame, places: DataFrame, policy: Policy) -> DataFrame:
    """Winners with their losers' attributes, losers gone; a winner's source_count is that of its places as they are now."""
    winners = merged.select(F.col("winner_id").alias("entity_id")).distinct()
    counts = places.join(winners, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("__n"))
    rest = [c for c in entities.columns if c not in ("entity_id", "source_count")]
    made = repointed(entities, merged).groupBy("entity_id").agg(*[SETTLE[policy[c]](c).alias(c) for c in rest], _own("source_count").alias("source_count"))
    return made.join(counts, "entity_id", "left").withColumn("source_count", F.coalesce("__n", "source_count")).select(*entities.columns)


@dataclass
class Merged:
    """The tables after the last pass, the log of all passes and how many entities each absorbed."""

    state: dict[str, DataFrame]
    log: DataFrame | None = None
    passes: list[tuple[int, int]] = field(default_factory=list)


#: How the attributes of an entity, and the rows of its e-mails and phones, become one.
ENTITY_POLICY = {
    "name": "own", "postcode": "own", "brand_name": "own", "is_known_brand": "or", "confidence": "greatest",
    "earliest_source_date": "least", "latest_source_refresh": "greatest", "is_qualified": "or",
}
CHILDREN: dict[str, tuple[list[str], Policy | None]] = {
    "emails": (["entity_id", "normalized_email"], {"display_email": "own", "email_domain": "own", "is_usable": "or", "is_role_account": "or", "sources": "union"}),
    "phones": (["entity_id", "normalized_phone"], {"raw_values": "union", "sources": "union"}),
    "socials": (["entity_id", "platform", "handle_or_url", "source"], None),
    "categories": (["entity_id", "source", "category_id"], None),
    "enrichment": (["entity_id"], None),
    "activity": (["entity_id", "source", "normalized_url"], None),
}
#: The tables that pairs are made of; they are written after each pass.
WRITTEN = ("entities", "places", "emails", "phones")


def to_fixed_point(state: dict[str, DataFrame], most: int = 3, logged: bool = True) -> Merged:
    """Passes of pairs, components and merges until one absorbs nothing, or most of them ran.

    state holds entities, places and any of CHILDREN.  Other children than
    those that pairs are made of stay lazy: a pass adds one join with its merge
    map and one grouping to their plan.  Without logged no log is made.
    """
    if most < 1:
        raise ValueError("at least one pass is needed")
    # each pass reads the tables of WRITTEN several times
    out = Merged(state | {name: written(state[name], name) for name in WRITTEN})
    touched = None
    for number in range(1, most + 1):
        now = out.state
        pairs = written(entity_pairs(now, touched), "pairs")
        merged = written(merge_map(pairs, now["entities"]), "merged")
        n = merged.count()  # each has places, or it would be in no pair
        out.passes.append((number, n))
        if logged:
            log = written(merge_log(merged, pairs, source_sets(now["places"]), number), "log")
            out.log = log if out.log is None else out.log.unionByName(log)
        forget(pairs)
        if not n:
            forget(merged)
            break
        places = repointed(now["places"], merged).select(*now["places"].columns)
        made = {"places": written(places, "places")}
        made["entities"] = written(merged_entities(now["entities"], merged, made["places"], ENTITY_POLICY), "entities")
        for name in now.keys() & CHILDREN.keys():
            table = merged_children(now[name], merged, *CHILDREN[name])
            made[name] = written(table, name) if name in WRITTEN else table
        forget(*[now[name] for name in WRITTEN])
        out.state = now | made
        touched = merged.select(F.col("winner_id").alias("entity_id")).distinct()
    return out


def checks(state: dict[str, DataFrame]) -> DataFrame:
    """One row: for each child table its rows without an entity and its repeated keys, and entities with a wrong number of places."""
    entities = state["entities"].select("entity_id")
    of = {"places": ["source", "place_id"]} | {name: keys for name, (keys, _) in CHILDREN.items() if name in state}
    counts = []
    for name, keys in of.items():
        t = state[name] if name in WRITTEN else written(state[name], name)
        counts.append(t.join(entities, "entity_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"{name}_orphans").alias("what"), "n"))
        counts.append(t.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit(f"{name}_repeated").alias("what"), "n"))
    placed = state["places"].groupBy("entity_id").agg(F.count("*").alias("places"))
    wrong = state["entities"].join(placed, "entity_id").filter("source_count <> places").agg(F.count("*").alias("n"))
    counts.append(wrong.select(F.lit("source_count_mismatches").alias("what"), "n"))
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    return every
