"""The fixed point and its child tables against SQL that runs three whole passes, in one run of the library."""

import pytest
from pyspark.sql import functions as F

from prospectra.operators import dedup
from prospectra.plans import dedup as plans

LISTS = {"places": [], "emails": ["sources"], "phones": ["raw_values", "sources"], "socials": [], "categories": [], "enrichment": [], "activity": []}


@pytest.fixture(scope="module")
def merged(spark, small):
    return dedup.to_fixed_point(plans.tables(spark, small))


@pytest.mark.parametrize("name", LISTS)
def test_children_follow(merged, duck, name):
    t = merged.state[name]
    for c in LISTS[name]:
        t = t.withColumn(c, F.array_join(c, ","))
    found = duck.execute(plans.REGISTRY.sql[f"repointed_{name}"])
    names = [c[0] for c in found.description]
    want = sorted((tuple(v for n, v in zip(names, r) if n in t.columns) for r in found.fetchall()), key=repr)
    assert sorted(map(tuple, t.select(*[n for n in names if n in t.columns]).collect()), key=repr) == want


def test_passes_and_log(merged, duck):
    assert merged.passes == duck.execute(plans.REGISTRY.sql["dedup_passes"]).fetchall()
    (_, one), (_, two), (_, three) = merged.passes
    assert one > two > three == 0
    log = merged.log.select("pass", "winner_id", "merged_id", F.array_join("reasons", ","), F.array_join("merged_sources", ",")).collect()
    assert sorted(map(tuple, log)) == sorted(duck.execute(plans.REGISTRY.sql["dedup_merge_log"]).fetchall())


def test_nothing_is_lost_or_repeated(merged):
    assert {r["n"] for r in dedup.checks(merged.state).collect()} == {0}


def rows(spark, entities, places):
    e = [(i, name, code, None, False, None, None, None, False, 1) for i, name, code in entities]
    return {
        "entities": spark.createDataFrame(e, "entity_id long, name string, postcode string, brand_name string, is_known_brand boolean, confidence double, earliest_source_date string, latest_source_refresh string, is_qualified boolean, source_count long"),
        "places": spark.createDataFrame(places, "source string, place_id string, entity_id long"),
        "emails": spark.createDataFrame([], "entity_id long, normalized_email string, display_email string, email_domain string, is_usable boolean, is_role_account boolean, sources array<string>"),
        "phones": spark.createDataFrame([(7, "2001112222", ["x"], ["d"]), (9, "2001112222", ["y"], ["e"])], "entity_id long, normalized_phone string, raw_values array<string>, sources array<string>"),
    }


def test_sets_of_sources_decide(spark):
    """1 and 2 share a name but also source a; 3 joins neither side of an overlap; 7 has no entity row; 8 and 9 merge."""
    state = rows(
        spark, [(1, "Long Name", "12345"), (2, "Long Name", "12345"), (3, "tiny", "12345"), (8, "Other Name", "54321-1"), (9, "other name!", "54321")],
        [("a", "p1", 1), ("b", "p2", 1), ("a", "p3", 2), ("c", "p4", 3), ("d", "p5", 8), ("e", "p6", 9)],
    )
    done = dedup.to_fixed_point(state)
    assert done.passes == [(1, 1), (2, 0)]
    assert [(r["winner_id"], r["merged_id"], r["reasons"]) for r in done.log.collect()] == [(8, 9, ["name+postcode_exact"])]
    assert sorted(r["entity_id"] for r in done.state["entities"].collect()) == [1, 2, 3, 8]
    assert {r["entity_id"] for r in done.state["phones"].collect()} == {7, 8}
    with pytest.raises(ValueError):
        dedup.to_fixed_point(state, 0)


def test_a_loser_stays_if_its_winner_is_gone(spark):
    pairs = spark.createDataFrame([(1, 2, ["r"]), (3, 4, ["r"])], "left_id long, right_id long, reasons array<string>")
    entities = spark.createDataFrame([(2,), (3,), (4,)], "entity_id long")
    assert [tuple(r) for r in dedup.merge_map(pairs, entities).collect()] == [(4, 3)]
