"""Work that grew faster than its input, or stood in one task: the cheaper forms give what the plain ones gave."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from prospectra.functions import markup, payloads
from prospectra.operators import dedup, match, scratch
from prospectra.plans import fixtures, requests
from prospectra.streaming import lifecycle


def test_all_matches_of_large_phones_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(match, "TILE", 3)
    rng = random.Random(4)
    phones, zips = ["555-000-0000", "(200) 111-2222", "12", None], ["12345", "123456789", "", None]

    def rows(src, n):
        ids = [f"{src}{i}" for i in range(n)] + [f"{src}0", f"{src}1", None, None]
        return [(i, src, p, f"Shop {rng.randint(0, 5)}", rng.choice(zips), rng.choice(phones), rng.choice([f"m{rng.randint(0, 4)}@x.example.org", "test@test.com", None])) for i, p in enumerate(ids)]

    schema = "entity_id long, source string, place_id string, name string, postcode string, phone string, email string"
    a, b = (spark.createDataFrame(rows(s, 24), schema) for s in "ba")
    made = match.source_matches(a, b)
    left, right = (match.keyed(x).collect() for x in (a, b))
    good = set(r["email_key"] for r in match.keyed(a).filter("email_key like 'm%'").collect())
    want = {}
    for x in left:
        for y in right:
            named = len(x["name_key"] or "") >= 4 and x["name_key"] == y["name_key"]
            zips_ = None if x["zip5"] is None or y["zip5"] is None else x["zip5"] == y["zip5"] != ""
            arms = [(True, False, True, zips_)] * (named and x["email_key"] in good and x["email_key"] == y["email_key"])
            arms += [(False, True, False, False)] * (x["phone_key"] is not None and x["phone_key"] == y["phone_key"])
            arms += [(False, False, True, True)] * (named and len(x["zip5"] or "") == 5 and bool(zips_))
            if arms:
                want.setdefault((x["place_id"], y["place_id"]), []).extend(arms)
    some = lambda vs: None if not (vs := [v for v in vs if v is not None]) else any(vs)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(((*k, *map(some, zip(*v))) for k, v in want.items()), key=repr)


def test_a_large_phone_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(match, "TILE", 50)
    a, b = (spark.range(400).select(F.lit("5550000000").alias(k), F.col("id").cast("string").alias(i)) for k, i in (("phone_key", "left_id"), ("r_phone_key", "right_id")))
    made = match.tiled(a, b, "phone_key", "r_phone_key", "left_id", "right_id")
    assert made.select("left_id", "right_id").distinct().count() == made.count() == 160_000
    most = made.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 60_000  # one task had all


@pytest.mark.parametrize("name", sorted(fixtures.WIDE))
def test_wide_views_are_made_by_all_cores(spark, small, name):
    """A small file is one row group, hence one task before."""
    assert fixtures.view(spark, small, name).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_lengths_of_frames_in_linear_time(spark):
    body = "[" + "é" * 5 + "😀" * 3 + "x" * 200_000 + "]"
    raw = f"{len(body) + 3 + 2}\r\n{body}\n7\n[1]\n[2]"
    df = spark.createDataFrame([(raw,)] * 20, "raw string").select(F.transform(payloads.frames(F.col("raw")), lambda f: F.struct(f["declared"], payloads.honest(f))).alias("f"))
    assert {tuple(map(tuple, r["f"])) for r in df.collect()} == {((len(body) + 5, True), (7, False), (None, False))}
    assert "regexp_replace(f" not in str(payloads.honest(F.col("f")))  # a match for every character


def test_walk_writes_few_tables(spark, monkeypatch):
    """Places below more levels than one table holds; a table was written for each level."""
    place = [None] * 179
    place[9], place[11], place[78] = [0, 0, 1, 2], "Shop", "ChIJx"
    text, made = json.dumps(place), []
    monkeypatch.setattr(payloads, "written", lambda df, name: made.append(name) or scratch.written(df, name))
    rows = spark.createDataFrame([(i, "[" * n + f"[],{text}" + "]" * n) for i, n in enumerate((1, 3, 9, 20))] + [(9, text), (10, "[]"), (11, "[null,[]]")], "id int, p string")
    got = payloads.places_in(rows.select("id", F.try_parse_json("p").alias("v")), "id", "v").select("id", F.size("path"), F.get("path", F.size("path") - 1)).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1), (1, 3, 1), (2, 9, 1), (3, 20, 1), (9, 0, None)]
    assert len(made) == 3


def test_strings_between_tags_equal_those_of_elements():
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<b class=\"a>b\">", "<br/>", "<", ">", " x ", "&amp;", "&nbsp;", "&lt;i&gt;", "<!-- c <b> -->", "<!--", "-->", "<!doctype x>", "<?x?>", "'", "\"", "a=b", "</", "<1>", "é", "<script>", "</script>", "<STYLE a>", "\n", "<i", "<svg/>"]
    for _ in range(20_000):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert markup.visible(x) == " ".join(s for y in markup.read(x).strings if (s := y.strip())), x


def test_contexts_build_no_elements(monkeypatch):
    monkeypatch.setattr(markup, "read", lambda x: pytest.fail("elements are built"))
    assert markup.visible("b>Fish &amp; <i>Chips</i> a <u") == "b>Fish & Chips a <u"


def test_requests_cross_the_join_without_their_texts(spark, small):
    """Only what is given on is moved; offerings' errors need no join at all."""
    plan = requests.judged(*(fixtures.view(spark, small, v) for v in ("raw_requests", "stored_photos")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "photo_brief" not in plan and "offerings" not in plan
    assert "Join" not in requests.offering_errors(spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_a_request_makes_few_calls_to_its_state():
    """One read and one write of a request, however many events it has; copies count once, ids before the watermark are forgotten."""
    calls = []

    class Value:
        kept = None

        def exists(self):
            return self.kept is not None

        def get(self):
            calls.append("get")
            return self.kept

        def update(self, value):
            calls.append("update")
            self.kept = value

    value = Value()
    handle = type("H", (), {"getValueState": lambda self, name, schema: value})()
    timers = type("T", (), {"getCurrentWatermarkInMs": lambda self: 50_000})()
    rows = lambda ids: pd.DataFrame([(7, i, pd.Timestamp(i, unit="s"), "ticket_opened", None, None, i, None) for i in ids], columns=[c.split()[0] for c in lifecycle.EVENT.split(", ")])
    p = lifecycle.Lifecycle()
    p.init(handle)
    (one,) = p.handleInputRows((7,), iter([rows(range(100)), rows(range(100))]), timers)
    (two,) = p.handleInputRows((7,), iter([rows(range(60, 110))]), timers)
    assert one.events[0] == 100 and two.events[0] == 110 and calls == ["update", "get", "update"]
    assert sorted(value.kept[-2]) == list(range(50, 110))


def test_pairs_of_blocks_need_no_self_join(spark):
    """The members of a counted block give its pairs; a join with themselves made its plan twice."""
    rows = spark.createDataFrame([("x", 1, ["a"]), ("x", 2, ["b"]), ("x", 3, ["a"]), ("y", 1, ["a"]), ("y", 2, None)] + [("z", i, [str(i)]) for i in range(6)], "k string, entity_id long, sources array<string>")
    made = dedup.disjoint_pairs(rows, ["k"], 2, 5, "r")
    assert sorted(map(tuple, made.collect())) == [(1, 2, "r"), (2, 3, "r")]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
