"""The reference's rules by literal values: names, ownership, results, long shared phones."""

import pytest
from pyspark.sql import functions as F

from prospectra.functions import ownership as O
from prospectra.functions import text as X
from prospectra.operators import match, similarity


def one(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize("a,b,low,high", [
    ("Austin", "Austin Plumbing Heating Cooling Supply", 0.30, 0.45), ("Joe's Pizza LLC", "joes pizza, inc.", 0.9, 1.0), ("Acme", "Acme", 1, 1), ("", "Acme", 0, 0),
    ("Red Oak", "The Red Oak Tavern", 0.96, 1.0), ("Pizza Pizza Hut", "Pizza Hut", 0.9, 1.0),
])
def test_name_similarity(spark, a, b, low, high):
    n = lambda x: similarity.business_name(similarity.fold(F.col(x)))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    got = df.select(similarity.name_similarity(n("a"), n("b"))).first()[0]
    assert low <= got <= high, got


@pytest.mark.parametrize("raw,want", [("Joe dba Pizza Hut", "joe pizza hut"), ("Joe d/b/a Pizza & Co", "joe pizza and co"), ("D B A Tools", "d b a tools"), ("Straße Café", "stra e cafe"), (None, "")])
def test_fold(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(similarity.fold(F.col("x"))).first()[0] == want


def test_meaningful_needs_a_shared_word(spark):
    got = lambda a, b: one(spark, similarity.meaningful(F.lit(a), F.lit(b)))
    assert not got("art", "smart phones repair here") and got("blue art", "art house") and not got("the shop", "the shop")


@pytest.mark.parametrize("name,category,result,want", [
    ("Zenith Roofing", "Roofer", "best of zenith roofing in town", True), ("Taco Truck", "Food truck", "we sell food", False), ("Silver Pine Roofing", "", "silver lakes and pine hills", True), ("Valet", "Cleaner", "call 512 555 0100 now", True),
])
def test_results(spark, name, category, result, want):
    assert one(spark, O.result_relevant(F.lit(result), F.lit(name), F.lit("512-555-0100"), F.lit(category))) is want


def test_bad_escapes_and_nulls_never_fail(spark):
    rows = spark.createDataFrame([("https://www.google.com/url?q=100%zz",), (None,), ("",), ("%",)], "x string")
    assert rows.select(X.website_class("x"), X.us_address("x"), X.phone_display("x"), X.clean_email("x"), X.profile_url("x"), X.url_host("x")).count() == 4
    c = F.col("x")
    assert rows.select(O.owned_by(c, c, c, c, c, c, c, c, F.lit(True), F.lit(True)).alias("o")).filter("o IS NULL").count() == 0


def test_a_phone_that_all_share_makes_no_pairs(spark):
    side = lambda name, n: spark.range(n).select(F.col("id").alias("entity_id"), F.lit(name).alias("source"), F.concat(F.lit(name), "id").alias("place_id"), F.concat(F.lit("Shop "), "id").alias("name"), F.lit("11111").alias("postcode"), F.lit("5550000000").alias("phone"), F.lit(None).cast("string").alias("email"))
    best = match.best_match(match.source_matches(side("b", 100_000), side("a", 100_000), best_only=True))
    assert best.count() == 100_000
    assert best.filter("match_method <> 'phone+name_postcode'").isEmpty()
