"""Name similarity and scores of candidate matches; the sequence ratio runs in Arrow batches."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V


def fold(c) -> Column:
    """Lower case, combining marks dropped, & spelt out, d/b/a and dba dropped, all but a-z and digits one space."""

    @F.pandas_udf("string")
    def plain(x: pd.Series) -> pd.Series:
        bare = lambda s: s if s.isascii() else "".join(k for k in unicodedata.normalize("NFKD", s) if not unicodedata.combining(k))
        return x.map(lambda s: None if s is None else bare(s))

    x = F.replace(F.lower(F.coalesce(plain(c), F.lit(""))), F.lit("&"), F.lit(" and "))
    x = F.regexp_replace(x, r"(?<![\p{L}\p{N}_])(?:d/b/a|dba)(?![\p{L}\p{N}_])", " ")
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def business_name(folded: Column) -> Column:
    """A folded name without its legal endings."""
    return F.trim(F.regexp_replace(folded, r"(?:(?:^|\s)(?:" + "|".join(V.LEGAL_SUFFIXES) + r")(?=\s|$))+$", ""))


def sequence_ratios(left: Column, right: Column) -> Column:
    """The larger of the ratios of the two names and of their sorted words, in this order of arguments."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        words = lambda s: " ".join(sorted(s.split()))
        seq = lambda x, y: SequenceMatcher(None, x, y).ratio()
        return pd.Series([max(seq(x, y), seq(words(x), words(y))) for x, y in zip(a, b)])

    return ratio(left, right)


def name_similarity(left: Column, right: Column) -> Column:
    """0 to 1 of two business names; 0 if either is blank."""
    a, b = F.split(left, " "), F.split(right, " ")
    common, n, m = F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    jaccard = common / (n + m - common)
    contained = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    contained = F.when((common == n) | (common == m), F.greatest(contained, F.lit(0.9))).otherwise(contained)
    first = F.size(a) <= F.size(b)
    shorter, longer = F.when(first, left).otherwise(right), F.when(first, right).otherwise(left)
    phrase = F.when((F.least(F.size(a), F.size(b)) >= 2) & F.contains(longer, shorter), 0.96).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(sequence_ratios(left, right), phrase, 0.72 * jaccard + 0.28 * contained))
    return F.when((left == "") | (right == ""), 0.0).when(left == right, 1.0).otherwise(score)


def meaningful(left: Column, right: Column) -> Column:
    """Whether the names share a telling word."""
    telling = lambda x: F.filter(F.split(x, " "), lambda t: (F.length(t) >= 3) & ~t.isin(V.GENERIC_NAME_TOKENS))
    return F.coalesce(F.arrays_overlap(telling(left), telling(right)), F.lit(False))


def postcode_root(c) -> Column:
    """Letters and digits in upper case; the first five if they are digits."""
    x = F.upper(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[^A-Za-z0-9]", ""))
    return F.when(x.rlike("^[0-9]{5}"), F.substring(x, 1, 5)).otherwise(x)


def score_candidates(pairs: DataFrame) -> DataFrame:
    """pairs with score and meaningful.

    Columns: entity_id, name, postcode, city, region, latitude, longitude and candidate_id, c_name, address,
    c_postcode, c_city, c_region, c_latitude, c_longitude.  Place evidence is the better of address and distance.
    """
    plain = {"at": "address", "ci": "city", "re": "region", "c_ci": "c_city", "c_re": "c_region"}
    made = pairs.withColumns({"a": business_name(fold("name")), "b": business_name(fold("c_name")), **{k: fold(c) for k, c in plain.items()}})
    root = postcode_root("postcode")
    there = lambda c: (F.col(c) != "") & ((F.col(c) == F.col("c_" + c)) | F.contains(F.col("at"), F.col(c)))
    zip_ = (root != "") & (root == postcode_root("c_postcode"))
    address = F.least(F.lit(1.0), F.when(zip_, 0.45).otherwise(0.0) + F.when(there("ci"), 0.35).otherwise(0.0) + F.when(there("re"), 0.20).otherwise(0.0))
    place = F.greatest(address, X.geo_band(X.haversine_m("latitude", "longitude", "c_latitude", "c_longitude")))
    score = F.least(F.lit(1.0), 0.85 * name_similarity(F.col("a"), F.col("b")) + 0.15 * place)
    return made.select("entity_id", "candidate_id", score.alias("score"), meaningful(F.col("a"), F.col("b")).alias("meaningful"))
