"""Connected components by alternating large- and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import forget, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each end of an edge, the smallest node that it reaches.

    Each step is a grouped minimum and a join of written tables, both sides of
    which are shuffled anew, so adaptive execution can split a hub.
    """
    star = written(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "star")
    mark = _mark(star)
    while mark[0]:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        nearest = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = written(large.join(nearest, "u").select(F.inline(pairs)).filter("u <> v").distinct(), "star")
        was, mark = mark, _mark(small)
        forget(star, least, large, nearest)
        star = small
        if mark == was:
            break
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(hash(v, u))")).first())
