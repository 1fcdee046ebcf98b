"""A balanced campaign: search jobs dealt over places and keywords in rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import VIEWS, view
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

# Where in a box each round looks, as fractions of its height and width.
SAMPLE_POINTS = [(0.18, 0.22), (0.32, 0.72), (0.48, 0.42), (0.64, 0.82), (0.78, 0.28), (0.24, 0.54), (0.55, 0.14), (0.84, 0.62), (0.40, 0.90), (0.70, 0.50)]
TARGET = 20_000

VIEWS["state_boxes"] = "SELECT n_name AS state, CAST(24 + n_nationkey AS DOUBLE) + 0.396 AS south, CAST(26 + 2 * n_nationkey AS DOUBLE) - 0.081 AS north, CAST(-120 + n_nationkey AS DOUBLE) - 0.57 AS west, CAST(-117 + n_nationkey AS DOUBLE) + 0.91 AS east FROM {nation}"
VIEWS["campaign_keywords"] = "SELECT DISTINCT concat(p_type, ' ', p_brand) AS keyword FROM {part}"
VIEWS["queued_jobs"] = "SELECT DISTINCT concat(p_type, ' ', p_brand) AS keyword, n_name AS state, CAST(p_partkey % 10 AS INTEGER) AS round FROM {part} JOIN {nation} ON p_size % 25 = n_nationkey"


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """A small dimension with the place of each of its keys in order; the keys are one list of bounded size."""
    listed = rows.agg(F.array_sort(F.collect_set(key)).alias("keys")).select(F.posexplode("keys").alias("n", key))
    return rows.join(F.broadcast(listed), key)


def balanced(keywords: DataFrame, boxes: DataFrame, queued: DataFrame, target: int) -> DataFrame:
    """The first target jobs of all rounds x keywords x states that are not queued, by their ordinals.

    An ordinal says which round, keyword and state it is, so the jobs are read
    off a range of numbers; no list of all jobs is sorted.  As a round holds
    every keyword and state once, any prefix is balanced over both.
    """
    spark: SparkSession = keywords.sparkSession
    keywords, boxes = numbered(keywords, "keyword"), numbered(boxes, "state")
    k, s = keywords.count(), boxes.count()
    point = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in SAMPLE_POINTS])
    at = F.col("id")
    jobs = spark.range(len(SAMPLE_POINTS) * k * s).select(at.alias("ordinal"), (at % s).cast("int").alias("sn"), (F.floor(at / s) % k).cast("int").alias("kn"), F.floor(at / (s * k)).cast("int").alias("round"))
    rows = jobs.join(F.broadcast(keywords.withColumnRenamed("n", "kn")), "kn").join(F.broadcast(boxes.withColumnRenamed("n", "sn")), "sn").withColumn("p", F.get(point, F.col("round")))
    new = rows.join(queued, ["keyword", "state", "round"], "left_anti")

    def inside(low: str, high: str, part: str) -> Column:
        return F.round(F.col(low) + (F.col(high) - F.col(low)) * F.col(part), 5)

    made = new.select("ordinal", "round", "keyword", "state", inside("south", "north", "p.lat").alias("latitude"), inside("west", "east", "p.lng").alias("longitude"), *["south", "west", "north", "east"])
    box = F.concat_ws(",", *[F.format_string("%.4f", c) for c in ("south", "west", "north", "east")])
    return made.orderBy("ordinal").limit(target).select("ordinal", "round", "keyword", "state", "latitude", "longitude", box.alias("bounding_box"))


_POINTS = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(SAMPLE_POINTS))


@query(f"""WITH k AS (SELECT keyword, row_number() OVER (ORDER BY keyword) - 1 AS kn, count(*) OVER () AS n FROM campaign_keywords), s AS (SELECT *, row_number() OVER (ORDER BY state) - 1 AS sn, count(*) OVER () AS m FROM state_boxes),
r(round, lat, lng) AS (VALUES {_POINTS})
SELECT (CAST(round AS BIGINT) * n + kn) * m + sn AS ordinal, CAST(round AS INTEGER) AS round, keyword, state, round(south + (north - south) * lat, 5) AS latitude, round(west + (east - west) * lng, 5) AS longitude,
  printf('%.4f,%.4f,%.4f,%.4f', south, west, north, east) AS bounding_box
FROM r, k, s WHERE NOT EXISTS (SELECT 1 FROM queued_jobs q WHERE q.keyword = k.keyword AND q.state = s.state AND q.round = r.round) ORDER BY ordinal LIMIT {TARGET}""")
def balanced_candidates(spark, sf_dir):
    """The first jobs of a nationwide campaign; the number of jobs is its target."""
    return balanced(view(spark, sf_dir, "campaign_keywords").select("keyword"), view(spark, sf_dir, "state_boxes"), view(spark, sf_dir, "queued_jobs"), TARGET)
