"""Deduplication to a fixed point, and the tables that follow their entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup
from ..operators.scratch import written
from .fixtures import VIEWS, view
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

# Places of four sources. By the key's rest of 6: 0 all agree; 1 a chain a - b - c by phone, then by e-mail and name; 2 six entities share a
# phone, too many until a and b merge by name and postcode; 3 the winner has no name until it takes b's, which d then shares; 4 sets of
# sources overlap; 5 nothing is shared.
_T = "VARCHAR(20)"
VIEWS["dd_rows"] = f"""
SELECT src AS source, k, concat(src, CAST(k AS {_T})) AS place_id,
  CASE WHEN src = 'c' AND k % 12 = 4 THEN k ELSE rnk * 1000000000 + k END AS entity_id,
  CASE WHEN src = 'a' AND k % 6 = 3 THEN NULL ELSE concat('Shop No. ', CAST(k AS {_T}), CASE WHEN k % 6 = 1 AND src = 'a' OR k % 6 = 2 AND src = 'c' OR k % 6 > 3 THEN src ELSE '' END) END AS name,
  CASE WHEN k % 6 = 3 AND src = 'b' THEN NULL WHEN k % 6 = 1 OR k % 6 = 2 AND src = 'c' THEN src ELSE concat('9', lpad(CAST(k % 10000 AS {_T}), 4, '0'), '-12') END AS postcode,
  CASE WHEN k % 6 = 0 AND src < 'c' OR k % 6 = 3 AND src < 'c' THEN concat('(200) ', lpad(CAST(k AS {_T}), 7, '0'))
       WHEN k % 6 = 1 THEN concat('+1 30', CASE WHEN src = 'c' THEN '1' ELSE '0' END, lpad(CAST(k AS {_T}), 7, '0'))
       WHEN k % 6 = 2 THEN concat('+1 400', lpad(CAST((k - k % 12) / 12 AS {_T}), 7, '0'))
       WHEN k % 12 = 4 AND src = 'a' THEN concat('500', lpad(CAST(k AS {_T}), 7, '0')) WHEN k % 12 = 10 AND src = 'c' THEN concat('500-', lpad(CAST(k - 6 AS {_T}), 7, '0'))
       WHEN k % 6 = 5 THEN concat('7', CAST(rnk AS {_T}), lpad(CAST(k AS {_T}), 8, '0')) END AS phone,
  CASE WHEN k % 6 = 1 AND src > 'a' THEN concat(CASE WHEN src = 'b' THEN 'M' ELSE 'm' END, CAST(k AS {_T}), '@mail.example.net')
       WHEN k % 6 = 0 THEN concat(upper(src), '-', CAST(k AS {_T}), '@both.example.net') WHEN k % 4 <> 0 THEN concat(src, CAST(k AS {_T}), '@own.example.net') END AS email,
  rnk, CASE WHEN k % 5 = 0 THEN concat('Brand', CAST(rnk AS {_T})) END AS brand, CASE WHEN k % 7 <> 0 THEN CAST((k * 7 + rnk * 31) % 100 AS DOUBLE) / 100 END AS confidence,
  concat('202', CAST(rnk AS {_T}), '-0', CAST(1 + k % 9 AS {_T}), '-11') AS refreshed
FROM (SELECT 'a' AS src, CAST(0 AS BIGINT) AS rnk, c_custkey AS k FROM {{customer}}
      UNION ALL SELECT 'b', CAST(1 AS BIGINT), p_partkey FROM {{part}}
      UNION ALL SELECT 'c', CAST(2 AS BIGINT), c_custkey FROM {{customer}} WHERE c_custkey % 2 = 0 OR c_custkey % 6 = 1
      UNION ALL SELECT 'd', CAST(3 AS BIGINT), p_partkey FROM {{part}} WHERE p_partkey % 3 = 0) t""".replace("(k - k % 12) / 12", "floor(k / 12)").replace("CAST(floor(k / 12) AS VARCHAR(20))", "CAST(CAST(floor(k / 12) AS BIGINT) AS VARCHAR(20))")  # fmt: skip

POLICY_COLUMNS = ["name", "postcode", "brand_name", "is_known_brand", "confidence", "earliest_source_date", "latest_source_refresh", "is_qualified"]


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Entities, places and six child tables before any merge."""
    rows = written(view(spark, sf_dir, "dd_rows"), "rows")
    sorted_set = lambda c: F.array_sort(F.collect_set(c))
    mail = rows.filter("email is not null").withColumn("normalized_email", F.lower("email"))
    calls = rows.filter("phone is not null").withColumn("normalized_phone", F.right(F.regexp_replace("phone", "[^0-9]", ""), F.lit(10)))
    own = F.struct("rnk", "k")
    return {
        "places": rows.select("source", "place_id", "entity_id"),
        "entities": rows.groupBy("entity_id").agg(
            F.min_by("name", own).alias("name"), F.min_by("postcode", own).alias("postcode"), F.min("brand").alias("brand_name"), F.bool_or(F.col("k") % 11 == 0).alias("is_known_brand"),
            F.max("confidence").alias("confidence"), F.min("refreshed").alias("earliest_source_date"), F.max("refreshed").alias("latest_source_refresh"),
            F.bool_or((F.col("source") == "b") & (F.col("k") % 4 == 0)).alias("is_qualified"), F.count("*").alias("source_count"),
        ),
        "emails": mail.groupBy("entity_id", "normalized_email").agg(
            F.min("email").alias("display_email"), F.min(F.substring_index("normalized_email", "@", -1)).alias("email_domain"), F.bool_or(F.col("k") % 7 != 0).alias("is_usable"),
            F.bool_or(F.col("k") % 5 == 0).alias("is_role_account"), sorted_set("source").alias("sources"),
        ),
        "phones": calls.groupBy("entity_id", "normalized_phone").agg(sorted_set("phone").alias("raw_values"), sorted_set("source").alias("sources")),
        "socials": rows.filter("k % 2 = 0").select("entity_id", F.lit("facebook").alias("platform"), F.concat(F.lit("shop"), F.floor(F.col("k") / 12)).alias("handle_or_url"), "source").distinct(),
        "categories": rows.groupBy("entity_id", "source", F.concat(F.lit("cat"), F.col("k") % 3).alias("category_id")).agg(F.min(F.concat(F.lit("Label "), F.col("k"))).alias("category_label"), F.min(F.col("k") % 4 == 0).alias("is_primary")),
        "enrichment": rows.filter("k % 3 <> 1").groupBy("entity_id").agg(F.min(F.concat("source", F.lit(":"), F.col("k") % 5)).alias("status")),
        "activity": rows.groupBy("entity_id", "source", F.concat(F.lit("https://www.facebook.com/shop"), F.floor(F.col("k") / 12)).alias("normalized_url")).agg(F.min(F.when(F.col("k") % 2 == 0, "succeeded").otherwise("pending")).alias("state")),
    }


CHILD_SQL = """
pl0 AS MATERIALIZED (SELECT source, place_id, entity_id FROM dd_rows),
e0 AS MATERIALIZED (SELECT entity_id, arg_min_null(name, {'r': rnk, 'k': k}) AS name, arg_min_null(postcode, {'r': rnk, 'k': k}) AS postcode, min(brand) AS brand_name, bool_or(k % 11 = 0) AS is_known_brand, max(confidence) AS confidence,
  min(refreshed) AS earliest_source_date, max(refreshed) AS latest_source_refresh, bool_or(source = 'b' AND k % 4 = 0) AS is_qualified, count(*) AS source_count FROM dd_rows GROUP BY 1),
em0 AS MATERIALIZED (SELECT entity_id, lower(email) AS normalized_email, min(email) AS display_email, min(split_part(lower(email), '@', 2)) AS email_domain, bool_or(k % 7 <> 0) AS is_usable, bool_or(k % 5 = 0) AS is_role_account,
  list_sort(list(DISTINCT source)) AS sources FROM dd_rows WHERE email IS NOT NULL GROUP BY 1, 2),
ph0 AS MATERIALIZED (SELECT entity_id, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS normalized_phone, list_sort(list(DISTINCT phone)) AS raw_values, list_sort(list(DISTINCT source)) AS sources FROM dd_rows WHERE phone IS NOT NULL GROUP BY 1, 2),
so0 AS MATERIALIZED (SELECT DISTINCT entity_id, 'facebook' AS platform, concat('shop', k // 12) AS handle_or_url, source FROM dd_rows WHERE k % 2 = 0),
ca0 AS MATERIALIZED (SELECT entity_id, source, concat('cat', k % 3) AS category_id, min(concat('Label ', k)) AS category_label, min(k % 4 = 0) AS is_primary FROM dd_rows GROUP BY 1, 2, 3),
en0 AS MATERIALIZED (SELECT entity_id, min(concat(source, ':', k % 5)) AS status FROM dd_rows WHERE k % 3 <> 1 GROUP BY 1),
ac0 AS MATERIALIZED (SELECT entity_id, source, concat('https://www.facebook.com/shop', k // 12) AS normalized_url, min(CASE WHEN k % 2 = 0 THEN 'succeeded' ELSE 'pending' END) AS state FROM dd_rows GROUP BY 1, 2, 3)"""


def _pass(i: int) -> str:
    """One pass over the tables numbered i - 1, all blocks counted again."""
    o = i - 1
    flag = "(m.winner_id IS NULL)"

    def own(c: str) -> str:
        return f"coalesce(min(t.{c}) FILTER ({flag}), min(t.{c}) FILTER (NOT {flag})) AS {c}"

    def moved(t: str, keys: str, rest: str) -> str:
        return f"SELECT coalesce(m.winner_id, t.entity_id) AS entity_id{keys}, {rest} FROM {t}{o} t LEFT JOIN m{i} m USING (entity_id) GROUP BY ALL"

    def first(t: str, keys: str, rest: list[str]) -> str:
        cols = ", ".join(f"t.{c}" for c in [*[k for k in keys.split(", ") if k], *rest])
        by = "coalesce(m.winner_id, t.entity_id)" + (f", {keys}" if keys else "")
        return f"SELECT coalesce(m.winner_id, t.entity_id) AS entity_id, {cols} FROM {t}{o} t LEFT JOIN m{i} m USING (entity_id) QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY NOT {flag}, t.entity_id) = 1"

    union = lambda c: f"list_sort(list_distinct(flatten(list(t.{c})))) AS {c}"
    pair = "JOIN s{i} l ON l.entity_id = a.entity_id JOIN s{i} r ON r.entity_id = b.entity_id WHERE b.entity_id > a.entity_id AND NOT list_has_any(l.sources, r.sources)".format(i=i)
    return f""",
s{i} AS MATERIALIZED (SELECT entity_id, list_sort(list(DISTINCT source)) AS sources FROM pl{o} GROUP BY 1),
k{i} AS MATERIALIZED (SELECT entity_id, regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]', '', 'g') AS nk, left(regexp_replace(coalesce(postcode, ''), '[^0-9]', '', 'g'), 5) AS pk FROM e{o}),
mk{i} AS MATERIALIZED (SELECT entity_id, normalized_email, nk FROM em{o} JOIN k{i} USING (entity_id) WHERE is_usable AND length(nk) >= 5),
arm{i} AS MATERIALIZED (
  SELECT a.entity_id AS a, b.entity_id AS b, 'phone_exact' AS reason FROM ph{o} a JOIN ph{o} b USING (normalized_phone) {pair}
    AND normalized_phone IN (SELECT normalized_phone FROM ph{o} WHERE length(normalized_phone) = 10 GROUP BY 1 HAVING count(DISTINCT entity_id) BETWEEN 2 AND 5)
  UNION ALL SELECT a.entity_id, b.entity_id, 'email+name_exact' FROM mk{i} a JOIN mk{i} b USING (normalized_email, nk) {pair}
    AND (normalized_email, nk) IN (SELECT (normalized_email, nk) FROM mk{i} GROUP BY normalized_email, nk HAVING count(DISTINCT entity_id) BETWEEN 2 AND 5)
  UNION ALL SELECT a.entity_id, b.entity_id, 'name+postcode_exact' FROM k{i} a JOIN k{i} b USING (nk, pk) {pair}
    AND (nk, pk) IN (SELECT (nk, pk) FROM k{i} WHERE length(nk) >= 5 AND length(pk) = 5 GROUP BY nk, pk HAVING count(*) BETWEEN 2 AND 10)),
both{i} AS MATERIALIZED (SELECT a, b FROM arm{i} UNION SELECT b, a FROM arm{i}),
reach{i} AS (SELECT a, b FROM both{i} UNION SELECT r.a, x.b FROM reach{i} r JOIN both{i} x ON x.a = r.b),
m{i} AS MATERIALIZED (SELECT a AS entity_id, min(b) AS winner_id FROM reach{i} GROUP BY 1 HAVING min(b) < a),
why{i} AS (SELECT a AS id, reason FROM arm{i} UNION SELECT b, reason FROM arm{i}),
log{i} AS MATERIALIZED (SELECT {i} AS pass, m.winner_id, m.entity_id AS merged_id, coalesce(list_sort(list(DISTINCT reason)), ['transitive_component']) AS reasons, s.sources AS merged_sources
  FROM m{i} m JOIN s{i} s USING (entity_id) LEFT JOIN why{i} w ON w.id = m.entity_id GROUP BY ALL),
pl{i} AS MATERIALIZED (SELECT source, place_id, coalesce(m.winner_id, t.entity_id) AS entity_id FROM pl{o} t LEFT JOIN m{i} m USING (entity_id)),
e{i} AS MATERIALIZED (WITH n AS (SELECT entity_id, count(*) AS n FROM pl{i} WHERE entity_id IN (SELECT winner_id FROM m{i}) GROUP BY 1), x AS ({moved(f"e", "", ", ".join([own("name"), own("postcode"), own("brand_name"), "bool_or(t.is_known_brand) AS is_known_brand", "max(t.confidence) AS confidence", "min(t.earliest_source_date) AS earliest_source_date", "max(t.latest_source_refresh) AS latest_source_refresh", "bool_or(t.is_qualified) AS is_qualified", own("source_count")]))})
  SELECT x.* REPLACE (coalesce(n.n, x.source_count) AS source_count) FROM x LEFT JOIN n USING (entity_id)),
em{i} AS MATERIALIZED ({moved("em", ", normalized_email", ", ".join([own("display_email"), own("email_domain"), "bool_or(t.is_usable) AS is_usable", "bool_or(t.is_role_account) AS is_role_account", union("sources")]))}),
ph{i} AS MATERIALIZED ({moved("ph", ", normalized_phone", union("raw_values") + ", " + union("sources"))}),
so{i} AS MATERIALIZED ({first("so", "platform, handle_or_url, source", [])}),
ca{i} AS MATERIALIZED ({first("ca", "source, category_id", ["category_label", "is_primary"])}),
en{i} AS MATERIALIZED ({first("en", "", ["status"])}),
ac{i} AS MATERIALIZED ({first("ac", "source, normalized_url", ["state"])})"""


PASSES = 3
FIXED = "WITH RECURSIVE " + CHILD_SQL.strip().replace("arg_min_null(name, {'r': rnk, 'k': k})", "arg_min({'v': name}, {'r': rnk, 'k': k}).v").replace("arg_min_null(postcode, {'r': rnk, 'k': k})", "arg_min({'v': postcode}, {'r': rnk, 'k': k}).v") + "".join(_pass(i) for i in range(1, PASSES + 1))
LAST = str(PASSES)


def _fixed(spark: SparkSession, sf_dir: str, logged: bool = False) -> dedup.Merged:
    return dedup.to_fixed_point(tables(spark, sf_dir), PASSES, logged)


@query(FIXED + f"""
SELECT * FROM ({" UNION ALL ".join(f"SELECT {i} AS pass, count(*) AS merged_entities FROM log{i}" for i in range(1, PASSES + 1))})""")
def dedup_passes(spark, sf_dir):
    """How many entities each pass absorbed; the last row is of the pass that found none."""
    return spark.createDataFrame(_fixed(spark, sf_dir).passes, "pass int, merged_entities long")


@query(FIXED + f"""
SELECT pass, winner_id, merged_id, array_to_string(reasons, ',') AS reasons, array_to_string(merged_sources, ',') AS merged_sources FROM ({" UNION ALL ".join(f"SELECT * FROM log{i}" for i in range(1, PASSES + 1))})""")
def dedup_merge_log(spark, sf_dir):
    log = _fixed(spark, sf_dir, logged=True).log
    return log.select("pass", "winner_id", "merged_id", F.array_join("reasons", ",").alias("reasons"), F.array_join("merged_sources", ",").alias("merged_sources"))


@query(FIXED + f"\nSELECT e.*, array_to_string(s.sources, ',') AS sources FROM e{LAST} e JOIN (SELECT entity_id, list_sort(list(DISTINCT source)) AS sources FROM pl{LAST} GROUP BY 1) s USING (entity_id)")
def dedup_fixed_point(spark, sf_dir):
    """The entities that no pass merges any more, with the sources of their places."""
    state = _fixed(spark, sf_dir).state
    return state["entities"].join(dedup.source_sets(state["places"]), "entity_id").withColumn("sources", F.array_join("sources", ","))


@query(FIXED + f"\nSELECT * FROM pl{LAST}")
def repointed_places(spark, sf_dir):
    return _fixed(spark, sf_dir).state["places"]


@query(FIXED + f"\nSELECT * REPLACE (array_to_string(sources, ',') AS sources), CAST(len(sources) AS INTEGER) AS source_count FROM em{LAST}")
def repointed_emails(spark, sf_dir):
    e = _fixed(spark, sf_dir).state["emails"]
    return e.withColumn("source_count", F.size("sources")).withColumn("sources", F.array_join("sources", ","))


@query(FIXED + f"\nSELECT entity_id, normalized_phone, array_to_string(raw_values, ',') AS raw_values, array_to_string(sources, ',') AS sources FROM ph{LAST}")
def repointed_phones(spark, sf_dir):
    p = _fixed(spark, sf_dir).state["phones"]
    return p.select("entity_id", "normalized_phone", F.array_join("raw_values", ",").alias("raw_values"), F.array_join("sources", ",").alias("sources"))


@query(FIXED + f"\nSELECT * FROM so{LAST}")
def repointed_socials(spark, sf_dir):
    return _fixed(spark, sf_dir).state["socials"]


@query(FIXED + f"\nSELECT * FROM ca{LAST}")
def repointed_categories(spark, sf_dir):
    return _fixed(spark, sf_dir).state["categories"]


@query(FIXED + f"\nSELECT * FROM en{LAST}")
def repointed_enrichment(spark, sf_dir):
    return _fixed(spark, sf_dir).state["enrichment"]


@query(FIXED + f"\nSELECT * FROM ac{LAST}")
def repointed_activity(spark, sf_dir):
    return _fixed(spark, sf_dir).state["activity"]


def _counted(name: str, table: str, keys: str) -> str:
    return (
        f"SELECT '{name}_orphans' AS what, count(*) AS n FROM {table}{LAST} t WHERE NOT EXISTS (SELECT 1 FROM e{LAST} e WHERE e.entity_id = t.entity_id) "
        f"UNION ALL SELECT '{name}_repeated', count(*) FROM (SELECT 1 FROM {table}{LAST} GROUP BY {keys} HAVING count(*) > 1)"
    )


TABLES = {"places": "pl", "emails": "em", "phones": "ph", "socials": "so", "categories": "ca", "enrichment": "en", "activity": "ac"}


@query(FIXED + "\n" + " UNION ALL ".join(_counted(n, t, ", ".join(dedup.CHILDREN[n][0]) if n != "places" else "source, place_id") for n, t in TABLES.items()) + f"""
UNION ALL SELECT 'source_count_mismatches', count(*) FROM e{LAST} e JOIN (SELECT entity_id, count(*) AS n FROM pl{LAST} GROUP BY 1) p USING (entity_id) WHERE e.source_count <> p.n""")
def repointed_checks(spark, sf_dir):
    """Orphans and repeated keys of every table that follows the entities: none, after any number of passes."""
    return dedup.checks(_fixed(spark, sf_dir).state)
