"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, filter_audit, html_extract, lattice_dedup, license_scan, periodic_runs, quality, secret_scan, simhash, substring_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    """Per document what repeats earlier text; null and empty texts stay as they are, rows without an id come last, rows equal in id and text get one result each alike, an empty table gives none; other columns are not read, whatever their names."""
    return substring_dedup.dedup_report(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    """Per document a score and toxic spans; null, empty and wordless texts get the score of no toxic token, equal rows each a row, an empty table none; other columns are not read, whatever their names."""
    docs = _table(spark, sf_dir, "documents")
    scorer = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.toxicity_report(docs, scorer)


def op3_decontamination(spark, sf_dir):
    """Per document the words inside benchmark windows; null and empty texts have no words, equal rows each a row, a null item_id counts as 'null', an empty table gives none; other columns are not read, whatever their names."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_simhash(spark, sf_dir):
    """Per document its fingerprint and component; null and empty texts have fingerprint zero and link like any other, null ids never name a component with an id, equal rows each a row, an empty table gives none; other columns are not read, whatever their names."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    """Per document its bytes and tokens; a null text counts as empty, equal rows each a row, an empty table gives none; other columns are not read, whatever their names."""
    return token_counts.token_report(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    """Per document its licences; null, empty and one-word texts have none, of overlapping runs the best counts, equal rows each a row, an empty table gives none; other columns are not read, whatever their names."""
    return license_scan.license_report(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    """Per document base counts and verdict; null and empty texts fail the base rule, without labels nothing else is rejected, equal rows each a row, an empty table gives none; other columns are not read, whatever their names."""
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_html_extraction(spark, sf_dir):
    """Per page its main text; null and empty pages give an empty text, open and stray tags never fail, equal rows each a row, an empty table gives none; other columns are not read, whatever their names."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op9_bpe(spark, sf_dir):
    """Per document digests of its ids and of the decoded text; a null text counts as empty, equal rows each a row, an empty table gives none; other columns are not read, whatever their names."""
    return bpe.bpe_report(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark, sf_dir):
    """Per document its secrets; a null text has none, equal rows each a row, an empty table gives none; other columns are not read, whatever their names."""
    return secret_scan.secret_report(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    """Per document its runs and what stays of it; null and empty texts have no run, a null id makes no text periodic, equal rows each a row, other columns are not read, an empty table gives none."""
    texts = periodic_runs.repeating(_table(spark, sf_dir, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(texts))


def op12_filter_audit(spark, sf_dir):
    """Per lang, order of five filters and step what it keeps and removes; null texts count as empty, a null id is no duplicate and has no label, equal rows each count, other columns are not read, an empty table gives none."""
    return filter_audit.interaction(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_lattice_dedup(spark, sf_dir):
    """Per vector its links and component; null, empty, zero and non-finite vectors and those without a label link with nothing, equal rows link with each other, other columns are not read, an empty table gives none."""
    return lattice_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def pipeline(spark, sf_dir):
    """The documents that all stages keep, with their token ids; each stage of corpus_pipeline states what it does with nulls, ties and empty tables, and drops columns beyond those of documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_toxicity, op3_decontamination, op4_simhash, op5_token_counts, op6_license_scan,
        op7_quality_rules, op8_html_extraction, op9_bpe, op10_secret_scan, op11_periodic_runs, op12_filter_audit, op13_lattice_dedup, pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, i, i + 9), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.m = bw.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
, spans AS (SELECT doc_id, string_agg(CAST(i - 1 AS VARCHAR) || ':' || CAST(i - 1 + m AS VARCHAR), ',' ORDER BY i, m) AS hit_spans FROM (SELECT DISTINCT doc_id, i, m FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(hit_spans, '') AS hit_spans
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN spans USING (doc_id)
""",
    "op11_periodic_runs": r"""
WITH h AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
        lambda i: list_transform(range(0, 8), lambda b: CAST((ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) >> b) & 1 AS BIGINT))))),
      lambda c, b: xor(c >> 1, CAST(3988292384 AS BIGINT) * (xor(c, b) & 1))), CAST(4294967295 AS BIGINT)) AS h
  FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS made, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM h),
t AS (
  SELECT doc_id, n, CASE WHEN made THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM g),
word AS (SELECT doc_id, n, i, w[i + 1] AS w FROM (SELECT doc_id, n, w, unnest(range(0, n)) AS i FROM t)),
same AS (SELECT a.doc_id, b.i - a.i AS p, a.i FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.w = b.w AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
stretch AS (
  SELECT doc_id, p, min(i) AS s, count(*) + p AS len
  FROM (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM same) GROUP BY doc_id, p, island),
run AS (SELECT doc_id, s, len, min(p) AS p FROM stretch WHERE len >= greatest(6, 4 * p) GROUP BY doc_id, s, len),
best AS (
  SELECT doc_id, count(*) AS n_runs, arg_min([s, len, p], {'e': -len / p, 's': s, 'p': p}) AS b,
    string_agg(concat(s, ',', len, ',', p, chr(10)), '' ORDER BY s, p) AS lines FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b[1] AS BIGINT) AS start, CAST(b[2] AS BIGINT) AS length, CAST(b[3] AS BIGINT) AS period,
  CAST(1000 * b[2] // b[3] AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM t LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op12_filter_audit": r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first_of AS (SELECT text, min(doc_id) AS least FROM w GROUP BY text),
label AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(bad, FALSE) AS bad, [
    len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, FALSE)] AS fails
  FROM w JOIN first_of USING (text) LEFT JOIN label USING (doc_id)),
masks AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM m GROUP BY part, fails),
f AS (SELECT unnest(range(1, 6)) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, k AS step, o[k] AS own, o[1:k - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS k)),
made AS (
  SELECT part, o, step, own, fails, n, good, bad, fails[own] AS hit, len(list_filter(before, lambda i: fails[i])) > 0 AS earlier, len(list_filter(fails, lambda x: x)) AS many
  FROM masks, steps),
counted AS (
  SELECT part, o, step, own, sum(n) FILTER (NOT hit AND NOT earlier) AS kept, sum(n) FILTER (hit AND NOT earlier) AS removed, sum(n) FILTER (hit AND earlier) AS redundant,
    sum(n) FILTER (hit AND many = 1) AS unique_fails, sum(good) FILTER (hit AND NOT earlier) AS good_lost, sum(bad) FILTER (hit AND NOT earlier) AS toxic_lost
  FROM made GROUP BY part, o, step, own),
share AS (SELECT part, own, sum(removed) AS shapley FROM counted GROUP BY part, own)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(shapley, 0) AS BIGINT) AS shapley
FROM counted JOIN share USING (part, own)
""",
    "op13_lattice_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)
""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
