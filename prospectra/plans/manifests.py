"""Manifests over a listing of release files: changes, digests that still hold, checksum lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import manifests as M
from .fixtures import VIEWS, view
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

_FILE = "concat('release/', CASE WHEN o_orderkey % 41 = 0 THEN '../' ELSE '' END, CASE WHEN o_orderkey % 43 = 0 THEN 'a/../../..' ELSE 'places' END, '/part-', CAST(o_orderkey AS VARCHAR(20)), '.parquet')"
VIEWS["old_manifest"] = f"SELECT {_FILE} AS path, o_orderkey AS length, o_orderdate AS modified, CASE WHEN o_orderkey % 13 <> 0 THEN upper(md5(concat('v1-', CAST(o_orderkey AS VARCHAR(20))))) END AS sha256 FROM {{orders}} WHERE o_orderkey % 7 <> 0"
VIEWS["new_listing"] = f"SELECT {_FILE} AS path, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS length, CASE WHEN o_orderkey % 11 = 0 THEN date '2026-01-01' ELSE o_orderdate END AS modified FROM {{orders}} WHERE o_orderkey % 3 <> 0"
VIEWS["checksum_lines"] = f"SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'no digest' ELSE concat(md5(concat('v1-', CAST(o_orderkey AS VARCHAR(20)))), '  ', {_FILE}) END AS value FROM {{orders}}"
VIEWS["file_digests"] = f"SELECT {_FILE} AS relative, md5(concat(CASE WHEN o_orderkey % 19 = 0 THEN 'v2-' ELSE 'v1-' END, CAST(o_orderkey AS VARCHAR(20)))) AS sha256 FROM {{orders}} WHERE o_orderkey % 23 <> 0"


@query("""SELECT path, CASE WHEN n.path IS NULL THEN 'gone' WHEN o.path IS NULL THEN 'new' WHEN n.length = o.length AND n.modified = o.modified AND sha256 IS NOT NULL THEN 'kept' ELSE 'changed' END AS state, coalesce(n.length, o.length) AS length,
  CAST(coalesce(n.modified, o.modified) AS VARCHAR) AS modified, CASE WHEN n.path IS NULL OR (n.length = o.length AND n.modified = o.modified) THEN sha256 END AS sha256
FROM new_listing n FULL OUTER JOIN old_manifest o USING (path)""")
def manifest_changes(spark, sf_dir):
    """What became of every file between a manifest and a listing, and which digests need not be made again."""
    return M.compared(view(spark, sf_dir, "old_manifest"), view(spark, sf_dir, "new_listing")).withColumn("modified", F.col("modified").cast("string"))


@query(r"""WITH s AS (SELECT substr(value, instr(value, '  ') + 2) AS relative, upper(split_part(value, '  ', 1)) AS expected FROM checksum_lines WHERE instr(value, '  ') > 0)
SELECT relative, CASE WHEN contains(relative, '/../') AND (relative LIKE '%/../../..%' ) THEN 'unsafe' WHEN f.sha256 IS NULL THEN 'missing' WHEN upper(f.sha256) <> expected THEN 'mismatch' ELSE 'ok' END AS state
FROM s LEFT JOIN file_digests f USING (relative)""")
def checksum_verification(spark, sf_dir):
    """Every file of a checksum list: as it says, changed, missing, or outside the folder."""
    return M.verified(M.sums(view(spark, sf_dir, "checksum_lines")), view(spark, sf_dir, "file_digests"))
