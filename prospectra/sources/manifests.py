"""Manifests of files: what changed since the last one, digests of only that, and snapshots checked before they are restored.

A manifest has a row per file: path, length, modified, sha256 (upper case).  A
file counts as unchanged while its length and time of change are; its digest is
then taken over, so an unchanged release of any size is not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, length long, modified timestamp, sha256 string"
#: What became of a file since the last manifest.
KEPT, CHANGED, NEW, GONE = "kept", "changed", "new", "gone"


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the files below a path whose names match; nothing of them is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def compared(old: DataFrame, now: DataFrame) -> DataFrame:
    """Every path of either side with its state, its length and time now (of a file that is gone, as they were) and the digest that still holds."""
    o = old.select("path", F.col("length").alias("o_length"), F.col("modified").alias("o_modified"), "sha256", F.lit(True).alias("o"))
    both = now.withColumn("n", F.lit(True)).join(o, "path", "full_outer")
    same = (F.col("length") == F.col("o_length")) & F.col("modified").eqNullSafe(F.col("o_modified")) & F.col("sha256").isNotNull()
    state = F.when(F.col("n").isNull(), GONE).when(F.col("o").isNull(), NEW).when(F.coalesce(same, F.lit(False)), KEPT).otherwise(CHANGED)
    return both.select(
        "path", state.alias("state"), F.coalesce("length", "o_length").alias("length"), F.coalesce("modified", "o_modified").alias("modified"), F.when(state.isin(KEPT, GONE), F.col("sha256")).alias("sha256")
    )


def digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256) of some files, read by the tasks; a file may have 2 GB at most, as Spark reads it as one value."""
    if not paths:
        return spark.createDataFrame([], "path string, sha256 string")
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.upper(F.sha2("content", 256)).alias("sha256"))


def updated(spark: SparkSession, old: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the new manifest, the states of all paths): files that are new or changed are read for their digests, those that are gone leave it."""
    states = compared(old, now).cache()
    asked = [r["path"] for r in states.filter(F.col("state").isin(NEW, CHANGED)).select("path").toLocalIterator()]  # as a listing, these are the driver's anyway
    made = digests(spark, asked).withColumnRenamed("sha256", "fresh")
    current = states.filter(F.col("state") != GONE).join(made, "path", "left")
    return current.select("path", "length", "modified", F.coalesce("fresh", "sha256").alias("sha256")), states.select("path", "state")


def sums(lines: DataFrame) -> DataFrame:
    """(relative, expected) of a checksum list's lines, each a digest, two blanks and a path."""
    at = F.instr("value", "  ")
    return lines.filter(at > 0).select(F.expr("substr(value, instr(value, '  ') + 2)").alias("relative"), F.upper(F.substring_index("value", "  ", 1)).alias("expected"))


def unsafe(relative: Column) -> Column:
    """Whether a path leaves the folder that it is relative to."""
    steps = F.filter(F.split(relative, "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(
        steps, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda s, p: F.struct((s["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), F.least(s["low"], s["d"] + F.when(p == "..", -1).otherwise(1)).alias("low")),
    )
    return relative.startswith("/") | (depth["low"] < 0)


def verified(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(relative, state) of every listed file: ok, mismatch, missing or unsafe; found has relative and sha256."""
    both = listed.join(found.select("relative", F.upper("sha256").alias("actual")), "relative", "left")
    state = F.when(unsafe(F.col("relative")), "unsafe").when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("expected"), "mismatch").otherwise("ok")
    return both.select("relative", state.alias("state"))


def verify_folder(spark: SparkSession, path: str, sums_name: str = "SHA256SUMS") -> DataFrame:
    """The states of the files that a folder's own checksum list names."""
    listed = sums(spark.read.text(f"{path}/{sums_name}"))
    root = listing(spark, path, sums_name).filter(F.col("path").endswith("/" + sums_name)).orderBy(F.length("path")).select(F.expr(f"left(path, length(path) - {len(sums_name)})")).first()[0]
    files = listing(spark, path).select("path", F.expr(f"substr(path, {len(root) + 1})").alias("relative"))
    wanted = files.join(listed.filter(~unsafe(F.col("relative"))), "relative", "left_semi")
    read = digests(spark, [r["path"] for r in wanted.select("path").toLocalIterator()])
    return verified(listed, files.join(read, "path").select("relative", "sha256"))


def restore_snapshot(spark: SparkSession, path: str, target: str, sums_name: str = "SHA256SUMS") -> int:
    """Copy a snapshot's Parquet files into a table that must not be there yet, if all that its list names hold; returns the number of files."""
    states = {r["state"]: r["count"] for r in verify_folder(spark, path, sums_name).groupBy("state").count().collect()}
    if set(states) != {"ok"}:
        raise ValueError(f"the snapshot is not as its checksum list says: {states}")
    spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path).write.mode("errorifexists").parquet(target)
    return states["ok"]
