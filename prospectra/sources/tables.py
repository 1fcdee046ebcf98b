"""Sources and sinks: registry files, snapshots and exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def registry_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """An all-text staging table; the header must be names, but for case, blanks and a byte order mark."""
    head = spark.read.csv(path, header=True, encoding="UTF-8").columns
    found = [c.lstrip("﻿").strip().lower() for c in head]
    if found != [n.lower() for n in names]:
        raise ValueError(f"the header is {found}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True, multiLine=True, escape='"', encoding="UTF-8")


def manifest(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(path, length[, sha256 in upper case]) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", *([F.upper(F.sha2("content", 256)).alias("sha256")] if digest else []))


def snapshot_date(file: Column) -> Column:
    """The date in a file's name, as in _20260901."""
    return F.to_date(F.nullif(F.regexp_extract(file, r"(20\d{6})", 1), F.lit("")), "yyyyMMdd")


def with_file(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Parquet rows with source_file, the part of their file's name that matches pattern."""
    rows = spark.read.parquet(path)
    return rows.withColumn("source_file", F.regexp_extract(F.col("_metadata.file_path"), pattern, 0))


def latest_release(files: DataFrame, release: str = "latest") -> DataFrame:
    """(release, path, ...) of the files below the dt= directory asked for, the newest by default."""
    dated = files.withColumn("release", F.regexp_extract("path", r"dt=([^/]+)", 1)).filter(F.col("release") != "")
    if release.lower() != "latest":
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", release):
            raise ValueError("a release is YYYY-MM-DD or latest")
        return dated.filter(F.col("release") == release)
    newest = dated.agg(F.max("release").alias("__newest"))  # one row
    return dated.crossJoin(newest).filter(F.col("release") == F.col("__newest")).drop("__newest")


def read_release(spark: SparkSession, root: str, release: str = "latest", pattern: str = r"[^/]+\.parquet") -> DataFrame:
    """The rows of one dt= directory below root, the newest by default, with the release and the file that each is from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if s.isDirectory()]
    found = [n.removeprefix("dt=") for n in names if n.startswith("dt=")]
    if release.lower() == "latest":
        if not found:
            raise ValueError(f"there is no release in {root}")
        release = max(found)
    elif not re.fullmatch(r"\d{4}-\d{2}-\d{2}", release):
        raise ValueError("a release is YYYY-MM-DD or latest")
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/dt={release}")
    file = F.regexp_extract(F.col("_metadata.file_path"), pattern + "$", 0)
    return rows.select("*", F.lit(release).alias("release"), file.alias("source_file"))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns, in their order, with a header in each part."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


BOM = "\ufeff"


def write_export(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns as CSV for spreadsheets: every part begins with a byte order mark and the header; columns that df has not stay empty."""
    chosen = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    # the mark is a part of the first name, so that Spark's own writer puts it first
    df.select(*chosen).withColumnRenamed(columns[0], BOM + columns[0]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def restore(df: DataFrame, path: str) -> None:
    """Write a snapshot; an existing one is never overwritten."""
    df.write.mode("errorifexists").parquet(path)
