"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that this process wrote and has not deleted.
_left: set[str] = set()
#: With it Spark deletes a query's shuffle files when the query ends, not when the driver's collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, which only a local session may have."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="prospectra-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of a table in the shared folder.

    Its lineage is cut, a lost executor costs nothing, and a join on it
    shuffles both sides, so adaptive execution can split a hot key.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, was)
    _left.add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def adopt(*paths: str) -> None:
    """Count tables that something else wrote into the shared folder among those that clear() deletes."""
    _left.update(paths)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _left.discard(path)


def _paths(df: DataFrame) -> set[str]:
    names = {f.rsplit("/", 2)[1] for f in df.inputFiles()}
    return {p for p in _left if p.rsplit("/", 1)[1] in names}


def forget(*tables: DataFrame) -> None:
    """Delete tables that written() returned and nothing reads any more."""
    for df in tables:
        for path in _paths(df):
            _delete(df.sparkSession, path)


def left() -> frozenset[str]:
    """The tables of this process that are not deleted."""
    return frozenset(_left)


def clear(spark: SparkSession, *keep: DataFrame, since: frozenset[str] = frozenset()) -> None:
    """Delete every table of this process but those that the frames in keep read and those in since.

    An operator deletes its own intermediate tables; the last ones, which its
    result reads, are left until the result is written and this is called.
    """
    for path in _left - since - set().union(*map(_paths, keep)):
        _delete(spark, path)
