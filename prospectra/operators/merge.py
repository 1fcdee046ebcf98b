"""Upserts and deletes as new snapshots: a join, then one expression per field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ways to settle a field that both the old and the new row have.
POLICIES: dict[str, Callable[[Column, Column], Column]] = {
    "new": lambda old, new: new,
    "old": lambda old, new: old,
    "new_or_old": lambda old, new: F.coalesce(new, old),
    "old_or_new": lambda old, new: F.coalesce(old, new),
    "greatest": lambda old, new: F.greatest(old, new),
    "least": lambda old, new: F.least(old, new),
    "or": lambda old, new: F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False)),
    "union": lambda old, new: F.array_sort(F.array_union(F.coalesce(old, new), F.coalesce(new, old))),
}


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in order. Only rows of a key are compared, by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return ranked.select(*keys, "r.*").select(*df.columns)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """old, and the rows of new whose key is not there yet, one of each."""
    return old.unionByName(first_per_key(new, keys, *order).join(old, keys, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """old with the rows of new merged in by key; new must have one row of each key.

    Fields without a policy take the new value.
    """
    has_old, has_new = F.col("o.__old").isNotNull(), F.col("n.__new").isNotNull()
    marked = old.withColumn("__old", F.lit(1)).alias("o").join(new.withColumn("__new", F.lit(1)).alias("n"), keys, "full_outer")
    fields = []
    for c in old.columns:
        if c in keys:
            fields.append(F.col(c))
            continue
        settle = POLICIES[policy.get(c, "new")]
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        fields.append(F.when(has_old & has_new, settle(a, b)).when(has_new, b).otherwise(a).alias(c))
    return marked.select(*fields)


def fold(rows: DataFrame, keys: list[str], order: list[str], policy: dict[str, str]) -> DataFrame:
    """Rows of a key folded in order, as a sequence of upserts would: one row of each key.

    Every policy is an aggregate, so nothing is sorted or gathered.
    """
    at = F.struct(*order)
    made = []
    for c in rows.columns:
        if c in keys:
            continue
        x, p = F.col(c), policy.get(c, "new")
        made.append({
            "new": F.max_by(x, at), "old": F.min_by(x, at),
            "new_or_old": F.max_by(x, F.when(x.isNotNull(), at)), "old_or_new": F.min_by(x, F.when(x.isNotNull(), at)),
            "greatest": F.max(x), "least": F.min(x), "or": F.bool_or(F.coalesce(x, F.lit(False))),
        }[p].alias(c))
    return rows.groupBy(*keys).agg(*made)


def fill_missing(old: DataFrame, source: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """old with nulls of fields filled from source (one row of each key)."""
    s = source.select(*keys, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = old.join(s, keys, "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in fields else F.col(c) for c in old.columns])


def delete_using(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone, keys, "left_anti").select(*old.columns)


def snapshot_currency(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows are current; old ones of other keys stay, no longer current."""
    kept = old.join(new.select(key), key, "left_anti").withColumn("is_current", F.lit(False))
    return kept.unionByName(new.withColumn("is_current", F.lit(True)), allowMissingColumns=True)


def top_per_key(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)
