"""Record matching: capped blocking pairs, evidence, best match, priority lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .scratch import written
from .spread import partitions

#: Rows of either side in a tile of a large phone's pairs.
TILE = 2048


def keyed(ent: DataFrame) -> DataFrame:
    """Entities with the keys that records are matched on."""
    return ent.select(
        "entity_id", "source", "place_id", X.name_key("name").alias("name_key"), X.zip5("postcode").alias("zip5"),
        X.phone_key("phone").alias("phone_key"), X.email_key("email").alias("email_key"),
    )


def capped_pairs(rows: DataFrame, keys: list[str], low: int, high: int, reason: str, distinct: bool = True) -> DataFrame:
    """(left_id, right_id, reason): rows of one block with disjoint sources, of blocks of low to high members.

    The sizes of blocks are counted first (a partial aggregate), so a block
    that many rows share gives no pair at all, and the others at most
    high * (high - 1) / 2.
    """
    size = F.count_distinct("entity_id") if distinct else F.count("*")
    blocks = rows.groupBy(*keys).agg(size.alias("n")).filter(F.col("n").between(low, high)).select(*keys)
    members = rows.join(blocks, keys).select(*keys, "entity_id", "source").distinct()
    right = members.select(*keys, F.col("entity_id").alias("right_id"), F.col("source").alias("right_source"))
    pairs = members.join(right, keys).filter((F.col("right_id") > F.col("entity_id")) & (F.col("source") != F.col("right_source")))
    return pairs.select(F.col("entity_id").alias("left_id"), "right_id", F.lit(reason).alias("reason")).distinct()


def duplicate_pairs(ent: DataFrame) -> DataFrame:
    """Pairs of entities of different sources, with the sorted reasons for each."""
    k = keyed(ent)
    phone = capped_pairs(k.filter(F.col("phone_key").isNotNull()), ["phone_key"], 2, 5, "phone")
    named = k.filter(F.length("name_key") >= 5)
    email = capped_pairs(named.filter(X.is_usable("email_key")), ["email_key", "name_key"], 2, 5, "email_name")
    zipped = capped_pairs(named.filter(F.length("zip5") == 5), ["name_key", "zip5"], 2, 10, "name_zip", distinct=False)
    every = phone.unionByName(email).unionByName(zipped)
    return every.groupBy("left_id", "right_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def source_matches(left: DataFrame, right: DataFrame, best_only: bool = False) -> DataFrame:
    """(left_id, right_id and four flags): three equi-joins, their flags united per pair.

    All pairs of a phone that many rows of both sides share are given, so the
    result can grow with the square of such a group.  With best_only it does
    not: of pairs that only a phone joins, a left row gets the one of the least
    right id, as no other can be its best match; pairs of the other arms tell
    by themselves whether the phones agree.
    """
    a = keyed(left).select(F.col("place_id").alias("left_id"), *KEYS)
    b = keyed(right).select(F.col("place_id").alias("right_id"), *[F.col(k).alias(f"r_{k}") for k in KEYS])
    if not best_only:
        return _all_matches(a, b)
    named, zipped = F.length("name_key") >= 4, F.length("zip5") == 5
    called = F.coalesce(F.col("phone_key") == F.col("r_phone_key"), F.lit(False))
    arm = lambda rows, on, e, p, n, z: rows.join(b, [F.col(k) == F.col(f"r_{k}") for k in on]).select(
        "left_id", "right_id", F.lit(e).alias("email_match"), p.alias("phone_match"), F.lit(n).alias("name_match"), z.alias("postcode_match")
    )
    same_zip = (F.col("zip5") == F.col("r_zip5")) & (F.col("zip5") != "")
    every = arm(a.filter(named & X.is_usable("email_key")), ["email_key", "name_key"], True, called, True, same_zip)
    every = every.unionByName(arm(a.filter(named & zipped), ["name_key", "zip5"], False, called, True, F.lit(True)))
    b = b.groupBy("r_phone_key").agg(F.min("right_id").alias("right_id"))
    every = every.unionByName(arm(a.filter(F.col("phone_key").isNotNull()), ["phone_key"], False, F.lit(True), False, F.lit(False)))
    return united(every)


def united(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("left_id", "right_id").agg(*[F.bool_or(f).alias(f) for f in FLAGS])


def _all_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every pair of the three arms.

    A pair of rows comes from one arm only and has all its flags from there, so
    pairs need no grouping, but for ids that several rows of a side have.
    """
    a, b = written(_repeated(a, "left_id"), "left"), written(_repeated(b, "right_id"), "right")
    a1, a2, b1, b2 = a.filter("not twice"), a.filter("twice"), b.filter("not twice"), b.filter("twice")
    every = _pairs(a1, b1)
    for again, some, more in ((a2, a2, b), (b2, a1, b2)):
        if not again.isEmpty():
            every = every.unionByName(united(_pairs(some, more)))
    return every


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """Rows with twice: whether the key is null or another row's too."""
    often = rows.groupBy(key).agg((F.count("*") > 1).alias("twice"))
    return rows.join(often, key, "left").withColumn("twice", F.coalesce("twice", F.lit(True)))


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """A row for each pair of rows that an arm joins: by phone with the flags of the other arms, by e-mail and name without a phone, by name and postcode without either."""
    a, b = a.drop("twice"), b.drop("twice")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    same = lambda *on: is_(F.expr(" and ".join(f"{k} = r_{k}" for k in on)))
    named, zipped, usable = F.length("name_key") >= 4, F.length("zip5") == 5, X.is_usable("email_key")
    by_email, by_zip = same("email_key", "name_key") & is_(named & usable), same("name_key", "zip5") & is_(named & zipped)
    same_zip = (F.col("zip5") == F.col("r_zip5")) & (F.col("zip5") != "")
    flags = lambda *cs: [c.alias(f) for c, f in zip(cs, FLAGS)]
    join = lambda rows, *on: rows.join(b, [F.col(k) == F.col(f"r_{k}") for k in on])
    no, yes = F.lit(False), F.lit(True)
    phone = tiled(a, b, "phone_key", "r_phone_key", "left_id", "right_id").select("left_id", "right_id", *flags(by_email, yes, by_email | by_zip, is_(by_email & same_zip) | by_zip))
    email = join(a.filter(named & usable), "email_key", "name_key").filter(~same("phone_key")).select("left_id", "right_id", *flags(yes, no, yes, same_zip))
    zip_ = join(a.filter(named & zipped), "name_key", "zip5").filter(~same("phone_key") & ~by_email).select("left_id", "right_id", *flags(no, no, yes, yes))
    return phone.unionByName(email).unionByName(zip_)


def tiled(a: DataFrame, b: DataFrame, key: str, other: str, a_id: str, b_id: str) -> DataFrame:
    """a and b joined where key equals other, the pairs of a large group cut into tiles of about TILE rows on either side.

    A row goes to each tile of its row or column of tiles, so a group costs its
    pairs, but no task gets more than its tiles.  Large groups are few: each has
    more than TILE rows on one side.
    """
    big = a.groupBy(key).agg(F.count("*").alias("m")).join(b.groupBy(F.col(other).alias(key)).agg(F.count("*").alias("n")), key)
    big = big.filter(F.greatest("m", "n") > TILE).select(key, F.ceil(F.col("m") / TILE).cast("int").alias("xs"), F.ceil(F.col("n") / TILE).cast("int").alias("ys"))
    size = lambda c: F.coalesce(c, F.lit(1))
    part = lambda c, n: F.pmod(F.xxhash64(c), size(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), size(n) - 1))
    n = partitions(a, 16)
    tiles = lambda rows, k: rows.filter(F.col(k).isNotNull()).join(F.broadcast(big.withColumnRenamed(key, "of")), F.col(k) == F.col("of"), "left")
    left = tiles(a, key).select(*a.columns, part(a_id, "xs").alias("x"), each("ys").alias("y")).repartition(n, key, "x", "y")
    right = tiles(b, other).select(*b.columns, part(b_id, "ys").alias("r_y"), each("xs").alias("r_x")).repartition(n, other, "r_x", "r_y")
    return left.join(right, (F.col(key) == F.col(other)) & (F.col("x") == F.col("r_x")) & (F.col("y") == F.col("r_y"))).drop("x", "y", "r_x", "r_y")


FLAGS = ["email_match", "phone_match", "name_match", "postcode_match"]
KEYS = ["name_key", "zip5", "phone_key", "email_key"]


def best_match(matches: DataFrame) -> DataFrame:
    """Each left row's best right row: phone, name, postcode, email, then the id."""
    order = F.struct(*[~F.col(f) for f in ("phone_match", "name_match", "postcode_match", "email_match")], F.col("right_id"))
    best = matches.groupBy("left_id").agg(F.min_by(F.struct(*matches.columns[1:]), order).alias("m"))
    return best.select("left_id", "m.*").withColumn("match_method", match_method())


def match_method() -> Column:
    return F.concat_ws(
        "+", F.when(F.col("phone_match"), "phone"), F.when(F.col("name_match") & F.col("postcode_match"), "name_postcode"),
        F.when(F.col("email_match"), "email_name"),
    )


def unique_best(scored: DataFrame, key: str, score: str) -> DataFrame:
    """Rows with their key's best score, where only one has it."""
    top = scored.groupBy(key).agg(F.max(score).alias("__top"))
    best = scored.join(top, key).filter(F.col(score) == F.col("__top")).drop("__top")
    alone = best.groupBy(key).count().filter("count = 1").select(key)
    return best.join(alone, key, "left_semi")


def explode_edges(pairs: DataFrame) -> DataFrame:
    """Both ends of each pair as (entity_id, reasons): the equi-join form of 'id is either end'."""
    ends = F.explode(F.array("left_id", "right_id"))
    return pairs.select(ends.alias("entity_id"), "reasons")


def priority_lookup(rows: DataFrame, target: DataFrame, arms: list[tuple[str, str]], id_col: str, target_id: str) -> DataFrame:
    """For each row the target found by the first key that finds any (the smallest id of ties): OR of keys as equi-joins."""
    found = None
    for rank, (a, b) in enumerate(arms):
        t = target.select(F.col(b).alias("__k"), F.col(target_id).alias("__t"))
        one = rows.join(t, rows[a] == t["__k"]).select(rows[id_col], F.lit(rank).alias("priority"), "__t")
        found = one if found is None else found.unionByName(one)
    best = found.groupBy(id_col).agg(F.min(F.struct("priority", "__t")).alias("m"))
    return best.select(id_col, F.col("m.priority").alias("priority"), F.col("m.__t").alias(target_id))
