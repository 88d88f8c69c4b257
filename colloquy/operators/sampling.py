"""Samples, queues and set operations on ids. Order comes from a hash of id and seed, so a sample is the
same on every cluster and in SQL. Null ids are left out; samples larger than a stratum take all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.plans import blocks
from colloquy.session import small


def ticket(key: Column, seed: str) -> Column:
    """A hash that orders ids at random."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(seed)))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the ticket's first eight digits."""
    return (F.conv(F.substring(ticket(key, seed), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def simple(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows at random."""
    return rows.where(F.col(key).isNotNull()).orderBy(ticket(F.col(key), seed), key).limit(n)


def per_stratum(rows: DataFrame, key: str, strata: list[str], n: int, seed: str) -> DataFrame:
    """Up to ``n`` rows of each stratum at random."""
    w = Window.partitionBy(*strata).orderBy(ticket(F.col(key), seed), key)
    return rows.where(F.col(key).isNotNull()).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")


def weighted(rows: DataFrame, key: str, strata: list[str], weight: Column, n: int, seed: str) -> DataFrame:
    """Up to ``n`` rows of each stratum without replacement, with chances in proportion to ``weight``.

    The row with the smallest -ln(u) / weight comes first.
    """
    order = F.round(-F.log(uniform(F.col(key), seed)) / weight, 9)
    w = Window.partitionBy(*strata).orderBy(order, key)
    return rows.where(F.col(key).isNotNull()).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def split(rows: DataFrame, key: str, classes: str, share: float, seed: str) -> DataFrame:
    """``rows`` with part train or test: of each class the first ``share`` by ticket are train."""
    t = rows.where(F.col(key).isNotNull()).withColumn("_t", ticket(F.col(key), seed))
    ranked = blocks.running_sums(t, [classes], F.substring("_t", 1, 2), ["_t", key], {"_rank": F.lit(1)})
    n = t.groupBy(F.col(classes).alias("_c")).agg(F.count("*").alias("_n"))
    part = F.when(F.col("_rank") <= F.ceil(F.col("_n") * share), "train").otherwise("test")
    return ranked.join(n, F.col(classes).eqNullSafe(F.col("_c"))).withColumn("part", part).drop("_t", "_rank", "_c", "_n")


def first_reason(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``rows`` with the first rule that holds as reason, or kept."""
    out = F.lit("kept")
    for name, test in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return rows.withColumn("reason", out)


def upsert(old: DataFrame, new: DataFrame, key: str, manual: list[str]) -> DataFrame:
    """``new`` with the manual columns of ``old``; reviewed rows that vanished stay, marked stale."""
    kept = old.select(key, *[F.col(c).alias(f"_{c}") for c in manual])
    fresh = new.join(kept, key, "left")
    for c in manual:
        fresh = fresh.withColumn(c, F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)))
    fresh = fresh.drop(*[f"_{c}" for c in manual]).withColumn("stale", F.lit(False))
    reviewed = F.lit(False)
    for c in manual:
        reviewed = reviewed | (F.coalesce(F.col(c), F.lit("")) != "")
    gone = old.join(new.select(key), key, "left_anti").where(reviewed).withColumn("stale", F.lit(True))
    return fresh.unionByName(gone.select(*[c for c in fresh.columns if c in gone.columns]), allowMissingColumns=True)


def keep_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def replace_group(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """``old`` without the groups of ``new``, and ``new``."""
    return old.join(new.select(column).distinct(), column, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def proportional(rows: DataFrame, key: str, by: str, n: int, seed: str) -> DataFrame:
    """``n`` rows, of each class of ``by`` in proportion to its size (rounded down, one at least), filled up from the others.

    In both steps rows come in order of the hash of id and seed; fewer than ``n`` rows are all kept.
    """
    order = F.struct(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), F.col(key))
    total = F.sum("_n").over(Window.partitionBy(F.lit(0)))  # over one row a class
    sizes = rows.groupBy(F.col(by).alias("_class")).agg(F.count("*").alias("_n"))
    quota = sizes.select("_class", F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("_n") / total)).alias("_quota"))
    w = Window.partitionBy(by).orderBy(order)
    ranked = rows.join(small(quota), F.col(by).eqNullSafe(F.col("_class"))).withColumn("_nth", F.row_number().over(w))
    first = ranked.withColumn("_first", (F.col("_nth") <= F.col("_quota")).cast("int"))
    return first.orderBy(F.desc("_first"), order).limit(n).drop("_class", "_quota", "_nth", "_first")


def first_in_order(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group in an order."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_nth") <= k).drop("_nth")
