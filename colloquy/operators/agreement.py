"""Agreement of labels: kappa, F1, alpha, AUC, votes, intervals. All decompose into grouped sums.

Inputs are long tables (item, coder, label) or pairs of labels; null labels are no labels; a statistic
that isn't defined (one class, no items) is null; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import numbers
from colloquy.plans import blocks


def coder_pairs(long: DataFrame) -> DataFrame:
    """(item, a, b, label_a, label_b): both labels of every two coders of an item."""
    r = long.where("label is not null").select("item", "coder", "label")
    return (
        r.alias("x").join(r.alias("y"), "item").where("x.coder < y.coder")
        .select("item", F.col("x.coder").alias("a"), F.col("y.coder").alias("b"), F.col("x.label").alias("label_a"), F.col("y.label").alias("label_b"))
    )


def kappa(pairs: DataFrame, *by: str) -> DataFrame:
    """(by..., n, raw, kappa) of label_a against label_b; kappa is null where chance agreement is 1."""
    keys = list(by)
    cells = pairs.where("label_a is not null and label_b is not null").groupBy(*keys, "label_a", "label_b").agg(F.count("*").alias("n"))
    none = F.lit(0).cast("long")
    same = F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(none)
    sides = F.array(
        F.struct(F.col("label_a").alias("label"), F.col("n").alias("na"), none.alias("nb"), same.alias("same")),
        F.struct(F.col("label_b").alias("label"), none.alias("na"), F.col("n").alias("nb"), none.alias("same")),
    )
    per_label = cells.select(*keys, F.explode(sides).alias("s")).groupBy(*keys, "s.label").agg(
        F.sum("s.na").alias("na"), F.sum("s.nb").alias("nb"), F.sum("s.same").alias("same")
    )
    j = per_label.groupBy(*keys).agg(F.sum("na").alias("n"), F.sum("same").alias("same"), F.sum(F.col("na") * F.col("nb")).alias("by_chance"))
    po, pe = F.col("same") / F.col("n"), F.col("by_chance") / (F.col("n") * F.col("n"))
    return j.select(*keys, "n", F.round(po, 6).alias("raw"), F.round(F.try_divide(po - pe, F.when(pe < 1, 1 - pe)), 6).alias("kappa"))


def classification(pairs: DataFrame, gold: str = "gold", guess: str = "guess") -> DataFrame:
    """(label, n_gold, n_guess, precision, recall, f1) per label; undefined ratios are 0."""
    p = pairs.where(F.col(gold).isNotNull() & F.col(guess).isNotNull())
    both = F.explode(F.array_distinct(F.array(gold, guess)))
    t = p.select(F.col(gold).alias("g"), F.col(guess).alias("h"), both.alias("label"))
    s = t.groupBy("label").agg(
        F.sum((F.col("g") == F.col("label")).cast("int")).alias("n_gold"), F.sum((F.col("h") == F.col("label")).cast("int")).alias("n_guess"),
        F.sum(((F.col("g") == F.col("label")) & (F.col("h") == F.col("label"))).cast("int")).alias("hit"),
    )
    zero = F.lit(0.0)
    return s.select(
        "label", "n_gold", "n_guess", F.round(F.coalesce(F.try_divide("hit", "n_guess"), zero), 6).alias("precision"),
        F.round(F.coalesce(F.try_divide("hit", "n_gold"), zero), 6).alias("recall"),
        F.round(F.coalesce(F.try_divide(2 * F.col("hit"), F.col("n_gold") + F.col("n_guess")), zero), 6).alias("f1"),
    )


def macro(report: DataFrame) -> DataFrame:
    """(n, accuracy, macro_f1, weighted_f1) of a report of ``classification``."""
    n = F.sum("n_gold")
    return report.agg(
        n.alias("n"), F.round(F.try_divide(F.sum(F.col("recall") * F.col("n_gold")), n), 5).alias("accuracy"), F.round(F.avg("f1"), 5).alias("macro_f1"),
        F.round(F.try_divide(F.sum(F.col("f1") * F.col("n_gold")), n), 5).alias("weighted_f1"),
    )


def krippendorff(long: DataFrame, *by: str) -> DataFrame:
    """(by..., n_items, alpha): nominal alpha over items with two labels or more."""
    keys = list(by)
    cells = long.where("label is not null").groupBy(*keys, "item", "label").agg(F.count("*").alias("n"))
    cells = cells.withColumn("m", F.sum("n").over(Window.partitionBy(*keys, "item"))).where("m >= 2")
    per_label = cells.groupBy(*keys, "label").agg(
        F.sum("n").alias("k"), F.sum(F.col("n") / F.col("m")).alias("items"), F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1)).alias("apart")
    )
    j = per_label.groupBy(*keys).agg(
        F.round(F.sum("items")).cast("long").alias("n_items"), F.sum("k").alias("all"), F.sum("apart").alias("apart"), F.sum(F.col("k") * F.col("k")).alias("squares")
    )
    mixed = F.col("all") * F.col("all") - F.col("squares")
    d = F.try_divide((F.col("all") - 1) * F.col("apart"), F.when(mixed > 0, mixed))
    return j.select(*keys, "n_items", F.round(1 - d, 6).alias("alpha"))


def majority(long: DataFrame) -> DataFrame:
    """(item, label, votes): most votes; of equals the label of the first coder by name."""
    c = long.where("label is not null").groupBy("item", "label").agg(F.count("*").alias("votes"), F.min("coder").alias("first_coder"))
    w = Window.partitionBy("item").orderBy(F.desc("votes"), "first_coder", "label")
    return c.withColumn("at", F.row_number().over(w)).where("at = 1").select("item", "label", "votes")


def strict(long: DataFrame) -> DataFrame:
    """(item, label): the label of more than half of the coders, else null."""
    c = long.where("label is not null").groupBy("item", "label").agg(F.count("*").alias("n"))
    return c.groupBy("item").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all")).select(
        "item", F.when(F.col("top.n") * 2 > F.col("all"), F.col("top.label")).alias("label")
    )


def average_ranks(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with the average rank of a numeric ``value`` among equals.

    Ranks come from counts per distinct value, so equal values, however many, are one row; the counts
    are summed up in blocks of values.
    """
    counts = rows.groupBy(value).agg(F.count("*").alias("_n"))
    summed = blocks.running_sums(counts, [], blocks.value_blocks(counts, value), [value], {"_upto": F.col("_n")})
    ranks = summed.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias("rank"))
    return rows.join(ranks, value)


def auc(rows: DataFrame, positive: str, score: str) -> DataFrame:
    """(n_pos, n_neg, auc): the chance that a positive scores above a negative, by average ranks."""
    r = average_ranks(rows.where(F.col(positive).isNotNull() & F.col(score).isNotNull()), score)
    p = F.col(positive).cast("int")
    s = r.agg(F.sum(p).alias("n_pos"), F.sum(1 - p).alias("n_neg"), F.sum(p * F.col("rank")).alias("ranks"))
    u = F.col("ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return s.select("n_pos", "n_neg", F.round(F.try_divide(u, F.col("n_pos") * F.col("n_neg")), 6).alias("auc"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho): Pearson of average ranks."""
    r = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    x = average_ranks(r, "a").withColumnRenamed("rank", "ra")
    y = average_ranks(x, "b").withColumnRenamed("rank", "rb")
    return y.agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("rho"))


def pearson(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, r) to two digits, null under three rows."""
    r = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return r.agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.round(F.corr(a, b), 2)).alias("r"))


def share_interval(rows: DataFrame, hit: str, counted: str) -> DataFrame:
    """(k, n, share, low, high, not_counted): share of hits among counted rows with Wilson's interval."""
    k, n = F.sum((F.col(counted) & (F.col(hit) > 0)).cast("int")), F.sum(F.col(counted).cast("int"))
    s = rows.agg(k.alias("k"), n.alias("n"), F.sum((F.col(hit).isNotNull() & ~F.col(counted)).cast("int")).alias("not_counted"))
    low, high = numbers.wilson(F.col("k"), F.col("n"))
    return s.select("k", "n", F.round(F.try_divide("k", "n"), 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), "not_counted")


def bootstrap_kappa(pairs: DataFrame, resamples: int = 2_000, seed: int = 0) -> DataFrame:
    """(resamples, low, high): percentile interval of kappa over Poisson resamples of the pairs.

    Pairs are first counted per cell; a cell of n pairs gets a Poisson count of mean n in each resample,
    drawn by a generator seeded by the cell, so the work is resamples x cells whatever the number of pairs.
    """
    cells = pairs.where("label_a is not null and label_b is not null").groupBy("label_a", "label_b").agg(F.count("*").alias("n"))

    @F.pandas_udf("array<double>")
    def drawn(n: pd.Series, cell: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, c % 2**64]).poisson(k, resamples).astype(float) for k, c in zip(n, cell, strict=True)])

    r = cells.select("label_a", "label_b", F.posexplode(drawn("n", F.xxhash64("label_a", "label_b"))).alias("rep", "w"))
    tot = r.groupBy("rep").agg(F.sum("w").alias("t"), F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("w")).otherwise(0.0)).alias("same"))
    a = r.groupBy("rep", F.col("label_a").alias("l")).agg(F.sum("w").alias("a"))
    b = r.groupBy("rep", F.col("label_b").alias("l")).agg(F.sum("w").alias("b"))
    pe = a.join(b, ["rep", "l"]).groupBy("rep").agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    k = tot.join(pe, "rep").select(F.try_divide(F.col("same") / F.col("t") - F.col("ab") / (F.col("t") * F.col("t")), 1 - F.col("ab") / (F.col("t") * F.col("t"))).alias("k"))
    return k.agg(F.count("k").alias("resamples"), F.percentile("k", F.lit(0.025)).alias("low"), F.percentile("k", F.lit(0.975)).alias("high"))


def bundle(long: DataFrame) -> DataFrame:
    """(unit, side, n, raw, kappa, macro_f1) of labels (unit, side, item, gold, guess) per side and pooled over the sides.

    A unit is what labelled (a model, a coder); null labels don't count; a unit or side without labels has no row.
    """
    some = long.where("gold is not null and guess is not null").select("unit", "side", "gold", "guess")
    both = some.unionByName(some.withColumn("side", F.lit("pooled")))
    k = kappa(both.select("unit", "side", F.col("gold").alias("label_a"), F.col("guess").alias("label_b")), "unit", "side")
    label = F.explode(F.array_distinct(F.array("gold", "guess"))).alias("label")
    per = both.select("unit", "side", "gold", "guess", label).groupBy("unit", "side", "label").agg(
        F.sum((F.col("gold") == F.col("label")).cast("int")).alias("a"), F.sum((F.col("guess") == F.col("label")).cast("int")).alias("b"),
        F.sum(((F.col("gold") == F.col("label")) & (F.col("guess") == F.col("label"))).cast("int")).alias("h"),
    )
    f1 = per.groupBy("unit", "side").agg(F.round(F.avg(2 * F.col("h") / (F.col("a") + F.col("b"))), 5).alias("macro_f1"))
    return k.join(f1, ["unit", "side"]).select("unit", "side", "n", "raw", "kappa", "macro_f1")
