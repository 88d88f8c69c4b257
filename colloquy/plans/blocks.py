"""Running sums and ranks over groups of any size, in blocks.

A window over a whole group runs in one task. Here a group is cut into blocks that are monotone in the
order; windows run inside (group, block), and one row per block carries the sums across, so a group
that holds a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, by: list[str], block: Column, order: list, sums: dict[str, Column]) -> DataFrame:
    """``df`` with columns of ``sums`` summed up to and with each row, over its group in ``order``.

    ``block`` must never fall along the order. Null group keys form a group of their own.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    marked = df.withColumn("_block", block).withColumns({f"_v_{n}": c.cast("long") for n, c in sums.items()})
    same = [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys, strict=True)]
    per_block = marked.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col("_block").alias("_b")).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    here = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = F.col("_block").eqNullSafe(F.col("_b"))
    for s in same:
        on = on & s
    out = marked.join(offsets, on).withColumns({n: F.sum(f"_v_{n}").over(here) + F.col(f"_o_{n}") for n in sums})
    return out.drop("_block", "_b", *keys, *[f"_v_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def value_blocks(df: DataFrame, value: str, blocks: int = 64) -> Column:
    """A block number that never falls with a numeric value, from approximate quantiles of all rows."""
    cuts = sorted(set(df.approxQuantile(value, [i / blocks for i in range(1, blocks)], 0.002)))
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(value).cast("double")))
