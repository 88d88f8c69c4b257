"""Numeric scalars as columns: intervals, directions, numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import config


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of Wilson's interval for k of n; (0, 0) for none."""
    p = F.try_divide(k, n)
    den = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / den
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    low, high = F.greatest(F.lit(0.0), centre - margin), F.least(F.lit(1.0), centre + margin)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def reported_direction(now: Column, before: Column, metric: Column, rescale: bool = False) -> Column:
    """up, down or flat against the prior figure; costs and impairment by absolute value."""
    absolute = metric.isin(*config.ABSOLUTE_METRICS)
    c, p = F.when(absolute, F.abs(now)).otherwise(now), F.when(absolute, F.abs(before)).otherwise(before)
    if rescale:
        c, p = F.when((F.abs(c) <= 1) & (F.abs(p) > 1), c * 100).otherwise(c), F.when((F.abs(p) <= 1) & (F.abs(c) > 1), p * 100).otherwise(p)
    change = F.try_divide(c - p, F.abs(p))
    return F.when(change.isNull() | (F.abs(change) <= config.FLAT), "flat").when(change > 0, "up").otherwise("down")


def narrative_direction(net: Column, metric: Column, band: float = config.NARRATIVE_BAND) -> Column:
    """Tone as a direction; turned for costs and impairment."""
    turned = metric.isin(*config.ABSOLUTE_METRICS)
    up, down = F.when(turned, "down").otherwise("up"), F.when(turned, "up").otherwise("down")
    return F.when(net > band, up).when(net < -band, down).when(net.isNotNull(), "flat")


def to_number(text: Column) -> Column:
    """A figure written with commas as a double, or null."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def signed_net(label: Column, score: Column) -> Column:
    """The score with the sign of its label; 0 for neutral, null for others."""
    return F.when(label == "positive", score).when(label == "negative", -score).when(label == "neutral", F.lit(0.0))


def topic_size(n: Column) -> Column:
    """Least topic size of a corpus: max(4, min(40, n // 50))."""
    return F.greatest(F.lit(4), F.least(F.lit(40), F.expr("1").cast("int") * F.floor(n / 50).cast("int")))
