"""Comparisons of banks, periods and metrics: gaps, coverage, presence, change points, directions.

All operators work on every (bank, period) in one plan. Missing stays missing: nothing is filled with
0 but counts inside a grid. Null keys form no group of their own in joins; empty inputs give empty
results; ties are broken by name or id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import config
from colloquy.functions import numbers, periods, text


def peer_gap(scored: DataFrame, peers: tuple[str, str] = config.PEERS, window_only: bool = True) -> DataFrame:
    """(calendar_period, left_mean, right_mean, gap) of the periods both peers have.

    ``scored`` has bank, quarter, net. Both means come from one aggregation; unpaired periods are dropped.
    """
    p = periods.calendar_period(F.col("quarter"))
    base = scored.where(F.lower("bank").isin(*peers) & F.col("net").isNotNull()).select(F.lower("bank").alias("bank"), p.alias("calendar_period"), "net")
    if window_only:
        base = base.where(periods.coverage_window(F.col("calendar_period")) == "both_complete")
    side = [F.avg(F.when(F.col("bank") == b, F.col("net"))) for b in peers]
    return (
        base.groupBy("calendar_period").agg(side[0].alias("left_mean"), side[1].alias("right_mean"))
        .where("left_mean is not null and right_mean is not null")
        .select("calendar_period", *[F.round(c, 6).alias(c) for c in ("left_mean", "right_mean")], F.round(F.col("left_mean") - F.col("right_mean"), 6).alias("gap"))
    )


def peer_sides(scored: DataFrame) -> DataFrame:
    """(bank, calendar_period, n, mean_net, non_neutral_share, informative) of every bank and period."""
    p = periods.calendar_period(F.col("quarter")).alias("calendar_period")
    share = F.avg((F.col("label") != "neutral").cast("double"))
    return scored.where("net is not null").groupBy("bank", p).agg(
        F.count("*").alias("n"), F.round(F.avg("net"), 6).alias("mean_net"), F.round(share, 6).alias("non_neutral_share"), (share > 0).alias("informative")
    )


def coverage_by_year(manifest: DataFrame, peers: tuple[str, str] = config.PEERS) -> DataFrame:
    """(year, left_n, right_n, coverage_window) of transcripts, absent counts as 0."""
    y = periods.year_of(F.col("quarter"))
    n = [F.sum((F.col("bank") == b).cast("int")) for b in peers]
    return (
        manifest.where("kind = 'transcript'").groupBy(y.alias("year")).agg(n[0].alias("left_n"), n[1].alias("right_n"))
        .where("year is not null")
        .withColumn("coverage_window", periods.coverage_window(F.col("year").cast("string")))
    )


def coverage_line(manifest: DataFrame, peers: tuple[str, str] = config.PEERS) -> DataFrame:
    """(n_years, n_paired_years, first_paired, last_paired, left_total, right_total)."""
    c = coverage_by_year(manifest, peers)
    both = (F.col("left_n") > 0) & (F.col("right_n") > 0)
    return c.agg(
        F.count("*").alias("n_years"), F.sum(both.cast("int")).alias("n_paired_years"), F.min(F.when(both, F.col("year"))).alias("first_paired"),
        F.max(F.when(both, F.col("year"))).alias("last_paired"), F.sum("left_n").alias("left_total"), F.sum("right_n").alias("right_total"),
    )


def presence_delta(rows: DataFrame, topic: str = "topic") -> DataFrame:
    """(bank, calendar_period, topic, n_turns, present, n_turns_print, delta) over a bank's prints and topics.

    The grid holds every topic of a bank in every period of the bank; inside it an absent count is 0.
    The grid is joined per bank, so it grows with prints x topics of one bank only.
    """
    base = rows.where(F.col(topic).isNotNull() & F.col("bank").isNotNull() & F.col("quarter").isNotNull()).select(
        "bank", periods.calendar_period(F.col("quarter")).alias("calendar_period"), F.col(topic).alias("topic")
    )
    counts = base.groupBy("bank", "calendar_period", "topic").agg(F.count("*").alias("n_turns"))
    prints = counts.groupBy("bank", "calendar_period").agg(F.sum("n_turns").alias("n_turns_print"))
    topics = counts.select("bank", "topic").distinct()
    grid = prints.join(topics, "bank").join(counts, ["bank", "calendar_period", "topic"], "left").fillna(0, ["n_turns"])
    p = F.col("calendar_period")
    order = Window.partitionBy("bank", "topic").orderBy(periods.year_of(p), periods.period_order(p), p)
    now, before = F.col("n_turns") > 0, F.lag(F.col("n_turns") > 0).over(order)
    return grid.select(
        "bank", "calendar_period", "topic", "n_turns", now.alias("present"), "n_turns_print",
        F.when(before.isNull(), F.when(now, "first_seen").otherwise("first_absent"))
        .when(now & ~before, "appeared").when(~now & before, "disappeared").when(now, "continued").otherwise("still_absent").alias("delta"),
    )


def rolling_flags(series: DataFrame, value: str = "net", window: int = 3, least: int = 2, limit: float = 1.5) -> DataFrame:
    """(bank, calendar_period, value, z, changepoint): against the ``window`` prior periods of the bank.

    Without spread in the prior periods any other value is a change point; without ``least`` of them none is.
    """
    p = F.col("calendar_period")
    prior = Window.partitionBy("bank").orderBy(periods.year_of(p), periods.period_order(p), p).rowsBetween(-window, -1)
    n, m, sd = F.count(value).over(prior), F.avg(value).over(prior), F.stddev_samp(value).over(prior)
    z = F.when(n >= least, F.try_divide(F.col(value) - m, sd))
    flat = (n >= least) & (sd < 1e-12)
    flag = F.when(flat, F.abs(F.col(value) - m) > 1e-9).otherwise(F.coalesce(F.abs(z) > limit, F.lit(False)))
    return series.select("bank", "calendar_period", F.col(value).alias("value"), F.round(F.when(~flat, z), 4).alias("z"), flag.alias("changepoint"))


def bank_series(scored: DataFrame) -> DataFrame:
    """(bank, calendar_period, net): the mean of each bank and shared period."""
    p = periods.calendar_period(F.col("quarter")).alias("calendar_period")
    return scored.where("net is not null and bank is not null").groupBy("bank", p).agg(F.round(F.avg("net"), 6).alias("net"))


def topic_shares(rows: DataFrame, topic: str = "seed_topic", label: str = "label") -> DataFrame:
    """(topic, n, mean_net, negative_share, neutral_share, positive_share)."""
    shares = [F.round(F.avg((F.col(label) == x).cast("double")), 6).alias(f"{x}_share") for x in config.LABELS]
    return rows.where(F.col(label).isNotNull()).groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("n"), F.round(F.avg("net"), 6).alias("mean_net"), *shares)


def bank_trend(rows: DataFrame) -> DataFrame:
    """(bank, calendar_period, n, mean_net, n_negative, n_neutral, n_positive, neg_share, n_topics)."""
    n = [F.sum((F.col("label") == x).cast("int")).alias(f"n_{x}") for x in config.LABELS]
    return rows.where("label is not null").groupBy("bank", periods.calendar_period(F.col("quarter")).alias("calendar_period")).agg(
        F.count("*").alias("n"), F.round(F.avg("net"), 6).alias("mean_net"), *n,
        F.round(F.avg((F.col("label") == "negative").cast("double")), 6).alias("neg_share"), F.count_distinct("topic").alias("n_topics"),
    )


def softest(scored: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` bank quarters with the lowest mean."""
    g = scored.where("net is not null").groupBy("bank", "quarter").agg(F.round(F.avg("net"), 6).alias("mean_net"), F.count("*").alias("n"))
    return g.orderBy("mean_net", "bank", "quarter").limit(k)


def shared_periods(scored: DataFrame, least: int = 2) -> DataFrame:
    """(calendar_period, n_banks) of periods that at least ``least`` banks have."""
    p = periods.calendar_period(F.col("quarter")).alias("calendar_period")
    return scored.groupBy(p).agg(F.count_distinct("bank").alias("n_banks")).where(F.col("n_banks") >= least)


def reported_metrics(claims: DataFrame, bank: str = "bank") -> DataFrame:
    """(bank, calendar_period, metric, value, prior, direction): means of claims and their prior period.

    Values are summed in whole hundredths, so the mean does not depend on the order of rows.
    """
    p = periods.calendar_period(F.col("quarter")).alias("calendar_period")
    g = claims.where("metric is not null and value is not null and bank is not null").groupBy("bank", p, "metric").agg(F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("*") / 100, 4).alias("value"))
    c = F.col("calendar_period")
    w = Window.partitionBy("bank", "metric").orderBy(periods.year_of(c), periods.period_order(c), c)
    g = g.withColumn("prior", F.lag("value").over(w))
    return g.withColumn("direction", numbers.reported_direction(F.col("value"), F.col("prior"), F.col("metric")))


def narrative(scored: DataFrame) -> DataFrame:
    """(bank, calendar_period, metric, sentiment_net, n_turns): tone of the turns that name a metric, and overall."""
    n = text.normal(F.col("text"))
    named = F.array(*[F.when(text.any_keyword(n, words), F.lit(m)) for m, words in config.METRIC_WORDS.items()], F.lit("overall"))
    p = periods.calendar_period(F.col("quarter")).alias("calendar_period")
    return (
        scored.where("net is not null and bank is not null").select("bank", p, "net", F.explode(F.filter(named, lambda m: m.isNotNull())).alias("metric"))
        .groupBy("bank", "calendar_period", "metric").agg(F.round(F.avg("net"), 6).alias("sentiment_net"), F.count("*").alias("n_turns"))
    )


def struct_vs_narrative(scored: DataFrame, claims: DataFrame) -> DataFrame:
    """Reported against narrative direction of each bank, period and metric that both have."""
    j = narrative(scored).join(reported_metrics(claims), ["bank", "calendar_period", "metric"])
    told = numbers.narrative_direction(F.col("sentiment_net"), F.col("metric"))
    return j.select("bank", "calendar_period", "metric", "sentiment_net", "direction", told.alias("narrative_direction"), (told == F.col("direction")).alias("agrees"))


def divergence(compared: DataFrame) -> DataFrame:
    """(metric, n, divergence_rate)."""
    return compared.groupBy("metric").agg(F.count("*").alias("n"), F.round(1 - F.avg(F.col("agrees").cast("double")), 6).alias("divergence_rate"))


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) with margins: null stands for all."""
    r = rows.select(F.coalesce(F.col(a), F.lit("(none)")).alias("a"), F.coalesce(F.col(b), F.lit("(none)")).alias("b"))
    return r.cube("a", "b").agg(F.count("*").alias("n")).select(F.coalesce("a", F.lit("(all)")).alias("a"), F.coalesce("b", F.lit("(all)")).alias("b"), "n")


def drift_grid(rows: DataFrame, topic: str, when: Column) -> DataFrame:
    """(topic, quarter_start, n) for every topic and calendar quarter, 0 where absent."""
    base = rows.where(F.col(topic).isNotNull()).select(F.col(topic).alias("topic"), F.date_trunc("quarter", when).cast("date").alias("quarter_start")).where("quarter_start is not null")
    counts = base.groupBy("topic", "quarter_start").agg(F.count("*").alias("n"))
    span = base.agg(F.min("quarter_start").alias("lo"), F.max("quarter_start").alias("hi")).first()
    if span["lo"] is None:
        return counts
    steps = F.explode(F.sequence(F.lit(span["lo"]), F.lit(span["hi"]), F.expr("interval 3 months"))).alias("quarter_start")
    return counts.select("topic").distinct().select("topic", steps).join(counts, ["topic", "quarter_start"], "left").fillna(0, ["n"])


def topics_over_time(rows: DataFrame, topic: str, when: str, bins: int) -> DataFrame:
    """(topic, bin, n): frequency per topic in equal bins of the whole span."""
    t = F.unix_timestamp(F.col(when).cast("timestamp"))
    base = rows.where(F.col(topic).isNotNull() & F.col(when).isNotNull()).select(F.col(topic).alias("topic"), t.alias("t"))
    span = base.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    if span["lo"] is None:
        return base.select("topic", F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n"))
    width = max(1, span["hi"] - span["lo"])
    b = F.least(F.lit(bins - 1), F.floor((F.col("t") - span["lo"]) * bins / width)).cast("int")
    return base.groupBy("topic", b.alias("bin")).agg(F.count("*").alias("n"))


def press_against_calls(press: DataFrame, calls: DataFrame, least: int = 3) -> DataFrame:
    """(bank, n_press, press_net, calls_net, gap, treat_as_signal); a missing side stays null."""
    a = press.where("net is not null").groupBy("bank").agg(F.count("*").alias("n_press"), F.round(F.avg("net"), 6).alias("press_net"))
    b = calls.where("net is not null").groupBy("bank").agg(F.round(F.avg("net"), 6).alias("calls_net"))
    return a.join(b, "bank", "left").select("bank", "n_press", "press_net", "calls_net", F.round(F.col("press_net") - F.col("calls_net"), 6).alias("gap"), (F.col("n_press") >= least).alias("treat_as_signal"))


def attach_topic(pairs: DataFrame, corpus: DataFrame, topic: str) -> DataFrame:
    """``pairs`` with the topic of the corpus row of the same bank, quarter and trimmed text; null if none has it.

    A text of several rows has the topic of the smallest row_id that has one, so no pair is doubled.
    """
    key = F.trim("text")
    once = (
        corpus.where(F.col(topic).isNotNull() & F.col("text").isNotNull()).groupBy(F.col("bank").alias("_b"), F.col("quarter").alias("_q"), key.alias("_t"))
        .agg(F.min_by(topic, "row_id").alias(topic))
    )
    on = (F.col("bank") == F.col("_b")) & (F.col("quarter") == F.col("_q")) & (F.trim("question_text") == F.col("_t"))
    return pairs.join(once, on, "left").drop("_b", "_q", "_t")


def topic_quarter_net(scored: DataFrame, topic: str) -> DataFrame:
    """(topic, quarter, mean_net, n): tone of a topic in each quarter; rows without a net don't count."""
    return scored.where("net is not null").groupBy(F.col(topic).alias("topic"), "quarter").agg(F.round(F.avg("net"), 6).alias("mean_net"), F.count("*").alias("n"))


def quotes(scored: DataFrame, key: str, by: list[str], most: int = 5) -> DataFrame:
    """The ``most`` rows of each group by label (negative first, as in the alphabet), then strength, then key."""
    w = Window.partitionBy(*by).orderBy(F.col("label").asc_nulls_last(), F.abs("net").desc_nulls_last(), key)
    return scored.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
