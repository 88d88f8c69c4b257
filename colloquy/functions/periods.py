"""Reporting-period labels as columns: shared periods, years, order, bands, short forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy import config


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def calendar_period(quarter: Column) -> Column:
    """The shared period of a label such as 2021-interim; a label without one stays as it is."""
    q = F.trim(F.lower(quarter))
    year, tag = F.regexp_extract(q, r"^(20\d{2})[-_]?(.*)$", 1), F.regexp_extract(q, r"^(20\d{2})[-_]?(.*)$", 2)
    named = _lookup(config.PERIOD_TAGS, tag)
    return F.when((year != "") & named.isNotNull(), F.concat_ws("-", year, named)).otherwise(quarter)


def year_of(label: Column) -> Column:
    """The first year 20xx in a label, or null."""
    return F.regexp_extract(label, r"(20\d{2})", 1).try_cast("int")


def coverage_window(label: Column, years: tuple[int, int] = config.PEER_YEARS) -> Column:
    """unknown, single_bank, both_complete or partial, by the label's year."""
    y = year_of(label)
    return F.when(y.isNull(), "unknown").when(y < years[0], "single_bank").when(y > years[1], "partial").otherwise("both_complete")


def period_order(label: Column) -> Column:
    """Place of the label's shared period in its year, 9 if it has none; order by year_of first."""
    tag = F.regexp_extract(calendar_period(label), r"^20\d{2}-(H1q1|H1|Q3|FY)$", 1)
    return F.coalesce(_lookup(config.PERIOD_ORDER, tag), F.lit(9))


def compact_label(label: Column) -> Column:
    """14H1 for 2014-interim; a label without a shared period stays as it is."""
    p = calendar_period(label)
    year, tag = F.regexp_extract(p, r"^20(\d{2})-(H1q1|H1|Q3|FY)$", 1), F.regexp_extract(p, r"^20(\d{2})-(H1q1|H1|Q3|FY)$", 2)
    return F.when(year != "", F.concat(year, _lookup(config.PERIOD_SHORT, tag))).otherwise(label)


def period_date(label: Column) -> Column:
    """A distinct date for every period of a year, or null."""
    day = {"q1": "03-31", "q2": "06-29", "interim": "06-30", "h1": "06-28", "q3": "09-30", "q4": "12-30", "annual": "12-31", "fy": "12-29"}
    q = F.lower(F.trim(label))
    md = _lookup(day, F.regexp_extract(q, r"^20\d{2}[-_]?(.*)$", 1))
    return F.concat_ws("-", F.regexp_extract(q, r"^(20\d{2})", 1), md).try_cast("date")


def period_bucket(label: Column) -> Column:
    """2024+, 2020-23 or pre-2020."""
    y = year_of(label)
    return F.when(y >= 2024, "2024+").when(y >= 2020, "2020-23").when(y.isNotNull(), "pre-2020").otherwise("unknown")


def pack_quarter(bank: Column, label: Column, banks: tuple[str, ...]) -> Column:
    """The label a bank's data pack uses: for ``banks`` interim is q2 and annual is fy."""
    return F.when(bank.isin(*banks), F.regexp_replace(F.regexp_replace(label, "interim$", "q2"), "annual$", "fy")).otherwise(label)


def episode_id(bank: Column, label: Column) -> Column:
    """A slug of bank and period."""
    return F.concat_ws("_", F.translate(F.lower(bank), " -", "__"), F.translate(F.lower(label), " -", "__"))


def bin_count(first: Column, last: Column, days: float) -> Column:
    """How many bins of ``days`` a span of dates has, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.datediff(last, first) / F.lit(days)).cast("int"))
