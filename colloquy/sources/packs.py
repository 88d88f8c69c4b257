"""Data packs as positional grids, pipe tables, news feeds and file manifests.

A grid has (file, sheet, row_no, cells array<string>); whatever read the workbook only has to give this
shape. Rules are windows over row_no: the first matching row of a metric wins, the shortest matching
label wins, rows after a stop phrase are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import numbers


def first_matches(grid: DataFrame, patterns: dict[str, str], stop: str | None = None) -> DataFrame:
    """(file, sheet, metric, value, prior): the first row of each metric whose label matches, and its first two figures."""
    g = grid
    if stop:
        ends = g.groupBy("file", "sheet").agg(F.min(F.when(F.lower(F.col("cells")[0]).contains(stop), F.col("row_no"))).alias("_end"))
        g = g.join(ends, ["file", "sheet"], "left").where("_end is null or row_no < _end").drop("_end")
    label = F.regexp_replace(F.lower(F.trim(F.col("cells")[0])), r"\s+", " ")
    metric = F.lit(None).cast("string")
    for name, p in reversed(list(patterns.items())):
        metric = F.when(label.rlike(p), name).otherwise(metric)
    figures = F.filter(F.transform(F.slice("cells", 2, 1000), numbers.to_number), lambda x: x.isNotNull())
    m = g.select("file", "sheet", "row_no", metric.alias("metric"), figures.alias("v")).where("metric is not null and size(v) > 0")
    best = m.groupBy("file", "sheet", "metric").agg(F.min_by("v", "row_no").alias("v"))
    return best.select("file", "sheet", "metric", F.col("v")[0].alias("value"), F.get("v", F.lit(1)).alias("prior"))


def shortest_matches(grid: DataFrame, words: dict[str, str]) -> DataFrame:
    """(file, metric, cells): of the labels that hold a metric's word the shortest, then the first."""
    label = F.lower(F.trim(F.col("cells")[0]))
    hits = F.array(*[F.when(label.contains(w), F.lit(m)) for m, w in words.items()])
    h = grid.select("file", "row_no", "cells", F.length(label).alias("n"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("metric"))
    return h.groupBy("file", "metric").agg(F.min_by("cells", F.struct("n", "row_no")).alias("cells"))


def rescaled(values: DataFrame, above: float = 1e7, by: float = 1e6) -> DataFrame:
    """Figures above ``above`` taken to be in units and brought to millions."""
    return values.withColumns({c: F.when(F.abs(c) > above, F.col(c) / by).otherwise(F.col(c)) for c in ("value", "prior")})


def pipe_table(lines: DataFrame, key: str = "file") -> DataFrame:
    """(key, line_no, cells) of lines written as | a | b |."""
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    return lines.where(F.col("line").contains("|") & ~F.col("line").rlike(r"^[\s|:\-]+$")).select(key, "line_no", cells.alias("cells"))


def feed_items(raw: DataFrame, column: str = "json") -> DataFrame:
    """(title, url, published) of news items in either of two shapes."""
    g = lambda p: F.get_json_object(column, p)
    return raw.select(
        F.coalesce(g("$.content.title"), g("$.title")).alias("title"), F.coalesce(g("$.content.canonicalUrl.url"), g("$.link")).alias("url"),
        F.coalesce(g("$.content.pubDate"), g("$.providerPublishTime")).alias("published"),
    )


def manifest(files: DataFrame, banks: list[str]) -> DataFrame:
    """(path, source, bank, kind, quarter, event_type) of file paths, each once."""
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    year, tag = F.regexp_extract(name, r"(20\d{2})", 1), F.regexp_extract(name, r"20\d{2}.*?(q[1-4]|[1-4]q|interim|annual|fy|h1)", 1)
    same = F.create_map(*[F.lit(x) for kv in {"1q": "q1", "2q": "q2", "3q": "q3", "4q": "q4", "fy": "annual", "h1": "interim"}.items() for x in kv])
    bank = F.lit("other")
    for b in reversed(banks):
        bank = F.when(F.lower("path").contains(b), b).otherwise(bank)
    return files.select("path").distinct().where(~name.startswith("~$")).select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), bank.alias("bank"),
        F.when(name.rlike(r"\.xlsx?$"), "results_pack").otherwise("transcript").alias("kind"),
        F.when((year != "") & (tag != ""), F.concat_ws("-", year, F.coalesce(same[tag], tag))).otherwise(F.regexp_replace(name, r"\.[a-z0-9]+$", "")).alias("quarter"),
        F.when(name.rlike("meeting|fireside|roundtable"), "other").otherwise("results_call").alias("event_type"),
    )


def publication_date(text_column: str = "text"):
    """The first date such as 5 March 2024 in the first 4,000 characters, or an empty string."""
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    return F.regexp_extract(F.substring(text_column, 1, 4000), rf"(?i)\b(\d{{1,2}}\s+(?:{months})\s+20\d{{2}})\b", 1)
