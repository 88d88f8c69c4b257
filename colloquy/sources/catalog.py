"""Tables, documents and assets of a store folder; reviewed tables and exports.

A store is a folder with ``tables/<name>`` (parquet), ``csv/<name>.csv`` as a fallback, and
``documents`` (name, mime, body) and ``assets`` (name, mime, bytes) as parquet tables.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def slug(name: str) -> str:
    """A table's name as a folder name."""
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


class Store:
    """A folder of named tables."""

    def __init__(self, spark: SparkSession, root: str, aliases: dict[str, str] | None = None):
        self.spark, self.root, self.aliases = spark, root.rstrip("/"), aliases or {}

    def path(self, name: str) -> str:
        return f"{self.root}/tables/{slug(self.aliases.get(name, name))}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def has(self, name: str) -> bool:
        return self._exists(self.path(name))

    def names(self) -> list[str]:
        """The tables of the store in order of name."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/tables")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def load(self, name: str) -> DataFrame:
        """The parquet table, else the CSV of that name, else FileNotFoundError."""
        if self.has(name):
            return self.spark.read.parquet(self.path(name))
        csv = f"{self.root}/csv/{slug(name)}.csv"
        if self._exists(csv):
            return read_strings(self.spark, csv)
        raise FileNotFoundError(name)

    def save(self, df: DataFrame, name: str, by: list[str] | None = None) -> None:
        """Replace a table; with ``by`` it is partitioned, for pruning and for replacing one group."""
        w = df.write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(self.path(name))

    def replace_groups(self, df: DataFrame, name: str, by: list[str]) -> None:
        """Replace only the partitions that ``df`` has."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(self.path(name))

    def put(self, rows: DataFrame, name: str, key: str, version: str = "a") -> None:
        """Upsert rows of a keyed table such as documents or assets, newest wins."""
        if self.has(name):
            old = self.load(name)
            rows = old.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)
            rows.write.mode("overwrite").parquet(self.path(f"{name}_{version}_next"))
            rows = self.spark.read.parquet(self.path(f"{name}_{version}_next"))
        self.save(rows, name)

    def document(self, name: str) -> str | None:
        r = self.load("documents").where(F.col("name") == name).select("body").first()
        return r["body"] if r else None


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column a string, blanks as empty strings."""
    t = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return t.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in t.columns])


def read_labels(spark: SparkSession, paths: list[str], key: str, value: str) -> DataFrame:
    """(coder, key, label) of coders' files named <pack>_labels_<coder>.csv."""
    t = spark.read.option("header", True).csv(paths).withColumn("_file", F.input_file_name())
    return t.select(F.regexp_extract("_file", r"labels_([^/.]+)\.csv$", 1).alias("coder"), F.col(key), F.nullif(F.trim(value), F.lit("")).alias("label"))


def overlay(base: DataFrame, changes: DataFrame, key: str, column: str, new: str) -> DataFrame:
    """``base`` with ``column`` replaced where ``changes`` has a value for its key."""
    c = changes.select(key, F.col(new).alias("_new")).where("_new is not null and _new <> ''").dropDuplicates([key])
    return base.join(c, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def export(df: DataFrame, path: str, drop: list[str] | None = None) -> None:
    """One CSV with a header, without the named columns; nested columns as JSON. For small result tables."""
    kept = df.drop(*(drop or []))
    flat = [F.to_json(F.col(c)).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in kept.dtypes]
    kept.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df``, or an error if it is empty."""
    if df.isEmpty():
        raise AnalysisException(message=message)
    return df


def problems(labels: DataFrame, items: DataFrame, key: str, column: str, allowed: list[str]) -> DataFrame:
    """(key, problem) of every fault of a coder's file: unknown, missing or repeated items, and labels not allowed."""
    bad = labels.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed)).select(key, F.lit("label not allowed").alias("problem"))
    unknown = labels.join(items.select(key), key, "left_anti").select(key, F.lit("unknown item").alias("problem"))
    missing = items.join(labels.select(key), key, "left_anti").select(key, F.lit("missing item").alias("problem"))
    twice = labels.groupBy(key).count().where("count > 1").select(key, F.lit("repeated item").alias("problem"))
    return bad.unionByName(unknown).unionByName(missing).unionByName(twice)


def read_lexicon(spark: SparkSession, path: str, word: str = "Word") -> DataFrame:
    """(category, word): the words of each category of a lexicon CSV, one column a category, where the value is above 0."""
    t = read_strings(spark, path)
    categories = [c for c in t.columns if c != word]
    long = F.explode(F.array(*[F.struct(F.lower(F.lit(c)).alias("category"), F.col(f"`{c}`").try_cast("double").alias("v")) for c in categories]))
    return t.select(F.lower(F.trim(word)).alias("word"), long.alias("x")).where("x.v > 0 and word <> ''").select("x.category", "word").distinct()


def category_counts(rows: DataFrame, key: str, column: str, lexicon: DataFrame) -> DataFrame:
    """(key, category, n): words of each category of a lexicon in each text; a category without any has no row."""
    words = rows.select(key, F.explode(F.regexp_extract_all(F.lower(column), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    return words.join(lexicon, "word").groupBy(key, "category").agg(F.sum("n").alias("n"))
