"""Topics: nearest centroid, LDA with an outlier class, NMF word lists, top words, coherence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy import config
from colloquy.functions import text


def nearest_centroid(vectors: DataFrame, key: str = "vec_id", label: str = "label", column: str = "embedding") -> DataFrame:
    """(key, topic): the label whose mean vector is nearest; of equals the smaller label.

    The centroids are one row per label; they are gathered into one small array and compared within the
    row, so the vectors are neither exploded against them nor moved.
    """
    parts = vectors.select(label, F.posexplode(column).alias("i", "x"))
    means = parts.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select(label, F.col("v.m").alias("v")).collect()
    if not rows:
        return vectors.select(key, F.col(label).alias("topic"))
    centres = F.array(*[F.struct(F.lit(r[0]).alias("topic"), F.array(*[F.lit(float(x)) for x in r[1]]).alias("v")) for r in sorted(rows)])
    dist = F.transform(
        centres,
        lambda c: F.struct(
            F.round(F.aggregate(F.zip_with(F.col(column), c["v"], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x), 6).alias("d"),
            c["topic"].alias("topic"),
        ),
    )
    return vectors.select(key, F.array_min(dist)["topic"].alias("topic"))


def _terms(rows: DataFrame, key: str, column: str) -> DataFrame:
    w = F.filter(text.tokens(F.col(column), "[a-z]{3,}"), lambda x: ~x.isin(config.STOP_WORDS))
    return rows.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(key, w.alias("terms")).where(F.size("terms") > 0)


def lda(rows: DataFrame, key: str, column: str, k: int = 6, least: float = 0.15, seed: int = 42) -> DataFrame:
    """(key, topic, strength): the strongest LDA topic, -1 under ``least``."""
    docs = _terms(rows, key, column)
    if docs.isEmpty():
        return docs.select(key, F.lit(-1).alias("topic"), F.lit(0.0).alias("strength"))
    counts = CountVectorizer(inputCol="terms", outputCol="features", minDF=2.0, vocabSize=20_000).fit(docs).transform(docs)
    model = LDA(k=k, maxIter=10, seed=seed, optimizer="online", featuresCol="features").fit(counts)
    p = vector_to_array("topicDistribution")
    top = F.array_max(p)
    return model.transform(counts).select(key, F.when(top < least, -1).otherwise(F.array_position(p, top).cast("int") - 1).alias("topic"), F.round(top, 4).alias("strength"))


def nmf_words(rows: DataFrame, key: str, column: str, k: int = 6, words: int = 300, rounds: int = 60, most: int = 8, seed: int = 42) -> DataFrame:
    """(topic, rank, word, weight): topics by non-negative factors of the words' co-occurrence.

    The words are the ``words`` most frequent ones, so the matrix that is factored on the driver has a
    fixed size; its counts come from all rows.
    """
    t = _terms(rows, key, column).select(F.array_distinct("terms").alias("terms"))
    top = [r["w"] for r in t.select(F.explode("terms").alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(words).collect()]
    spark = rows.sparkSession
    if not top:
        return spark.createDataFrame([], "topic int, rank int, word string, weight double")
    kept = t.select(F.array_intersect("terms", F.array(*[F.lit(w) for w in top])).alias("x"))
    cells = kept.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).collect()
    at = {w: i for i, w in enumerate(top)}
    m = np.zeros((len(top), len(top)))
    for r in cells:
        m[at[r["a"]], at[r["b"]]] = r["n"]
    d = np.maximum(m.diagonal(), 1.0)
    m = m / np.sqrt(np.outer(d, d))
    rnd = np.random.default_rng(seed)
    w, h = rnd.random((len(top), k)) + 0.1, rnd.random((k, len(top))) + 0.1
    for _ in range(rounds):
        h *= (w.T @ m) / (w.T @ w @ h + 1e-9)
        w *= (m @ h.T) / (w @ (h @ h.T) + 1e-9)
    out = []
    for j in range(k):
        share = h[j] / max(h[j].sum(), 1e-12)
        for rank, i in enumerate(np.argsort(-share)[:most], 1):
            out.append((j, rank, top[i], round(float(share[i]), 6)))
    return spark.createDataFrame(pd.DataFrame(out, columns=["topic", "rank", "word", "weight"]), "topic int, rank int, word string, weight double")


def top_words(rows: DataFrame, key: str, topic: str, column: str, k: int = 10) -> DataFrame:
    """(topic, word, n, rank): the words that most texts of a topic have."""
    w = F.array_distinct(F.filter(text.tokens(F.col(column), "[a-z]{3,}"), lambda x: ~x.isin(config.STOP_WORDS)))
    c = rows.select(key, F.col(topic).alias("topic"), F.explode(w).alias("word")).groupBy("topic", "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy("topic").orderBy(F.desc("n"), "word")
    return c.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def coherence(rows: DataFrame, words: DataFrame, key: str, column: str) -> DataFrame:
    """(topic, n_pairs, npmi): mean normalised mutual information of a topic's words over whole texts.

    ``words`` is (topic, word), a few per topic. Texts are reduced to the words asked about before any
    pair is formed, so a text gives at most the pairs of one topic's words.
    """
    asked = words.select("topic", "word").distinct()
    has = F.array_distinct(text.tokens(F.col(column), "[a-z]{3,}"))
    told = rows.select(F.col(key).alias("key"), F.explode(has).alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
    n = rows.count()
    one = told.groupBy("word").agg(F.count("*").alias("n"))
    kept = told.join(asked, "word").groupBy("topic", "key").agg(F.array_sort(F.collect_set("word")).alias("w")).where(F.size("w") > 1)
    pairs = (
        kept.select("topic", F.posexplode("w").alias("i", "a"), "w").select("topic", "a", F.explode(F.slice("w", F.col("i") + 2, F.size("w"))).alias("b"))
        .groupBy("topic", "a", "b").agg(F.count("*").alias("both"))
    )
    j = pairs.join(one.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(one.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    pmi = F.log(F.col("both") * n / (F.col("na") * F.col("nb")))
    npmi = F.when(F.col("both") == n, 1.0).otherwise(pmi / -F.log(F.col("both") / n))
    return j.groupBy("topic").agg(F.count("*").alias("n_pairs"), F.round(F.avg(npmi), 4).alias("npmi"))
