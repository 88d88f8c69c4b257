"""Turns into question and answer pairs, by windows over each source.

A question is a turn of an analyst, or of somebody tagged analyst elsewhere in the source (a follow-up).
Its answer are the management turns up to the first other turn. Ids number the analysts' questions, in
three figures or more; follow-ups keep the number and add a letter, from the 26th on z and their number. Rows of a (source, turn_no) delivered again count once.
Null sources or turn numbers are left out; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text
from colloquy.plans import blocks

#: Turn numbers of a block of a source.
BLOCK = 4096


def one_row_per_turn(turns: DataFrame) -> DataFrame:
    """The row of each (source, turn_no) with the smallest row_id."""
    cols = [c for c in ("speaker", "firm", "role", "text", "bank", "quarter", "seed_topic") if c in turns.columns]
    return (
        turns.where("source is not null and turn_no is not null").groupBy("source", "turn_no")
        .agg(F.min_by(F.struct(*cols), "row_id").alias("r")).select("source", "turn_no", "r.*")
    )


def pair_qa(turns: DataFrame) -> DataFrame:
    """(pair_id, bank, quarter, source, question_turn, analyst, question_text, answer_text, n_answer_turns)."""
    name = F.regexp_replace(F.lower(F.trim(F.coalesce("speaker", F.lit("")))), r"\s+", " ")
    base = one_row_per_turn(turns).withColumn("name", name)
    asked = base.where("role = 'analyst' and name <> ''").select("source", "name", F.lit(True).alias("asked")).distinct()
    is_a = F.coalesce(F.col("role") == "analyst", F.lit(False))
    marked = base.join(asked, ["source", "name"], "left").withColumn("is_a", is_a).withColumn("is_q", F.col("is_a") | F.coalesce("asked", F.lit(False)))
    numbered = blocks.running_sums(marked, ["source"], F.expr(f"turn_no div {BLOCK}"), ["turn_no"], {"qid": F.col("is_q").cast("int"), "pid": F.col("is_a").cast("int")})
    in_pair = Window.partitionBy("source", "pid").orderBy("turn_no")
    follow = F.sum((F.col("is_q") & ~F.col("is_a")).cast("int")).over(in_pair)
    in_q = Window.partitionBy("source", "qid").orderBy("turn_no")
    managed = F.min(F.when(F.col("is_q"), F.lit(1)).otherwise(F.coalesce((F.col("role") == "management").cast("int"), F.lit(0)))).over(in_q)
    rows = numbered.withColumn("follow", follow).withColumn("managed", managed).where("qid > 0 and (is_q or managed = 1)")
    answers = F.array_sort(F.collect_list(F.when(~F.col("is_q"), F.struct("turn_no", F.coalesce("text", F.lit("")).alias("text")))))
    q = F.max(F.when(F.col("is_q"), F.struct("turn_no", "bank", "quarter", "speaker", "text", "pid", "follow")))
    f, pid = F.col("q.follow"), F.col("q.pid").cast("string")
    letter = F.when(f > 25, F.concat(F.lit("z"), f.cast("string"))).when(f > 0, F.char(F.lit(97) + f)).otherwise("")
    number = F.when(F.length(pid) < 3, F.lpad(pid, 3, "0")).otherwise(pid)  # lpad alone would cut a longer number
    return (
        rows.groupBy("source", "qid").agg(q.alias("q"), answers.alias("a"))
        .select(
            F.concat(F.coalesce("q.bank", F.lit("")), F.lit("_"), F.coalesce("q.quarter", F.lit("")), F.lit("_"), number, letter).alias("pair_id"),
            "q.bank", "q.quarter", "source", F.col("q.turn_no").alias("question_turn"), F.col("q.speaker").alias("analyst"), F.col("q.text").alias("question_text"),
            F.array_join(F.transform("a", lambda x: x["text"]), " ").alias("answer_text"), F.size("a").alias("n_answer_turns"),
        )
    )


def safe_ids(pairs: DataFrame) -> DataFrame:
    """``pairs`` with their ids as source_pair_id, and in pair_id the source's slug added to ids that more than one row has.

    A null source is ``unknown-source``. Rows of one source that share an id keep sharing one.
    """
    bare = F.regexp_replace(F.coalesce("source", F.lit("unknown-source")), r"\.[^.]+$", "")
    slug = F.lower(F.regexp_replace(F.regexp_replace(bare, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    shared = pairs.groupBy("pair_id").agg(F.count("*").alias("_n")).where("_n > 1")
    return (
        pairs.join(shared, "pair_id", "left")
        .withColumn("source_pair_id", F.col("pair_id"))
        .withColumn("pair_id", F.when(F.col("_n") > 1, F.concat("pair_id", F.lit("__"), slug)).otherwise(F.col("pair_id"))).drop("_n")
    )


def split_bleed(question: str, names: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose ``question`` holds a line that is only a known name: the text before, and from it on.

    Lines are joined with ``names`` (name), however many there are; a row without a question keeps it.
    """
    cols = [F.col(c) for c in rows.columns]
    known = names.where("name is not null").select(F.trim("name").alias("_line"), F.lit(True).alias("_known")).distinct()
    numbered = rows.withColumn("_row", F.monotonically_increasing_id()).select(
        "_row", F.struct(*cols).alias("_r"), F.posexplode_outer(F.split(F.col(question), "\n")).alias("_at", "_text")
    )
    first = (
        numbered.withColumn("_line", F.trim(F.translate("_text", "\t\r", "  "))).join(known, "_line", "left")
        .groupBy("_row").agg(F.first("_r").alias("_r"), F.min(F.when(F.col("_known"), F.col("_at"))).alias("_at"))
    )
    lines, q, found = F.split(F.col(question), "\n"), F.col(question), F.col("_at").isNotNull()

    def tidy(c):
        return F.regexp_replace(c, r"^\s+|\s+$", "")

    before = F.when(found, tidy(F.array_join(F.slice(lines, F.lit(1), F.col("_at")), "\n"))).otherwise(q)
    bleed = F.when(found, tidy(F.array_join(F.slice(lines, F.col("_at") + 1, F.size(lines)), "\n"))).otherwise(F.lit(""))
    return first.select("_r.*", "_at").withColumn("before", before).withColumn("bleed", bleed).drop("_at")


def behaviour(pairs: DataFrame) -> DataFrame:
    """(pair_id, directness, directness_v2, metric_coverage, topic_substitution, substitution_measurable).

    A blank question or answer is missing, not indirect; only pairs with one bucket on each side can
    be measured for substitution.
    """
    from colloquy import config

    q, a = F.col("question_text"), F.col("answer_text")
    nq, na = F.col("nq"), F.col("na")
    missing = text.blank(q) | text.blank(a)
    asked = [text.any_keyword(nq, w) for w in config.METRIC_WORDS.values()]
    told = [text.any_keyword(na, w) for w in config.METRIC_WORDS.values()]
    any_asked, covered = F.lit(False), F.lit(False)
    for x, y in zip(asked, told, strict=True):
        any_asked, covered = any_asked | x, covered | (x & y)
    single = ~F.col("bq").isin("untagged", "mixed") & ~F.col("ba").isin("untagged", "mixed")
    return (
        pairs.withColumn("nq", text.normal(q)).withColumn("na", text.normal(a))
        .withColumn("bq", text.bucket(nq)).withColumn("ba", text.bucket(na))
        .select(
            "pair_id", "bank", "quarter", text.directness_v1(q, a).alias("directness"), text.directness_v2(q, a).alias("directness_v2"),
            F.when(~missing & any_asked, covered.cast("double")).alias("metric_coverage"),
            F.when(~missing, (single & (F.col("bq") != F.col("ba"))).cast("double")).alias("topic_substitution"),
            (~missing & single).alias("substitution_measurable"),
        )
    )
