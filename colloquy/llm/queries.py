"""Driver queries of the operators in this subpackage, named pN_..., and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import abuse as _abuse
from colloquy.llm import consensus as _consensus
from colloquy.llm import encode as _encode
from colloquy.llm import leakage as _leakage
from colloquy.llm import overlap as _overlap
from colloquy.llm import pairs as _pairs
from colloquy.llm import scans as _scans
from colloquy.llm import sentences as _sentences
from colloquy.llm import turns as _turns
from colloquy.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _turns.clean_turns(table(spark, sf, "corpus_analyst"), table(spark, sf, "speakers"))


def p1_turn_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _turns.turn_texts(table(spark, sf, "corpus_analyst"), table(spark, sf, "speakers"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _consensus.consensus(table(spark, sf, "coder_labels"))


def p2_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return _consensus.agreement(table(spark, sf, "coder_labels"))


def p2_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return _consensus.reliability(table(spark, sf, "coder_labels"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs.defects(table(spark, sf, "qa_pairs"))


def p3_by_bank(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs.defect_report(table(spark, sf, "qa_pairs"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sentences.records(table(spark, sf, "corpus_analyst"), table(spark, sf, "qa_pairs"), "edited")
    return _sentences.sentence_units(rows)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scans.repairs(_scans.records(table(spark, sf, "corpus_analyst"), table(spark, sf, "qa_pairs")))


def p6_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _scans.repaired(_scans.records(table(spark, sf, "corpus_analyst"), table(spark, sf, "qa_pairs")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _overlap.overlap_pairs(table(spark, sf, "sentiment_labels"))


def p7_by_round_source(spark: SparkSession, sf: str) -> DataFrame:
    return _overlap.overlap_report(table(spark, sf, "sentiment_labels"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _encode.encode(table(spark, sf, "documents"))


def p8_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return _encode.roundtrip(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p9_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return _leakage.leak_report(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _abuse.found(table(spark, sf, "documents"), table(spark, sf, "content_labels"))


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _abuse.scores(table(spark, sf, "documents"), table(spark, sf, "content_labels"))


def p10_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return _abuse.rates(table(spark, sf, "documents"), table(spark, sf, "content_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this module by its name."""
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


_FORMS = {
    "q_label": {"negative": "'negative', 'neg', 'negatve'", "neutral": "'neutral', 'neu', 'neut', 'nuetral'", "positive": "'positive', 'pos', 'postive'"},
    "a_label": {"negative": "'negative', 'neg', 'negatve'", "neutral": "'neutral', 'neu', 'neut', 'nuetral'", "positive": "'positive', 'pos', 'postive'"},
    "addressed": {"no": "'no', 'n', 'false'", "partly": "'partly', 'partially', 'partial', 'part'", "yes": "'yes', 'y', 'true'"},
    "changed_topic": {"no": "'no', 'n', 'false'", "yes": "'yes', 'y', 'true'"},
}


def _agreement_sql() -> str:
    """Krippendorff's alpha per field from each coder's latest row."""
    cols = ", ".join(_FORMS)
    long = " UNION ALL ".join(
        f"SELECT pair_id, '{f}' AS field, CASE "
        + " ".join(f"WHEN regexp_replace(lower(trim({f})), '[\\s.]+$', '') IN ({v}) THEN '{k}'" for k, v in forms.items())
        + " END AS label FROM latest"
        for f, forms in _FORMS.items()
    )
    return f"""WITH r AS (SELECT pair_id, regexp_replace(lower(trim(coder)), '^(coder|annotator)[\\s_:-]*', '') AS c, labelled_at, {cols} FROM coder_labels),
    latest AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY pair_id, c ORDER BY labelled_at DESC, {", ".join(f"coalesce({c}, '') DESC" for c in _FORMS)}) = 1),
    l AS (SELECT * FROM ({long}) WHERE label IS NOT NULL), n AS (SELECT pair_id, field, label, count(*) AS n FROM l GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY pair_id, field) AS m FROM n), k AS (SELECT * FROM m WHERE m >= 2),
    s AS (SELECT field, count(DISTINCT pair_id) AS n_items, CAST(sum(n) AS BIGINT) AS n_labels, sum(n * (m - n) / (m - 1)) AS apart FROM k GROUP BY 1), g AS (SELECT field, label, sum(n) AS t FROM k GROUP BY 1, 2),
    e AS (SELECT field, (sum(t) * sum(t) - sum(t * t)) / (sum(t) * (sum(t) - 1)) AS expected FROM g GROUP BY 1)
    SELECT field, n_items, n_labels, round(1 - apart / n_labels, 6) AS observed, round(1 - expected, 6) AS expected, round(1 - (apart / n_labels) / expected, 6) AS alpha FROM s JOIN e USING (field)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can say on whole tables; the others are tested by brute force or round trips."""
    return {"p2_agreement": _agreement_sql()}
