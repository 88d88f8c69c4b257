"""Driver queries of the core operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import config
from colloquy import oracle as O
from colloquy.functions import normalise, numbers, periods, text
from colloquy.operators import agreement, compare, evidence, pairing, sampling, topics, units
from colloquy.session import table
from colloquy.streaming import windows

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ inputs


def scored(s: SparkSession, d: str) -> DataFrame:
    """Scored texts: row_id, text, bank, quarter, label, net and the reviewers' label."""
    t = table(s, d, "sentiment_labels")
    net = numbers.signed_net(F.col("finbert_sentiment"), F.col("finbert_score"))
    return t.select("row_id", "text", "bank", "quarter", "source", "human_label", "human_reviewed", F.col("finbert_sentiment").alias("label"), net.alias("net"))


def pairs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "qa_pairs").select("pair_id", "bank", "quarter", "source", "question_text", "answer_text").distinct()


def coder_long(s: SparkSession, d: str) -> DataFrame:
    """(item, coder, label): the latest usable question label of each coder and pair."""
    forms = {"negative": ["negative", "neg", "negatve"], "neutral": ["neutral", "neu", "neut", "nuetral"], "positive": ["positive", "pos", "postive"]}
    c = F.regexp_replace(F.lower(F.trim("q_label")), r"[\s.]+$", "")
    label = F.lit(None).cast("string")
    for k, v in forms.items():
        label = F.when(c.isin(v), k).otherwise(label)
    r = table(s, d, "coder_labels").select(
        F.col("pair_id").alias("item"), F.regexp_replace(F.lower(F.trim("coder")), "^coder_", "").alias("coder"), label.alias("label"), "labelled_at"
    )
    return r.where("label is not null").groupBy("item", "coder").agg(F.max_by("label", "labelled_at").alias("label"))


# ------------------------------------------------------------------ problem 4


@query()
def p4_found(s, d):
    return units.common_units(table(s, d, "numeric_claims"))


@query()
def p4_by_unit(s, d):
    return units.unit_report(table(s, d, "numeric_claims"))


# ------------------------------------------------------------------ periods and comparison


@query(f"""WITH {O.SCORED}, b AS (SELECT lower(bank) AS bank, {O.cp('quarter')} AS calendar_period, net FROM scored WHERE lower(bank) IN ({O.words_in(O.PEERS)}) AND net IS NOT NULL),
g AS (SELECT calendar_period, avg(net) FILTER (bank = '{O.PEERS[0]}') AS l, avg(net) FILTER (bank = '{O.PEERS[1]}') AS r FROM b WHERE {O.band('calendar_period')} = 'both_complete' GROUP BY 1)
SELECT calendar_period, round(l, 6) AS left_mean, round(r, 6) AS right_mean, round(l - r, 6) AS gap FROM g WHERE l IS NOT NULL AND r IS NOT NULL""")
def peer_gap(s, d):
    return compare.peer_gap(scored(s, d))


@query(f"""WITH {O.SCORED} SELECT bank, {O.cp('quarter')} AS calendar_period, count(*) AS n, round(avg(net), 6) AS mean_net, round(avg(CAST(label <> 'neutral' AS DOUBLE)), 6) AS non_neutral_share,
avg(CAST(label <> 'neutral' AS DOUBLE)) > 0 AS informative FROM scored WHERE net IS NOT NULL GROUP BY ALL""")
def peer_sides(s, d):
    return compare.peer_sides(scored(s, d))


COVER = f"""cov AS (SELECT {O.year('quarter')} AS year, CAST(sum(CAST(bank = '{O.PEERS[0]}' AS INTEGER)) AS BIGINT) AS left_n, CAST(sum(CAST(bank = '{O.PEERS[1]}' AS INTEGER)) AS BIGINT) AS right_n
FROM corpus_manifest WHERE kind = 'transcript' GROUP BY 1)"""


@query(f"""WITH {COVER} SELECT year, left_n, right_n, {O.band('CAST(year AS VARCHAR)')} AS coverage_window FROM cov WHERE year IS NOT NULL""")
def coverage_by_year(s, d):
    return compare.coverage_by_year(table(s, d, "corpus_manifest"))


@query(f"""WITH {COVER} SELECT count(*) AS n_years, CAST(sum(CAST(left_n > 0 AND right_n > 0 AS INTEGER)) AS BIGINT) AS n_paired_years, min(CASE WHEN left_n > 0 AND right_n > 0 THEN year END) AS first_paired,
max(CASE WHEN left_n > 0 AND right_n > 0 THEN year END) AS last_paired, CAST(sum(left_n) AS BIGINT) AS left_total, CAST(sum(right_n) AS BIGINT) AS right_total FROM cov WHERE year IS NOT NULL""")
def coverage_line(s, d):
    return compare.coverage_line(table(s, d, "corpus_manifest"))


_short = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.PERIOD_SHORT.items())


@query(f"""SELECT DISTINCT quarter, {O.cp('quarter')} AS calendar_period, {O.year('quarter')} AS year, {O.order('quarter')} AS period_order, {O.band('quarter')} AS coverage_window,
CASE WHEN regexp_extract({O.cp('quarter')}, '^20(\\d{{2}})-(H1q1|H1|Q3|FY)$', 1) <> '' THEN regexp_extract({O.cp('quarter')}, '^20(\\d{{2}})-(H1q1|H1|Q3|FY)$', 1) || (CASE regexp_extract({O.cp('quarter')}, '^20(\\d{{2}})-(H1q1|H1|Q3|FY)$', 2) {_short} END) ELSE quarter END AS compact_label,
CASE WHEN {O.year('quarter')} >= 2024 THEN '2024+' WHEN {O.year('quarter')} >= 2020 THEN '2020-23' WHEN {O.year('quarter')} IS NOT NULL THEN 'pre-2020' ELSE 'unknown' END AS period_bucket FROM corpus_manifest WHERE quarter IS NOT NULL""")
def period_labels(s, d):
    q = F.col("quarter")
    return table(s, d, "corpus_manifest").where("quarter is not null").select(
        "quarter", periods.calendar_period(q).alias("calendar_period"), periods.year_of(q).alias("year"), periods.period_order(q).alias("period_order"),
        periods.coverage_window(q).alias("coverage_window"), periods.compact_label(q).alias("compact_label"), periods.period_bucket(q).alias("period_bucket"),
    ).distinct()


@query("""SELECT source, bank, replace(replace(lower(bank), ' ', '_'), '-', '_') || '_' || replace(replace(lower(quarter), ' ', '_'), '-', '_') AS episode_id,
CASE WHEN bank = 'calder_union' THEN regexp_replace(regexp_replace(quarter, 'interim$', 'q2'), 'annual$', 'fy') ELSE quarter END AS pack_quarter,
CASE WHEN lower(source) LIKE '%results-call%' THEN 'results_call' ELSE 'other' END AS event_kind FROM corpus_manifest WHERE source IS NOT NULL AND bank IS NOT NULL AND quarter IS NOT NULL""")
def manifest_keys(s, d):
    b, q = F.col("bank"), F.col("quarter")
    kind = F.when(F.lower("source").contains("results-call"), "results_call").otherwise("other")
    return table(s, d, "corpus_manifest").where("source is not null and bank is not null and quarter is not null").select(
        "source", "bank", periods.episode_id(b, q).alias("episode_id"), periods.pack_quarter(b, q, ("calder_union",)).alias("pack_quarter"), kind.alias("event_kind")
    )


@query(O.presence())
def presence_delta(s, d):
    return compare.presence_delta(table(s, d, "corpus_analyst").withColumnRenamed("seed_topic", "topic"))


@query(f"""WITH {O.SCORED}, b AS (SELECT bank, {O.cp('quarter')} AS calendar_period, round(avg(net), 6) AS value FROM scored WHERE net IS NOT NULL AND bank IS NOT NULL GROUP BY ALL),
w AS (SELECT *, count(value) OVER x AS n, avg(value) OVER x AS m, stddev_samp(value) OVER x AS sd FROM b WINDOW x AS (PARTITION BY bank ORDER BY {O.year('calendar_period')}, {O.order('calendar_period')}, calendar_period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT bank, calendar_period, value, CASE WHEN n >= 2 AND NOT (sd < 1e-12) THEN round((value - m) / sd, 4) END AS z,
CASE WHEN n >= 2 AND sd < 1e-12 THEN abs(value - m) > 1e-9 ELSE coalesce(n >= 2 AND abs((value - m) / nullif(sd, 0)) > 1.5, false) END AS changepoint FROM w""")
def changepoints(s, d):
    return compare.rolling_flags(compare.bank_series(scored(s, d)))


SEED = """tops AS (SELECT source, turn_no, arg_min(seed_topic, row_id) AS topic FROM corpus_analyst GROUP BY 1, 2)"""


@query(f"""WITH {O.SCORED} SELECT {O.bucket('n')} AS topic, count(*) AS n, round(avg(net), 6) AS mean_net, round(avg(CAST(label = 'negative' AS DOUBLE)), 6) AS negative_share,
round(avg(CAST(label = 'neutral' AS DOUBLE)), 6) AS neutral_share, round(avg(CAST(label = 'positive' AS DOUBLE)), 6) AS positive_share FROM (SELECT *, {O.norm('text')} AS n FROM scored) WHERE label IS NOT NULL GROUP BY 1""")
def topic_shares(s, d):
    return compare.topic_shares(scored(s, d).withColumn("seed_topic", text.bucket(text.normal(F.col("text")))))


@query(f"""WITH {O.SCORED}, b AS (SELECT *, {O.cp('quarter')} AS calendar_period, {O.bucket(O.norm('text'))} AS topic FROM scored WHERE label IS NOT NULL)
SELECT bank, calendar_period, count(*) AS n, round(avg(net), 6) AS mean_net, CAST(sum(CAST(label = 'negative' AS INTEGER)) AS BIGINT) AS n_negative, CAST(sum(CAST(label = 'neutral' AS INTEGER)) AS BIGINT) AS n_neutral,
CAST(sum(CAST(label = 'positive' AS INTEGER)) AS BIGINT) AS n_positive, round(avg(CAST(label = 'negative' AS DOUBLE)), 6) AS neg_share, count(DISTINCT topic) AS n_topics FROM b GROUP BY 1, 2""")
def bank_trend(s, d):
    return compare.bank_trend(scored(s, d).withColumn("topic", text.bucket(text.normal(F.col("text")))))


@query(f"""WITH {O.SCORED} SELECT bank, quarter, round(avg(net), 6) AS mean_net, count(*) AS n FROM scored WHERE net IS NOT NULL GROUP BY ALL ORDER BY mean_net, bank, quarter LIMIT 4""")
def softest_quarters(s, d):
    return compare.softest(scored(s, d))


@query(f"""WITH {O.SCORED} SELECT {O.cp('quarter')} AS calendar_period, count(DISTINCT bank) AS n_banks FROM scored GROUP BY 1 HAVING count(DISTINCT bank) >= 2""")
def shared_periods(s, d):
    return compare.shared_periods(scored(s, d))


@query(f"""WITH {O.reported()} SELECT * FROM reported""")
def reported_metrics(s, d):
    return compare.reported_metrics(table(s, d, "numeric_claims"))


@query(f"""WITH {O.reported()} SELECT bank, calendar_period, """ + ", ".join(f"max(CASE WHEN metric = '{m}' THEN direction END) AS {m}" for m in config.METRIC_WORDS) + " FROM reported GROUP BY 1, 2")
def direction_columns(s, d):
    r = compare.reported_metrics(table(s, d, "numeric_claims"))
    return r.groupBy("bank", "calendar_period").agg(*[F.max(F.when(F.col("metric") == m, F.col("direction"))).alias(m) for m in config.METRIC_WORDS])


@query(f"""WITH {O.SCORED}, {O.narrative()} SELECT * FROM narrative""")
def narrative_by_metric(s, d):
    return compare.narrative(scored(s, d))


@query(f"""WITH {O.compared()} SELECT *, narrative_direction = direction AS agrees FROM told""")
def struct_vs_narrative(s, d):
    return compare.struct_vs_narrative(scored(s, d), table(s, d, "numeric_claims"))


@query(f"""WITH {O.compared()} SELECT metric, count(*) AS n, round(1 - avg(CAST(narrative_direction = direction AS DOUBLE)), 6) AS divergence_rate FROM told GROUP BY 1""")
def divergence_rate(s, d):
    return compare.divergence(compare.struct_vs_narrative(scored(s, d), table(s, d, "numeric_claims")))


@query("""WITH r AS (SELECT coalesce(role, '(none)') AS a, coalesce(text_origin, '(none)') AS b FROM corpus_analyst)
SELECT coalesce(a, '(all)') AS a, coalesce(b, '(all)') AS b, count(*) AS n FROM r GROUP BY CUBE (a, b)""")
def crosstab_margins(s, d):
    return compare.crosstab(table(s, d, "corpus_analyst"), "role", "text_origin")


@query("""WITH b AS (SELECT seed_topic AS topic, CAST(date_trunc('quarter', ingested_at) AS DATE) AS quarter_start FROM corpus_analyst WHERE seed_topic IS NOT NULL AND ingested_at IS NOT NULL),
c AS (SELECT topic, quarter_start, count(*) AS n FROM b GROUP BY ALL), q AS (SELECT CAST(unnest(generate_series((SELECT min(quarter_start) FROM b), (SELECT max(quarter_start) FROM b), INTERVAL 3 MONTH)) AS DATE) AS quarter_start), t AS (SELECT DISTINCT topic FROM b)
SELECT topic, quarter_start, coalesce(n, 0) AS n FROM t JOIN q ON true LEFT JOIN c USING (topic, quarter_start)""")
def drift_grid(s, d):
    return compare.drift_grid(table(s, d, "corpus_analyst"), "seed_topic", F.col("ingested_at"))


@query("""WITH b AS (SELECT seed_topic AS topic, CAST(floor(epoch(ingested_at)) AS BIGINT) AS t FROM corpus_analyst WHERE seed_topic IS NOT NULL AND ingested_at IS NOT NULL), r AS (SELECT min(t) AS lo, greatest(1, max(t) - min(t)) AS w FROM b)
SELECT topic, CAST(least(7, floor((t - lo) * 8.0 / w)) AS INTEGER) AS bin, count(*) AS n FROM b, r GROUP BY 1, 2""")
def topics_over_time(s, d):
    return compare.topics_over_time(table(s, d, "corpus_analyst"), "seed_topic", "ingested_at", 8)


@query(f"""WITH {O.SCORED}, a AS (SELECT bank, count(*) AS n_press, round(avg(net), 6) AS press_net FROM scored WHERE net IS NOT NULL AND human_reviewed GROUP BY 1),
b AS (SELECT bank, round(avg(net), 6) AS calls_net FROM scored WHERE net IS NOT NULL AND NOT coalesce(human_reviewed, false) GROUP BY 1)
SELECT a.bank, n_press, press_net, calls_net, round(press_net - calls_net, 6) AS gap, n_press >= 3 AS treat_as_signal FROM a LEFT JOIN b ON a.bank = b.bank""")
def press_against_calls(s, d):
    t = scored(s, d)
    return compare.press_against_calls(t.where("human_reviewed"), t.where("not coalesce(human_reviewed, false)"))


# ------------------------------------------------------------------ turns, pairs and behaviour


@query(f"""WITH {O.TURN.format(c="{'speaker': speaker, 'role': role, 'text': text, 'bank': bank, 'quarter': quarter}")}, b AS (SELECT source, turn_no, r.speaker AS speaker, r.role AS role, r.text AS text, r.bank AS bank, r.quarter AS quarter,
regexp_replace(lower(trim(coalesce(r.speaker, ''))), '\\s+', ' ', 'g') AS name, coalesce(r.role = 'analyst', false) AS is_a FROM turn1),
an AS (SELECT DISTINCT source, name FROM b WHERE role = 'analyst' AND name <> ''),
m AS (SELECT b.*, is_a OR an.name IS NOT NULL AS is_q FROM b LEFT JOIN an ON an.source = b.source AND an.name = b.name),
k AS (SELECT *, sum(CAST(is_q AS INTEGER)) OVER w AS qid, sum(CAST(is_a AS INTEGER)) OVER w AS pid FROM m WINDOW w AS (PARTITION BY source ORDER BY turn_no)),
f AS (SELECT *, sum(CAST(is_q AND NOT is_a AS INTEGER)) OVER (PARTITION BY source, pid ORDER BY turn_no) AS follow, min(CASE WHEN is_q THEN 1 WHEN role = 'management' THEN 1 ELSE 0 END) OVER (PARTITION BY source, qid ORDER BY turn_no) AS managed FROM k),
r AS (SELECT * FROM f WHERE qid > 0 AND (is_q OR managed = 1)),
q AS (SELECT source, qid, turn_no AS question_turn, bank, quarter, speaker AS analyst, text AS question_text, pid, follow FROM r WHERE is_q),
a AS (SELECT source, qid, string_agg(coalesce(text, ''), ' ' ORDER BY turn_no) AS answer_text, count(*) AS n FROM r WHERE NOT is_q GROUP BY 1, 2)
SELECT coalesce(bank, '') || '_' || coalesce(quarter, '') || '_' || CASE WHEN pid < 10 THEN '00' WHEN pid < 100 THEN '0' ELSE '' END || CAST(CAST(pid AS BIGINT) AS VARCHAR) || CASE WHEN follow > 25 THEN 'z' || CAST(CAST(follow AS BIGINT) AS VARCHAR) WHEN follow > 0 THEN chr(CAST(97 + follow AS INTEGER)) ELSE '' END AS pair_id, bank, quarter, q.source, question_turn, analyst, question_text,
coalesce(answer_text, '') AS answer_text, CAST(coalesce(n, 0) AS INTEGER) AS n_answer_turns FROM q LEFT JOIN a ON a.source = q.source AND a.qid = q.qid""")
def pair_qa(s, d):
    return pairing.pair_qa(table(s, d, "corpus_analyst"))


@query(f"""WITH {O.pairs_labelled()}, {O.behaviour_sql()} SELECT * FROM behaviour""")
def behaviour(s, d):
    return pairing.behaviour(pairs(s, d))


@query(f"""WITH {O.pairs_labelled()}, {O.behaviour_sql()} SELECT bank, quarter, count(*) AS n_pairs, round(avg(directness), 6) AS mean_directness, round(avg(directness_v2), 6) AS mean_directness_v2, round(avg(metric_coverage), 6) AS metric_coverage_rate,
round(avg(topic_substitution), 6) AS substitution_rate, count(metric_coverage) AS n_coverage_asked, CAST(sum(CAST(substitution_measurable AS INTEGER)) AS BIGINT) AS n_substitution_measurable FROM behaviour GROUP BY 1, 2""")
def state_summary(s, d):
    return pairing.behaviour(pairs(s, d)).groupBy("bank", "quarter").agg(
        F.count("*").alias("n_pairs"), F.round(F.avg("directness"), 6).alias("mean_directness"), F.round(F.avg("directness_v2"), 6).alias("mean_directness_v2"),
        F.round(F.avg("metric_coverage"), 6).alias("metric_coverage_rate"), F.round(F.avg("topic_substitution"), 6).alias("substitution_rate"),
        F.count("metric_coverage").alias("n_coverage_asked"), F.sum(F.col("substitution_measurable").cast("int")).alias("n_substitution_measurable"),
    )


@query(f"""WITH {O.pairs_labelled()}, {O.behaviour_sql()}, c AS (SELECT CAST(sum(CAST(substitution_measurable AND topic_substitution > 0 AS INTEGER)) AS BIGINT) AS k, CAST(sum(CAST(substitution_measurable AS INTEGER)) AS BIGINT) AS n,
CAST(sum(CAST(topic_substitution IS NOT NULL AND NOT substitution_measurable AS INTEGER)) AS BIGINT) AS not_counted FROM behaviour),
w AS (SELECT *, k / n AS p, 1 + 3.8416 / n AS den FROM c), v AS (SELECT *, (p + 3.8416 / (2 * n)) / den AS centre, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / den AS margin FROM w)
SELECT k, n, round(p, 6) AS share, CASE WHEN n > 0 THEN round(greatest(0.0, centre - margin), 6) ELSE 0.0 END AS low, CASE WHEN n > 0 THEN round(least(1.0, centre + margin), 6) ELSE 0.0 END AS high, not_counted FROM v""")
def substitution_interval(s, d):
    return agreement.share_interval(pairing.behaviour(pairs(s, d)), "topic_substitution", "substitution_measurable")


WC = "(CASE WHEN trim(regexp_replace(coalesce(answer_text, ''), '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(coalesce(answer_text, ''), '\\s+', ' ', 'g')), ' ')) END)"


@query(f"""WITH {O.pairs_labelled()}, {O.behaviour_sql()}, j AS (SELECT b.directness, {WC} AS w FROM behaviour b JOIN pairs USING (pair_id) WHERE b.directness IS NOT NULL)
SELECT count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(directness, w), 2) END AS r FROM j""")
def directness_length(s, d):
    p = pairs(s, d)
    j = pairing.behaviour(p).select("pair_id", "directness").join(p.select("pair_id", text.word_count(F.col("answer_text")).alias("w")), "pair_id")
    return agreement.pearson(j, "directness", "w")


def _ranked(x: str, t: str) -> str:
    return f"(SELECT *, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS r_{x} FROM {t})"


@query(f"""WITH {O.pairs_labelled()}, {O.behaviour_sql()}, b AS (SELECT directness AS a, directness_v2 AS b FROM behaviour WHERE directness IS NOT NULL AND directness_v2 IS NOT NULL)
SELECT count(*) AS n, round(corr(r_a, r_b), 6) AS rho FROM {_ranked('b', _ranked('a', 'b') + ' z')} y""")
def directness_spearman(s, d):
    return agreement.spearman(pairing.behaviour(pairs(s, d)), "directness", "directness_v2")


@query(f"""WITH {O.pairs_labelled()}, {O.behaviour_sql()}, b AS (SELECT directness AS v, metric_coverage > 0 AS pos FROM behaviour WHERE directness IS NOT NULL AND metric_coverage IS NOT NULL), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM b),
g AS (SELECT CAST(sum(CAST(pos AS INTEGER)) AS BIGINT) AS n_pos, CAST(sum(CAST(NOT pos AS INTEGER)) AS BIGINT) AS n_neg, sum(CASE WHEN pos THEN k ELSE 0 END) AS s FROM r) SELECT n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0), 6) AS auc FROM g""")
def directness_auc(s, d):
    b = pairing.behaviour(pairs(s, d)).withColumn("pos", F.col("metric_coverage") > 0)
    return agreement.auc(b, "pos", "directness")


@query(f"""WITH {O.pairs_labelled()}, {O.behaviour_sql()} SELECT round(quantile_cont(directness_v2, 1/3.0), 6) AS low, round(quantile_cont(directness_v2, 2/3.0), 6) AS high FROM behaviour""")
def directness_terciles(s, d):
    t = pairing.behaviour(pairs(s, d)).agg(F.percentile("directness_v2", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("t"))
    return t.select(F.round(F.col("t")[0], 6).alias("low"), F.round(F.col("t")[1], 6).alias("high"))


# ------------------------------------------------------------------ labels and evidence


@query(f"""WITH {O.pairs_labelled()} SELECT pair_id, bq AS bucket_q, ba AS bucket_a, cq AS category_q, ca AS category_a FROM lab""")
def pair_labels(s, d):
    return evidence.labelled(pairs(s, d)).select("pair_id", F.col("bq").alias("bucket_q"), F.col("ba").alias("bucket_a"), F.col("cq").alias("category_q"), F.col("ca").alias("category_a"))


_KW = sorted({w for ws in config.METRIC_WORDS.values() for w in ws})


@query("WITH k AS (" + " UNION ALL ".join(f"SELECT '{w}' AS keyword, {O.count('n', w)} AS c FROM (SELECT {O.norm('answer_text')} AS n FROM ({O.PAIRS.split(' AS ', 1)[1][1:-1]}))" for w in _KW) + ") SELECT keyword, CAST(sum(c) AS BIGINT) AS n_mentions, CAST(sum(CAST(c > 0 AS INTEGER)) AS BIGINT) AS n_texts FROM k GROUP BY 1")
def keyword_counts(s, d):
    n = pairs(s, d).select(text.normal(F.col("answer_text")).alias("n"))
    long = F.explode(F.array(*[F.struct(F.lit(w).alias("keyword"), text.keyword_count(F.col("n"), w).alias("c")) for w in _KW]))
    return n.select(long.alias("k")).groupBy("k.keyword").agg(F.sum("k.c").alias("n_mentions"), F.sum((F.col("k.c") > 0).cast("int")).alias("n_texts"))


_calm = "regexp_replace(n, ' risk  weight[a-z]* | de  risk[a-z]* | derisk[a-z]* | stress  test[a-z]* ', '   ', 'g')"


@query(f"""WITH {O.SCORED}, c AS (SELECT row_id, {_calm} AS n FROM (SELECT row_id, {O.norm('text')} AS n FROM scored)), v AS (SELECT row_id, {O.votes('n', config.VOTE_NEGATIVE)} AS neg, {O.votes('n', config.VOTE_POSITIVE)} AS pos FROM c)
SELECT row_id, CASE WHEN neg >= pos + 2 AND neg >= 2 THEN 'negative' WHEN pos >= neg + 2 AND pos >= 2 THEN 'positive' END AS vote FROM v""")
def tone_votes(s, d):
    return scored(s, d).select("row_id", text.tone_vote(text.normal(F.col("text"))).alias("vote"))


_lexrow = f"SELECT row_id, net, label, human_label, {O.lex('t')} AS x FROM (SELECT row_id, net, label, human_label, {O.toks('text', '[a-z]+')} AS t FROM scored)"


@query(f"""WITH {O.SCORED}, l AS ({_lexrow}) SELECT row_id, CAST(x.n AS INTEGER) AS n_tokens, CAST(x.pos AS INTEGER) AS n_pos, CAST(x.neg AS INTEGER) AS n_neg, round(coalesce((x.pos - x.neg) / nullif(x.n, 0), 0.0), 6) AS lexicon_net,
CASE WHEN coalesce((x.pos - x.neg) / nullif(x.n, 0), 0.0) > 0.01 THEN 'positive' WHEN coalesce((x.pos - x.neg) / nullif(x.n, 0), 0.0) < -0.01 THEN 'negative' ELSE 'neutral' END AS lexicon_label FROM l""")
def lexicon_scores(s, d):
    t = scored(s, d).select("row_id", text.lexicon_counts(F.col("text")).alias("x"))
    net = F.coalesce(F.try_divide(F.col("x.pos") - F.col("x.neg"), F.col("x.n")), F.lit(0.0))
    return t.select("row_id", F.col("x.n").alias("n_tokens"), F.col("x.pos").alias("n_pos"), F.col("x.neg").alias("n_neg"), F.round(net, 6).alias("lexicon_net"), text.sign_label(net, config.LEXICON_BAND).alias("lexicon_label"))


HL = """hl AS (SELECT lower(trim(human_label)) AS gold, label AS guess FROM scored WHERE lower(trim(human_label)) IN ('negative', 'neutral', 'positive') AND label IS NOT NULL)"""
REP = """ex AS (SELECT gold, guess, unnest(list_distinct([gold, guess])) AS l FROM hl), rep AS (SELECT l AS label, CAST(sum(CAST(gold = l AS INTEGER)) AS BIGINT) AS n_gold, CAST(sum(CAST(guess = l AS INTEGER)) AS BIGINT) AS n_guess, CAST(sum(CAST(gold = l AND guess = l AS INTEGER)) AS BIGINT) AS h FROM ex GROUP BY 1),
rp AS (SELECT label, n_gold, n_guess, round(coalesce(h / nullif(n_guess, 0), 0.0), 6) AS precision, round(coalesce(h / nullif(n_gold, 0), 0.0), 6) AS recall, round(coalesce(2 * h / nullif(n_gold + n_guess, 0), 0.0), 6) AS f1 FROM rep)"""


def _gold(s, d):
    g = F.lower(F.trim("human_label"))
    return scored(s, d).where(g.isin(*config.LABELS) & F.col("label").isNotNull()).select(g.alias("gold"), F.col("label").alias("guess"))


@query(f"""WITH {O.SCORED}, {HL}, {REP} SELECT * FROM rp""")
def model_report(s, d):
    return agreement.classification(_gold(s, d))


@query(f"""WITH {O.SCORED}, {HL}, {REP} SELECT CAST(sum(n_gold) AS BIGINT) AS n, round(sum(recall * n_gold) / sum(n_gold), 5) AS accuracy, round(avg(f1), 5) AS macro_f1, round(sum(f1 * n_gold) / sum(n_gold), 5) AS weighted_f1 FROM rp""")
def model_macro(s, d):
    return agreement.macro(agreement.classification(_gold(s, d)))


@query(f"""WITH {O.SCORED}, {HL} SELECT gold, guess, count(*) AS n FROM hl GROUP BY 1, 2""")
def model_confusion(s, d):
    return _gold(s, d).groupBy("gold", "guess").agg(F.count("*").alias("n"))


_over = r"\b(next question|please go ahead|your line is (now )?open|please ask your question|that concludes|no further questions)\b"


@query(f"""WITH {O.pairs_labelled()}, u AS (SELECT pair_id, cq, coalesce(question_text, '') AS q, regexp_replace(coalesce(question_text, ''), '(?i)[^.?!]*{_over}[^.?!]*[.?!]?', ' ', 'g') AS rest, {O.blank('answer_text')} AS answer_missing FROM lab WHERE bq = 'untagged'),
c AS (SELECT *, len(regexp_extract_all(q, '\\S+')) AS n, len(regexp_extract_all(rest, '\\S+')) AS n_rest FROM u),
r AS (SELECT pair_id, CASE WHEN n_rest < n AND n_rest < 15 AND NOT contains(rest, '?') THEN 'operator_handover' WHEN n < 15 AND NOT contains(q, '?') THEN 'courtesy_or_fragment' WHEN cq <> 'untagged' THEN 'coder1_tagged' WHEN n < 15 THEN 'short_follow_up' ELSE 'off_seed' END AS untagged_reason,
regexp_matches(q, '(?i){_over}') AS operator_bleed, answer_missing FROM c) SELECT *, untagged_reason NOT IN ('operator_handover', 'courtesy_or_fragment') AS in_analysis FROM r""")
def untagged_reasons(s, d):
    return evidence.untagged(pairs(s, d))


_map = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.BUCKET_CATEGORY.items())


@query(f"""WITH {O.pairs_labelled()}, m AS (SELECT pair_id, cq AS first_coder, CASE WHEN ca <> 'untagged' THEN ca ELSE CASE bq {_map} END END AS second_coder FROM lab) SELECT *, first_coder IS DISTINCT FROM second_coder AS disagreement FROM m""")
def category_map(s, d):
    return evidence.category_map(pairs(s, d))


@query(f"""WITH {O.pairs_labelled()}, m AS (SELECT cq AS a, CASE WHEN ca <> 'untagged' THEN ca ELSE coalesce(CASE bq {_map} END, 'untagged') END AS b FROM lab) SELECT count(*) AS n, CAST(sum(CAST(a = b AS INTEGER)) AS BIGINT) AS n_same, round(avg(CAST(a = b AS DOUBLE)), 6) AS raw FROM m""")
def raw_agreement(s, d):
    same = F.col("first_coder") == F.coalesce("second_coder", F.lit("untagged"))
    return evidence.category_map(pairs(s, d)).agg(F.count("*").alias("n"), F.sum(same.cast("int")).alias("n_same"), F.round(F.avg(same.cast("double")), 6).alias("raw"))


def _hits_sql() -> str:
    parts = []
    for at, (m, b) in enumerate(config.BUCKETS.items()):
        ws = [w for w in dict.fromkeys(config.METRIC_WORDS[m]) if not (w == "costs" and "cost" in config.METRIC_WORDS[m])]
        c = " + ".join(O.count("na", w) for w in ws)
        pats = sorted({text.keyword_pattern(w) for w in config.METRIC_WORDS[m]})
        joined = "|".join(pats)
        first = f"strpos(na, regexp_extract(na, '{joined}'))"
        parts.append(f"SELECT pair_id, {at} AS nth, '{b}' AS bucket, {c} AS n_mentions, {first} AS first_pos FROM n")
    return f"""{O.PAIRS}, n AS (SELECT pair_id, {O.norm('answer_text')} AS na FROM pairs), h0 AS ({' UNION ALL '.join(parts)}), h1 AS (SELECT *, count(*) OVER (PARTITION BY pair_id) AS nb FROM h0 WHERE n_mentions > 0),
    h2 AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY n_mentions DESC, first_pos, nth) AS rank, sum(n_mentions) OVER (PARTITION BY pair_id) AS total, max(n_mentions) OVER (PARTITION BY pair_id) AS top FROM h1 WHERE nb > 1),
    hits AS (SELECT pair_id, rank, bucket, n_mentions, round(n_mentions / total, 3) AS share, CASE WHEN rank = 1 THEN CASE WHEN sum(CAST(n_mentions = top AS INTEGER)) OVER (PARTITION BY pair_id) > 1 THEN 'first_mention' ELSE 'count' END ELSE '' END AS primary_by FROM h2)"""


@query(f"""WITH {_hits_sql()} SELECT * FROM hits""")
def bucket_hits(s, d):
    return evidence.bucket_hits(pairs(s, d), "pair_id", "answer_text")


@query(f"""WITH {_hits_sql()} SELECT pair_id, count(*) AS n_buckets, string_agg(bucket, ' + ' ORDER BY bucket) AS bucket_combo, arg_min(bucket, rank) AS primary_bucket FROM hits GROUP BY 1""")
def bucket_combos(s, d):
    return evidence.bucket_combos(evidence.bucket_hits(pairs(s, d), "pair_id", "answer_text"), "pair_id")


@query()
def metric_briefs(s, d):
    return evidence.briefs(pairs(s, d))


@query()
def brief_quality(s, d):
    return evidence.brief_quality(evidence.briefs(pairs(s, d)))


@query()
def review_queue(s, d):
    p = pairs(s, d)
    return evidence.review_queue(evidence.briefs(p), p)


@query()
def pair_figures(s, d):
    return evidence.figures(pairs(s, d))


@query(f"""SELECT word, count(*) AS n FROM (SELECT unnest({O.toks('text', '[a-z]{3,}')}) AS word FROM sentiment_labels) GROUP BY 1 HAVING count(*) >= 2""")
def vocabulary(s, d):
    return evidence.vocabulary(table(s, d, "sentiment_labels"), "text")


@query("""WITH n AS (SELECT trim(regexp_replace(speaker, '\\s+', ' ', 'g')) AS name FROM corpus_analyst WHERE speaker IS NOT NULL)
SELECT name, count(*) AS n FROM n WHERE regexp_full_match(name, '[A-Z][A-Za-z.''-]*( [A-Z][A-Za-z.''-]*){1,3}') GROUP BY 1 HAVING count(*) >= 3""")
def speaker_names(s, d):
    return evidence.speaker_names(table(s, d, "corpus_analyst"))


@query()
def sentence_rollup(s, d):
    return evidence.sentence_rollup(table(s, d, "sentiment_labels"), "row_id", "text")


_hint = " OR ".join(f"contains(f, '{h}')" for h in config.MANAGEMENT_HINTS)
_house = " OR ".join(f"contains(f, '{h}')" for h in config.RESEARCH_HINTS)


@query(f"""SELECT row_id, CASE WHEN sp = 'operator' OR f = 'operator' THEN 'operator' WHEN contains(f, 'analyst') THEN 'analyst' WHEN {_hint} THEN 'management' WHEN ({_house}) AND NOT coalesce(f <> '' AND f = replace(lower(bank), '_', ' '), false) THEN 'analyst' ELSE 'management' END AS role_by_firm
FROM (SELECT row_id, bank, lower(coalesce(firm, '')) AS f, lower(trim(coalesce(speaker, ''))) AS sp FROM corpus_analyst)""")
def roles_by_firm(s, d):
    return table(s, d, "corpus_analyst").select("row_id", text.role_of(F.col("firm"), F.col("bank"), F.col("speaker")).alias("role_by_firm"))


@query(f"""WITH t AS (SELECT row_id, array_to_string(list_filter({O.toks('text', '[a-z]+')}, lambda w: w NOT IN ({O.words_in(config.STOP_WORDS)})), ' ') AS clean_text FROM corpus_analyst WHERE role = 'analyst' AND event_type = 'results_call')
SELECT row_id, clean_text FROM t WHERE len(string_split(clean_text, ' ')) > 3""")
def analyst_corpus(s, d):
    t = table(s, d, "corpus_analyst").where("role = 'analyst' and event_type = 'results_call'")
    return t.select("row_id", text.clean_words(F.col("text")).alias("clean_text")).where(F.size(F.split("clean_text", " ")) > 3)


# ------------------------------------------------------------------ agreement of coders


@query(f"""WITH {O.coder_long()}, p AS (SELECT x.coder AS a, y.coder AS b, x.label AS la, y.label AS lb FROM long x JOIN long y ON x.item = y.item AND x.coder < y.coder),
c AS (SELECT a, b, la, lb, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT a, b, sum(n) AS n, sum(CASE WHEN la = lb THEN n ELSE 0 END) AS same FROM c GROUP BY 1, 2),
m AS (SELECT u.a, u.b, sum(u.n * v.n) AS ch FROM (SELECT a, b, la AS l, sum(n) AS n FROM c GROUP BY ALL) u JOIN (SELECT a, b, lb AS l, sum(n) AS n FROM c GROUP BY ALL) v ON u.a = v.a AND u.b = v.b AND u.l = v.l GROUP BY 1, 2)
SELECT t.a, t.b, CAST(t.n AS BIGINT) AS n, round(same / t.n, 6) AS raw, round((same / t.n - coalesce(ch, 0) / (t.n * t.n)) / nullif(1 - coalesce(ch, 0) / (t.n * t.n), 0), 6) AS kappa FROM t LEFT JOIN m ON t.a = m.a AND t.b = m.b""")
def coder_kappa(s, d):
    return agreement.kappa(agreement.coder_pairs(coder_long(s, d)), "a", "b")


@query(f"""WITH {O.coder_long()}, c AS (SELECT item, label, count(*) AS n FROM long GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY item) AS m FROM c), k AS (SELECT * FROM m WHERE m >= 2),
s AS (SELECT count(DISTINCT item) AS n_items, sum(n) AS total, sum(n * (m - n) / (m - 1)) AS apart FROM k), l AS (SELECT sum(n) AS k FROM k GROUP BY label), x AS (SELECT sum(k) * sum(k) - sum(k * k) AS mixed FROM l)
SELECT n_items, round(1 - (total - 1) * apart / nullif(mixed, 0), 6) AS alpha FROM s, x""")
def coder_alpha(s, d):
    return agreement.krippendorff(coder_long(s, d))


@query(f"""WITH {O.coder_long()}, c AS (SELECT item, label, count(*) AS votes, min(coder) AS fc FROM long GROUP BY ALL) SELECT item, label, votes FROM c QUALIFY row_number() OVER (PARTITION BY item ORDER BY votes DESC, fc, label) = 1""")
def majority_vote(s, d):
    return agreement.majority(coder_long(s, d))


@query(f"""WITH {O.coder_long()}, c AS (SELECT item, label, count(*) AS n FROM long GROUP BY ALL), t AS (SELECT item, max(n) AS top, sum(n) AS total, max_by(label, (n, label)) AS l FROM c GROUP BY 1) SELECT item, CASE WHEN top * 2 > total THEN l END AS label FROM t""")
def strict_consensus(s, d):
    return agreement.strict(coder_long(s, d))


@query()
def kappa_interval(s, d):
    return agreement.bootstrap_kappa(agreement.coder_pairs(coder_long(s, d)))


# ------------------------------------------------------------------ samples, sorts and sets


@query(f"""WITH {O.PAIRS} SELECT pair_id FROM pairs WHERE pair_id IS NOT NULL ORDER BY md5(pair_id || '|audit'), pair_id LIMIT 50""")
def audit_sample(s, d):
    return sampling.simple(pairs(s, d), "pair_id", 50, "audit").select("pair_id")


@query(f"""WITH {O.PAIRS} SELECT pair_id, bank FROM pairs QUALIFY row_number() OVER (PARTITION BY bank ORDER BY md5(pair_id || '|strata'), pair_id) <= 3""")
def stratified_sample(s, d):
    return sampling.per_stratum(pairs(s, d), "pair_id", ["bank"], 3, "strata").select("pair_id", "bank")


@query(f"""WITH {O.PAIRS}, u AS (SELECT pair_id, bank, (CAST('0x' || substr(md5(pair_id || '|w'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0 AS u, CASE WHEN {O.year('quarter')} >= 2020 THEN 2.0 ELSE 1.0 END AS w FROM pairs)
SELECT pair_id, bank FROM u QUALIFY row_number() OVER (PARTITION BY bank ORDER BY round(-ln(u) / w, 9), pair_id) <= 3""")
def weighted_sample(s, d):
    w = F.when(periods.year_of(F.col("quarter")) >= 2020, 2.0).otherwise(1.0)
    return sampling.weighted(pairs(s, d), "pair_id", ["bank"], w, 3, "w").select("pair_id", "bank")


@query(f"""WITH {O.SCORED} SELECT row_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(CAST(row_id AS VARCHAR) || '|split'), row_id) <= ceil(count(*) OVER (PARTITION BY label) * 0.75) THEN 'train' ELSE 'test' END AS part FROM scored""")
def train_test_split(s, d):
    return sampling.split(scored(s, d), "row_id", "label", 0.75, "split").select("row_id", "label", "part")


WCQ = WC.replace("answer_text", "question_text")


@query(f"""WITH {O.PAIRS}, r AS (SELECT CASE WHEN {O.blank('question_text')} THEN 'no_question' WHEN {O.blank('answer_text')} THEN 'no_answer' WHEN {WCQ} < 12 THEN 'short_question' WHEN {WC} < 12 THEN 'short_answer' ELSE 'kept' END AS reason FROM pairs) SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def exclusion_counts(s, d):
    q, a = F.col("question_text"), F.col("answer_text")
    rules = [("no_question", text.blank(q)), ("no_answer", text.blank(a)), ("short_question", text.word_count(q) < 12), ("short_answer", text.word_count(a) < 12)]
    return sampling.first_reason(pairs(s, d), rules).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT pair_id, 'unlabelled' AS side FROM (SELECT pair_id FROM qa_pairs EXCEPT SELECT pair_id FROM coder_labels) UNION ALL SELECT pair_id, 'both' FROM (SELECT pair_id FROM qa_pairs INTERSECT SELECT pair_id FROM coder_labels)""")
def label_sets(s, d):
    a, b = table(s, d, "qa_pairs").select("pair_id"), table(s, d, "coder_labels").select("pair_id")
    return a.subtract(b).withColumn("side", F.lit("unlabelled")).unionByName(a.intersect(b).withColumn("side", F.lit("both")))


@query("""SELECT source, turn_no, row_id, ingested_at FROM corpus_analyst QUALIFY row_number() OVER (PARTITION BY source, turn_no ORDER BY ingested_at DESC, row_id DESC) = 1""")
def latest_rows(s, d):
    t = table(s, d, "corpus_analyst").select("source", "turn_no", "row_id", "ingested_at")
    return sampling.keep_one(t, ["source", "turn_no"], [F.desc("ingested_at"), F.desc("row_id")])


@query("""SELECT bank, quarter, metric, min(claim_id) AS claim_id, arg_min(value_raw, claim_id) AS value_raw FROM numeric_claims WHERE value_raw IS NOT NULL GROUP BY ALL""")
def first_claims(s, d):
    return table(s, d, "numeric_claims").where("value_raw is not null").groupBy("bank", "quarter", "metric").agg(F.min("claim_id").alias("claim_id"), F.min_by("value_raw", "claim_id").alias("value_raw"))


@query(f"""WITH {O.SCORED} SELECT bank, quarter, max_by(row_id, (abs(net), -row_id)) AS row_id, round(max(abs(net)), 6) AS strength FROM scored WHERE net IS NOT NULL GROUP BY 1, 2""")
def strongest_turns(s, d):
    n = F.abs("net")
    return scored(s, d).where("net is not null").groupBy("bank", "quarter").agg(F.max_by("row_id", F.struct(n, -F.col("row_id"))).alias("row_id"), F.round(F.max(n), 6).alias("strength"))


@query(f"""WITH {O.SCORED} SELECT row_id, bank, label, round(net, 6) AS net FROM scored ORDER BY CASE label WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2 ELSE 3 END, net NULLS LAST, row_id LIMIT 50""")
def browse_negative_first(s, d):
    rank = F.when(F.col("label") == "negative", 0).when(F.col("label") == "neutral", 1).when(F.col("label") == "positive", 2).otherwise(3)
    return scored(s, d).orderBy(rank, F.asc_nulls_last("net"), "row_id").limit(50).select("row_id", "bank", "label", F.round("net", 6).alias("net"))


@query(f"""WITH {O.SCORED}, a AS (SELECT row_id, substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 120) AS k, label, net FROM scored), g AS (SELECT k, max(lower(trim(human_label))) AS gold FROM (SELECT substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 120) AS k, human_label FROM scored WHERE human_reviewed) GROUP BY 1)
SELECT row_id, coalesce(CASE WHEN gold IN ('negative', 'neutral', 'positive') THEN gold END, label) AS final_label FROM a LEFT JOIN g ON a.k = g.k""")
def gold_overrides(s, d):
    t = scored(s, d).withColumn("k", text.join_key(F.col("text")))
    gold = t.where("human_reviewed").groupBy("k").agg(F.max(F.lower(F.trim("human_label"))).alias("gold"))
    final = F.coalesce(F.when(F.col("gold").isin(*config.LABELS), F.col("gold")), F.col("label"))
    return t.join(gold, "k", "left").select("row_id", final.alias("final_label"))


@query("""SELECT source, bank, quarter FROM corpus_manifest WHERE bank <> 'calder_union' AND source IS NOT NULL UNION ALL SELECT source, bank, quarter || '-new' FROM corpus_manifest WHERE bank = 'calder_union'""")
def replaced_bank(s, d):
    m = table(s, d, "corpus_manifest").select("source", "bank", "quarter")
    new = m.where("bank = 'calder_union'").withColumn("quarter", F.concat("quarter", F.lit("-new")))
    return sampling.replace_group(m.where("bank is not null and source is not null"), new, "bank")


@query(f"""WITH {O.PAIRS}, z AS (SELECT bank, count(*) AS n, (SELECT count(*) FROM pairs) AS t FROM pairs GROUP BY 1), r AS (SELECT pair_id, p.bank, md5(pair_id || '|prop') AS h, row_number() OVER (PARTITION BY p.bank ORDER BY md5(pair_id || '|prop'), pair_id) <= greatest(1, floor(60 * z.n / z.t)) AS first
FROM pairs p JOIN z ON p.bank IS NOT DISTINCT FROM z.bank) SELECT pair_id, bank FROM r ORDER BY first DESC, h, pair_id LIMIT 60""")
def proportional_sample(s, d):
    return sampling.proportional(pairs(s, d), "pair_id", "bank", 60, "prop").select("pair_id", "bank")


@query(f"""WITH {O.PAIRS} SELECT bank, quarter, pair_id FROM pairs QUALIFY row_number() OVER (PARTITION BY bank, quarter ORDER BY pair_id) <= 6""")
def first_pairs(s, d):
    return sampling.first_in_order(pairs(s, d).select("bank", "quarter", "pair_id"), ["bank", "quarter"], ["pair_id"], 6)


@query(f"""WITH {O.SCORED} SELECT bank, row_id, label, CAST(row_number() OVER w AS INTEGER) AS nth FROM scored WINDOW w AS (PARTITION BY bank ORDER BY label ASC NULLS LAST, abs(net) DESC NULLS LAST, row_id) QUALIFY nth <= 5""")
def bank_quotes(s, d):
    return compare.quotes(scored(s, d), "row_id", ["bank"]).select("bank", "row_id", "label", "nth")


@query(f"""WITH {O.SCORED} SELECT {O.bucket(O.norm('text'))} AS topic, quarter, round(avg(net), 6) AS mean_net, count(*) AS n FROM scored WHERE net IS NOT NULL GROUP BY 1, 2""")
def topic_quarters(s, d):
    return compare.topic_quarter_net(scored(s, d).withColumn("t", text.bucket(text.normal(F.col("text")))), "t")


@query("""WITH turn AS (SELECT bank, quarter, trim(text, ' ') AS t, arg_min(seed_topic, row_id) AS seed_topic FROM corpus_analyst WHERE seed_topic IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT min(row_id) AS row_id, source, turn_no, bank, quarter, text AS question_text FROM corpus_analyst WHERE role = 'analyst' GROUP BY ALL)
SELECT p.row_id, turn.seed_topic AS topic FROM p LEFT JOIN turn ON p.bank = turn.bank AND p.quarter = turn.quarter AND trim(p.question_text, ' ') = turn.t""")
def questions_with_topic(s, d):
    t = table(s, d, "corpus_analyst")
    asked = t.where("role = 'analyst'").groupBy("source", "turn_no", "bank", "quarter", F.col("text").alias("question_text")).agg(F.min("row_id").alias("row_id"))
    return compare.attach_topic(asked, t, "seed_topic").select("row_id", F.col("seed_topic").alias("topic"))


@query(f"""WITH {O.pairs_labelled()}, {O.behaviour_sql()}, st AS (SELECT bank, {O.cp('quarter')} AS calendar_period, count(*) AS n_pairs, round(avg(directness), 6) AS mean_directness FROM behaviour GROUP BY 1, 2),
{O.reported()}, d AS (SELECT bank, calendar_period, """ + ", ".join(f"max(CASE WHEN metric = '{m}' THEN direction END) AS {m}" for m in config.METRIC_WORDS) + """ FROM reported GROUP BY 1, 2)
SELECT st.*, """ + ", ".join(config.METRIC_WORDS) + """ FROM st LEFT JOIN d ON d.bank = st.bank AND d.calendar_period = st.calendar_period""")
def state_with_directions(s, d):
    r = compare.reported_metrics(table(s, d, "numeric_claims"))
    wide = r.groupBy("bank", "calendar_period").agg(*[F.max(F.when(F.col("metric") == m, F.col("direction"))).alias(m) for m in config.METRIC_WORDS])
    state = pairing.behaviour(pairs(s, d)).groupBy("bank", periods.calendar_period(F.col("quarter")).alias("calendar_period")).agg(
        F.count("*").alias("n_pairs"), F.round(F.avg("directness"), 6).alias("mean_directness")
    )
    return state.join(wide, ["bank", "calendar_period"], "left")


_sides = " UNION ALL ".join(f"SELECT coder AS unit, '{f}' AS side, pair_id, lower(trim({f})) AS guess FROM coder_labels" for f in ("q_label", "a_label"))


@query(f"""WITH g AS (SELECT DISTINCT * FROM ({_sides}) WHERE guess IN ('negative', 'neutral', 'positive')), votes AS (SELECT side, pair_id, guess, count(DISTINCT unit) AS n FROM g GROUP BY ALL), gold AS (SELECT side, pair_id, arg_max(guess, (n, guess)) AS gold FROM votes GROUP BY 1, 2),
b0 AS (SELECT unit, g.side, gold, guess FROM g JOIN gold USING (side, pair_id)), b AS (SELECT * FROM b0 UNION ALL SELECT unit, 'pooled', gold, guess FROM b0), t AS (SELECT unit, side, count(*) AS n, avg(CAST(gold = guess AS DOUBLE)) AS po FROM b GROUP BY 1, 2),
x AS (SELECT unit, side, gold AS l, count(*) AS c FROM b GROUP BY ALL), y AS (SELECT unit, side, guess AS l, count(*) AS c FROM b GROUP BY ALL), e AS (SELECT unit, side, sum(x.c * y.c) AS ab FROM x JOIN y USING (unit, side, l) GROUP BY 1, 2),
h AS (SELECT unit, side, gold AS l, count(*) AS c FROM b WHERE gold = guess GROUP BY ALL), ls AS (SELECT unit, side, l FROM x UNION SELECT unit, side, l FROM y), f AS (SELECT unit, side, avg(2.0 * coalesce(h.c, 0) / (coalesce(x.c, 0) + coalesce(y.c, 0))) AS f1 FROM ls LEFT JOIN x USING (unit, side, l) LEFT JOIN y USING (unit, side, l) LEFT JOIN h USING (unit, side, l) GROUP BY 1, 2)
SELECT t.unit, t.side, n, round(po, 6) AS raw, CASE WHEN coalesce(ab, 0) < n * n THEN round((po - coalesce(ab, 0) / (n * n)) / (1 - coalesce(ab, 0) / (n * n)), 6) END AS kappa, round(f1, 5) AS macro_f1 FROM t LEFT JOIN e USING (unit, side) JOIN f USING (unit, side)""")
def coder_bundle(s, d):
    t = table(s, d, "coder_labels")
    sides = F.explode(F.array(*[F.struct(F.lit(f).alias("side"), F.lower(F.trim(f)).alias("guess")) for f in ("q_label", "a_label")]))
    g = t.select(F.col("coder").alias("unit"), "pair_id", sides.alias("x")).select("unit", "pair_id", "x.*").where(F.col("guess").isin(*config.LABELS)).distinct()
    votes = g.groupBy("side", "pair_id", "guess").agg(F.count_distinct("unit").alias("n"))
    gold = votes.groupBy("side", "pair_id").agg(F.max_by("guess", F.struct("n", "guess")).alias("gold"))
    return agreement.bundle(g.join(gold, ["side", "pair_id"]))


# ------------------------------------------------------------------ topics and streams


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS topic, i, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY 1, 2),
dd AS (SELECT vec_id, topic, sum((CAST(x AS DOUBLE) - m) * (CAST(x AS DOUBLE) - m)) AS dist FROM e JOIN c USING (i) GROUP BY 1, 2) SELECT vec_id, arg_min(topic, (round(dist, 6), topic)) AS topic FROM dd GROUP BY 1""")
def nearest_topics(s, d):
    return topics.nearest_centroid(table(s, d, "embeddings"))


@query()
def lda_topics(s, d):
    return topics.lda(table(s, d, "sentiment_labels"), "row_id", "text")


@query()
def nmf_topics(s, d):
    return topics.nmf_words(table(s, d, "sentiment_labels"), "row_id", "text")


@query(f"""WITH {O.SCORED}, w AS (SELECT DISTINCT row_id, {O.bucket(O.norm('text'))} AS topic, unnest(list_filter({O.toks('text', '[a-z]{3,}')}, lambda w: w NOT IN ({O.words_in(config.STOP_WORDS)}))) AS word FROM scored), c AS (SELECT topic, word, count(*) AS n FROM w GROUP BY ALL)
SELECT topic, word, n, CAST(row_number() OVER (PARTITION BY topic ORDER BY n DESC, word) AS INTEGER) AS rank FROM c QUALIFY rank <= 10""")
def topic_words(s, d):
    t = scored(s, d).withColumn("topic", text.bucket(text.normal(F.col("text"))))
    return topics.top_words(t, "row_id", "topic", "text")


_tw = f"""w AS (SELECT DISTINCT row_id, {O.bucket(O.norm('text'))} AS topic, unnest(list_filter({O.toks('text', '[a-z]{3,}')}, lambda w: w NOT IN ({O.words_in(config.STOP_WORDS)}))) AS word FROM scored),
tc AS (SELECT topic, word, count(*) AS n FROM w GROUP BY ALL), tw AS (SELECT topic, word FROM tc QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, word) <= 10)"""


@query(f"""WITH {O.SCORED}, {_tw}, d AS (SELECT DISTINCT row_id, unnest({O.toks('text', '[a-z]{3,}')}) AS word FROM scored), k AS (SELECT d.* FROM d WHERE word IN (SELECT word FROM tw)), n AS (SELECT count(*) AS n FROM scored),
o AS (SELECT word, count(*) AS c FROM k GROUP BY 1), p AS (SELECT x.topic, x.word AS a, y.word AS b, count(*) AS bn FROM (SELECT * FROM k JOIN tw USING (word)) x JOIN (SELECT * FROM k JOIN tw USING (word)) y ON x.topic = y.topic AND x.row_id = y.row_id AND x.word < y.word GROUP BY 1, 2, 3)
SELECT topic, count(*) AS n_pairs, round(avg(CASE WHEN bn = n THEN 1.0 ELSE ln(bn * n / (oa.c * ob.c)) / -ln(bn / n) END), 4) AS npmi FROM p JOIN o oa ON oa.word = a JOIN o ob ON ob.word = b, n GROUP BY 1""")
def topic_coherence(s, d):
    t = scored(s, d).withColumn("topic", text.bucket(text.normal(F.col("text"))))
    return topics.coherence(t, topics.top_words(t, "row_id", "topic", "text"), "row_id", "text")


@query()
def scoring_texts(s, d):
    t = table(s, d, "documents")
    known = normalise.known_words(t, "text")
    names = [r["full_name"] for r in table(s, d, "speakers").where("full_name is not null").select("full_name").distinct().limit(normalise.MAX_NAMES + 1).collect()]
    return t.select("doc_id", normalise.for_scoring(normalise.normal_form(F.col("text"), known), names).alias("text"))


@query("""WITH p AS (SELECT DISTINCT pair_id, source FROM qa_pairs), k AS (SELECT regexp_replace(pair_id, '^.*_', '') AS pair_id, source FROM p), n AS (SELECT pair_id, count(*) AS n FROM k GROUP BY 1)
SELECT k.pair_id AS source_pair_id, k.source, CASE WHEN n > 1 THEN k.pair_id || '__' || lower(regexp_replace(regexp_replace(regexp_replace(coalesce(k.source, 'unknown-source'), '\\.[^.]+$', ''), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) ELSE k.pair_id END AS pair_id FROM k JOIN n USING (pair_id)""")
def collision_safe_ids(s, d):
    p = table(s, d, "qa_pairs").select(F.regexp_replace("pair_id", "^.*_", "").alias("pair_id"), "source", F.col("pair_id").alias("whole")).distinct().drop("whole")
    return pairing.safe_ids(p).select("source_pair_id", "source", "pair_id")


@query("""WITH names AS (SELECT DISTINCT trim(full_name) AS line FROM speakers WHERE full_name IS NOT NULL), t AS (SELECT row_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM corpus_analyst WHERE text IS NOT NULL),
f AS (SELECT row_id, min(pos) AS pos FROM t JOIN names ON trim(replace(replace(t.line, chr(9), ' '), chr(13), ' ')) = names.line GROUP BY 1)
SELECT c.row_id, f.pos IS NOT NULL AS split FROM corpus_analyst c LEFT JOIN f ON f.row_id = c.row_id""")
def bleed_lines(s, d):
    names = table(s, d, "speakers").select(F.col("full_name").alias("name"))
    return pairing.split_bleed("text", names, table(s, d, "corpus_analyst").select("row_id", "text")).select("row_id", (F.col("bleed") != "").alias("split"))


@query(f"""WITH {O.SCORED}, {O.PAIRS} SELECT p.pair_id, count(s.row_id) AS n_same_period, round(avg(s.net), 6) AS period_net FROM pairs p LEFT JOIN scored s ON p.bank = s.bank AND {O.cp('p.quarter')} = {O.cp('s.quarter')} GROUP BY 1""")
def pairs_with_period_tone(s, d):
    tone = scored(s, d).groupBy("bank", periods.calendar_period(F.col("quarter")).alias("period")).agg(F.count("*").alias("n"), F.sum("net").alias("total"), F.count("net").alias("k"))
    p = pairs(s, d).withColumn("period", periods.calendar_period(F.col("quarter")))
    return p.join(tone, ["bank", "period"], "left").select("pair_id", F.coalesce("n", F.lit(0)).alias("n_same_period"), F.round(F.try_divide("total", "k"), 6).alias("period_net"))


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def event_windows(s, d):
    return windows.tumbling(table(s, d, "events"), "ts", "1 day")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
