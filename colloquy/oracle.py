"""The same queries as SQL for DuckDB, over views named like the tables."""

from __future__ import annotations

from colloquy import config
from colloquy.functions import text as T

PEERS = config.PEERS


def cp(q: str) -> str:
    """The shared period of a label."""
    tags = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.PERIOD_TAGS.items())
    t = f"CASE regexp_extract(lower(trim({q})), '^(20\\d{{2}})[-_]?(.*)$', 2) {tags} END"
    return f"(CASE WHEN {q} IS NULL THEN NULL WHEN ({t}) IS NOT NULL THEN regexp_extract(lower(trim({q})), '^(20\\d{{2}})[-_]?(.*)$', 1) || '-' || ({t}) ELSE {q} END)"


def year(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '(20\\d{{2}})', 1), '') AS INTEGER)"


def order(x: str) -> str:
    o = " ".join(f"WHEN '{k}' THEN {v}" for k, v in config.PERIOD_ORDER.items())
    return f"(CASE regexp_extract({cp(x)}, '^20\\d{{2}}-(H1q1|H1|Q3|FY)$', 1) {o} ELSE 9 END)"


def band(x: str) -> str:
    return f"(CASE WHEN {year(x)} IS NULL THEN 'unknown' WHEN {year(x)} < 2012 THEN 'single_bank' WHEN {year(x)} > 2025 THEN 'partial' ELSE 'both_complete' END)"


def toks(t: str, p: str = "[a-z0-9]+") -> str:
    return f"regexp_extract_all(lower(coalesce({t}, '')), '{p}')"


def norm(t: str) -> str:
    return f"(' ' || coalesce(array_to_string({toks(t)}, '  '), '') || ' ')"


def count(n: str, keyword: str) -> str:
    c = f"len(regexp_extract_all({n}, '{T.keyword_pattern(keyword)}'))"
    ex = T.bare_pattern(keyword)
    return f"({c} - len(regexp_extract_all({n}, '{ex}')))" if ex else c


def hit(n: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"{count(n, w)} > 0" for w in words) + ")"


def votes(n: str, entries: list[list[str]]) -> str:
    return "(" + " + ".join(f"CAST({hit(n, e)} AS INTEGER)" for e in entries) + ")"


def bucket(n: str) -> str:
    hits = {b: hit(n, config.METRIC_WORDS[m]) for m, b in config.BUCKETS.items()}
    total = " + ".join(f"CAST({h} AS INTEGER)" for h in hits.values())
    one = " ".join(f"WHEN {h} THEN '{b}'" for b, h in hits.items())
    return f"(CASE WHEN {total} = 0 THEN 'untagged' WHEN {total} > 1 THEN 'mixed' {one} END)"


def category(n: str) -> str:
    """Most distinct keywords, of equals the last by name."""
    parts = []
    for c, keys in config.CATEGORIES.items():
        k = " + ".join(f"CAST({count(n, w)} > 0 AS INTEGER)" for w in keys)
        parts.append(f"lpad(CAST({k} AS VARCHAR), 3, '0') || '|{c}'")
    best = f"greatest({', '.join(parts)})"
    return f"(CASE WHEN substr({best}, 1, 3) = '000' THEN 'untagged' ELSE substr({best}, 5) END)"


def blank(t: str) -> str:
    return f"(coalesce(regexp_replace(lower({t}), '^\\s+|\\s+$', '', 'g'), '') IN ('', 'nan', 'none'))"


def words_in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


SCORED = """scored AS (SELECT row_id, text, bank, quarter, source, human_label, human_reviewed, finbert_sentiment AS label,
  CASE finbert_sentiment WHEN 'positive' THEN finbert_score WHEN 'negative' THEN -finbert_score WHEN 'neutral' THEN 0.0 END AS net FROM sentiment_labels)"""
TURN = """turn1 AS (SELECT source, turn_no, arg_min({c}, row_id) AS r FROM corpus_analyst WHERE source IS NOT NULL AND turn_no IS NOT NULL GROUP BY 1, 2)"""
PAIRS = """pairs AS (SELECT DISTINCT pair_id, bank, quarter, source, question_text, answer_text FROM qa_pairs)"""


def pairs_labelled() -> str:
    n, a = norm("question_text"), norm("answer_text")
    return f"""{PAIRS}, n AS (SELECT *, {n} AS nq, {a} AS na FROM pairs),
    lab AS (SELECT *, {bucket('nq')} AS bq, {bucket('na')} AS ba, {category('nq')} AS cq, {category('na')} AS ca FROM n)"""


def behaviour_sql() -> str:
    m = list(config.METRIC_WORDS.values())
    asked = " OR ".join(hit("nq", w) for w in m)
    both = " OR ".join(f"({hit('nq', w)} AND {hit('na', w)})" for w in m)
    miss = f"({blank('question_text')} OR {blank('answer_text')})"
    single = "(bq NOT IN ('untagged', 'mixed') AND ba NOT IN ('untagged', 'mixed'))"
    stop = words_in(config.STOP_WORDS)
    cq = f"list_distinct(list_filter({toks('question_text')}, lambda w: length(w) >= 3 AND w NOT IN ({stop})))"
    ca = f"list_distinct(list_filter(({toks('answer_text')})[1:100], lambda w: length(w) >= 3 AND w NOT IN ({stop})))"
    q3, a3 = f"list_distinct({toks('question_text', '[a-z]{3,}')})", f"list_distinct({toks('answer_text', '[a-z]{3,}')})"

    def share(x: str, y: str) -> str:
        return f"CASE WHEN len({x}) > 0 THEN round(len(list_intersect({x}, {y})) / len({x}), 3) END"

    return f"""behaviour AS (SELECT pair_id, bank, quarter,
      CASE WHEN NOT {miss} AND len({a3}) > 0 THEN {share(q3, a3)} END AS directness,
      CASE WHEN NOT {miss} THEN {share(cq, ca)} END AS directness_v2,
      CASE WHEN NOT {miss} AND ({asked}) THEN CAST(({both}) AS DOUBLE) END AS metric_coverage,
      CASE WHEN NOT {miss} THEN CAST(({single} AND bq <> ba) AS DOUBLE) END AS topic_substitution,
      (NOT {miss} AND {single}) AS substitution_measurable FROM lab)"""


def presence() -> str:
    return f"""WITH base AS (SELECT bank, {cp('quarter')} AS calendar_period, seed_topic AS topic FROM corpus_analyst WHERE seed_topic IS NOT NULL AND bank IS NOT NULL AND quarter IS NOT NULL),
    c AS (SELECT bank, calendar_period, topic, count(*) AS n_turns FROM base GROUP BY ALL),
    p AS (SELECT bank, calendar_period, CAST(sum(n_turns) AS BIGINT) AS n_turns_print FROM c GROUP BY ALL), t AS (SELECT DISTINCT bank, topic FROM c),
    g AS (SELECT p.bank, p.calendar_period, t.topic, coalesce(c.n_turns, 0) AS n_turns, n_turns_print FROM p JOIN t USING (bank) LEFT JOIN c ON c.bank = p.bank AND c.calendar_period = p.calendar_period AND c.topic = t.topic),
    l AS (SELECT *, n_turns > 0 AS present, lag(n_turns > 0) OVER (PARTITION BY bank, topic ORDER BY {year('calendar_period')}, {order('calendar_period')}, calendar_period) AS before FROM g)
    SELECT bank, calendar_period, topic, n_turns, present, n_turns_print, CASE WHEN before IS NULL THEN CASE WHEN present THEN 'first_seen' ELSE 'first_absent' END
      WHEN present AND NOT before THEN 'appeared' WHEN NOT present AND before THEN 'disappeared' WHEN present THEN 'continued' ELSE 'still_absent' END AS delta FROM l"""


def reported() -> str:
    ab = words_in(config.ABSOLUTE_METRICS)
    o = f"ORDER BY {year('calendar_period')}, {order('calendar_period')}, calendar_period"
    return f"""rm0 AS (SELECT bank, {cp('quarter')} AS calendar_period, metric, round(sum(CAST(round(value * 100) AS BIGINT)) / count(*) / 100, 4) AS value FROM numeric_claims WHERE metric IS NOT NULL AND value IS NOT NULL AND bank IS NOT NULL GROUP BY ALL),
    rm1 AS (SELECT *, lag(value) OVER (PARTITION BY bank, metric {o}) AS prior FROM rm0),
    rm2 AS (SELECT *, CASE WHEN metric IN ({ab}) THEN abs(value) ELSE value END AS c, CASE WHEN metric IN ({ab}) THEN abs(prior) ELSE prior END AS p FROM rm1),
    reported AS (SELECT bank, calendar_period, metric, value, prior, CASE WHEN p IS NULL OR p = 0 OR abs((c - p) / abs(p)) <= 0.01 THEN 'flat' WHEN (c - p) / abs(p) > 0 THEN 'up' ELSE 'down' END AS direction FROM rm2)"""


def narrative() -> str:
    parts = " UNION ALL ".join(f"SELECT bank, calendar_period, net, '{m}' AS metric FROM nn WHERE {hit('n', w)}" for m, w in config.METRIC_WORDS.items())
    return f"""nn AS (SELECT bank, {cp('quarter')} AS calendar_period, net, {norm('text')} AS n FROM scored WHERE net IS NOT NULL AND bank IS NOT NULL),
    nx AS ({parts} UNION ALL SELECT bank, calendar_period, net, 'overall' FROM nn),
    narrative AS (SELECT bank, calendar_period, metric, round(avg(net), 6) AS sentiment_net, count(*) AS n_turns FROM nx GROUP BY ALL)"""


def compared() -> str:
    ab = words_in(config.ABSOLUTE_METRICS)
    return f"""{SCORED}, {narrative()}, {reported()}, told AS (SELECT bank, calendar_period, metric, sentiment_net, direction,
      CASE WHEN sentiment_net > 0.05 THEN CASE WHEN metric IN ({ab}) THEN 'down' ELSE 'up' END WHEN sentiment_net < -0.05 THEN CASE WHEN metric IN ({ab}) THEN 'up' ELSE 'down' END
      WHEN sentiment_net IS NOT NULL THEN 'flat' END AS narrative_direction FROM narrative JOIN reported USING (bank, calendar_period, metric))"""


def coder_long() -> str:
    forms = {"negative": ["negative", "neg", "negatve"], "neutral": ["neutral", "neu", "neut", "nuetral"], "positive": ["positive", "pos", "postive"]}
    c = "regexp_replace(lower(trim(q_label)), '[\\s.]+$', '')"
    label = " ".join(f"WHEN {c} IN ({words_in(v)}) THEN '{k}'" for k, v in forms.items())
    return f"""lng AS (SELECT DISTINCT pair_id AS item, regexp_replace(lower(trim(coder)), '^coder_', '') AS coder, CASE {label} END AS label,
      labelled_at FROM coder_labels), long AS (SELECT item, coder, arg_max(label, labelled_at) AS label FROM lng WHERE label IS NOT NULL GROUP BY ALL)"""


def lex(t: str) -> str:
    """Sum of pos and neg words with the negation window, as (n, pos, neg) columns of a subquery row."""
    pos, neg, no = words_in(config.LEXICON_POSITIVE), words_in(config.LEXICON_NEGATIVE), words_in(config.NEGATORS)
    return f"""(SELECT {{'n': count(*), 'pos': coalesce(sum(CAST(w IN ({pos}) AND NOT coalesce(b, false) AS INTEGER)), 0), 'neg': coalesce(sum(CAST((w IN ({pos}) AND coalesce(b, false)) OR w IN ({neg}) AS INTEGER)), 0)}}
      FROM (SELECT w, bool_or(w IN ({no})) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b FROM (SELECT unnest({t}) AS w, generate_subscripts({t}, 1) AS i)))"""
