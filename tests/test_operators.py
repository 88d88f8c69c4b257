import random
import re

from colloquy.operators import agreement, compare, evidence, pairing, sampling, topics


def test_peer_gap_keeps_only_paired_periods_in_the_window(spark):
    rows = [("a", "2020-interim", 0.3), ("b", "2020-q2", 0.2), ("a", "2011-interim", 0.1), ("b", "2011-q2", 0.1), ("a", "2021-q1", 0.5), ("c", "2020-q2", 9.0), ("b", "2020-q2", None)]
    df = spark.createDataFrame(rows, "bank string, quarter string, net double")
    got = compare.peer_gap(df, ("a", "b")).collect()
    assert [(r["calendar_period"], round(r["gap"], 6)) for r in got] == [("2020-H1", 0.1)]
    assert {r["calendar_period"] for r in compare.peer_gap(df, ("a", "b"), window_only=False).collect()} == {"2020-H1", "2011-H1"}
    assert compare.peer_gap(df.limit(0), ("a", "b")).count() == 0


def test_change_points(spark):
    v = [1.0, 1.1, 0.9, 5.0, 1.0]
    df = spark.createDataFrame([("a", f"20{15 + i}-fy", x) for i, x in enumerate(v)] + [("b", f"20{15 + i}-fy", x) for i, x in enumerate([1.0, 1.0, 2.0])], "bank string, calendar_period string, net double")
    got = {(r["bank"], r["calendar_period"]): r["changepoint"] for r in compare.rolling_flags(df).collect()}
    assert got["a", "2018-fy"] and got["a", "2017-fy"] and not got["a", "2016-fy"] and not got["a", "2015-fy"]
    assert got["b", "2017-fy"]  # without spread any other value is one


def test_presence(spark):
    rows = [("a", "2020-q1", "x"), ("a", "2020-q2", "y"), ("a", "2020-q3", "x")]
    got = {(r["topic"], r["calendar_period"]): r["delta"] for r in compare.presence_delta(spark.createDataFrame(rows, "bank string, quarter string, topic string")).collect()}
    assert got == {
        ("x", "2020-H1q1"): "first_seen", ("x", "2020-H1"): "disappeared", ("x", "2020-Q3"): "appeared",
        ("y", "2020-H1q1"): "first_absent", ("y", "2020-H1"): "appeared", ("y", "2020-Q3"): "disappeared",
    }


def plain_pairs(turns):
    out = []
    names = {t[1].lower() for t in turns if t[2] == "analyst" and t[1]}
    i, pid, follow = 0, 0, 0
    while i < len(turns):
        _, who, role, text = turns[i]
        again = role != "analyst" and who.lower() in names
        if role != "analyst" and not again:
            i += 1
            continue
        j, answers = i + 1, []
        while j < len(turns) and turns[j][2] == "management" and turns[j][1].lower() not in names:
            answers.append(turns[j][3])
            j += 1
        if again:
            follow += 1
        else:
            pid, follow = pid + 1, 0
        out.append((f"bk_q_{pid:03d}" + (chr(97 + follow) if again else ""), text, " ".join(answers), len(answers)))
        i = max(j, i + 1)
    return out


def test_pairing_equals_a_plain_loop(spark):
    rnd = random.Random(1)
    rows, want = [], {}
    for s in range(25):
        turns = []
        for n in range(rnd.randint(0, 14)):
            role = rnd.choice(["analyst", "management", "management", "operator"])
            who = rnd.choice(["Ann", "Bob", "Cy"]) if role == "analyst" else rnd.choice(["Ann", "Dan", "Eve"])
            turns.append((n + 1, who, role, f"t{s}_{n}"))
        want[f"s{s}"] = plain_pairs(turns)
        for k, t in enumerate(turns):
            rows.append((s * 100 + k, f"s{s}", *t, "bk", "q"))
            if rnd.random() < 0.2:  # delivered again
                rows.append((s * 100 + k + 50, f"s{s}", *t, "bk", "q"))
    df = spark.createDataFrame(rows, "row_id long, source string, turn_no int, speaker string, role string, text string, bank string, quarter string")
    df = df.withColumnRenamed("x", "x")
    got = {}
    for r in pairing.pair_qa(df).orderBy("source", "question_turn").collect():
        got.setdefault(r["source"], []).append((r["pair_id"], r["question_text"], r["answer_text"], r["n_answer_turns"]))
    assert got == {k: v for k, v in want.items() if v}


def test_bleed_is_split_at_a_line_with_a_known_name(spark):
    names = spark.createDataFrame([("Anna Cross",)], "name string")
    rows = spark.createDataFrame([("Why?\nAnna Cross\nBecause.",), ("Why?",)], "q string")
    got = [(r["before"], r["bleed"]) for r in pairing.split_bleed("q", names, rows).collect()]
    assert got == [("Why?", "Anna Cross\nBecause."), ("Why?", "")]


def test_agreement(spark):
    p = spark.createDataFrame([("x", "a", "a"), ("x", "b", "b"), ("x", "a", "b"), ("x", "b", "b"), ("y", "a", "a")], "g string, label_a string, label_b string")
    got = {r["g"]: (r["n"], r["raw"], r["kappa"]) for r in agreement.kappa(p, "g").collect()}
    assert got["x"][:2] == (4, 0.75) and abs(got["x"][2] - 0.5) < 1e-6
    assert got["y"] == (1, 1.0, None)
    long = spark.createDataFrame([("1", "a", "x"), ("1", "b", "x"), ("2", "a", "x"), ("2", "b", "y"), ("3", "a", None)], "item string, coder string, label string")
    assert {r["item"]: r["label"] for r in agreement.majority(long).collect()} == {"1": "x", "2": "x"}
    assert {r["item"]: r["label"] for r in agreement.strict(long).collect()} == {"1": "x", "2": None}
    assert agreement.krippendorff(long).first()["n_items"] == 2
    assert agreement.kappa(p.limit(0)).count() in (0, 1)


def test_auc_and_spearman_with_ties(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.5), (False, 0.5), (False, 0.1), (None, 0.3)], "p boolean, s double")
    assert agreement.auc(df, "p", "s").first()["auc"] == 0.875
    xy = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 1.0)], "a double, b double")
    assert agreement.spearman(xy, "a", "b").first()["rho"] == 1.0


def test_upsert_keeps_manual_columns_and_marks_stale(spark):
    old = spark.createDataFrame([("1", "yes", "t1"), ("2", "", "t2"), ("3", "no", "t3")], "id string, human string, text string")
    new = spark.createDataFrame([("1", "", "n1"), ("2", "", "n2"), ("4", "", "n4")], "id string, human string, text string")
    got = {r["id"]: (r["human"], r["text"], r["stale"]) for r in sampling.upsert(old, new, "id", ["human"]).collect()}
    assert got == {"1": ("yes", "n1", False), "2": ("", "n2", False), "4": ("", "n4", False), "3": ("no", "t3", True)}


def test_nearest_centroid_of_equals_is_smaller(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    assert {r["vec_id"]: r["topic"] for r in topics.nearest_centroid(df).collect()} == {1: 0, 2: 1, 3: 2}


def test_blocks_equal_one_window(spark, monkeypatch):
    from pyspark.sql import functions as F

    from colloquy.plans import blocks

    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "b", None]), n, rnd.randint(0, 3)) for n in range(200)]
    df = spark.createDataFrame(rows, "g string, n int, v int")
    got = {r["n"]: r["s"] for r in blocks.running_sums(df, ["g"], F.expr("n div 7"), ["n"], {"s": F.col("v")}).collect()}
    want, sums = {}, {}
    for g, n, v in rows:
        sums[g] = sums.get(g, 0) + v
        want[n] = sums[g]
    assert got == want
    part = sampling.split(df.withColumn("id", F.col("n")), "id", "g", 0.75, "x").groupBy("g", "part").count().collect()
    n = {}
    for g, _, _ in rows:
        n[g] = n.get(g, 0) + 1
    assert {(r["g"], r["count"]) for r in part if r["part"] == "train"} == {(g, -(-3 * c // 4)) for g, c in n.items()}
    monkeypatch.setattr(pairing, "BLOCK", 3)
    test_pairing_equals_a_plain_loop(spark)


def plain_figures(question, answer, most=6):
    blob = f"{question or ''}\n{answer or ''}".lower()
    out = []
    for m in re.finditer(evidence.CLAIM, blob, re.ASCII):
        value = float(re.search(r"\d[\d,]*(?:\.\d+)?", m[0])[0].replace(",", ""))
        unit = re.search(r"(?:%|bps|bp|billion|bn|million|mn|m|ppt)?$", m[0])[0]
        near = re.search(evidence.NEAR, blob[max(0, m.start() - 48) : m.end() + 48])
        if (unit or not 1900 <= value <= 2035) and (unit or near) and len(out) < most:
            out.append((len(out) + 1, m[0].strip(" "), value, unit))
    return out


def test_figures_see_past_other_figures(spark):
    rnd = random.Random(3)
    bits = ["our income in 2023 was 512", "512", "2023", "costs", "rose", "CET1", "4.5 %", "£1,200 million", "a line\n", "😀é", "x" * 20, "7", "8 9", "12 bps", "the branch", "fee"]
    rows = [("a", None, "Our income in 2023 was 512"), ("b", None, "income 1 2 3 4 5 6 7 8"), ("c", "income" + "x" * 42 + " 77", ""), ("d", "income" + "x" * 43 + " 77", ""), ("e", None, None)]
    rows += [("f", "income " + "😀" * 40 + " 77", "1" + " 2 x" * 60)]
    rows += [(f"r{i}", " ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))), " ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))) for i in range(200)]
    got = {}
    for r in evidence.figures(spark.createDataFrame(rows, "pair_id string, question_text string, answer_text string")).orderBy("pair_id", "at").collect():
        got.setdefault(r["pair_id"], []).append((r["at"], r["span"], r["value"], r["unit"]))
    assert got["a"] == [(1, "512", 512.0, "")]
    assert got == {k: f for k, q, a in rows if (f := plain_figures(q, a))}


def test_kappa_interval_draws_poisson_counts(spark):
    import numpy as np

    cells = {("a", "a"): 6, ("b", "b"): 3, ("a", "b"): 1, ("b", "a"): 2}
    rows = [c for c, n in cells.items() for _ in range(n)]
    got = agreement.bootstrap_kappa(spark.createDataFrame([*rows, (None, "a")], "label_a string, label_b string")).first()
    w = np.random.default_rng(7).poisson(list(cells.values()), (200_000, 4)).astype(float)
    w = w[w.sum(1) > 0]
    t = w.sum(1)
    a, b = (w[:, 0] + w[:, 2]) / t, (w[:, 0] + w[:, 3]) / t
    pe = a * b + (1 - a) * (1 - b)
    with np.errstate(all="ignore"):
        k = ((w[:, 0] + w[:, 1]) / t - pe) / (1 - pe)
    low, high = np.nanpercentile(k, [2.5, 97.5])
    assert got["resamples"] > 1_900
    assert abs(got["low"] - low) < 0.1 and abs(got["high"] - high) < 0.1  # values of few pairs lie 0.06 apart
    assert agreement.bootstrap_kappa(spark.createDataFrame([], "label_a string, label_b string")).first()["resamples"] == 0


def test_ids_stay_apart_past_a_thousand_questions_and_26_follow_ups(spark):
    rows = [(n, "s", n, "Ann" if n <= 1204 else "Bob", "analyst" if n <= 1204 else "management", f"q{n}", "b", "q") for n in range(1, 1206)]
    rows += [(2000 + n, "t", n, "Ann", "analyst" if n == 0 else "other", f"t{n}", "b", "q") for n in range(40)]
    df = spark.createDataFrame(rows, "row_id long, source string, turn_no int, speaker string, role string, text string, bank string, quarter string")
    got = {(r["source"], r["pair_id"]) for r in pairing.pair_qa(df).collect()}
    assert len(got) == 1204 + 40 and ("s", "b_q_007") in got and ("s", "b_q_1204") in got and ("t", "b_q_001z") in got and ("t", "b_q_001z26") in got


def test_ids_met_twice_get_their_source(spark):
    rows = spark.createDataFrame([("a_1", "One File.txt"), ("a_1", "two.pdf"), ("a_2", "two.pdf"), ("a_1", None)], "pair_id string, source string")
    got = {(r["source_pair_id"], r["pair_id"]) for r in pairing.safe_ids(rows).collect()}
    assert got == {("a_1", "a_1__one-file"), ("a_1", "a_1__two"), ("a_2", "a_2"), ("a_1", "a_1__unknown-source")}


def test_long_handovers_are_told_from_questions(spark):
    from pyspark.sql import functions as F

    from colloquy.functions import text as T

    long = "Thank you all very much indeed for that. Our next question today comes from the line of Ann Lee at Elm Research, please go ahead when you are ready."
    rows = [(long, "operator_handover"), (long + " Why did it fall?", "off_seed"), ("Thanks a lot.", "courtesy_or_fragment"), ("And why?", "short_follow_up"), (None, "courtesy_or_fragment"), ("word " * 20, "off_seed")]
    df = spark.createDataFrame(rows, "q string, want string")
    assert [r["got"] for r in df.select(T.untagged_reason(F.col("q"), F.lit("untagged")).alias("got")).collect()] == [w for _, w in rows]


def test_bleed_with_many_names_and_rows_without_text(spark):
    names = spark.range(9_000).selectExpr("concat('Name ', id) AS name")
    rows = spark.createDataFrame([("Why?\n  Name 8999\nSo.\nName 3\nx", 1), (None, 2), ("", 3), ("Name 1", 4)], "q string, k int")
    got = {r["k"]: (r["before"], r["bleed"]) for r in pairing.split_bleed("q", names, rows).collect()}
    assert got == {1: ("Why?", "Name 8999\nSo.\nName 3\nx"), 2: (None, ""), 3: ("", ""), 4: ("", "Name 1")}


def test_figures_carry_context_and_horizon(spark):
    df = spark.createDataFrame([("p", "Income in FY 2023 was 512 against 498 this year", "It rose 5% to £3.2bn, see 2019")], "pair_id string, question_text string, answer_text string")
    got = {r["span"]: (r["value"], r["unit"], r["time_horizon"]) for r in evidence.figures(df).collect()}
    assert got["512"] == (512.0, "", "fy 2023") and got["5%"][:2] == (5.0, "%") and got["£3.2bn"][:2] == (3.2, "bn") and "2019" not in got


def test_proportional_sample_quotes_and_bundle(spark):
    rows = spark.createDataFrame([(i, "a" if i < 70 else "b" if i < 99 else None) for i in range(100)], "k int, c string")
    got = [r["c"] for r in sampling.proportional(rows, "k", "c", 10, "s").collect()]
    assert len(got) == 10 and got.count("a") in (7, 8) and got.count(None) == 1
    assert sampling.proportional(rows, "k", "c", 500, "s").count() == 100 and sampling.proportional(rows.limit(0), "k", "c", 5, "s").count() == 0
    q = compare.quotes(spark.createDataFrame([("x", 1, "neutral", 0.0), ("x", 2, "negative", -0.5), ("x", 3, "negative", -0.9), ("x", 4, None, None)], "g string, k int, label string, net double"), "k", ["g"], 3)
    assert {(r["k"], r["nth"]) for r in q.collect()} == {(3, 1), (2, 2), (1, 3)}
    long = spark.createDataFrame([("m", "q", 1, "a", "a"), ("m", "q", 2, "b", "a"), ("m", "a", 1, "b", "b"), ("m", "a", 2, None, "b")], "unit string, side string, item int, gold string, guess string")
    got = {r["side"]: (r["n"], r["raw"]) for r in agreement.bundle(long).collect()}
    assert got == {"q": (2, 0.5), "a": (1, 1.0), "pooled": (3, 0.666667)}
    corpus = spark.createDataFrame([("b", "q", " Why? ", 2, "old"), ("b", "q", "Why?", 1, "new"), ("b", "q", "x", 3, None)], "bank string, quarter string, text string, row_id int, topic string")
    asked = spark.createDataFrame([("b", "q", "Why?"), ("b", "r", "Why?"), ("b", "q", None)], "bank string, quarter string, question_text string")
    assert {(r["quarter"], r["question_text"], r["topic"]) for r in compare.attach_topic(asked, corpus, "topic").collect()} == {("q", "Why?", "new"), ("r", "Why?", None), ("q", None, None)}
