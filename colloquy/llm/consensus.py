"""Problem 2: a consensus of several coders' labels, with agreement and reliability.

Minimax conditional entropy. The chance that coder i gives item j of true class c the label k is
exp(s_i[c,k] + t_j[c,k]) / Z: s_i tilts what the coder tends to do, t_j what the item invites. The
tiltings maximise the regularised dual: the log likelihood of the labels, with the true classes
weighted by their posteriors, less alpha/2 |s|^2 and beta/2 |t|^2. Given the posteriors the dual is a
sum over the blocks s_i[c,:] (and, for given s, over t_j[c,:]), so it is climbed block by block: each
block takes a Newton step with its own Hessian, and posteriors are renewed between. Item blocks are
climbed to the end within an item, a step that doesn't raise the item's dual being halved; coder blocks
take one step a round, halved as long as the dual has not risen. It ends when a round raises the dual by
less than TOLERANCE of itself; ``Fit`` holds the dual of every round and whether it came to that.

Items with the same field and the same set of (coder, label) have the same solution, so they are
counted first and each set is solved once; with a fixed staff of coders the number of sets stays
bounded however many items there are. The sets are spread over the cluster and solved there against
the coders' tiltings, which are small (coders x classes x classes per field) and sent with each round;
only sums of that size come back, one set of sums a task. Staffs larger than MAX_CODERS are refused.

Defined results: a coder's latest row for a pair counts (labelled_at, then all columns in order break
ties); a blank, null or unusable label is no label; coders are told apart by their normal names, whatever
characters they hold; an item has a consensus if two different coders gave it usable labels; ties between
classes go to the alphabetically first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import cut, fan

#: Spellings of each field's classes, after lower case and trimming of stops and blanks.
SENTIMENT = {
    "negative": ["negative", "neg", "negatve", "negativ", "negitive", "n"],
    "neutral": ["neutral", "neu", "neut", "nuetral", "netural"],
    "positive": ["positive", "pos", "postive", "positiv", "p"],
}
ADDRESSED = {"no": ["no", "n", "false", "0"], "partly": ["partly", "partially", "partial", "part"], "yes": ["yes", "y", "true", "1"]}
CHANGED = {"no": ["no", "n", "false", "0"], "yes": ["yes", "y", "true", "1"]}
FIELDS = {"q_label": SENTIMENT, "a_label": SENTIMENT, "addressed": ADDRESSED, "changed_topic": CHANGED}
#: Regularisation of coder and item tiltings, most rounds, most steps of an item, and the largest staff.
ALPHA, BETA, ROUNDS, ITEM_STEPS, MAX_CODERS = 1.0, 8.0, 40, 12, 20_000
#: Rise of the dual, as a share of it, below which the ascent ends; and below which an item's ends.
TOLERANCE, ITEM_TOLERANCE = 1e-6, 1e-3
#: A vote is coder * LABELS + label.
LABELS = 8


def normal_label(col: Column, classes: dict[str, list[str]]) -> Column:
    """The class a label spells, or null."""
    c = F.regexp_replace(F.lower(F.trim(col)), r"[\s.]+$", "")
    out = F.lit(None).cast("string")
    for name, spellings in classes.items():
        out = F.when(c.isin(spellings), F.lit(name)).otherwise(out)
    return out


def normal_coder(col: Column) -> Column:
    """A coder's name without case, blanks and the prefix coder."""
    return F.regexp_replace(F.lower(F.trim(col)), r"^(?:coder|annotator)[\s_:\-]*", "")


def usable(labels: DataFrame) -> DataFrame:
    """(pair_id, coder, field, label): the usable labels of each coder's latest row for a pair."""
    cols = ["q_label", "a_label", "addressed", "changed_topic"]
    rows = labels.select("pair_id", normal_coder(F.col("coder")).alias("coder"), "labelled_at", *cols)
    rows = rows.where("pair_id is not null and coder is not null and coder <> ''")
    latest = rows.groupBy("pair_id", "coder").agg(
        F.max_by(F.struct(*cols), F.struct("labelled_at", *[F.coalesce(c, F.lit("")) for c in cols])).alias("r")
    )
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), normal_label(F.col(f"r.{f}"), FIELDS[f]).alias("label")) for f in cols]))
    return latest.select("pair_id", "coder", long.alias("x")).select("pair_id", "coder", "x.field", "x.label").where("label is not null")


def patterns(long: DataFrame, coders: list[str]) -> DataFrame:
    """(pair_id, field, votes): the votes of each item with two coders or more, in order."""
    spark = long.sparkSession
    numbers = spark.createDataFrame(list(enumerate(coders)), "number int, coder string")
    classes = spark.createDataFrame([(f, k, i) for f, x in FIELDS.items() for i, k in enumerate(sorted(x))], "field string, label string, nth int")
    vote = F.col("number") * LABELS + F.col("nth")
    return (
        long.join(F.broadcast(numbers), "coder").join(F.broadcast(classes), ["field", "label"])
        .groupBy("pair_id", "field").agg(F.array_sort(F.collect_set(vote)).alias("votes")).where("size(votes) >= 2")
    )


def _softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    return x / x.sum(axis=-1, keepdims=True)


def _newton(grad: np.ndarray, weight: np.ndarray, p: np.ndarray, at: np.ndarray, n: int, pull: float, here: np.ndarray) -> np.ndarray:
    """Newton steps of ``n`` x classes blocks from vote rows of weight (rows x classes) and chances p."""
    K = p.shape[-1]
    wp = weight[:, :, None] * p
    hess = np.zeros((n, K, K, K))
    np.add.at(hess, at, wp[..., None] * (np.eye(K) - p[:, :, None, :]))
    return np.linalg.solve(hess + pull * np.eye(K), (grad - pull * here)[..., None])[..., 0]


def _solve(s: np.ndarray, prior: np.ndarray, coder: np.ndarray, label: np.ndarray, set_: np.ndarray, n_sets: int, beta: float):
    """(posteriors q, label chances p, dual) of sets: sets x classes, votes x classes x labels, sets.

    Item tiltings start at nothing, so the result depends on the sets and the coders alone.
    """
    K = len(prior)
    given = np.eye(K)[label]

    def state(t: np.ndarray):
        p = _softmax(s[coder] + t[set_])
        logq = np.tile(np.log(prior), (n_sets, 1))
        np.add.at(logq, set_, np.log(np.take_along_axis(p, label[:, None, None], 2)[:, :, 0] + 1e-300))
        top = logq.max(1, keepdims=True)
        q = np.exp(logq - top)
        total = q.sum(1, keepdims=True)
        return q / total, p, (top + np.log(total))[:, 0] - beta / 2 * (t**2).sum((1, 2))

    t = np.zeros((n_sets, K, K))
    q, p, dual = state(t)
    share = np.ones(n_sets)
    for _ in range(ITEM_STEPS):
        grad = np.zeros_like(t)
        np.add.at(grad, set_, q[set_][:, :, None] * (given[:, None, :] - p))
        step = _newton(grad, q[set_], p, set_, n_sets, beta, t)
        tried = t + share[:, None, None] * step
        q2, p2, dual2 = state(tried)
        rose = dual2 >= dual
        t = np.where(rose[:, None, None], tried, t)
        gain = np.where(rose, dual2 - dual, np.inf)
        q, dual = np.where(rose[:, None], q2, q), np.where(rose, dual2, dual)
        p = np.where(rose[set_][:, None, None], p2, p)
        share = np.where(rose, 1.0, share / 2)
        if (gain < ITEM_TOLERANCE).all():
            break
    return q, p, dual


def _votes(votes: pd.Series):
    """Vote rows of sets: coder, label and set numbers."""
    sizes = np.fromiter(map(len, votes), dtype=np.int64, count=len(votes))
    flat = np.concatenate([np.asarray(v, dtype=np.int64) for v in votes]) if len(votes) else np.empty(0, dtype=np.int64)
    return flat // LABELS, flat % LABELS, np.repeat(np.arange(len(votes)), sizes)


class Fit:
    """Fitted tiltings and priors of every field, the coders' numbers, and the dual of every round."""

    def __init__(self, coders: list[str]):
        self.coders = {c: i for i, c in enumerate(coders)}
        self.classes = {f: sorted(x) for f, x in FIELDS.items()}
        self.prior = {f: np.full(len(k), 1 / len(k)) for f, k in self.classes.items()}
        self.s = {f: np.tile(np.eye(len(k)) * 1.5, (len(coders), 1, 1)) for f, k in self.classes.items()}
        self.duals: dict[str, list[float]] = {f: [] for f in self.classes}
        self.converged: dict[str, bool] = dict.fromkeys(self.classes, False)

    def reliability(self, field: str) -> np.ndarray:
        """Per coder the chance of the right label, over the classes' frequencies."""
        return (_softmax(self.s[field].copy())[:, range(len(self.prior[field])), range(len(self.prior[field]))] * self.prior[field]).sum(1)


def _sums(sets: DataFrame, model: Fit, open_: list[str], beta: float) -> dict[tuple[str, str], dict[int, float]]:
    """Per field: gradient, Hessian, class sums and log likelihood over all sets, as {place: sum}."""
    shared = sets.sparkSession.sparkContext.broadcast((model.s, model.prior, len(model.coders)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, prior, n = shared.value
        out: dict[tuple[str, str], np.ndarray] = {}

        def add(field: str, name: str, x: np.ndarray) -> None:
            out[field, name] = out[field, name] + x if (field, name) in out else x

        for b in batches:
            for field, g in b.groupby("field"):
                K = len(prior[field])
                coder, label, set_ = _votes(g["votes"])
                weight = g["weight"].to_numpy()
                q, p, dual = _solve(s[field], prior[field], coder, label, set_, len(g), beta)
                w = q * weight[:, None]
                wv = w[set_]
                grad, hess = np.zeros((n, K, K)), np.zeros((n, K, K, K))
                np.add.at(grad, coder, wv[:, :, None] * (np.eye(K)[label][:, None, :] - p))
                np.add.at(hess, coder, (wv[:, :, None] * p)[..., None] * (np.eye(K) - p[:, :, None, :]))
                for name, x in (("grad", grad), ("hess", hess), ("prior", w.sum(0)), ("dual", np.array([(dual * weight).sum()]))):
                    add(field, name, x.ravel())
        rows = [(f, name, i, v) for (f, name), x in out.items() for i, v in zip(np.flatnonzero(x).tolist(), x[x != 0].tolist(), strict=True)]
        yield pd.DataFrame(rows, columns=["field", "name", "at", "x"])

    got: dict[tuple[str, str], dict[int, float]] = {}
    sums = sets.where(F.col("field").isin(open_)).mapInPandas(work, "field string, name string, at int, x double")
    for r in sums.groupBy("field", "name", "at").agg(F.sum("x").alias("x")).collect():
        got.setdefault((r["field"], r["name"]), {})[r["at"]] = r["x"]
    shared.unpersist()
    return got


def _full(sums: dict[int, float] | None, shape: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(int(np.prod(shape)))
    if sums:
        out[list(sums)] = list(sums.values())
    return out.reshape(shape)


def fit(sets: DataFrame, coders: list[str], rounds: int = ROUNDS, alpha: float = ALPHA, beta: float = BETA) -> Fit:
    """Fit the coders' tiltings on counted sets (field, votes, weight) by ascent of the dual, field by field at once."""
    model = Fit(coders)
    best: dict[str, tuple] = {}  # field -> (dual, s, prior, step, new prior)
    share = dict.fromkeys(model.s, 1.0)
    for _ in range(rounds):
        open_ = [f for f in model.s if not model.converged[f]]
        if not open_:
            break
        got = _sums(sets, model, open_, beta)
        for f in open_:
            s = model.s[f]
            if (f, "prior") not in got:
                model.converged[f] = True
                continue
            prior = _full(got[f, "prior"], model.prior[f].shape) + 1.0
            # the added count of each class is a prior on the class frequencies, and part of the dual
            dual = got[f, "dual"].get(0, 0.0) - alpha / 2 * float((s**2).sum()) + float(np.log(model.prior[f]).sum())
            model.duals[f].append(dual)
            before = best.get(f)
            if before is None or dual >= before[0]:
                if before is not None and dual - before[0] <= TOLERANCE * abs(before[0]):
                    model.converged[f] = True
                    continue
                grad = _full(got.get((f, "grad")), s.shape)
                hess = _full(got.get((f, "hess")), (*s.shape, s.shape[-1]))
                step = np.linalg.solve(hess + alpha * np.eye(s.shape[-1]), (grad - alpha * s)[..., None])[..., 0]
                best[f], share[f] = (dual, s, model.prior[f], step, prior / prior.sum()), 1.0
            else:
                share[f] /= 2
                if share[f] < 1e-3:
                    model.s[f], model.prior[f], model.converged[f] = before[1], before[2], True
                    continue
            _, s, old, step, new = best[f]
            model.s[f] = s + share[f] * step
            mixed = old ** (1 - share[f]) * new ** share[f]
            model.prior[f] = mixed / mixed.sum()
    return model


def _prepared(labels: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Items with their vote sets, the counted sets, and the coders in order."""
    coders = labels.where("pair_id is not null").select(normal_coder(F.col("coder")).alias("c")).where("c is not null and c <> ''").distinct().limit(MAX_CODERS + 1)
    names = sorted(r["c"] for r in coders.collect())
    if len(names) > MAX_CODERS:
        raise ValueError(f"more than {MAX_CODERS} coders")
    items = cut(patterns(usable(labels), names))
    sets = cut(fan(items.groupBy("field", "votes").agg(F.count("*").alias("weight"))))
    return items, sets, names


def solved(labels: DataFrame) -> tuple[DataFrame, DataFrame, Fit]:
    """Items, their sets' posteriors (field, votes, label, chance), and the fit."""
    items, sets, names = _prepared(labels)
    model = fit(sets, names)
    shared = sets.sparkSession.sparkContext.broadcast((model.s, model.prior, model.classes))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, prior, classes = shared.value
        for b in batches:
            for field, g in b.groupby("field"):
                coder, label, set_ = _votes(g["votes"])
                q, _, _ = _solve(s[field], prior[field], coder, label, set_, len(g), BETA)
                best = q.argmax(1)
                yield pd.DataFrame(
                    {"field": field, "votes": g["votes"], "label": np.array(classes[field])[best], "chance": q[np.arange(len(g)), best]}
                )

    post = sets.mapInPandas(work, "field string, votes array<int>, label string, chance double")
    return items, post, model


def consensus(labels: DataFrame) -> DataFrame:
    """(pair_id, field, label): the label most likely right, of every item with two or more coders."""
    items, post, _ = solved(labels)
    return items.join(post, ["field", "votes"]).select("pair_id", "field", "label")


def reliability(labels: DataFrame) -> DataFrame:
    """(field, coder, n_items, reliability, n_agreed): how far each coder can be relied upon."""
    items, post, model = solved(labels)
    spark = labels.sparkSession
    nth = F.broadcast(spark.createDataFrame([(f, i, k) for f, x in model.classes.items() for i, k in enumerate(x)], "field string, nth int, said string"))
    counts = (
        items.groupBy("field", "votes").agg(F.count("*").alias("n")).join(post, ["field", "votes"])
        .select("field", "label", "n", F.explode("votes").alias("v"))
        .select("field", "label", "n", F.expr(f"v div {LABELS}").cast("int").alias("number"), (F.col("v") % LABELS).alias("nth")).join(nth, ["field", "nth"])
        .groupBy("field", "number")
        .agg(F.sum("n").alias("n_items"), F.sum(F.when(F.col("said") == F.col("label"), F.col("n")).otherwise(0)).alias("n_agreed"))
    )
    rows = [(f, i, c, float(model.reliability(f)[i])) for f in model.s for c, i in model.coders.items()]
    known = spark.createDataFrame(rows, "field string, number int, coder string, reliability double")
    return counts.join(F.broadcast(known), ["field", "number"]).select(
        "field", "coder", "n_items", "n_agreed", F.round("reliability", 6).alias("reliability")
    )


def agreement(labels: DataFrame) -> DataFrame:
    """(field, n_items, n_labels, observed, expected, alpha): Krippendorff's nominal alpha per field."""
    long = usable(labels)
    per = Window.partitionBy("pair_id", "field")
    units = (
        long.groupBy("pair_id", "field", "label").agg(F.count("*").alias("n"))
        .withColumn("m", F.sum("n").over(per)).where("m >= 2")
    )
    by_label = units.groupBy("field", "label").agg(F.sum("n").alias("n_label"))
    total = Window.partitionBy("field")
    chance = (
        by_label.withColumn("all", F.sum("n_label").over(total)).groupBy("field")
        .agg(F.first("all").alias("n_labels"), F.sum(F.col("n_label") * (F.col("all") - F.col("n_label"))).alias("apart"))
        .select("field", "n_labels", F.try_divide("apart", F.col("n_labels") * (F.col("n_labels") - 1)).alias("expected"))
    )
    seen = units.groupBy("field").agg(
        F.count_distinct("pair_id").alias("n_items"), F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1)).alias("apart")
    )
    return seen.join(chance, "field").select(
        "field", "n_items", "n_labels", F.round(1 - F.col("apart") / F.col("n_labels"), 6).alias("observed"),
        F.round(1 - F.col("expected"), 6).alias("expected"),
        F.round(1 - F.try_divide(F.col("apart") / F.col("n_labels"), F.col("expected")), 6).alias("alpha"),
    )
