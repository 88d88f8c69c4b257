"""Problem 9: held-out evaluation items found again in the documents.

A prefix-filtered set join. Items and documents become sequences of normal words and sets of word
shingles: five words, three for items under LONG words (fewer if the item has fewer). A passage holds
at most one changed, missing or added word in eight, so some of its shingles survive. In every window
of an item the shingles are ordered by how often they occur in the documents, and only the rarest are
joined, just so many that a survivor must be among them (``necessary``); shingles met often are salted.

A hit gives a diagonal and a place in the item. A shortest passage is at most REACH words long, so only
the words that far around the hit are compared, within both texts: a dynamic program over item words,
shifts of the diagonal and passage lengths, on whole batches of windows at once, decides exactly
whether a passage of at least twelve words, or a whole shorter item, stands there with at most one
change in eight words. A passage begins and ends on equal words.

Items made from one form differ in a few words. Where an item has no unbroken passage in a document
and another item of the document has every equal word of its passage, and more of the words around,
the document quotes the other one there. Nothing else is settled between items.

Defined results: null, empty and blank texts leak nothing; items without words are in no pair; equal
items given twice leak twice, each under its id; further columns are ignored; empty tables give an
empty result; texts are read whole, and the work is linear in their length and in the hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import BROADCAST_ROWS, cut, fan, small, spread

#: Words of a shingle, of a shingle of short items, and of an item that isn't short.
SHINGLE, SHORT, LONG = 5, 3, 13
#: Least words of a passage, and words per changed word.
PASSAGE, PER_CHANGE = 12, 8
#: Most words of a shortest passage; a longer one holds a shorter one (see ``necessary``).
REACH = 31
#: Item places that are compared as one window, and most words that are missing or added in a row.
BIN, SHIFT = 32, 3
#: Words of all items together that may be sent to the tasks; with more, items are joined instead.
HELD_WORDS = 2_000_000
#: Hits of a shingle beyond which its hits and items are dealt out over salts, where they are shuffled.
HOT_SHINGLE = 20_000
#: Words compared at once.
CELLS = 1 << 18


def words(text: Column) -> Column:
    """Lower-case words without punctuation, tags, entities and invisible characters."""
    t = F.lower(text)
    marked = F.contains(t, F.lit("<")) | F.contains(t, F.lit("&"))
    t = F.when(marked, F.regexp_replace(t, r"<[a-z/!][^<>]{0,60}>|&(?:[a-z]{2,8}|#\d{1,6});", " ")).otherwise(t)
    t = F.translate(t, "​‌‍­﻿'’‘ʼ`-‐‑", "")
    return F.filter(F.split(t, r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != "")


def _shingle(size: Column | int, at: str = "i") -> str:
    return f"xxhash64(slice(h, {at}, {size}))"


def necessary(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(item_id, item_pos, shingle): the shingles of which every passage has one unchanged.

    Long items: of the 12 shingles of 16 words two changed words spare at least 2, so the 11 rarest have
    a survivor; that covers passages of 12 to 23 words. One of 24 to 31 words has three changes: if no 16
    of its words have fewer, its first 8 are unchanged. A longer one has a half that is a passage.
    Items of 13 to 15 words: one change spares 3 of the 8 shingles of 12 words, so the 6 rarest do. Short
    items are passages as a whole: of S shingles a change spares S - SHORT; without one all are spared.
    """
    g, n = F.col("g"), F.col("n")
    sh = items.select("item_id", "n", "g", F.posexplode(F.expr(f"transform(sequence(1, n - g + 1), i -> {_shingle('g')})")).alias("item_pos", "shingle"))
    span = F.when(n >= 16, 16).when(n >= LONG, PASSAGE).otherwise(n)
    spoilt = F.floor(span / PER_CHANGE) * g
    in_window = Window.partitionBy("item_id", "start").orderBy("hits", "shingle", "item_pos")
    return (
        sh.join(counts, "shingle", "left").fillna({"hits": 0})
        .withColumn("size", span - g + 1).withColumn("keep", F.least(F.col("size"), spoilt + 1)).withColumn("last", n - span)
        .withColumn("start", F.explode(F.sequence(F.greatest(F.col("item_pos") - F.col("size") + 1, F.lit(0)), F.least(F.col("item_pos"), F.col("last")))))
        .withColumn("rank", F.row_number().over(in_window))
        .where(F.col("rank") <= F.col("keep"))
        .select("item_id", "item_pos", "shingle")
        .distinct()
    )


def straight(same: np.ndarray, n: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, first word, last word) of the best passage without missing or added words, from where words are equal."""
    rows, width = same.shape
    here = np.arange(width) < n[:, None]
    least = np.minimum(n, PASSAGE)
    total = np.zeros((rows, width + 1), dtype=np.int32)
    np.cumsum(np.where(same & here, 1, 1 - PER_CHANGE), axis=1, out=total[:, 1:])
    far = np.int32(1 << 28)
    begins = np.where(short[:, None], np.arange(width) == 0, same & here)
    ends = np.where(short[:, None], np.arange(width) == (n - 1)[:, None], same & here)
    low = np.where(begins, total[:, :-1], far)
    lowest = np.minimum.accumulate(low, axis=1)
    back = np.arange(width) - (least - 1)[:, None]
    before = np.where(back >= 0, np.take_along_axis(lowest, np.maximum(back, 0), 1), far)
    gain = np.where(ends, total[:, 1:] - before, -far)
    last = gain.argmax(1)
    every = np.arange(rows)
    first = (low == before[every, last][:, None]).argmax(1)
    return gain[every, last] >= 0, first, last


def passages(a: np.ndarray, w: np.ndarray, n: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, ...]:
    """(found, first word, last word, first shift, last shift) of windows of items in documents.

    ``a`` are item words (rows x N, the first ``n`` of each row count), ``w`` the document's words around
    them (rows x N + 2 SHIFT, so that w[SHIFT + i] faces a[i]). A state is (words of the passage so far,
    at most PASSAGE; shift); of each the best score is kept, where an item word gives 1 and a change takes
    PER_CHANGE, so that a passage has a score of at least 0. A short row must be met whole.
    """
    rows, width = a.shape
    G, L = 2 * SHIFT + 1, PASSAGE
    none = np.int32(-1_000_000)
    least = np.minimum(n, PASSAGE)
    score = np.full((rows, L + 1, G), none, dtype=np.int32)
    began = np.zeros((rows, L + 1, G), dtype=np.int32)  # first word * G + first shift
    best = np.full(rows, none, dtype=np.int32)
    where = np.zeros((rows, 2), dtype=np.int32)
    every = np.arange(rows)
    shifts = np.arange(G, dtype=np.int32)
    for i in range(width):
        live = i < n
        if not live.any():
            break
        same = a[:, i, None] == w[:, i : i + G]
        gain = np.where(same, 1, 1 - PER_CHANGE).astype(np.int32)
        new, origin = np.full_like(score, none), np.zeros_like(began)
        # one word on, along the same shift
        new[:, 1:, :] = score[:, :-1, :] + gain[:, None, :]
        origin[:, 1:, :] = began[:, :-1, :]
        last = score[:, L, :] + gain
        better = last > new[:, L, :]
        new[:, L, :] = np.where(better, last, new[:, L, :])
        origin[:, L, :] = np.where(better, began[:, L, :], origin[:, L, :])
        # an item word that the document lacks
        for lo, hi in ((slice(0, L), slice(1, L + 1)), (slice(L, L + 1), slice(L, L + 1))):
            lost = score[:, lo, 1:] + (1 - PER_CHANGE)
            better = lost > new[:, hi, :-1]
            new[:, hi, :-1] = np.where(better, lost, new[:, hi, :-1])
            origin[:, hi, :-1] = np.where(better, began[:, lo, 1:], origin[:, hi, :-1])
        # a passage that begins here
        starts = (same & ~short[:, None]) | (short[:, None] & (i == 0))
        fresh = np.where(starts, gain, none)
        better = fresh > new[:, 1, :]
        new[:, 1, :] = np.where(better, fresh, new[:, 1, :])
        origin[:, 1, :] = np.where(better, i * G + shifts, origin[:, 1, :])
        # words that the document has beside the item's
        for k in range(1, G):
            added = new[:, :, k - 1] - PER_CHANGE
            better = added > new[:, :, k]
            new[:, :, k] = np.where(better, added, new[:, :, k])
            origin[:, :, k] = np.where(better, origin[:, :, k - 1], origin[:, :, k])
        score, began = np.maximum(new, none), origin
        ends = live[:, None] & ((same & ~short[:, None]) | (short[:, None] & (i == n - 1)[:, None]))
        done = np.where(ends, score[every, least, :], none)
        k = done.argmax(1)
        top = done[every, k]
        better = top > best
        best = np.where(better, top, best)
        where[better, 0] = began[every, least, k][better]
        where[better, 1] = (i * G + k)[better]
    found = best >= 0
    return found, where[:, 0] // G, where[:, 1] // G, where[:, 0] % G, where[:, 1] % G


def region(n: np.ndarray, bin_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last item word that is compared around the hits of a bin."""
    return np.maximum(0, bin_ * BIN - REACH), np.minimum(n, (bin_ + 1) * BIN + SHINGLE + REACH)


def compare(a: np.ndarray, w: np.ndarray, n: np.ndarray, first: np.ndarray, short: np.ndarray) -> list[tuple[int, bool, list[int], list[int], list[int]]]:
    """(row, whether unbroken, equal places, those of the passage, its other places) of each row that has a passage.

    Places are the document's.

    ``first`` is the document's place that w[SHIFT] stands for.
    """
    rows, width = a.shape
    found, i0, i1 = straight(a == w[:, SHIFT : SHIFT + width], n, short)
    k0, k1 = np.full(rows, SHIFT), np.full(rows, SHIFT)
    # with a missing or added word: hopeful where words are equal on whatever shift
    met = np.zeros(a.shape, dtype=bool)
    for k in range(2 * SHIFT + 1):
        met |= a == w[:, k : k + width]
    bent = np.flatnonzero(~found & straight(met, n, short)[0])
    if len(bent):
        found[bent], i0[bent], i1[bent], k0[bent], k1[bent] = passages(a[bent], w[bent], n[bent], short[bent])
    out = []
    for r in np.flatnonzero(found):
        span = np.arange(i0[r], i1[r] + 1)
        ks = range(min(k0[r], k1[r]), max(k0[r], k1[r]) + 1)
        equal, own, unbroken, hit = set(), set(), False, np.zeros(len(span), dtype=bool)
        need = min(PASSAGE, int(n[r]))
        for k in ks:
            all_ = np.arange(n[r])
            same = a[r, : n[r]] == w[r, all_ + k]
            equal.update((all_[same] + k - SHIFT + first[r]).tolist())
            hit |= same[span]
            own.update((span[same[span]] + k - SHIFT + first[r]).tolist())
            breaks = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
            unbroken |= bool(len(breaks)) and int((breaks[1::2] - breaks[::2]).max()) >= need
        other = (span[~hit] + k0[r] - SHIFT + first[r]).tolist()
        out.append((int(r), unbroken or not other, sorted(equal), sorted(own), other))
    return out


def _windows(flat: np.ndarray, lo: np.ndarray, hi: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, pad: int) -> np.ndarray:
    """Rows flat[lo : lo + width] where they lie in [begin, end) and before hi, else ``pad``."""
    at = lo[:, None] + np.arange(width)
    ok = (at >= begin[:, None]) & (at < np.minimum(end, hi)[:, None])
    return np.where(ok, flat[np.clip(at, 0, max(0, len(flat) - 1))] if len(flat) else pad, pad)


class Items:
    """Word hashes of the items, end to end."""

    def __init__(self, rows: list[tuple[object, list[int]]]):
        self.at = {k: i for i, (k, _) in enumerate(rows)}
        self.ids = [k for k, _ in rows]
        sizes = np.array([len(h) for _, h in rows], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.begins, self.sizes = self.ends - sizes, sizes
        self.flat = np.concatenate([np.asarray(h, dtype=np.int64) for _, h in rows]) if rows else np.empty(0, dtype=np.int64)


_COLUMNS = ["unbroken", "equal", "own", "other"]
_SCHEMA = "unbroken boolean, equal array<int>, own array<int>, other array<int>"


def _held(candidates: DataFrame, key: str, kinds: tuple[str, str], shared) -> DataFrame:
    """Passages of rows (key, h, cands of (item, diagonal, bin)), the items being sent to the tasks."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: Items = shared.value
        for b in batches:
            sizes = np.array([len(h) for h in b["h"]], dtype=np.int64)
            ends = np.cumsum(sizes)
            flat = np.concatenate([np.asarray(h, dtype=np.int64) for h in b["h"]]) if len(b) else np.empty(0, dtype=np.int64)
            cands = [(d, items.at[c["item_id"]], c["diagonal"], c["bin"]) for d, cs in enumerate(b["cands"]) for c in cs]
            c = np.array(cands, dtype=np.int64).reshape(-1, 4)
            lo, hi = region(items.sizes[c[:, 1]], c[:, 3])
            order = np.argsort(hi - lo, kind="stable")
            rows = []
            for part in np.array_split(order, max(1, int((hi - lo).sum() // CELLS) + 1)):
                if not len(part):
                    continue
                d, it, diag, l, h = c[part, 0], c[part, 1], c[part, 2], lo[part], hi[part]
                width = int((h - l).max())
                base = items.begins[it]
                a = _windows(items.flat, base + l, base + h, base + l, items.ends[it], width, 0)
                start = ends[d] - sizes[d]
                w = _windows(flat, start + diag + l - SHIFT, ends[d], start, ends[d], width + 2 * SHIFT, 1)
                for r, *found in compare(a, w, h - l, diag + l, items.sizes[it] < LONG):
                    rows.append((b[key].iat[int(d[r])], items.ids[int(it[r])], *found))
            yield pd.DataFrame(rows, columns=[key, "item_id", *_COLUMNS])

    return candidates.mapInPandas(work, f"`{key}` {kinds[0]}, item_id {kinds[1]}, {_SCHEMA}")


def _joined(candidates: DataFrame, it: DataFrame, key: str, kinds: tuple[str, str]) -> DataFrame:
    """The same with items too large to be sent: every candidate carries the words of its own window."""
    lo = F.greatest(F.lit(0), F.col("bin") * BIN - REACH)
    hi = F.least(F.col("n"), (F.col("bin") + 1) * BIN + SHINGLE + REACH)
    at = F.col("diagonal") + F.col("lo") - SHIFT
    rows = (
        candidates.select(key, "h", F.explode("cands").alias("c")).select(key, "h", "c.*")
        .join(it.select("item_id", "n", F.col("h").alias("ih")), "item_id")
        .withColumn("lo", lo).withColumn("hi", hi)
        .select(
            key, "item_id", "n", (F.col("diagonal") + F.col("lo")).alias("first"), F.slice("ih", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("a"),
            F.greatest(F.lit(0), -at).alias("skipped"), F.expr(f"slice(h, greatest(0, diagonal + lo - {SHIFT}) + 1, greatest(0, hi - lo + {2 * SHIFT} - greatest(0, {SHIFT} - diagonal - lo)))").alias("w"),
        )
    )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = np.array([len(x) for x in b["a"]], dtype=np.int64)
            order = np.argsort(n, kind="stable")
            rows = []
            for part in np.array_split(order, max(1, int(n.sum() // CELLS) + 1)):
                if not len(part):
                    continue
                width = int(n[part].max())
                a, w = np.zeros((len(part), width), dtype=np.int64), np.ones((len(part), width + 2 * SHIFT), dtype=np.int64)
                for r, p in enumerate(part):
                    a[r, : n[p]] = b["a"].iat[p]
                    x, s = b["w"].iat[p], int(b["skipped"].iat[p])
                    w[r, s : s + len(x)] = x
                size = b["n"].to_numpy()[part]
                for r, *found in compare(a, w, n[part], b["first"].to_numpy()[part], size < LONG):
                    p = int(part[r])
                    rows.append((b[key].iat[p], b["item_id"].iat[p], *found))
            yield pd.DataFrame(rows, columns=[key, "item_id", *_COLUMNS])

    return rows.mapInPandas(work, f"`{key}` {kinds[0]}, item_id {kinds[1]}, {_SCHEMA}")


def _prefix_join(hits: DataFrame, prefix: DataFrame, counts: DataFrame) -> DataFrame:
    """Hits with the items of their shingle; both sides of a hot shingle are salted if they are shuffled."""
    if prefix.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return hits.join(F.broadcast(prefix), "shingle")
    hot = counts.where(F.col("hits") > HOT_SHINGLE).select("shingle", F.ceil(F.col("hits") / HOT_SHINGLE).cast("int").alias("salts"))
    one = F.coalesce("salts", F.lit(1))
    left = hits.join(hot, "shingle", "left").withColumn("salt", F.pmod(F.xxhash64(*[c for c in hits.columns if c != "shingle"]), one).cast("int")).drop("salts")
    right = prefix.join(hot, "shingle", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("salts")
    return left.join(right, ["shingle", "salt"])


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id) of every document that holds an item or a passage of it."""
    w = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where("w is not null and size(w) > 0")
    g = F.when(F.col("n") >= LONG, SHINGLE).otherwise(F.least(F.lit(SHORT), F.col("n"))).cast("int")
    it = cut(w.select("item_id", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h")).withColumn("g", g))
    sizes = sorted(r["g"] for r in it.select("g").distinct().collect())  # at most SHORT + 1 values
    kinds = docs.schema[key].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    if not sizes:
        return docs.select(key).join(items.select("item_id"), F.lit(False))
    wanted = it.select(F.explode(F.expr(f"transform(sequence(1, n - g + 1), i -> {_shingle('g')})")).alias("shingle")).distinct()
    doc_h = spread(docs.select(key, text).where(f"`{key}` is not null and `{text}` is not null")).select(
        key, F.transform(words(F.col(text)), lambda x: F.xxhash64(x)).alias("h")
    )
    each = F.concat(*[F.expr(f"transform(sequence(1, greatest(size(h) - {s - 1}, 1)), i -> struct(i - 1 as pos, {_shingle(s)} as shingle))") for s in sizes])
    hits = cut(doc_h.select(key, F.explode(each).alias("s")).select(key, "s.pos", "s.shingle").join(small(wanted, 2_000_000), "shingle"))
    counts = cut(hits.groupBy("shingle").agg(F.count("*").alias("hits")))
    prefix = cut(necessary(it, counts))
    place = F.struct("item_id", (F.col("pos") - F.col("item_pos")).cast("int").alias("diagonal"), F.expr(f"item_pos div {BIN}").cast("int").alias("bin"))
    per_doc = cut(_prefix_join(hits, prefix, counts).groupBy(key).agg(F.collect_set(place).alias("cands")))
    # only the texts of candidate documents are moved
    texts = docs.select(key, text).where(f"`{text}` is not null").join(small(per_doc.select(key), 1_000_000), key, "left_semi")
    candidates = fan(texts.select(key, F.transform(words(F.col(text)), lambda x: F.xxhash64(x)).alias("h")).join(per_doc, key))
    if (it.agg(F.sum("n")).first()[0] or 0) <= HELD_WORDS:
        rows = it.select("item_id", "h").orderBy("item_id").collect()
        met = _held(candidates, key, kinds, docs.sparkSession.sparkContext.broadcast(Items([(r["item_id"], r["h"]) for r in rows])))
    else:
        met = _joined(candidates, it, key, kinds)
    met = cut(met)
    # an item that is told apart from another one of the document by that one's words
    per_item = met.groupBy(key, "item_id").agg(F.array_distinct(F.flatten(F.collect_list("equal"))).alias("theirs"))
    told = per_item.select(F.col(key).alias("_doc"), F.col("item_id").alias("_item"), "theirs", F.explode("theirs").alias("_at"))
    doubt = met.where("not unbroken").join(met.where("unbroken").select(key, "item_id").distinct(), [key, "item_id"], "left_anti")
    doubt = doubt.withColumn("row", F.xxhash64(F.col("item_id"), "own", "other"))
    quoted = (
        doubt.join(per_item, [key, "item_id"]).select(key, "item_id", "row", "own", F.size("theirs").alias("mine"), F.element_at("own", 1).alias("_first"))
        .join(told, (F.col(key) == F.col("_doc")) & (F.col("_first") == F.col("_at")) & (F.col("item_id") != F.col("_item")))
        .where("size(theirs) > mine and size(array_except(own, theirs)) = 0").select(key, "item_id", "row").distinct()
    )
    own = doubt.join(quoted, [key, "item_id", "row"], "left_anti").select(key, "item_id")
    return met.where("unbroken").select(key, "item_id").unionByName(own).distinct()


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document source: its documents, those that leak, and the items leaked."""
    found = leaks(docs, items)
    n = docs.groupBy("source").agg(F.count_distinct("doc_id").alias("n_docs"))
    by = (
        docs.select("doc_id", "source")
        .join(found, "doc_id")
        .groupBy("source")
        .agg(F.count_distinct("doc_id").alias("n_leaking"), F.count_distinct("item_id").alias("n_items"))
    )
    return n.join(by, n["source"].eqNullSafe(by["source"]), "left").select(
        n["source"], "n_docs", F.coalesce("n_leaking", F.lit(0)).alias("n_leaking"), F.coalesce("n_items", F.lit(0)).alias("n_items")
    )
