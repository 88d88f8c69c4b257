"""Problem 8: the whole corpus as token ids of a public byte-level vocabulary.

Each partition holds a DuckDB database with the vocabulary's merge table. The distinct words of a
batch become token-position rows; a recursive query joins neighbouring rows with the merge table and
contracts, in every word, the leftmost pairs of the smallest rank until nothing can be contracted.
Ordered aggregation turns the rows back into lists, and, for decoding, ids back into bytes.

All disjoint occurrences of the smallest pair are contracted in one step. That equals contracting
them one by one from the left, since a token is only ever part of merges ranked after its own.

A recursive query keeps the rows of every step, so an unbroken run of LONG bytes and more is cut into
pieces of PIECE bytes first. Whether a sequence of tokens is the encoding of its bytes depends on every
two neighbours alone (two tokens that encode together to themselves never merge across, whatever stands
around them). So pieces are put together in pairs, level by level: the tokens around a seam are encoded
anew as one word, and if their neighbours on both sides stand beside them unmerged, the whole is right,
else more tokens are taken. The work grows with the bytes of a run, and no query holds more than BATCH
bytes of words.

Defined results: a null or an empty text has an empty list; a blank text is encoded like any other;
strings of special tokens are ordinary text; further columns are left out of the result; a row
delivered twice gives two rows; an empty table gives an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import spread

#: Words a worker remembers before it starts afresh; results don't depend on it.
CACHE_WORDS = 400_000
#: Bytes of words in one query, bytes from which a word is cut into pieces, bytes of a piece, and tokens around a seam.
BATCH, LONG, PIECE, SEAM = 150_000, 256, 64, 4

STEP = """
WITH RECURSIVE tok(word, pos, id, step) AS (
  SELECT word, pos, id, 0 FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT word, pos, step, id, lead(id) OVER w AS next_id, lead(pos) OVER w AS next_pos,
            row_number() OVER w AS nth
     FROM tok WINDOW w AS (PARTITION BY word ORDER BY pos)),
   hits AS (
     SELECT p.word, p.pos, p.next_pos, p.nth, m.rank, m.made,
            min(m.rank) OVER (PARTITION BY p.word) AS least
     FROM pairs p JOIN merges m ON m.a = p.id AND m.b = p.next_id),
   runs AS (
     SELECT *, nth - row_number() OVER (PARTITION BY word ORDER BY nth) AS run
     FROM hits WHERE rank = least),
   picked AS (
     SELECT word, pos, next_pos, made FROM runs
     QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY nth) % 2 = 1),
   live AS (SELECT DISTINCT word FROM picked)
   SELECT p.word, p.pos, coalesce(c.made, p.id), p.step + 1
   FROM pairs p JOIN live USING (word)
   LEFT JOIN picked c ON c.word = p.word AND c.pos = p.pos
   LEFT JOIN picked g ON g.word = p.word AND g.next_pos = p.pos
   WHERE g.word IS NULL))
SELECT word, list(id ORDER BY pos) AS ids
FROM (SELECT * FROM tok QUALIFY step = max(step) OVER (PARTITION BY word))
GROUP BY word
"""


def default_vocabulary() -> str:
    """Path of byte_bpe_50k among the installed public tokenizers."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"


def split_pattern() -> str:
    """The pattern that cuts text into words before merging (fixed value of the vocabulary)."""
    return r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


@lru_cache(maxsize=4)
def read_vocabulary(path: str) -> dict[str, np.ndarray | list[bytes]]:
    """Merge table (a, b, made, rank), id of each byte and bytes of each id, of a vocabulary file.

    About 0.6 MB of arrays and 0.5 MB of bytes for 50,000 merges, so it is broadcast.
    """
    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab, symbols = model["vocab"], byte_symbols()
    back = {s: b for b, s in enumerate(symbols)}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    names = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        names[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return {
        "a": np.array([vocab[a] for a, _ in pairs], dtype=np.int32),
        "b": np.array([vocab[b] for _, b in pairs], dtype=np.int32),
        "made": np.array([vocab[a + b] for a, b in pairs], dtype=np.int32),
        "rank": np.arange(len(pairs), dtype=np.int32),
        "byte": np.array([vocab[s] for s in symbols], dtype=np.int32),
        "names": names,
    }


class Encoder:
    """A worker's DuckDB database with the merge table, and the words it has met."""

    def __init__(self, vocabulary: dict):
        import duckdb
        import regex

        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        merges = pd.DataFrame({k: vocabulary[k] for k in ("a", "b", "made", "rank")})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.byte, self.names = vocabulary["byte"], vocabulary["names"]
        self.cut = regex.compile(split_pattern()).findall
        self.known: dict[str, np.ndarray] = {}
        self.beside: dict[tuple[int, int], bool] = {}

    def contract(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of words given as bytes, by the recursive query, in batches of bytes."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) <= BATCH):
                size += len(raw[end])
                end += 1
            out += self._contract(raw[at:end])
            at = end
        return out

    def _contract(self, raw: list[bytes]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum(sizes)
        start = pd.DataFrame(  # noqa: F841
            {
                "word": np.repeat(np.arange(len(raw), dtype=np.int32), sizes),
                "pos": (np.arange(len(flat)) - np.repeat(ends - sizes, sizes)).astype(np.int32),
                "id": self.byte[flat],
            }
        )
        self.db.register("start", start)
        done = self.db.sql(STEP).to_arrow_table()
        self.db.unregister("start")
        ids = done["ids"].combine_chunks()
        flat_ids, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
        out = [np.empty(0, dtype=np.int32)] * len(raw)
        for i, w in enumerate(done["word"].to_pylist()):
            out[w] = flat_ids[offsets[i] : offsets[i + 1]]
        return out

    def _bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(self.names[i] for i in ids)

    def _apart(self, pairs: list[tuple[int, int]]) -> None:
        """Learn of pairs of tokens whether they stay two when they stand side by side."""
        new = list({p for p in pairs if p not in self.beside})
        for p, ids in zip(new, self.contract([self.names[a] + self.names[b] for a, b in new]), strict=True):
            self.beside[p] = ids.tolist() == list(p)

    def long(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of long words: pieces are encoded and put together in pairs."""
        pieces = [[r[i : i + PIECE] for i in range(0, len(r), PIECE)] for r in raw]
        flat = list({p for ps in pieces for p in ps})
        ids = dict(zip(flat, self.contract(flat), strict=True))
        parts = [[ids[p] for p in ps] for ps in pieces]
        while any(len(ps) > 1 for ps in parts):
            seams = [(w, i) for w, ps in enumerate(parts) for i in range(0, len(ps) - 1, 2)]
            width = dict.fromkeys(seams, SEAM)
            made: dict[tuple[int, int], np.ndarray] = {}
            while todo := [x for x in seams if x not in made]:
                around = [(parts[w][i][-width[w, i] :], parts[w][i + 1][: width[w, i]]) for w, i in todo]
                anew = self.contract([self._bytes(a) + self._bytes(b) for a, b in around])
                asked = []
                for (w, i), new in zip(todo, anew, strict=True):
                    a, b, m = parts[w][i], parts[w][i + 1], width[w, i]
                    asked.append(([(int(a[-m - 1]), int(new[0]))] if len(a) > m else []) + ([(int(new[-1]), int(b[m]))] if len(b) > m else []))
                self._apart([p for ps in asked for p in ps])
                for (w, i), new, ps in zip(todo, anew, asked, strict=True):
                    m = width[w, i]
                    if all(self.beside[p] for p in ps):
                        made[w, i] = np.concatenate([parts[w][i][:-m], new, parts[w][i + 1][m:]])
                    else:
                        width[w, i] = 2 * m
            parts = [[made[w, i] if (w, i) in made else ps[i] for i in range(0, len(ps), 2)] for w, ps in enumerate(parts)]
        return [ps[0] for ps in parts]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.cut(t) if t else [] for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        if len(self.beside) > CACHE_WORDS:
            self.beside.clear()
        new = list({w for ws in cut for w in ws if w not in self.known})
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        short = [i for i, r in enumerate(raw) if len(r) < LONG]
        large = [i for i, r in enumerate(raw) if len(r) >= LONG]
        self.known.update(zip((new[i] for i in short), self.contract([raw[i] for i in short]), strict=True))
        run = dict(zip((new[i] for i in large), self.long([raw[i] for i in large]), strict=True))  # not kept: a few could fill the memory
        known, none = self.known, np.empty(0, dtype=np.int32)
        return [np.concatenate([run[w] if w in run else known[w] for w in ws]) if ws else none for ws in cut]

    def decode(self, lists: list) -> list[str]:
        """Ids back to text, by an ordered aggregation over the ids' bytes."""
        if "names" not in {r[0] for r in self.db.execute("SHOW TABLES").fetchall()}:
            names = pd.DataFrame({"id": np.arange(len(self.names)), "hex": [n.hex() for n in self.names]})  # noqa: F841
            self.db.execute("CREATE TABLE names AS SELECT * FROM names")
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists if len(x)] or [np.empty(0, dtype=np.int64)])
        ends = np.cumsum(sizes)
        ids = pd.DataFrame(  # noqa: F841
            {"doc": np.repeat(np.arange(len(lists)), sizes), "pos": np.arange(len(flat)) - np.repeat(ends - sizes, sizes), "id": flat}
        )
        rows = self.db.execute("SELECT doc, string_agg(hex, '' ORDER BY pos) FROM ids JOIN names USING (id) GROUP BY doc").fetchall()
        out = [""] * len(lists)
        for d, h in rows:
            out[d] = bytes.fromhex(h).decode("utf-8", "replace")
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(key: str, vocabulary: dict) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids) of every row of ``docs``."""
    path = vocabulary or default_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(path, shared.value)
        for b in batches:
            yield pd.DataFrame({key: b[key], "ids": enc.encode([t if isinstance(t, str) else None for t in b[text]])})

    return spread(docs.select(key, text)).mapInPandas(work, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(key, text) from (key, ids); null or empty ids give an empty text."""
    path = vocabulary or default_vocabulary()
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kind = encoded.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(path, shared.value)
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": enc.decode([x if x is not None else [] for x in b["ids"]])})

    return encoded.select(key, "ids").mapInPandas(work, f"`{key}` {kind}, text string")


def roundtrip(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, n_ids, same): whether decoding the ids gives the text back, for every row, in one pass."""
    path = vocabulary or default_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(path, shared.value)
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b[text]]
            ids = enc.encode(texts)
            same = [x == (t or "") for x, t in zip(enc.decode(ids), texts, strict=True)]
            yield pd.DataFrame({key: b[key], "n_ids": np.array([len(x) for x in ids], dtype=np.int32), "same": np.array(same, dtype=bool)})

    return spread(docs.select(key, text)).mapInPandas(work, f"`{key}` {kind}, n_ids int, same boolean")
