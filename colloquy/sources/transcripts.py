"""Plain transcript text into turns: three header layouts, chosen per file by how many lines look like headers.

Each file's text is one row and is cut in the JVM. A header is told from its line's shape: where its
separator stands, how its parts are written, and how long they are. The lines between two headers are
the turn. A header that is turned down still ends the turn before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text

#: Header layouts in order of choice: ``NAME, ROLE: words``, ``Name -- Role`` and ``Name, Firm``.
SHAPES = ("caps", "dash", "comma")
LEAST_HEADERS = 5
_MARK = "\u0001"


def _named(part: Column) -> Column:
    """Whether a part is written like a name: a capital first, and nothing but letters, blanks, dots, hyphens and apostrophes."""
    return F.length(F.translate(part, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz.-' ", "")).eqNullSafe(0) & part.substr(1, 1).between("A", "Z")


def _header(line: Column, layout: str) -> Column:
    """(speaker, firm, words behind) of a header line of a layout, or null."""
    s = F.rtrim(line)
    if layout == "caps":
        head = F.substring_index(s, ":", 1)
        speaker, firm = F.substring_index(head, ",", 1), F.trim(F.substring(head, F.length(F.substring_index(head, ",", 1)) + 2, F.length(head)))
        fits = s.contains(":") & (head == F.upper(head)) & _named(speaker) & F.length(speaker).between(2, 41) & (F.length(firm) <= 61)
        words = F.ltrim(F.substring(line, F.length(head) + 2, F.length(line)))
    elif layout == "dash":
        at = F.instr(s, " -- ")
        speaker, firm = F.trim(F.substring(s, F.lit(1), at)), F.trim(F.substring(s, at + 4, F.length(s)))
        fits = (at > 0) & _named(speaker) & F.length(speaker).between(2, 46) & F.length(firm).between(3, 90)
        words = F.lit("")
    else:
        speaker, firm = F.substring_index(s, ",", 1), F.ltrim(F.substring(s, F.length(F.substring_index(s, ",", 1)) + 2, F.length(s)))
        plain = F.length(F.regexp_replace(firm, r"[A-Za-z0-9 &.'/-]", "")) == 0
        fits = s.contains(", ") & _named(speaker) & (F.length(speaker) > 1) & plain & (F.length(firm) > 0)
        words = F.lit("")
    return F.when(fits, F.struct(F.trim(speaker).alias("speaker"), firm.alias("firm"), words.alias("words")))


def segment(files: DataFrame, key: str = "source") -> DataFrame:
    """(source, turn_no, speaker, firm, role, text, layout) of files with (source, bank, text).

    Turns of prose-like or long headers, of fewer than 20 characters and of operators are left out.
    """
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")

    def found(layout: str) -> Column:
        return F.transform(F.col("lines"), lambda x: _header(x, layout))

    heads = {k: found(k) for k in SHAPES}
    many = {k: F.size(F.filter(F.col(f"h_{k}"), lambda h: h.isNotNull())) >= LEAST_HEADERS for k in SHAPES}
    layout = F.when(many["caps"], "caps").when(many["dash"], "dash").otherwise("comma")
    chosen = F.when(F.col("layout") == "caps", F.col("h_caps")).when(F.col("layout") == "dash", F.col("h_dash")).otherwise(F.col("h_comma"))
    marked = F.array_join(
        F.zip_with("lines", "heads", lambda x, h: F.when(h.isNotNull(), F.concat(F.lit(_MARK), h["speaker"], F.lit(_MARK), h["firm"], F.lit(_MARK), h["words"])).otherwise(x)), "\n"
    )
    parts = F.slice(F.split("marked", _MARK), 2, 2_000_000_000)
    turns = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("parts") / 3).cast("int") - 1),
        lambda i: F.struct((i + 1).alias("turn_no"), F.trim(F.get("parts", i * 3)).alias("speaker"), F.trim(F.get("parts", i * 3 + 1)).alias("firm"), F.regexp_replace(F.get("parts", i * 3 + 2), r"^\s+|\s+$", "").alias("text")),
    )
    rows = (
        files.select(key, "bank", F.translate(F.col("text"), _MARK, "").alias("text")).withColumn("lines", lines).withColumns({f"h_{k}": h for k, h in heads.items()})
        .withColumn("layout", layout).withColumn("heads", chosen).withColumn("marked", marked).withColumn("parts", parts).where("size(parts) >= 3")
        .select(key, "bank", "layout", F.explode(turns).alias("t")).select(key, "bank", "layout", "t.*")
    )
    role = text.role_of(F.col("firm"), F.col("bank"), F.col("speaker"))
    prose = F.substring_index(F.lower("speaker"), " ", 1).isin("and", "in", "we", "the", "information", "finally") & F.col("speaker").contains(" ")
    ok = (F.length("speaker") <= 45) & (F.length("firm") <= 90) & ~prose & (F.length("text") >= 20)
    return rows.withColumn("role", role).where(ok & (F.col("role") != "operator")).select(key, "turn_no", "speaker", "firm", "role", "text", "layout")


def binary_texts(spark, folder: str) -> DataFrame:
    """(path, text) of UTF-8 text files below a folder, each path once."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder)
    return b.dropDuplicates(["path"]).select("path", F.decode("content", "UTF-8").alias("text"))
