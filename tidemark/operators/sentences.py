"""Sentences with offsets and the windows that cover them, distances of words, hidden characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.operators.scans import span_iou

#: Abbreviations, without their last full stop, that end no sentence.
ABBREVIATIONS = ["rs", "inr", "no", "nos", "sec", "para", "cl", "art", "e.g", "i.e", "viz", "vs", "v", "dept", "fig", "approx", "govt", "ltd", "pvt", "co", "dr", "mr", "mrs", "ms", "prof", "rbi", "sebi", "cir"]

_SHORT = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
#: A token such as "Sec." or "A." stands before this place, with white space after it or none.
_GUARD = rf"(?<!(?<!\S)(?:(?i:{_SHORT})|\p{{L}})\.\s{{0,20}})"
#: A piece up to a boundary, the white space of the boundary included, or up to the end.
_PIECE = rf"""(?sU)(.+?(?:(?=\s)(?<=[.?!;]){_GUARD}\s+(?=[A-Z0-9"'(\[\u0900-\u097F])|(?=\n\s*\n){_GUARD}\n\s*\n+|\z))"""

#: Classes of characters that a reader does not see.
HIDDEN = {
    "ansi": r"\x1B\[[0-9;]*[a-zA-Z]",
    "unicode_tags": r"[\x{E0000}-\x{E007F}]",
    "bidi": r"[\u202A-\u202E\u2066-\u2069\u200E\u200F]",
    "zero_width": r"[\u200B-\u200D\uFEFF\u2060\u180E\u00AD\u2061-\u2064\uFE00-\uFE0F]",
    "control": r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]",
}


def sentence_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, sentence): trimmed sentences with their places in the text, from 0.

    A boundary is white space after . ? ! or ; before a capital, digit, quote or
    bracket, or an empty line; abbreviations and single letters end no sentence.
    Null and blank texts have none, and rows that repeat a key are told apart.
    """
    rows = docs.select(key, F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    pieces = rows.select(key, "_row", F.posexplode(F.regexp_extract_all("_text", F.lit(_PIECE), F.lit(1))).alias("_at", "_piece"))
    before = W.Window.partitionBy("_row").orderBy("_at").rowsBetween(W.Window.unboundedPreceding, -1)
    placed = pieces.withColumn("_from", F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)))
    lead = F.length("_piece") - F.length(F.regexp_replace("_piece", r"(?U)^\s+", ""))
    sentence = F.regexp_replace("_piece", r"(?U)^\s+|\s+$", "")
    found = placed.select(key, (F.col("_from") + lead).alias("start"), sentence.alias("sentence")).filter("sentence <> ''")
    return found.select(key, "start", (F.col("start") + F.length("sentence")).alias("end"), "sentence")


def best_windows(sentences: DataFrame, key: str = "doc_id", size: int = 1000, overlap: int = 150) -> DataFrame:
    """(key, start, window, iou): the fixed window that covers each sentence best; the earlier one of equals.

    The windows that a sentence touches follow from its offsets, so nothing is joined.
    """
    step = size - overlap
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - size + 1) / step)).cast("long")
    last = F.floor((F.col("end") - 1) / step).cast("long")
    overlaps = F.transform(F.sequence(first, last), lambda w: F.struct(span_iou(F.col("start"), F.col("end"), w * step, w * step + size).alias("iou"), (-w).alias("minus")))
    best = F.array_max(overlaps)
    return sentences.select(key, "start", (-best["minus"]).alias("window"), best["iou"].alias("iou"))


def osa_distance(a: Column | str, b: Column | str) -> Column:
    """Optimal string alignment: edits and swaps of neighbours; lengths more than 2 apart give their difference."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    n, m = F.length(a), F.length(b)
    letter = lambda s, i: F.substring(s, i, F.lit(1))
    start = F.transform(F.sequence(F.lit(0), m), lambda j: j)
    zero = F.struct(F.transform(start, lambda j: F.lit(0)).alias("older"), start.alias("old"))

    def row(acc: Column, i: Column) -> Column:
        def cell(made: Column, j: Column) -> Column:
            same = F.when(letter(a, i) == letter(b, j), 0).otherwise(1)
            res = F.least(F.get(acc["old"], j) + 1, F.element_at(made, -1) + 1, F.get(acc["old"], j - 1) + same)
            swapped = (i > 1) & (j > 1) & (letter(a, i) == letter(b, j - 1)) & (letter(a, i - 1) == letter(b, j))
            res = F.when(swapped, F.least(res, F.get(acc["older"], j - 2) + 1)).otherwise(res)
            return F.concat(made, F.array(res))

        made = F.aggregate(F.sequence(F.lit(1), m), F.array(i), cell)
        return F.struct(acc["old"].alias("older"), made.alias("old"))

    full = F.element_at(F.aggregate(F.sequence(F.lit(1), n), zero, row)["old"], -1)
    return F.when(F.abs(n - m) > 2, F.abs(n - m)).when((n == 0) | (m == 0), F.greatest(n, m)).otherwise(full)


def hidden_classes(text: Column | str) -> Column:
    """The classes of hidden characters in a text, in the order of ``HIDDEN``; none for a null text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in HIDDEN.items())), lambda c: c.isNotNull())


def without_hidden(text: Column | str) -> Column:
    """The text without hidden characters, one class after the other, terminal codes first."""
    out = F.col(text) if isinstance(text, str) else text
    for pattern in HIDDEN.values():
        out = F.regexp_replace(out, pattern, "")
    return out
