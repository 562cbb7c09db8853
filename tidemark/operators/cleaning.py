"""Cleaning that keeps track of places: blanked texts keep every character's place, shortened ones bring a map.

A map is an array of runs (clean, raw, n): ``n`` characters of the clean text from ``clean`` on stood from ``raw`` on
in the text before. Runs ascend in both texts, so maps of two steps compose to a map of both.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tidemark.sources.tables import materialise

RUNS = "array<struct<clean: int, raw: int, n: int>>"
#: Characters that are blanked: Devanagari, broken font encodings, decode failures (fixed values).
NOISE = "[ऀ-ॿƀ-ɏʰ-˿�]"
NOISE_BUT_DEVANAGARI = "[ƀ-ɏʰ-˿�]"
#: Unicode categories of characters that nobody sees (fixed values).
INVISIBLE = ("Cf", "Co", "Cs")
#: What repeats on each page, by kind (fixed values).
FURNITURE = (
    ("page", r"(?i)\bPage\s+\d+\s+of\s+\d+\b|\bपृ.{0,3}ठ\s*सं\.?\s*\d+"),
    ("gazette_stamps", r"(?i)\bTHE\s+GAZETTE\s+OF\s+INDIA\s*[:\-]?\s*EXTRAORDINARY\b"),
    ("gazette_stamps", r"(?i)\bPUBLISHED\s+BY\s+AUTHORITY\b"),
    ("gazette_stamps", r"(?i)\bPART\s+[IVX\d]+[\-\s]+Section\s+\d+[\-\s]+Sub-section\s*\([ivx\d]+\)\b"),
    ("gazette_stamps", r"(?i)\[\s*(?:भाग|Part)\s+[IVX\d]+[\-\s]+(?:खण्ड|Section|Sec\.?)\s*[\d\(\)a-z]+\s*\]"),
    ("gazette_stamps", r"(?i)\bEXTRAORDINARY\s+PART\s+[IVX\d]+[\-\s]+SECTION\s+\d+\b"),
    ("authority_banners", r"(?i)\bREGD\.?\s*NO\.?\s*[A-Z\d\.\-/]+"),
    ("authority_banners", r"(?i)\bNEW\s+DELHI\s*,\s*(?:[A-Z]+,\s*)?[A-Z]+\s+\d{1,2}\s*,\s*\d{4}(?:\s*/\s*[^,\n\r]+)?"),
    ("authority_banners", r"(?i)\b\d{1,5}\s+GI\s*/\s*\d{2,4}\b"),
    ("authority_banners", r"(?i)\bMINISTRY\s+OF\s+FINANCE\s*\([A-Za-z\s]+\)\s*NOTIFICATION\b"),
    ("page_numbers", r"(?i)\bPage\s+\d+\s+of\s+\d+\b"),
    ("page_numbers", r"(?i)\[\s*Page\s+\d+\s*\]"),
    ("page_numbers", r"(?i)\bपृ.{0,3}ठ\s*सं\.?\s*\d+\b"),
    ("page_numbers", r"(?i)(?<=\n)\s*\d+\s*(?=\n|$)"),
    ("printer_signatures", r"(?i)\bPRINTED\s+BY\s+THE\s+MANAGER\s*,\s*GOVERNMENT\s+OF\s+INDIA\s+PRESS[^\n\r]*"),
    ("printer_signatures", r"(?i)\bPUBLISHED\s+BY\s+THE\s+CONTROLLER\s+OF\s+PUBLICATIONS\b[^\n\r]*"),
    ("printer_signatures", r"(?i)\bUPLOADED\s+BY\s+THE\s+DIRECTORATE\s+OF\s+PRINTING\b[^\n\r]*"),
    ("printer_signatures", r"(?i)\bGOVERNMENT\s+OF\s+INDIA\s+PRESS\s*,\s*RING\s+ROAD[^\n\r]*"),
    ("watermarks", r"(?i)\bCONFIDENTIAL\s*[\-]\s*FOR\s+INTERNAL\s+USE\s+ONLY\b"),
    ("watermarks", r"(?i)\bFOR\s+OFFICIAL\s+USE\s+ONLY\b"),
    ("watermarks", r"(?i)\bDRAFT\s+FOR\s+DISCUSSION(?:\s+PURPOSES?)?\s+ONLY\b"),
    ("watermarks", r"(?i)\bADVANCE\s+COPY\s*[\-]\s*NOT\s+FOR\s+SALE\b"),
)
#: Characters of a text that are joined to spans by one key.
STRETCH = 1024


def _with(texts: DataFrame, make: Callable[[str], tuple], columns: str) -> DataFrame:
    """``texts`` with text replaced by the first thing that ``make`` gives and ``columns`` by the others; null texts stay null."""
    added = StructType.fromDDL(columns)
    schema = StructType([*texts.schema, *added])
    kinds = to_arrow_schema(added)
    at = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(t.as_py()) if t.is_valid else (None,) * (len(kinds) + 1) for t in batch.column(at)]
            own = list(batch.columns)
            own[at] = pa.array([m[0] for m in made], own[at].type)
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([m[k + 1] for m in made], kind.type) for k, kind in enumerate(kinds))], schema.names)

    return texts.mapInArrow(run, schema)


def blanked(text: str, keep_devanagari: bool = False) -> tuple[str, int, int, list[str]]:
    """(text with noise and furniture as spaces, characters and words of furniture, its kinds); no character moves."""
    gone = [0, 0]
    kinds: dict[str, None] = {}
    text = "".join(" " if unicodedata.category(c) in INVISIBLE and not (keep_devanagari and c in "‌‍") else c for c in text) if not text.isascii() else text
    text = re.sub(NOISE_BUT_DEVANAGARI if keep_devanagari else NOISE, " ", text)

    for kind, form in FURNITURE:

        def blank(m: re.Match, kind: str = kind) -> str:
            if kind != "page":
                gone[0] += len(m.group())
                gone[1] += len(m.group().split())
                kinds[kind] = None
            return " " * len(m.group())

        text = re.sub(form, blank, text)
    return text, gone[0], gone[1], list(kinds)


def blank_noise(texts: DataFrame, *, keep_devanagari: bool = False) -> DataFrame:
    """``texts`` with text blanked, and furniture_chars, furniture_words, furniture_kinds; every character keeps its place."""
    return _with(texts, lambda t: blanked(t, keep_devanagari), "furniture_chars int, furniture_words int, furniture_kinds array<string>")


def kept_runs(text: str, form: re.Pattern, instead: str = "") -> tuple[str, list[dict]]:
    """The text without matches (``instead``, if given, takes their place) and the map of what stays."""
    parts, runs, at, clean = [], [], 0, 0
    for m in [*form.finditer(text), None]:
        stop = m.start() if m else len(text)
        if stop > at:
            runs.append({"clean": clean, "raw": at, "n": stop - at})
            parts.append(text[at:stop])
            clean += stop - at
        if m:
            parts.append(instead)
            clean += len(instead)
            at = m.end()
    return "".join(parts), runs


def cut_out(texts: DataFrame, form: str, instead: str = "") -> DataFrame:
    """``texts`` with matches of ``form`` cut out of text, and ``runs``, the map back."""
    compiled = re.compile(form)
    return _with(texts, lambda t: kept_runs(t, compiled, instead), f"runs {RUNS}")


def composed(later: list[dict], earlier: list[dict]) -> list[dict]:
    """The map of two steps from the map of each; both are walked once."""
    out, k = [], 0
    for run in later:
        at, end = run["raw"], run["raw"] + run["n"]
        while k < len(earlier) and earlier[k]["clean"] + earlier[k]["n"] <= at:
            k += 1
        j = k
        while j < len(earlier) and earlier[j]["clean"] < end:
            low, high = max(at, earlier[j]["clean"]), min(end, earlier[j]["clean"] + earlier[j]["n"])
            out.append({"clean": run["clean"] + low - at, "raw": earlier[j]["raw"] + low - earlier[j]["clean"], "n": high - low})
            j += 1
    return out


def compose(rows: DataFrame, later: str, earlier: str, out: str) -> DataFrame:
    """``rows`` with ``out``, the map of the step ``earlier`` and then ``later`` (columns of runs); null if one is null."""

    def both(pair: pa.RecordBatch) -> pa.Array:
        a, b = pair.column(later).to_pylist(), pair.column(earlier).to_pylist()
        return pa.array([None if x is None or y is None else composed(x, y) for x, y in zip(a, b, strict=True)], pair.schema.field(later).type)

    schema = StructType([*rows.schema, StructField(out, rows.schema[later].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, both(batch)], schema.names)

    return rows.mapInArrow(run, schema)


def mapped_back(spans: DataFrame, maps: DataFrame, key: str) -> DataFrame:
    """``spans`` (key, start, end and others) with raw_start and raw_end, where their first and last characters stood.

    ``maps``: (key, runs), one row a key. Runs and ends of spans meet by stretches of the text, so a text with many
    of both isn't paired run by run. A span whose first or last character was put in, or an empty span, has nulls.
    """
    stretch = F.sequence(F.expr(f"r.clean div {STRETCH}"), F.expr(f"(r.clean + r.n - 1) div {STRETCH}"))
    pieces = maps.select(key, F.explode("runs").alias("r")).select(key, "r.clean", "r.raw", "r.n", F.explode(stretch).alias("stretch"))
    named = spans.withColumn("span_row", F.monotonically_increasing_id())
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("start").alias("at")), F.struct(F.lit(1).alias("side"), (F.col("end") - 1).alias("at")))).alias("e")
    named = materialise(named, "cleaning-spans")
    asked = named.filter("end > start").select(key, "span_row", ends).select(key, "span_row", "e.side", "e.at", F.expr(f"e.at div {STRETCH}").cast("int").alias("stretch"))
    met = asked.join(pieces.withColumn("stretch", F.col("stretch").cast("int")), [key, "stretch"]).filter((F.col("clean") <= F.col("at")) & (F.col("at") < F.col("clean") + F.col("n")))
    place = F.col("raw") + F.col("at") - F.col("clean")
    found = met.groupBy("span_row").agg(F.max(F.when(F.col("side") == 0, place)).alias("raw_start"), F.max(F.when(F.col("side") == 1, place + 1)).alias("raw_end"))
    whole = F.col("raw_start").isNotNull() & F.col("raw_end").isNotNull()
    return named.join(found, "span_row", "left").withColumns({"raw_start": F.when(whole, F.col("raw_start")), "raw_end": F.when(whole, F.col("raw_end"))}).drop("span_row")


def repeated_lines(texts: DataFrame, source: str, *, edge: int = 3, share: float = 0.5, least: int = 3) -> DataFrame:
    """(source, place, line, n, texts): lines that stand at the same place of many texts of a source.

    Places count from the start (0, 1, ...) and from the end (-1, -2, ...), ``edge`` of each; digits count as one, so page
    numbers repeat. A line repeats if ``least`` texts and the ``share`` of the source's texts hold it there. Blank lines
    and null texts don't count; a null source is a source.
    """
    lines = F.split("text", "\n")
    places = F.concat(F.transform(F.slice(lines, 1, edge), lambda x, i: F.struct(i.alias("place"), x.alias("line"))), F.transform(F.reverse(F.slice(F.reverse(lines), 1, edge)), lambda x, i: F.struct((i - F.least(F.size(lines), F.lit(edge))).alias("place"), x.alias("line"))))
    same = F.regexp_replace(F.trim("line"), "[0-9]+", "#")
    each = texts.filter("text is not null").select(source, F.inline(places)).withColumn("line", same).filter("line <> ''")
    totals = texts.filter("text is not null").groupBy(F.col(source).alias("total_of")).agg(F.count("*").alias("texts"))
    counted = each.groupBy(source, "place", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counted.join(totals, F.col(source).eqNullSafe(F.col("total_of"))).filter(F.col("n") >= share * F.col("texts")).drop("total_of")
