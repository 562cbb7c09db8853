"""Amounts of money and rates in words, their equality, tables as Markdown, and states of a manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of currencies, the first that is found counts.
CURRENCIES = [("INR", r"(?i)₹|rs\.?|inr|rupees?"), ("USD", r"(?i)\$|usd|dollars?"), ("EUR", r"(?i)€|eur|euros?"), ("GBP", r"(?i)£|gbp|pounds?")]

#: Scales with their multipliers, the first that is found counts.
SCALES = [
    ("Crore", r"(?i)\b(crores?|crs?|koti)\b|[0-9\s]cr([^a-zA-Z]|$)", 1e7),
    ("Lakh", r"(?i)\b(lakhs?|lacs?|lk)\b|[0-9\s]l([^a-zA-Z]|$)", 1e5),
    ("Trillion", r"(?i)\b(trillions?|tn)\b|[0-9\s]t([^a-zA-Z]|$)", 1e12),
    ("Billion", r"(?i)\b(billions?|bn)\b|[0-9\s]b([^a-zA-Z]|$)", 1e9),
    ("Million", r"(?i)\b(millions?|mn)\b|[0-9\s]m([^a-zA-Z]|$)", 1e6),
    ("Thousand", r"(?i)\bthousands?\b|[0-9\s]k([^a-zA-Z]|$)", 1e3),
    ("bps", r"(?i)\b(bps|basis\s+points?|bp)\b", 1e-4),
    ("%", r"(?i)%|percent(age)?", 1e-2),
]

NUMBER = r"[-+]?[0-9]+(,[0-9]+)*(\.[0-9]+)?"


def _first(text: Column, choices: list, otherwise: Column) -> Column:
    made = reduce(lambda c, x: F.when(text.rlike(x[0]), F.lit(x[1])) if c is None else c.when(text.rlike(x[0]), F.lit(x[1])), choices, None)
    return made.otherwise(otherwise)


def parse_quantity(text: Column | str) -> Column:
    """struct(value, unit, scale); value is null where the text holds no number or is null."""
    text = F.col(text) if isinstance(text, str) else text
    scale = _first(text, [(p, name) for name, p, _ in SCALES], F.lit("unit"))
    times = _first(text, [(p, m) for _, p, m in SCALES], F.lit(1.0))
    own = F.when(scale == "bps", "BPS").when(scale == "%", "PERCENT").when(scale.isin("Crore", "Lakh"), "INR").otherwise("UNKNOWN")
    number = F.nullif(F.replace(F.regexp_extract(text, NUMBER, 0), F.lit(","), F.lit("")), F.lit("")).cast("double")
    return F.struct((number * times).alias("value"), _first(text, [(p, name) for name, p in CURRENCIES], own).alias("unit"), scale.alias("scale"))


def equivalent(a: Column, b: Column, tolerance: float = 0.001) -> Column:
    """Whether two parsed quantities are the same within an absolute or relative tolerance; currencies must not differ."""

    def ratio(q: Column) -> Column:
        return q["unit"].isin("BPS", "PERCENT", "UNKNOWN") | q["scale"].isin("bps", "%")

    known = (a["unit"] != "UNKNOWN") & (b["unit"] != "UNKNOWN") & (a["unit"] != b["unit"])
    apart, most = F.abs(a["value"] - b["value"]), F.greatest(F.abs(a["value"]), F.abs(b["value"]))
    near = (apart <= tolerance) | ((most > 0) & (apart <= tolerance * most))
    return F.coalesce(near & ~(known & ~(ratio(a) & ratio(b))), F.lit(False))


def markdown_tables(rows: DataFrame, table_key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(table key, n_rows, markdown): a Markdown table of each key's rows in their order; bars are escaped, nulls are empty.

    A table is one value and so has to fit in a row.
    """
    def line(cells: list[Column]) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    lines = rows.groupBy(table_key).agg(F.array_sort(F.collect_list(F.struct(*order, line(cells).alias("line")))).alias("lines"))
    head = F.array(line([F.lit(c.replace("|", "\\|")) for c in columns]), line([F.lit("---")] * len(columns)))
    return lines.select(table_key, F.size("lines").cast("long").alias("n_rows"), F.concat_ws("\n", F.concat(head, F.col("lines.line"))).alias("markdown"))


def manifest_states(manifest: DataFrame, stored: DataFrame, key: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns of ``also``, state) of ``sha256`` columns: ok, changed, missing from the store, or unlisted in the manifest.

    A key should name one row on each side, as rows that repeat one meet each other; what is in ``also`` goes along, as
    the manifest has it or else the store. Null keys match nothing: they are missing or unlisted.
    """
    own = lambda side: F.struct(*also, "sha256").alias(side)
    a, b = manifest.select(F.col(key).alias("_a"), own("_said")), stored.select(F.col(key).alias("_b"), own("_is"))
    state = F.when(F.col("_is").isNull(), "missing").when(F.col("_said").isNull(), "unlisted").when(F.col("_said.sha256").eqNullSafe(F.col("_is.sha256")), "ok").otherwise("changed")
    kept = [F.when(F.col("_said").isNull(), F.col(f"_is.{c}")).otherwise(F.col(f"_said.{c}")).alias(c) for c in also]
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), *kept, state.alias("state"))
