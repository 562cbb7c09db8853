"""Constraints on a table, declared by name and judged in one pass, and those of a gold set of questions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Answer types, difficulties and floors of a gold set (fixed values).
ANSWER_TYPES = ("extractive", "numeric", "multi-hop", "unanswerable")
DIFFICULTIES = ("easy", "medium", "hard")
MIN_ITEMS, MIN_UNANSWERABLE_SHARE, MIN_CANARIES = 120, 0.10, 1
_UUID5 = "(?i)^[{]?[0-9a-f]{8}-?[0-9a-f]{4}-?5[0-9a-f]{3}-?[89ab][0-9a-f]{3}-?[0-9a-f]{12}[}]?$"


def violations(rows: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, problem) of each row and each rule that it breaks; a rule is the condition that is broken, null counts as kept.

    All rules are judged together while the rows are read once, without a shuffle.
    """
    broken = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda p: p.isNotNull())
    return rows.select(key, F.explode(broken).alias("problem"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, problem) of each key that several rows have; null is a key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit(f"repeated {key}").alias("problem"))


def floors(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(problem) of the rules (aggregates that say whether one is broken) that the whole table breaks; an empty table is judged too."""
    judged = rows.agg(F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda p: p.isNotNull()).alias("broken"))
    return judged.select(F.explode("broken").alias("problem"))


def goldset_rules() -> dict[str, Column]:
    """The rules of single items."""
    col, no = F.col, lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    open_ = F.coalesce(col("answer_type") == "unanswerable", F.lit(False))
    rules = {
        "unknown answer_type": ~F.coalesce(col("answer_type").isin(*ANSWER_TYPES), F.lit(False)),
        "unknown difficulty": ~F.coalesce(col("difficulty").isin(*DIFFICULTIES), F.lit(False)),
        "empty question": blank("question"),
        "stable is not a boolean": col("stable").isNull(),
        "no unanswerable_reason": open_ & blank("unanswerable_reason"),
        "no forbidden_strings": F.coalesce(col("canary"), F.lit(False)) & no("forbidden_strings"),
        "no required_citation_chunk_ids": ~open_ & no("required_citation_chunk_ids"),
        "citation is no version-5 UUID": F.exists("required_citation_chunk_ids", lambda c: ~F.coalesce(c.rlike(_UUID5), F.lit(False))),
    }
    for name in ("source_docs", "evidence_quotes", "expected_answer_key_points"):
        rules[f"empty {name}"] = ~open_ & no(name)
    for name in ("source_docs", "evidence_quotes", "required_citation_chunk_ids", "expected_answer_key_points"):
        rules[f"unanswerable with {name}"] = open_ & ~no(name)
    return rules


def lint_goldset(items: DataFrame) -> DataFrame:
    """(item_id, problem): what is wrong with single items, repeated ids, and (item_id null) with the set as a whole.

    ``items``: item_id, question, answer_type, difficulty, stable, canary, unanswerable_reason, and arrays of strings source_docs,
    evidence_quotes, required_citation_chunk_ids, expected_answer_key_points, forbidden_strings. A sound set gives no rows.
    """
    n, open_ = F.count("*"), F.count_if(F.col("answer_type") == "unanswerable")
    whole = {
        f"fewer than {MIN_ITEMS} items": n < MIN_ITEMS,
        f"unanswerable share below {MIN_UNANSWERABLE_SHARE}": F.coalesce(F.try_divide(open_, n), F.lit(0.0)) < MIN_UNANSWERABLE_SHARE,
        f"fewer than {MIN_CANARIES} canaries": F.count_if("canary") < MIN_CANARIES,
    }
    kind = items.schema["item_id"].dataType
    return violations(items, "item_id", goldset_rules()).unionAll(repeated(items, "item_id")).unionAll(floors(items, whole).select(F.lit(None).cast(kind).alias("item_id"), "problem"))
