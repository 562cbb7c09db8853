"""Scans of texts by rules, with the place of every finding, and what is derived from them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.operators.chunks import rows_of_texts


@dataclass(frozen=True)
class Rule:
    """A pattern, its kind ("secret" or "pii"), and the group that holds the value (0: all of the match)."""

    ident: str
    kind: str
    severity: str
    pattern: str
    group: int = 0


#: Rules of the usual secrets and personal data (fixed values).
RULES = [
    Rule("SEC001", "secret", "critical", r"\bAKIA[0-9A-Z]{16}\b"),
    Rule("SEC002", "secret", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("SEC003", "secret", "critical", r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,255}\b"),
    Rule("SEC004", "secret", "critical", r"\bgithub_pat_[A-Za-z0-9_]{82}\b"),
    Rule("SEC005", "secret", "high", r"\bsk-[a-zA-Z0-9]{20,}\b"),
    Rule("SEC006", "secret", "high", r"(?i)\b(?:api[_-]?key|secret[_-]?key|auth[_-]?token|access[_-]?token|password)\s*[:=]\s*['\"]([a-zA-Z0-9_\-\.]{16,})['\"]", 1),
    Rule("SEC007", "secret", "high", r"\b(?:SYNTH|CANARY)[_-]SECRET[_-][A-Za-z0-9]{8,}\b"),
    Rule("PII001", "pii", "low", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,7}\b"),
    Rule("PII002", "pii", "low", r"(?:\+91[\s-]?)?[6789]\d{9}\b"),
    Rule("PII003", "pii", "medium", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    Rule("PII004", "pii", "medium", r"\b\d{4}\s\d{4}\s\d{4}\b"),
]


def masked_sample(kind: Column, value: Column) -> Column:
    """A finding of which a report may show no more than its ends."""
    text = F.trim(value)
    n = F.length(text)
    digits = F.regexp_replace(text, "[ -]", "")
    secret = F.when(n <= 8, "[redacted-secret]").otherwise(F.concat(F.left(text, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(text, F.lit(4))))
    mail = F.concat(F.left(text, F.lit(1)), F.lit("***@"), F.substring_index(F.regexp_replace(text, "^[^@]*@", ""), "\x00", 1))
    plain = F.when(n > 4, F.concat(F.left(text, F.lit(2)), F.lit("***"), F.right(text, F.lit(2)))).otherwise("[redacted-pii]")
    personal = F.when(text.contains("@"), mail).when((n >= 10) & digits.rlike("^[0-9]+$"), F.concat(F.lit("***-***-"), F.right(digits, F.lit(4)))).otherwise(plain)
    return F.when(n == 0, "[empty]").when(kind == "secret", secret).otherwise(personal)


def findings(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, rule_id, kind, severity, char_start, char_end, sample) of every match of every rule.

    Each text is read once by each rule, and a match knows its own place; null and empty texts have no findings.
    """
    compiled = [(r, re.compile(r.pattern, re.ASCII)) for r in rules or RULES]

    def matches(text: str) -> Iterator[tuple]:
        for rule, form in compiled:
            for m in form.finditer(text):
                yield rule.ident, rule.kind, rule.severity, m.start(rule.group), m.end(rule.group), m.group(rule.group)

    each = rows_of_texts(docs.select("doc_id", "text"), matches, "rule_id string, kind string, severity string, char_start long, char_end long, value string")
    return each.withColumn("sample", masked_sample(F.col("kind"), F.col("value"))).drop("value")


def scan_policy(found: DataFrame, docs: DataFrame, policy: str) -> DataFrame:
    """(doc_id, n_secrets, status): "ok" without secrets, else what the policy says; personal data never stops a text.

    Under "fail" the status is "fail"; the caller stops on such a row.
    """
    status = {"warn": "warn", "quarantine": "quarantined", "fail": "fail"}[policy]
    secrets = found.filter("kind = 'secret'").groupBy("doc_id").agg(F.count("*").alias("n_secrets"))
    n = F.coalesce("n_secrets", F.lit(0))
    return docs.select("doc_id").join(secrets, "doc_id", "left").select("doc_id", n.alias("n_secrets"), F.when(n > 0, status).otherwise("ok").alias("status"))


#: Words that carry no subject (fixed values).
STOPWORDS = (
    "a an the and or of to in for with on at by from is are was were be been being have has had do does did what which who whom whose how when where why "
    "this that these those it its as if each all both can could shall should will would may might must under over between into through after before during without within about against among "
    "below behind beneath beside beyond down up out off near above across along around towards toward upon via per"
).split()


def terms(text: Column) -> Column:
    """The words of a text that aren't stop words, without a suffix ing, ed, tion or s, in their order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z0-9\-./]+)\b"), F.lit(1))
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))

    def stem(w: Column) -> Column:
        cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
        return (
            F.when(w.endswith("ing") & (F.length(w) > 5), cut(3))
            .when(w.endswith("ing"), w)
            .when(w.endswith("ed") & (F.length(w) > 4), cut(2))
            .when(w.endswith("tion") & (F.length(w) > 6), cut(4))
            .when(w.endswith("s") & (F.length(w) > 3) & ~w.endswith("ss"), cut(1))
            .otherwise(w)
        )

    return F.transform(kept, stem)


def confidence(query: Column, passages: Column, *, depth: int = 5, threshold: float = 0.65) -> Column:
    """How much of a question's terms the first passages hold: coverage, level, refusal and the missing terms.

    ``passages``: an array of texts, best first.  A question without terms has
    level LOW and is refused.
    """
    asked = F.array_distinct(terms(query))
    there = F.array_distinct(F.flatten(F.transform(F.slice(passages, 1, depth), terms)))

    def judge(a: Column) -> Column:
        missing = F.array_sort(F.array_except(a, there))
        covered = (F.size(a) - F.size(missing)) / F.size(a)
        return F.struct(F.when(F.size(a) == 0, 0.0).otherwise(covered).alias("coverage"), F.size(a).alias("n_terms"), F.when(F.size(a) == 0, F.array().cast("array<string>")).otherwise(missing).alias("missing"))

    found = F.get(F.transform(F.array(asked), judge), 0)
    share = found["coverage"]
    level = F.when(found["n_terms"] == 0, "LOW").when(share >= 0.85, "HIGH").when(share >= threshold, "MEDIUM").otherwise("LOW")
    return F.struct(F.round(share, 6).alias("coverage"), level.alias("level"), (level == "LOW").alias("is_refusal"), found["missing"].alias("missing"))


def edit_distance(a: list, b: list) -> int:
    """Insertions, deletions and replacements that turn one list into the other, a row of the table at a time."""
    known: dict = {}
    x, y = (np.array([known.setdefault(w, len(known)) for w in ws], np.int64) for ws in (a, b))
    step = np.arange(len(y) + 1)
    row = step.copy()
    for i, w in enumerate(x):
        changed = np.concatenate([[i + 1], np.minimum(row[1:] + 1, row[:-1] + (y != w))])
        row = np.minimum.accumulate(changed - step) + step  # insertions run along the row
    return int(row[-1])


@F.pandas_udf(DoubleType())
def _word_error_rate(reference: pd.Series, heard: pd.Series) -> pd.Series:
    def rate(said: str | None, other: str | None) -> float | None:
        if said is None or other is None:
            return None
        a, b = said.lower().split(), other.lower().split()
        return (0.0 if not b else 1.0) if not a else edit_distance(a, b) / len(a)

    return pd.Series([rate(*pair) for pair in zip(reference, heard, strict=True)], dtype="float64")


def word_error_rate(reference: Column, heard: Column) -> Column:
    """Word-level edit distance over the words of the reference, whatever their case; null for a null text.

    Without words in the reference it is 0 if nothing was heard, else 1. Any number of different words will do.
    """
    return _word_error_rate(reference, heard)


def span_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap of two spans over what they cover together; 0 for empty spans."""
    both = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    union = (a_end - a_start) + (b_end - b_start) - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Overlap of two boxes (left, top, right, bottom) over what they cover together."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    both = side(0) * side(1)
    union = area(a) + area(b) - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def indian_number(value: Column) -> Column:
    """A number with its last three digits and then pairs of digits set apart, and two decimals unless they are zero."""
    whole = F.format_string("%.2f", F.abs(value))
    digits, decimals = F.substring_index(whole, ".", 1), F.substring_index(whole, ".", -1)
    head = F.reverse(F.regexp_replace(F.reverse(F.substring(digits, F.lit(1), F.length(digits) - 3)), "([0-9]{2})(?=[0-9])", "$1,"))
    grouped = F.when(F.length(digits) <= 3, digits).otherwise(F.concat(head, F.lit(","), F.right(digits, F.lit(3))))
    out = F.when(decimals == "00", grouped).otherwise(F.concat_ws(".", grouped, decimals))
    return F.when(value < 0, F.concat(F.lit("-"), out)).otherwise(out)
