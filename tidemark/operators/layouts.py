"""Tables in plain text: with pipes, with wide gaps, or with columns that only their gutters show."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tidemark.operators.chunks import rows_of_texts

#: Lines that separate a heading, and gaps that separate cells (fixed values).
RULED = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)+\|?\s*$")
RULE = re.compile(r"^\s*\+?[-=+]+\+?\s*$")
GAP = re.compile(r"\s{2,}|\t+")
FEWEST = 2
TABLE = "ordinal int, kind string, first_line int, headers array<string>, matrix array<array<string>>"


def cell(raw: str) -> str:
    return " ".join(raw.split())


def headings(rows: list[list[str]]) -> list[str]:
    """One label a column: the different cells above it, an empty one taking what spans it from the left (but in the last row)."""
    width = max(map(len, rows), default=0)
    rows = [[cell(r[i]) if i < len(r) else "" for i in range(width)] for r in rows]
    for k, row in enumerate(rows[:-1]):
        spans = ""
        for i, own in enumerate(row):
            spans = own or spans
            rows[k][i] = spans
    labels = []
    for i in range(width):
        parts = [r[i] for r in rows if r[i]]
        labels.append(" -> ".join(p for k, p in enumerate(parts) if not k or parts[k - 1] != p) or f"Column_{i + 1}")
    return labels


def _padded(rows: list[list[str]], width: int) -> list[list[str]]:
    return [[r[i] if i < len(r) else "" for i in range(width)] for r in rows]


def piped(lines: list[str]) -> tuple[list[str], list[list[str]]] | None:
    """(headers, matrix) of lines with pipes; what stands above the first ruled line heads the columns."""
    rows, head = [], 0
    for line in lines:
        if RULED.match(line) or RULE.match(line):
            head = head or len(rows)
            continue
        bare = line.strip()
        cells = [cell(c) for c in bare.removeprefix("|").removesuffix("|").split("|")]
        if any(cells):
            rows.append(cells)
    if len(rows) < FEWEST:
        return None
    labels = headings(rows[: head or 1])
    return labels, _padded(rows[head or 1 :], len(labels))


def gapped(lines: list[str]) -> tuple[list[str], list[list[str]]] | None:
    """(headers, matrix) of lines whose cells stand apart by two blanks or a tab; the first line heads the columns."""
    rows = [[cell(c) for c in GAP.split(line.strip()) if c.strip()] for line in lines if not RULE.match(line)]
    rows = [r for r in rows if r]
    if len(rows) < FEWEST:
        return None
    labels = headings(rows[:1])
    width = max(map(len, [labels, *rows[1:]]))
    return labels + [f"Column_{i + 1}" for i in range(len(labels), width)], _padded(rows[1:], width)


def gutters(lines: list[str], least: int = 2) -> list[tuple[int, int]]:
    """(start, end) of the columns: what lies between runs of at least ``least`` places that are blank in all lines."""
    lines = [x.expandtabs() for x in lines]
    width = max(map(len, lines), default=0)
    inked = [any(i < len(x) and x[i] != " " for x in lines) for i in range(width)]
    columns: list[list[int]] = []
    for i in range(width):
        if inked[i]:
            if columns and i - columns[-1][1] < least:
                columns[-1][1] = i + 1
            else:
                columns.append([i, i + 1])
    return [(a, b) for a, b in columns]


def profiled(lines: list[str]) -> tuple[list[str], list[list[str]]] | None:
    """(headers, matrix) by gutters: empty cells keep their column; what stands above a rule heads the columns, else the first line."""
    head = next((k for k, x in enumerate(lines) if k and RULE.match(x.replace(" ", "")) and x.strip()), 0)
    kept = [x for x in lines if not RULE.match(x.replace(" ", ""))]
    columns = gutters(kept)
    rows = [[cell(x.expandtabs()[a:b]) for a, b in columns] for x in kept]
    if len(rows) < FEWEST or len(columns) < FEWEST:
        return None
    labels = headings(rows[: head or 1])
    return labels, rows[head or 1 :]


def tables(text: str, by_gutters: bool = False) -> Iterator[tuple]:
    """(ordinal, kind, first line, headers, matrix) of the tables of one text, each line looked at once or twice."""
    lines = [x.rstrip() for x in text.splitlines()]
    cells = lambda x: sum(1 for c in GAP.split(x.strip()) if c.strip())
    at, n = 0, 0
    while at < len(lines):
        start, kind, made = at, "", None
        if "|" in lines[at]:
            while at < len(lines) and ("|" in lines[at] or RULE.match(lines[at])):
                at += 1
            kind, own = "pipes", [x for x in lines[start:at] if x.strip()]
            made = piped(own) if len(own) >= FEWEST else None
        else:
            at += 1
            if cells(lines[start]) >= FEWEST:
                end = at
                while end < len(lines) and lines[end].strip() and (RULE.match(lines[end].strip()) or cells(lines[end]) >= FEWEST or (by_gutters and lines[end][0] in " \t")):
                    end += 1
                kind, own = "gaps", lines[start:end]
                made = (profiled if by_gutters else gapped)(own) if len(own) >= FEWEST else None
                at = end if made else at
        if made:
            yield n, kind, start, *made
            n += 1


def parsed_tables(texts: DataFrame, *, by_gutters: bool = False) -> DataFrame:
    """The columns of ``texts`` but text, then ordinal, kind, first_line, headers, matrix of each table with two rows and columns at least.

    ``by_gutters``: tables without pipes are cut where all of their lines are blank, so empty cells keep their column
    and a heading may span several; else each line is cut at its own gaps. Null texts and texts without tables have no rows.
    """
    return rows_of_texts(texts, lambda text: tables(text, by_gutters), TABLE)
