"""Texts with headings: blocks, paragraphs that are merged into chunks, provisos and their parents, annexures."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.chunks import halves, middle_space, placed_strip, rows_of_texts, window_pieces

#: Headings by kind; of two at one place the earlier kind counts (fixed values).
HEADINGS = (
    ("section", r"^(?:PART\s+[IVXLCDM]+|CHAPTER\s+[IVXLCDM]+|SECTION\s+\d+|\d+\.)\s+"),
    ("schedule", r"^(?:SCHEDULE\s+[IVXLCDM\d]+|ANNEXURE\s+[IVXLCDM\d]+|APPENDIX\s+[IVXLCDM\d]+)"),
    ("gazette_header", r"^(?:THE\s+GAZETTE\s+OF\s+INDIA|RESERVE\s+BANK\s+OF\s+INDIA|DEPARTMENT\s+OF|NOTIFICATION|CIRCULAR\s+NO\.|REF(?:ERENCE)?\s+NO\.|F\.\s*NO\.)"),
    ("preamble", r"^(?:WHEREAS|IN\s+EXERCISE\s+OF\s+THE\s+POWERS|PLEASE\s+REFER\s+TO|ATTENTION\s+OF\s+AUTHORI[SZ]ED)"),
)
#: How clauses, provisos and blank lines look (fixed values).
CLAUSE = r"^\s*(?:\((\d+)\)|\((\w)\)|\(([ivxlcdm]+)\))\s+"
PROVISO = r"\b(?:Provided\s+that|Provided\s+further\s+that|Provided\s+also\s+that)\b"
BLANK = r"\n\s*\n|\r\n\s*\r\n"
#: Kinds of chunks that a later proviso may hang on.
OPERATIVE = ("section", "clause", "standard")
#: Texts above this length without any heading are cut into windows.
WINDOWED = 2000
WINDOW, OVERLAP = 1000, 150

CHUNK = "ordinal long, parent long, char_start long, char_end long, token_count long, path array<string>, kind string, is_proviso boolean, chunk string"


@dataclass(frozen=True)
class Limits:
    """Tokens of a chunk at most, and below which paragraphs are merged; whether provisos stay with what they follow."""

    most: int = 512
    least: int = 64
    keep_provisos: bool = True
    windows: bool = True


class Forms:
    """The compiled patterns, once per task."""

    def __init__(self) -> None:
        self.headings = [(kind, re.compile(form, re.IGNORECASE | re.MULTILINE)) for kind, form in HEADINGS]
        self.clause = re.compile(CLAUSE, re.IGNORECASE | re.MULTILINE)
        self.proviso = re.compile(PROVISO, re.IGNORECASE)
        self.blank = re.compile(BLANK)


def word_tokens(text: str) -> int:
    """Four tokens to three words, at least one."""
    return max(1, len(text.split()) * 4 // 3)


def blocks(text: str, forms: Forms) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, title) from heading to heading; they tile the text."""
    marks: dict[int, tuple[str, str]] = {}
    for kind, form in forms.headings:
        for m in form.finditer(text):
            marks.setdefault(m.start(), (kind, m.group().strip()))
    if not marks:
        return [(0, len(text), "standard", "Document Body")]
    starts = sorted(marks)
    lead = [(0, starts[0], "preamble", "Preamble")] if starts[0] else []
    return lead + [(a, b, *marks[a]) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]


def paragraphs(text: str, start: int, end: int, forms: Forms) -> Iterator[tuple[int, int]]:
    """The stripped spans between blank lines."""
    at = start
    for stop, after in [*((m.start() + start, m.end() + start) for m in forms.blank.finditer(text[start:end])), (end, end)]:
        begin, bare = placed_strip(text[at:stop], at)
        if bare:
            yield begin, begin + len(bare)
        at = after


def _sentence_space(text: str) -> int:
    stop = text.rfind(". ", 0, len(text) // 2)
    return stop if stop > 0 else middle_space(text)


def _merged(text: str, limits: Limits, forms: Forms) -> Iterator[tuple[int, int, list[str], str, bool]]:
    """(start, end, path, kind, is_proviso) of paragraphs of a block that are kept together.

    A chunk bears the path that holds when it is closed: of the paragraph that no longer fits.
    """
    for block_start, block_end, kind, title in blocks(text, forms):
        path, held = [title], None
        for start, end in paragraphs(text, block_start, block_end, forms):
            own = text[start:end]
            proviso = bool(forms.proviso.search(own))
            if clause := forms.clause.match(own):
                path = [title, clause.group().strip()]
            if held:
                fits = word_tokens(text[held[0] : end]) <= limits.most
                if fits and (limits.keep_provisos if proviso else word_tokens(text[held[0] : held[1]]) < limits.least):
                    held = (held[0], end, held[2] or proviso)
                    continue
                yield held[0], held[1], path, kind, held[2]
            held = (start, end, proviso)
        if held:
            yield held[0], held[1], path, kind, held[2]


def structured(text: str, limits: Limits, forms: Forms) -> Iterator[tuple]:
    """The chunks of one text; a proviso's parent is the first piece of the last operative chunk before it."""
    if not text.strip():
        return
    found = blocks(text, forms)
    if limits.windows and len(found) <= 1 and len(text) > WINDOWED and found[0][2] not in ("section", "preamble"):
        for i, (start, piece, tokens) in enumerate(window_pieces(text, WINDOW, OVERLAP, word_tokens, limits.most)):
            proviso = bool(forms.proviso.search(piece))
            yield i, None, start, start + len(piece), tokens, ["Sliding Window Body"], "proviso" if proviso else "standard", proviso, piece
        return
    n, parent = 0, None
    for start, end, path, kind, proviso in _merged(text, limits, forms):
        above, first = parent if proviso else None, n
        for at, piece, tokens in halves(text[start:end], start, word_tokens, limits.most, _sentence_space, shortest=4):
            yield n, above, at, at + len(piece), tokens, path, "proviso" if proviso else kind, proviso, piece
            n += 1
        if not proviso and kind in OPERATIVE:
            parent = first


def structural_chunks(texts: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The columns of ``texts`` but text, then ordinal, parent, char_start, char_end, token_count, path, kind, is_proviso, chunk.

    ``parent`` is the ordinal of the chunk that a proviso belongs to. Chunks stand at their offsets, and what
    no chunk holds is white space. A long text without headings is cut into overlapping windows. Null and blank
    texts have no chunks; each row's chunks are numbered by themselves.
    """

    def cut(text: str) -> Iterator[tuple]:
        return structured(text, limits, _forms())

    return rows_of_texts(texts, cut, CHUNK)


_FORMS: list[Forms] = []


def _forms() -> Forms:
    if not _FORMS:
        _FORMS.append(Forms())
    return _FORMS[0]


#: Headings of what is attached to a text (fixed values).
ATTACHED = (
    r"^\s*(?:(?P<ANNEXURE>ANNEX(?:URE)?(?:\s+([0-9IVXLCDM]+|[A-Z]))?(?:\s*[:\-\.]\s*([^\n\r]+))?)|"
    r"(?P<SCHEDULE>(?:SCHEDULE\s+([0-9IVXLCDM]+|[A-Z])|(?:FIRST|SECOND|THIRD|FOURTH|FIFTH)\s+SCHEDULE)(?:\s*[:\-\.]\s*([^\n\r]+))?)|"
    r"(?P<FAQ>(?:FREQUENTLY\s+ASKED\s+QUESTIONS|FAQs?|CLARIFICATORY\s+FAQs?)(?:\s*[:\-\.]\s*([^\n\r]+))?)|"
    r"(?P<APPENDIX>APPENDIX(?:\s+([0-9IVXLCDM]+|[A-Z]))?(?:\s*[:\-\.]\s*([^\n\r]+))?))"
)
FAQ = "Frequently Asked Questions"


def attached(text: str) -> Iterator[tuple]:
    """(ordinal, kind, identifier, title, start, end): the main body and each annexure, schedule, FAQ and appendix."""
    if not text.strip():
        return
    marks = list(re.finditer(ATTACHED, text, re.IGNORECASE | re.MULTILINE))
    yield 0, "MAIN", "MAIN", "Primary Circular Directives", 0, marks[0].start() if marks else len(text)
    for i, m in enumerate(marks):
        said = m.group().strip()
        mark = next((x for x in ":-" if x in said), None)
        name, title = (x.strip() for x in said.split(mark, 1)) if mark else (said, FAQ if m.lastgroup == "FAQ" else said)
        name = FAQ if m.lastgroup == "FAQ" else name
        yield i + 1, m.lastgroup, name, title or name, m.start(), marks[i + 1].start() if i + 1 < len(marks) else len(text)


def sections(texts: DataFrame) -> DataFrame:
    """The columns of ``texts`` but text, then ordinal, kind, identifier, title, char_start, char_end; sections tile the text, 0 is the main body."""
    return rows_of_texts(texts, attached, "ordinal long, kind string, identifier string, title string, char_start long, char_end long")


def section_links(found: DataFrame, kinds: tuple[str, ...] = ("ANNEXURE", "SCHEDULE", "FAQ", "APPENDIX")) -> DataFrame:
    """``sections`` that hang on the main body (``parent``: 0), those of the wanted kinds."""
    return found.filter(F.col("kind").isin(*kinds)).withColumn("parent", F.lit(0).cast("long"))
