"""Structural chunks tile their texts, keep to limits, and know their parents; windows equal a plain version."""

import random

import pytest

from tidemark.operators import chunks, structure

SCHEMA = "id long, chunk_count int, text string"


def made(n):
    rng = random.Random(8)
    heads = ["SECTION 4 ", "Chapter IV ", "12. ", "ANNEXURE 2", "WHEREAS ", "Circular No. ", "PART X "]
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 25)):
            lead = rng.choice(heads) if rng.random() < 0.3 else rng.choice(["(1) ", "(b) ", "", "  ", "Provided that "])
            body = " ".join(rng.choice(["rule", "applies.", "bank", "é", "shall"]) for _ in range(rng.choice([3, 30, 200])))
            parts.append(lead + body + rng.choice(["\n\n", "\n", "\n \n", "\r\n\r\n", "\t\n\n\n"]))
        yield i, 1, "".join(parts)


def test_chunks_tile_and_keep_limits(spark):
    texts = {i: t for i, _, t in made(80)} | {100: None, 101: " \n", 102: "x" * 4000, 103: "long words " * 30_000}
    df = spark.createDataFrame([(i, 1, t) for i, t in texts.items()], SCHEMA).repartition(3)
    limits = structure.Limits(most=60, least=20)
    rows = structure.structural_chunks(df, limits).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
        assert texts[r.id][r.char_start : r.char_end] == r.chunk == r.chunk.strip() and r.token_count == structure.word_tokens(r.chunk)
        assert r.token_count <= 60 or " " not in r.chunk
    assert set(by) == set(texts) - {100, 101}
    for i, own in by.items():
        own.sort(key=lambda r: r.ordinal)
        assert [r.ordinal for r in own] == list(range(len(own)))
        covered = set()
        for r in own:
            covered.update(range(r.char_start, r.char_end))
        assert all(texts[i][k].isspace() for k in range(len(texts[i])) if k not in covered)
        for r in own:
            assert (r.parent is None) or (r.is_proviso and own[r.parent].kind in structure.OPERATIVE and not own[r.parent].is_proviso and r.parent < r.ordinal)
    assert {r.kind for r in rows} >= {"section", "schedule", "preamble", "gazette_header", "proviso"}


def test_a_proviso_and_its_parent(spark):
    text = "SECTION 1 General\n\nAll banks shall report.\n\n(1) Reports are due in May.\n\n" + "word " * 80 + "\n\nProvided that small banks " + "need not " * 60 + "\n\nANNEXURE 1 Form"
    rows = structure.structural_chunks(spark.createDataFrame([(1, 1, text)], SCHEMA), structure.Limits(most=110, least=5)).orderBy("ordinal").collect()
    assert [(r.kind, r.parent, r.path) for r in rows] == [
        ("section", None, ["SECTION 1", "(1)"]), ("section", None, ["SECTION 1", "(1)"]), ("section", None, ["SECTION 1", "(1)"]),
        ("proviso", 2, ["SECTION 1", "(1)"]), ("proviso", 2, ["SECTION 1", "(1)"]), ("schedule", None, ["ANNEXURE 1"]),
    ]


def test_sections_tile(spark):
    text = "Body.\n\nAnnexure II: Forms\nform\nFAQs\nq\nSECOND SCHEDULE - Rates\nx\nAppendix"
    found = structure.sections(spark.createDataFrame([(1, 1, text), (2, 1, "only a body"), (3, 1, None), (4, 1, " ")], SCHEMA))
    rows = [tuple(r)[2:] for r in found.filter("id = 1").orderBy("ordinal").collect()]
    assert [r[1:4] for r in rows] == [("MAIN", "MAIN", "Primary Circular Directives"), ("ANNEXURE", "Annexure II", "Forms"), ("FAQ", structure.FAQ, structure.FAQ), ("SCHEDULE", "SECOND SCHEDULE", "Rates"), ("APPENDIX", "Appendix", "Appendix")]
    assert rows[0][4] == 0 and rows[-1][5] == len(text) and all(a[5] == b[4] for a, b in zip(rows, rows[1:], strict=False))
    assert found.filter("id = 2").count() == 1 and found.count() == 6
    assert {(r.ordinal, r.parent) for r in structure.section_links(found, ("FAQ", "APPENDIX")).collect()} == {(2, 0), (4, 0)}


def plain_windows(text, size, overlap, most):
    out, pos = [], 0
    while pos < len(text):
        end = min(pos + size, len(text))
        if end < len(text) and text.rfind(" ", pos + size - overlap, end) > pos:
            end = text.rfind(" ", pos + size - overlap, end)
        out.append(text[pos:end].strip())
        if pos + size >= len(text):
            break
        pos += size - overlap
    return [w for w in out if w]


def test_windows_strip_all_white_space(spark):
    text = "  alpha beta　" * 400
    rows = [(1, text), (2, ""), (3, None), (4, "　")]
    found = chunks.chunk_documents(spark.createDataFrame(rows, "doc_id long, text string"), size=100, overlap=20, max_tokens=1000).orderBy("ordinal").collect()
    assert [r.chunk for r in found] == plain_windows(text, 100, 20, 1000) and {r.doc_id for r in found} == {1}


def test_cutting_is_linear():
    import time

    took = []
    for n in (200_000, 1_600_000):
        text = "word and " * (n // 9)
        start = time.perf_counter()
        assert sum(1 for _ in chunks.window_pieces(text, 1000, 150, chunks.quarter_tokens, 64)) > n / 1000
        took.append(time.perf_counter() - start)
    assert took[1] < 30 * took[0]


@pytest.mark.parametrize("text", ["a", "ab cd", "x" * 50, "a b c d e f g h"])
def test_halves_lose_nothing(text):
    found = list(chunks.halves(text, 7, len, 3, chunks.middle_space))
    assert "".join(p for _, p, _ in found).replace(" ", "") == text.replace(" ", "") and all(text[s - 7 :].startswith(p) for s, p, _ in found)
