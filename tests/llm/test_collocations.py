"""Collocations against a plain count, on nulls, repeated rows, several languages, ties, and a sketch that is too narrow."""

import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, rank int, n long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, percent, most):
    f, n, found = Counter(), Counter(), []
    for _, text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, " ".join(w[i : i + m])] += 1
    often = {k: c for k, c in f.items() if c >= least and " " in k[1]}
    longer = Counter()
    for (lang, p), c in often.items():
        w = p.split(" ")
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                k = lang, " ".join(w[i : i + m])
                longer[k] = max(longer[k], c)
    for (lang, p), a in often.items():
        if 100 * longer[lang, p] >= percent * a:
            continue
        w = p.split(" ")
        parts = [(f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]) for k in range(1, len(w))]
        score, k = min((2000000 * a // (x + y), k) for k, (x, y) in enumerate(parts))
        found.append((lang, -score, -a, p.encode(), *parts[k]))
    found.sort()
    ranks = Counter()
    out = []
    for lang, score, a, p, x, y in found:
        ranks[lang] += 1
        if ranks[lang] <= most:
            out.append((lang, ranks[lang], p.decode(), -a, x, y, n[lang], -score))
    return sorted(out)


def texts():
    rng = random.Random(5)
    vocabulary = ["Aa", "b", "cc", "é", "漢字", "the", "of", "x-y", "\x00z"]
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!? ", "\x0b", " "]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice(seps) for _ in range(rng.randrange(60))), rng.choice(["en"] * 4 + ["de", None, "und"])) for i in range(120)]
    return [*rows, *rows[:9], (200, None, "en"), (201, "", None), (202, " .\n; ", "fr"), (203, "one two " * 5000, "en"), (204, "ab", "en"), (205, "c d", "en")]


def rows_of(found):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect())


@pytest.mark.parametrize(("least", "most"), [(3, 40), (9, 2000)])
def test_equals_plain_count(spark, least, most):
    rows = texts()
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(5)
    found = rows_of(collocations.collocations(df, least, 80, most))
    assert found == plain(rows, least, 80, most) and found


def test_narrow_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_WIDTH", 64)
    monkeypatch.setattr(collocations, "MOST_WIDTH", 64)
    rows = texts()
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(3)
    assert rows_of(collocations.collocations(df, 5)) == plain(rows, 5, 80, 2000)


def test_no_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", 1, 1), (2, "a b", "en", "", 1, 1)], SCHEMA)).collect() == []


def test_exact_scores_of_large_counts(spark):
    big = 4 * 10**18
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big), ("en", "a b", big - 1)], "lang string, phrase string, c long")
    cand = spark.createDataFrame([("en", "a b", big - 1, 2)], "lang string, phrase string, a long, m int")
    assert collocations.scored(cand, counts).first().score == 2000000 * (big - 1) // (2 * big)


def test_words_and_pieces():
    p = collocations.pieces_of_texts(pa.array(["A  b.c", None, "", "d\te\nf", "g"]))
    assert [bytes(p.data[s : s + n]) for s, n in zip(p.start, p.length, strict=True)] == [b"a", b"b", b"c", b"d", b"e", b"f", b"g"]
    assert p.doc.tolist() == [0, 0, 0, 3, 3, 3, 4]
    assert [int(p.piece[i] == p.piece[i + 1]) for i in range(6)] == [1, 0, 0, 1, 0, 0]


def test_counters_stay_at_least():
    row = np.zeros(8, np.uint8)
    for _ in range(3):
        collocations.count_up(row, np.array([5] * 1000 + [0, 7, 5], np.int32), 30)
    assert row.tolist() == [3, 0, 0, 0, 0, 30, 0, 3]
    row = np.zeros(8, np.uint16)
    for _ in range(3):
        collocations.count_up(row, np.array([1] * 250, np.int32), 700)
        collocations.count_up(row, np.zeros(0, np.int32), 700)
    assert row.tolist() == [0, 700, 0, 0, 0, 0, 0, 0]


def test_tasks_take_little_memory():
    """The widest sketch, and a count that lets all n-grams through, of a batch of texts."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(3000)]
    text = [" ".join(rng.choices(vocabulary, k=600)) for _ in range(1000)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(text), "lang": pa.array(["en"] * len(text))})
    assert batch.nbytes > 3_400_000
    width = collocations.MOST_WIDTH
    bits = SimpleNamespace(value=np.full((collocations.ROWS, width // 8), 255, np.uint8))
    tracemalloc.start()
    try:
        peaks = []
        for task in (collocations._sketch(width, 30), collocations._survivors(bits, width)):
            tracemalloc.reset_peak()
            for _ in task(iter([batch])):
                pass
            peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
    finally:
        tracemalloc.stop()
    assert max(peaks) < 200, peaks


def test_batches_are_bounded(spark, monkeypatch):
    """Each pass over the texts gets them in batches of BATCH_BYTES, and the setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name), []
    written = collocations.materialise
    monkeypatch.setattr(collocations, "materialise", lambda df, to: seen.append(spark.conf.get(name)) or written(df, to))
    collocations.frequent(spark.createDataFrame([(1, "a b", "en", "", 1, 1)], SCHEMA))
    assert seen == [str(collocations.BATCH_BYTES)] * 2 and spark.conf.get(name) == before


@pytest.mark.parametrize("counters", [1 << 12, 1 << 24, 1 << 34])
def test_sketch_grows_with_the_texts(counters):
    """No task holds the sketch of much text, two tasks' counts add up, and what passes is what is frequent, or more."""
    assert collocations.counters_for(10**11) >= 10**10
    rng = random.Random(3)
    text = pa.array([" ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(400)) for _ in range(60)])
    batches = [pa.RecordBatch.from_pydict({"text": part, "lang": pa.array(["en"] * len(part))}) for part in (text[:25], text[25:])]
    tracemalloc.start()
    sent = [b for batch in batches for b in collocations._sketch(counters, 9)(iter([batch]))]
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    found = []
    for part in {b["part"][0].as_py() for b in sent}:
        merged = list(collocations._merged(counters, 9)((pa.scalar(part),), iter([b for b in sent if b["part"][0].as_py() == part])))
        found += [part * collocations.part_of(counters) + x for m in merged for x in np.cumsum(np.frombuffer(collocations.zstandard.decompress(m["passed"][0].as_py()), "<u4"), dtype=np.int64).tolist()]
    counts = Counter()
    for _, _, h in collocations.gram_hashes(collocations.pieces_of_texts(text), collocations._lang_hashes(pa.array(["en"] * len(text)))):
        counts.update((h & np.uint64(counters - 1)).tolist())
    assert sorted(found) == sorted(b for b, c in counts.items() if c >= 9) and found
