"""Maps back to the original through one and two steps, blanked furniture, repeated lines, and nulls."""

import random
import re

from pyspark.sql import functions as F

from tidemark.operators import cleaning

TEXTS = "id long, raw_start string, text string"


def test_mapped_spans_give_the_original_characters(spark):
    rng = random.Random(1)
    texts = [(i, "clash", "".join(rng.choice("ab1 .é漢") for _ in range(rng.randrange(3000)))) for i in range(25)] + [(90, None, None), (91, None, ""), (92, None, "111")]
    df = spark.createDataFrame(texts, TEXTS).drop("raw_start").repartition(3)
    once = cleaning.cut_out(df, "[0-9]+").withColumnRenamed("runs", "first")
    twice = cleaning.compose(cleaning.cut_out(once, r"\.+"), "runs", "first", "whole")
    rows = {r.id: r for r in twice.collect()}
    raw = {i: t for i, _, t in texts}
    spans = []
    for i, r in rows.items():
        if raw[i] is None:
            assert r.text is None and r.whole is None
            continue
        assert r.text == re.sub(r"[0-9.]", "", raw[i])
        for _ in range(20 if r.text else 0):
            a, b = sorted(rng.randrange(len(r.text) + 1) for _ in range(2))
            spans.append((i, a, b))
    spans += [(92, 0, 1), (555, 0, 1), (None, 0, 1)]
    found = cleaning.mapped_back(spark.createDataFrame(spans, "id long, start int, end int"), twice.select("id", F.col("whole").alias("runs")), "id").collect()
    assert len(found) == len(spans)
    for r in found:
        if r.id not in rows or r.start == r.end or r.id == 92:
            assert r.raw_start is None and r.raw_end is None
        else:
            assert re.sub(r"[0-9.]", "", raw[r.id][r.raw_start : r.raw_end]) == rows[r.id].text[r.start : r.end]
            assert raw[r.id][r.raw_start] == rows[r.id].text[r.start] and raw[r.id][r.raw_end - 1] == rows[r.id].text[r.end - 1]


def test_what_is_put_in_has_no_place(spark):
    df = spark.createDataFrame([(1, "ab--cd")], "id long, text string")
    cut = cleaning.cut_out(df, "-+", " ")
    assert cut.first().text == "ab cd"
    spans = spark.createDataFrame([(1, 0, 5), (1, 2, 3), (1, 1, 4)], "id long, start int, end int")
    got = {(r.start, r.end): (r.raw_start, r.raw_end) for r in cleaning.mapped_back(spans, cut.select("id", "runs"), "id").collect()}
    assert got == {(0, 5): (0, 6), (2, 3): (None, None), (1, 4): (1, 5)}


def test_composed_equals_plain_maps():
    rng = random.Random(3)
    for _ in range(200):
        raw = list(range(rng.randrange(40)))
        one = "".join(rng.choice("ax") for _ in raw)
        first_text, first = cleaning.kept_runs(one, re.compile("x+"))
        kept = [i for i, c in enumerate(one) if c != "x"]
        two = "".join(rng.choice("by") for _ in first_text)
        _, second = cleaning.kept_runs(two, re.compile("y"))
        want = [kept[i] for i, c in enumerate(two) if c != "y"]
        got = [run["raw"] + i for run in cleaning.composed(second, first) for i in range(run["n"])]
        assert got == want


def test_blanking_keeps_places(spark):
    text = "Page 3 of 9 The Gazette of India: Extraordinary\n 12 \nNotice​ to all भाग ʰ�\nRegd. No. D.L.-33004/99\n[Page 4]"
    rows = spark.createDataFrame([(1, "", text), (2, "", None), (3, "", "plain text")], TEXTS)
    found = {r.id: r for r in cleaning.blank_noise(rows).collect()}
    clean = found[1].text
    assert len(clean) == len(text) and clean.split() == ["Notice", "to", "all"] and all(c == " " or c == t for c, t in zip(clean, text, strict=True))
    assert found[1].furniture_kinds == ["gazette_stamps", "authority_banners", "page_numbers"] and found[1].furniture_words == 5 + 3 + 1 + 2
    assert found[2].text is None and found[2].furniture_kinds is None and (found[3].text, found[3].furniture_chars, found[3].furniture_kinds) == ("plain text", 0, [])
    assert "भाग" in cleaning.blank_noise(rows, keep_devanagari=True).filter("id = 1").first().text


def test_repeated_lines(spark):
    rows = [(i, "s" if i < 6 else None, f"Head\nown {chr(97 + i)}\ntext\nmore {i}\nPage {i}") for i in range(9)] + [(20, "s", None), (21, "t", "Head"), (22, "t", "Head"), (23, "u", "")]
    found = cleaning.repeated_lines(spark.createDataFrame(rows, "id long, source string, text string"), "source", edge=2).collect()
    assert sorted((str(r.source), r.place, r.line, r.n, r.texts) for r in found) == sorted([(s, p, x, n, n) for s, n in (("s", 6), ("None", 3)) for p, x in ((0, "Head"), (-1, "Page #"), (-2, "more #"))])
    assert cleaning.repeated_lines(spark.createDataFrame([], "id long, source string, text string"), "source").count() == 0
