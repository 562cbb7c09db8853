"""Sentences, spans, distances, hidden characters, amounts, tables and manifests on nulls, ties and empty tables."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantities, scans, sentences
from tidemark.plans import passages


def test_sentences_keep_their_places(spark):
    text = "  Pay Rs. 15 at once.  See Sec. 46 and A. Smith; Then stop!\n\nlast line\n \n(end) no. "
    rows = [(1, text), (1, text), (2, None), (3, " \n\n "), (4, ""), (5, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.start, r.end, r.sentence) for r in sentences.sentence_spans(df).collect())
    want = ["Pay Rs. 15 at once.", "See Sec. 46 and A. Smith;", "Then stop!", "last line", "(end) no."]
    assert [f[3] for f in found if f[0] == 1] == [w for w in want for _ in range(2)]
    assert all(text[s:e] == t for i, s, e, t in found if i == 1) and found[-1] == (5, 0, 3, "one") and {f[0] for f in found} == {1, 5}
    assert sentences.sentence_spans(df.limit(0)).count() == 0
    assert [(r.window, round(r.iou, 3)) for r in sentences.best_windows(spark.createDataFrame([(1, 900, 1800), (1, 0, 10)], "doc_id long, start int, end int")).collect()] == [(1, 0.9), (0, 0.01)]


def test_overlaps(spark):
    spans = spark.createDataFrame([(0, 10, 5, 15), (0, 0, 0, 0), (0, 4, 6, 9), (None, 1, 2, 3)], "a int, b int, c int, d int")
    assert [r.iou for r in spans.select(scans.span_iou(*map(F.col, "abcd")).alias("iou")).collect()][:3] == [5 / 15, 0.0, 0.0]
    box = [F.lit(float(x)) for x in (0, 0, 2, 2)], [F.lit(float(x)) for x in (1, 1, 3, 3)]
    assert spark.range(1).select(scans.box_iou(*box).alias("iou")).first().iou == pytest.approx(1 / 7)


def test_distance_allows_swaps(spark):
    pairs = [("abcd", "abdc", 1), ("ca", "abc", 3), ("", "", 0), ("", "ab", 2), ("a", "abcd", 3), ("kitten", "sitting", 3), ("same", "same", 0), (None, "a", None)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    assert [(r.d, r.want) for r in df.select("want", sentences.osa_distance("a", "b").alias("d")).collect()] == [(p[2], p[2]) for p in pairs]


def test_hidden_characters(spark):
    rows = [("a\u200bb",), ("\x1b[1mx\x07",), ("\u202ey\U000e0041",), ("plain\t\n",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string").select(sentences.hidden_classes("t").alias("c"), sentences.without_hidden("t").alias("o"))
    assert [(r.c, r.o) for r in df.collect()] == [(["zero_width"], "ab"), (["ansi", "control"], "x"), (["unicode_tags", "bidi"], "y"), ([], "plain\t\n"), ([], None), ([], "")]


def test_amounts(spark):
    rows = [("₹ 1,50,000", 150000.0, "INR", "unit"), ("2.5 cr", 25000000.0, "INR", "Crore"), ("250 bps", 0.025, "BPS", "bps"), ("2.5%", 0.025, "PERCENT", "%"), ("$-3 bn", -3e9, "USD", "Billion"), ("none", None, "UNKNOWN", "unit"), (None, None, "UNKNOWN", "unit")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, v double, u string, s string").select("i", quantities.parse_quantity("t").alias("q"), "v", "u", "s")
    assert all((r.q.value == pytest.approx(r.v) if r.v is not None else r.q.value is None) and (r.q.unit, r.q.scale) == (r.u, r.s) for r in df.collect())
    pairs = df.alias("x").join(df.alias("y"), F.expr("x.i < y.i")).select(F.col("x.i").alias("i"), F.col("y.i").alias("j"), quantities.equivalent(F.col("x.q"), F.col("y.q")).alias("same"))
    assert {(r.i, r.j) for r in pairs.filter("same").collect()} == {(2, 3)}


def test_tables_and_manifests(spark):
    rows = spark.createDataFrame([("t", 2, "b|c", None), ("t", 1, "a", 1), (None, 1, "z", 2)], "k string, o int, x string, y int")
    found = {r.k: (r.n_rows, r.markdown) for r in quantities.markdown_tables(rows, "k", ["o"], ["x", "y"]).collect()}
    assert found["t"] == (2, "| x | y |\n| --- | --- |\n| a | 1 |\n| b\\|c |  |") and found[None][0] == 1
    listed = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), (None, "4"), ("e", None)], "url string, sha256 string")
    stored = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "5"), ("e", None)], "url string, sha256 string")
    states = {r.url: r.state for r in quantities.manifest_states(listed, stored, "url").collect()}
    assert states == {"a": "ok", "b": "changed", "c": "missing", None: "missing", "d": "unlisted", "e": "ok"}
    assert quantities.manifest_states(listed.limit(0), stored.limit(0), "url").count() == 0


def test_manifest_of_pages_that_share_a_url(spark, tmp_path):
    pages = [(1, "u", "a"), (2, "u", "b"), (3, "u", "c"), (5, "v", "d"), (6, None, None), (10, "u", "b")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted((r.url or "", r.state) for r in passages.manifest_states(spark, str(tmp_path)).collect())
    assert found == [("", "changed"), ("u", "changed"), ("u", "missing"), ("u", "missing"), ("u", "ok"), ("v", "unlisted")]
