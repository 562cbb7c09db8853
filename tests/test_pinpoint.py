"""Sentence scores, cover windows and text tables against plain versions; nulls, ties and empty tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import hybrid, layouts, pinpoint, retrieval
from tidemark.operators.scans import terms

TEXT = "id long, text string"


def frames(spark, items, docs):
    return spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")


def score(spark, query, sentence):
    df = spark.createDataFrame([(query, sentence)], "q string, s string")
    return df.select(pinpoint.sentence_score(pinpoint.query_features(F.col("q")), F.col("s"))).first()[0]


def test_scores_by_hand(spark):
    assert score(spark, "interest rate gold loan", "The interest rate of gold loan is 9 percent") == pytest.approx(0.4 + 0.25 + 0.2 + 0.15)
    assert score(spark, "interest rate gold loan", "Gold loans of Rs 5 crore need care") == pytest.approx(0.4 * 2 / 4 + 0.25 + 0.2 + 0.15)
    assert score(spark, "report within hours", "it took days") == pytest.approx(0.2)
    assert score(spark, "the of", "any thing") == 0.0 and score(spark, "gold", "of the") == 0.0


def test_best_sentences(spark):
    items, docs = frames(spark, [(1, "gold loan limit"), (2, None), (3, " ")], [(1, "A gold loan limit holds. Nothing here. The gold loan limit is old. Gold loan limits again."), (2, None), (3, "")])
    pairs = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 1), (3, 1), (1, 9), (None, 1)], "item_id long, doc_id long")
    found = [(r.item_id, r.doc_id, r.start, r.score) for r in pinpoint.pinpoint(pairs, items, docs).orderBy("start").collect()]
    assert found == [(1, 1, 0, 0.8), (1, 1, 39, 0.8)]
    assert pinpoint.pinpoint(pairs.limit(0), items, docs).count() == 0


def test_cover_windows_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["alpha", "beta", "gamma", "delta", "x1"]
    items = [(i, " ".join(rng.sample(vocabulary, 3))) for i in range(6)] + [(8, None)]
    docs = [(i, " ".join(rng.choice([*vocabulary, "other", "the"]) for _ in range(rng.randrange(60)))) for i in range(20)] + [(90, None), (91, "")]
    i, d = frames(spark, items, docs)
    pairs = i.select("item_id").crossJoin(d.select("doc_id"))
    found = {(r.item_id, r.doc_id): (r.n_terms, r["first"], r["last"]) for r in pinpoint.cover_windows(pairs, i, d).collect()}
    words = {r.doc_id: r.t or [] for r in d.select("doc_id", terms(F.col("text")).alias("t")).collect()}
    want = {}
    for a, q in items:
        for b, w in words.items():
            shared = set((q or "").split()) & set(w)
            if shared:
                runs = [(y - x, x, y) for x in range(len(w)) for y in range(x, len(w)) if shared <= set(w[x : y + 1])]
                size, x, y = min(runs)
                want[a, b] = (len(shared), x, y)
    assert found == want


def test_headings_fill_what_they_span():
    assert layouts.headings([["Order", "", "Price"], ["key", "status", ""]]) == ["Order -> key", "Order -> status", "Price"]
    assert layouts.headings([["a", "", "b"]]) == ["a", "Column_2", "b"] and layouts.headings([["x"], ["x"]]) == ["x"] and layouts.headings([]) == []


def test_tables_of_all_kinds(spark):
    text = "Intro\n| a | b |\n|---|:-:|\n| 1 |  2 x |\n|  | |\n| 3 |\nafter\n\nName   Age  City\n====\nAnn   9   Rome\nBob\t8\nend of it\n\nlone | pipe"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no table"), (5, "|")], TEXT)
    found = layouts.parsed_tables(rows).orderBy("ordinal").collect()
    assert [(r.id, r.kind, r.first_line, r.headers, r.matrix) for r in found] == [
        (1, "pipes", 1, ["a", "b"], [["1", "2 x"], ["3", ""]]),
        (1, "gaps", 8, ["Name", "Age", "City"], [["Ann", "9", "Rome"], ["Bob", "8", ""]]),
    ]
    assert layouts.parsed_tables(rows.limit(0)).count() == 0


def test_gutters_give_back_what_was_laid_out(spark):
    rng = random.Random(4)
    laid, texts = {}, []
    for i in range(40):
        n, rows = rng.randrange(2, 5), []
        for _ in range(rng.randrange(2, 7)):
            rows.append([rng.choice(["", "7", "a b", "é", "-12.5"]) if k else rng.choice(["u", "row x"]) for k in range(n)])
        head = [f"h{k} x" for k in range(n)]
        width = [max(len(r[k]) for r in [head, *rows]) + 2 for k in range(n)]
        # rows need a second cell to be told from prose
        rows = [r if any(r[1:]) else [r[0], *["1"] * (n - 1)] for r in rows]
        width = [max(w, *(len(r[k]) + 2 for r in rows)) for k, w in enumerate(width)]
        laid[i] = (head, rows)
        texts.append((i, "\n".join("".join(c.ljust(w) for c, w in zip(r, width, strict=True)) for r in [head, *rows]) + "\n\nprose follows"))
    found = {r.id: (r.headers, r.matrix) for r in layouts.parsed_tables(spark.createDataFrame(texts, TEXT), by_gutters=True).collect()}
    assert found == laid


def test_search_without_vectors_or_ways(spark):
    items, docs = frames(spark, [(1, "gold loan"), (2, "nothing there")], [(1, "gold loan gold"), (2, "gold"), (3, None), (4, "hidden gold loan")])
    no_vectors = spark.createDataFrame([], "item_id long, embedding array<double>")
    no_docs = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "doc_id long, embedding array<double>")
    ways = spark.createDataFrame([(1, 2, "cites"), (1, 4, "cites"), (4, 3, "cites"), (2, 3, "cites"), (1, 1, "x"), (None, 1, "x")], "src long, dst long, relation string")
    how = hybrid.Search(k=3, seeds=1, relations={"cites": 1.0})
    found = hybrid.hybrid_search(items, docs, no_vectors, no_docs, ways, keep=F.col("doc_id") != 4, how=how)
    got = [(r.item_id, r.doc_id, r["rank"]) for r in found.orderBy("item_id", "rank").collect()]
    assert {g[0] for g in got} == {1} and [g[1] for g in got][:2] in ([1, 2], [2, 1]) and 4 not in {g[1] for g in got} and 3 in {g[1] for g in got}
    assert hybrid.hybrid_search(items.limit(0), docs, no_vectors, no_docs, ways.limit(0), how=how).count() == 0


def test_nearest_by_cosine(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "item_id long, embedding array<double>")
    v = spark.createDataFrame([(5, [2.0, 0.0]), (6, [1.0, 1.0]), (7, [0.0, 0.0]), (8, [1.0]), (9, None), (4, [3.0, 0.0])], "doc_id long, embedding array<double>")
    assert [(r.item_id, r.doc_id, r.score) for r in hybrid.dense_arm(q, v, 3).orderBy("rank").collect()] == [(1, 4, 1.0), (1, 5, 1.0), (1, 6, 0.707107)]


def plain_bm25(items, docs, k):
    words = {d: (t or "").split() for d, t in docs}
    held = {d: w for d, w in words.items() if w}
    mean = sum(map(len, held.values())) / len(held)
    df = Counter(t for w in held.values() for t in set(w))
    out = []
    for i in sorted({i for i, _ in items}):
        asked = {t for j, q in items if j == i for t in (q or "").split()}
        scores = []
        for d, w in held.items():
            if asked & set(w):
                s = sum(math.log1p((len(held) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in sorted(asked & set(w)))
                scores.append((-round(s, 6), d))
        out += [(i, d, -s, r) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize(("at_once", "added"), [(500_000, 2_000_000), (7, 40)])
def test_bm25_equals_a_plain_one(spark, monkeypatch, at_once, added):
    monkeypatch.setattr(retrieval, "TERMS_AT_ONCE", at_once)
    monkeypatch.setattr(retrieval, "ADDED_AT_ONCE", added)
    rng = random.Random(2)
    word = lambda: f"w{int(rng.paretovariate(0.8)) % 60}"
    items = [*((i, " ".join(word() for _ in range(6))) for i in range(12)), (3, "w1 w2"), (20, None), (21, "nowhere"), (22, " ")]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(30)))) for i in range(150)]
    docs += [*((200 + i, t) for i, (_, t) in enumerate(docs[:40])), (300, None), (301, "")]
    i, d = frames(spark, items, docs)
    found = [tuple(r) for r in retrieval.bm25(i, d.repartition(5), k=4).orderBy("item_id", "rank").collect()]
    assert found == [(a, b, pytest.approx(s, abs=2e-6), r) for a, b, s, r in plain_bm25(items, docs, 4)]
    assert retrieval.bm25(i.limit(0), d).count() == 0 and retrieval.bm25(i, d.limit(0)).count() == 0


def test_bm25_writes_no_postings(spark, monkeypatch):
    """What is written follows the queries, not the documents."""
    written, sizes = retrieval.materialise, []
    monkeypatch.setattr(retrieval, "materialise", lambda df, name: (lambda out: sizes.append(out.count()) or out)(written(df, name)))
    i, d = frames(spark, [(1, "alpha beta gamma"), (2, "alpha delta")], [(n, "alpha beta gamma delta " * (n % 7)) for n in range(500)])
    pairs = retrieval.bm25(i, d, k=3).select("item_id", "doc_id")
    assert pairs.count() == 6 and max(sizes) <= 6
    assert pinpoint.cover_windows(pairs, i, d).count() == 6


def test_pinpointing_writes_what_is_found_only(spark, monkeypatch):
    sizes = []
    for module in (retrieval, pinpoint):
        monkeypatch.setattr(module, "materialise", lambda df, name, written=module.materialise: (lambda out: sizes.append(out.count()) or out)(written(df, name)))
    i, d = frames(spark, [(1, "gold loan limit"), (2, "gold rate")], [(n, f"A gold loan limit holds. The {n} rate. " * (n % 3 + 1)) for n in range(300)])
    assert pinpoint.pinpoint(retrieval.bm25(i, d, k=2).select("item_id", "doc_id"), i, d, least=0.1).count() > 0
    assert len(sizes) == 4 and max(sizes) <= 4 * 6


def test_cosine_in_tasks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "COSINES_AT_ONCE", 90)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(90)] + [(100 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(30)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [1.0, 2.0]), (203, [2.0, 4.1]), (None, [1.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(r) for r in retrieval.cosine_top_k(vectors.filter("vec_id % 10 in (0, 2)"), vectors, k=4).orderBy("query_id", "rank").collect()]
    want = []
    for a, x in rows:
        if a is None or a % 10 not in (0, 2):
            continue
        scores = []
        for b, y in rows:
            if b not in (None, a):
                whole = x is not None and y is not None and len(x) == len(y) and None not in x and None not in y
                scores.append((-round(float(np.dot(x, y) / math.sqrt(np.dot(x, x) * np.dot(y, y))), 6) if whole else 9.0, b))
        want += [(a, b, None if s == 9.0 else pytest.approx(-s, abs=2e-6), r) for r, (s, b) in enumerate(sorted(scores)[:4], 1)]
    assert found == sorted(want, key=lambda r: (r[0], r[3]))
    assert retrieval.cosine_top_k(vectors.limit(0), vectors, k=4).count() == retrieval.cosine_top_k(vectors, vectors.limit(0), k=4).count() == 0
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 7)
    again = retrieval.cosine_top_k(vectors.filter("vec_id % 10 in (0, 2)"), vectors, k=4).orderBy("query_id", "rank")
    assert [tuple(r) for r in again.collect()] == found
    assert "Cartesian" not in again._jdf.queryExecution().toString() and "NestedLoop" not in again._jdf.queryExecution().toString()
