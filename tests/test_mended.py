"""What was mended: readiness, word error rate, request logs and versions of hot keys, prefixes."""

import random

import pytest

from tidemark.operators import compliance, near, registry, retrieval, scans, search


def test_readiness_needs_no_deprecated_asset(spark):
    rows = [("a", "PQC_READY", False)] * 9 + [("a", "CLASSICAL_DEPRECATED", True)] + [("b", "HYBRID", None), ("b", None, True)] + [("c", "PQC_READY", False), (None, "UNKNOWN_AUDIT_REQUIRED", True)]
    df = spark.createDataFrame(rows, "team string, status string, weak boolean")
    found = {r.team: (r.total, r.deprecated, r.unknown, r.vulnerable, r.exposure, r.readiness, r.milestone) for r in registry.readiness(df, "team", "status", "weak").collect()}
    assert found == {
        "a": (10, 1, 0, 1, 0.1, 90.0, "PHASE_2_HYBRID_TRANSITION"), "b": (2, 0, 0, 1, 0.5, 37.5, "PHASE_2_HYBRID_TRANSITION"),
        "c": (1, 0, 0, 0, 0.0, 100.0, "PHASE_3_QUANTUM_RESILIENT"), None: (1, 0, 1, 1, 1.0, 0.0, "PHASE_1_INVENTORY"),
    }
    none = registry.readiness(df.limit(0), None, "status", "weak").collect()
    assert [(r.total, r.exposure, r.readiness, r.milestone) for r in none] == [(0, 0.0, 0.0, "PHASE_1_INVENTORY")]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_word_error_rate_of_many_different_words(spark):
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        assert scans.edit_distance(a, b) == plain_distance(a, b)
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, "A b c", "a x c d"), (2, "", ""), (3, " ", "x"), (4, None, "x"), (5, "x", None), (6, long, "w7 w9")]
    found = {r.id: r.wer for r in spark.createDataFrame(rows, "id int, a string, b string").select("id", scans.word_error_rate("a", "b").alias("wer")).collect()}
    assert found == {1: pytest.approx(2 / 3), 2: 0.0, 3: 1.0, 4: None, 5: None, 6: pytest.approx(49_998 / 50_000)}


def test_log_of_one_busy_user(spark):
    rng = random.Random(2)
    rows = sorted((rng.randrange(4000), i) for i in range(3000))
    held, want = [], {}
    for at, i in rows:
        held = [x for x in held if x > at - 60]
        want[i] = len(held) < 5
        held += [at] * want[i]
    df = spark.createDataFrame([(i, 7, at) for at, i in rows], "event_id long, user_id long, at long").selectExpr("event_id", "user_id", "timestamp_seconds(at) as ts").repartition(3)
    assert {r.event_id: r.allowed for r in compliance.sliding_log(df, seconds=60, limit=5).collect()} == want


def test_versions_meet_rows_of_a_hot_key(spark):
    rows = spark.createDataFrame([("k", t) for t in range(50)] + [(None, 5), ("z", 5), ("k", None)], "key string, t int")
    versions = spark.createDataFrame([("k", 10, "b"), ("k", 10, "a"), ("k", 30, None), (None, 1, "n"), ("z", 6, "late"), ("k", None, "x")], "key string, s int, v string")
    found = {(r.key, r.t): r.version_value for r in registry.as_of(rows, versions, "key", "t", "s", "v").collect()}
    assert all(found["k", t] == (None if t < 10 or t >= 30 else "b") for t in range(50)) and found[None, 5] is None and found["z", 5] is None and found["k", None] is None


def test_suggestions_meet_by_whole_prefixes(spark):
    keys = spark.createDataFrame([("Abc", 1.0), ("abd", 2.0), ("ab", 1.0), ("", 9.0), (None, 1.0)], "key string, base double")
    asked = spark.createDataFrame([("AB",), ("abd ",), ("",), (None,), ("zz",)], "prefix string")
    found = [(r.prefix, r.key, r.score) for r in search.prefix_suggestions(keys, asked, limit=2).orderBy("prefix", "rank").collect()]
    assert found == [("AB", "abd", pytest.approx(1.866667)), ("AB", "ab", 1.3), ("abd ", "abd", 2.6)]


def test_exact_copies_without_a_window(spark):
    rows = [(i, "same text of some words " * 3) for i in range(40)] + [(90, "another one entirely")]
    plan = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.canonical_id, r.match_type) for r in plan.filter("doc_id > 0 and doc_id < 90").collect()} == {(0, "exact_text")}
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()


def test_bm25_splits_texts_once(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, " ")], "doc_id long, text string")
    split = docs.select("doc_id", retrieval.terms("text").alias("t"))
    assert split.count() == 3
    found = retrieval.bm25(spark.createDataFrame([(1, "a z")], "item_id long, text string"), docs, k=3)
    assert [(r.item_id, r.doc_id, r["rank"]) for r in found.collect()] == [(1, 1, 1)]


def test_bm25_time_follows_text_length(spark):
    import time

    items, took = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"), []
    for n in (2_000, 2_000, 64_000):
        docs = spark.createDataFrame([(i, "alpha beta gamma delta " * n) for i in range(2)], "doc_id long, text string")
        start = time.perf_counter()
        assert retrieval.bm25(items, docs, k=1).count() == 1
        took.append(time.perf_counter() - start)
    assert took[2] < 20 + 16 * took[1]  # 32 times the text; quadratic work would take minutes
