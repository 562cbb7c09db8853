"""Nulls, ties, empty tables and hot keys of searches, registers and running sums."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import chunks, compliance, near, quality, registry, running, search
from tidemark.plans import analytics


def test_running_sum_equals_a_plain_one(spark):
    rows = [(k, i, (i * 7) % 5 if i % 9 else None) for k in ("hot", None) for i in range(400 if k else 5)]
    found = running.running_sum(spark.createDataFrame(rows, "k string, i int, v long"), ["k"], ["i"], "v", "s").collect()
    want = {}
    for k in ("hot", None):
        total = 0
        for kk, i, v in rows:
            if kk == k:
                total += v or 0
                want[k, i] = total
    assert {(r.k, r.i): r.s for r in found} == want
    assert running.running_sum(spark.createDataFrame([], "i int, v long"), [], ["i"], "v", "s").count() == 0


def test_request_log_forgets_refused_requests(spark):
    at = "2024-01-01 00:00:"
    rows = [(i, 1, at + f"{s:02d}") for i, s in enumerate((0, 1, 2, 9, 10, 11, 30))] + [(50, 2, None)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t string").selectExpr("event_id", "user_id", "cast(t as timestamp) as ts")
    found = {r.event_id: (r.allowed, r.remaining) for r in compliance.sliding_log(df, seconds=10, limit=2).collect()}
    assert found == {0: (True, 1), 1: (True, 0), 2: (False, 0), 3: (False, 0), 4: (True, 0), 5: (True, 0), 6: (True, 1), 50: (False, 0)}


def test_anchors_and_filters(spark):
    fused = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.4), (1, 12, 0.3), (1, 13, 0.2)], "q int, d int, score double")
    lead = spark.createDataFrame([(1, 13, "a"), (1, 10, "b"), (1, 99, "c"), (2, 5, "a")], "q int, d int, arm string")
    found = {(r.q, r["rank"]): (r.d, r.anchored_arm) for r in search.anchor_arm_leaders(fused, lead, "q", "d", 3).collect()}
    assert found == {(1, 1): (10, None), (1, 2): (13, "a"), (1, 3): (99, "c"), (2, 1): (5, "a")}
    with pytest.raises(ValueError):
        search.tri_arm_fusion({}, "q", "d", rrf_k=0)
    rows = spark.createDataFrame([(None, None), ("t1", 3), ("t2", None)], "tenant string, clearance int")
    assert rows.filter(search.entitlement("t1", 2)).count() == 1 and rows.filter(search.entitlement(None, None)).count() == 0


def test_chunks_lose_nothing_and_halve(spark):
    df = spark.createDataFrame([(1, "word " * 700), (2, "x" * 2500), (3, None), (4, " \n "), (5, "short")], "doc_id long, text string")
    own = chunks.chunk_documents(df, max_tokens=64)
    assert chunks.wrong_offsets(own, df).count() == 0
    assert {r.uncovered for r in chunks.uncovered_characters(own, df).collect()} == {0}
    assert {r.doc_id for r in own.collect()} == {1, 2, 5} and max(r.token_count for r in own.collect()) <= 64
    with pytest.raises(ValueError):
        chunks.chunk_documents(df, size=10, overlap=10)


def test_near_duplicates(spark):
    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join([*base[:200], "zz", *base[201:]])), (4, "other text here"), (5, " "), (6, None)]
    found = {r.doc_id: (r.canonical_id, r.match_type) for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), least=0.9).collect()}
    assert found == {1: (1, "none"), 2: (1, "exact_text"), 3: (1, "minhash_lsh"), 4: (4, "none")}
    a, b = near.permutations()
    x = [zlib.crc32(s.encode()) for s in near.shingles("a b c d e")]
    plain = [min((int(p) * y + int(q)) % near.MODULUS for y in x) for p, q in zip(a, b, strict=True)]
    assert near.signature(np.array(x, np.int64), a, b).tolist() == plain


def test_evaluation_order_and_versions(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "e"), ("f", "g"), ("g", "f"), ("c", "b"), (None, "a")], "node string, needs string")
    found = {r.node: (r.tier, r.state) for r in registry.evaluation_order(edges, nodes, nodes.filter("node = 'a'")).collect()}
    assert found["c"] == (2, "COMPUTED") and found["e"] == (0, "MISSING") and {found[x] for x in "dfg"} == {(None, "BLOCKED")}
    rows = spark.createDataFrame([("k", 1), ("k", 5), ("k", None), (None, 5)], "key string, t int")
    versions = spark.createDataFrame([("k", 2, "v1"), ("k", 5, "v2"), ("k", 5, "v3"), ("z", 1, "v4")], "key string, s int, v string")
    assert [(r.key, r.t, r.version_value) for r in registry.as_of(rows, versions, "key", "t", "s", "v").orderBy("key", "t").collect()] == [(None, 5, None), ("k", None, None), ("k", 1, None), ("k", 5, "v3")]


def test_measures_without_rows(spark):
    none = spark.createDataFrame([], "confidence double, outcome double, unanswerable boolean, refused boolean, correct boolean")
    assert quality.calibration_error(none, 5).first().asDict() == {"n": 0, "ece": 0.0, "mce": 0.0}
    assert [r.calibrated for r in quality.fit_calibrator(none, 4).orderBy("bin").collect()] == [0.125, 0.375, 0.625, 0.875]
    assert quality.abstention(none).first().asDict() == {"refusal_precision": 1.0, "selective_accuracy": 1.0, "false_rejection": 0.0, "passed": True}
    same = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "k int, v double")
    floor = quality.noise_floor(same, same, "k", "v", iterations=20).first()
    assert floor.n == 30 and floor.delta == 0.0 and floor.half_width == 0.0


def test_prerequisites_with_very_many_ways(spark, tmp_path):
    keys = {2**i * 3**j: (i, j) for i in range(13) for j in range(13)}
    spark.createDataFrame([(k,) for k in (0, *keys)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    found = {r.node: (r.tier, r.prerequisites) for r in analytics.formula_tiers(spark, str(tmp_path)).collect()}
    assert found == {k: (i + j, (i + 1) * (j + 1) - 1) for k, (i, j) in keys.items() if k > 1}


def test_prerequisites_by_hand(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "d"), ("b", "c"), ("c", "d"), ("x", None), (None, "x")], "node string, input string")
    assert {r.node: (r.tier, r.prerequisites) for r in registry.prerequisites(edges).collect()} == {"a": (3, 3), "b": (2, 2), "c": (1, 1)}
    assert registry.prerequisites(edges.limit(0)).count() == 0
    with pytest.raises(ValueError, match="itself"):
        registry.prerequisites(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "node string, input string"))


def test_pairs_of_a_large_domain_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(registry, "PAIRED_TOGETHER", 10)
    monkeypatch.setattr(registry, "PAIRS_A_TASK", 500)
    rows = [(i, "hot" if i % 4 else f"d{i % 8}", i % 3) for i in range(120)] + [(None, "hot", 1), (500, None, 1), (501, "alone", 1)]
    clauses = spark.createDataFrame(rows, "id long, domain string, x int")
    found = registry.clause_pairs(clauses, "id", "domain")
    want = [(d, a, x, b, y) for a, d, x in rows for b, e, y in rows if a is not None and b is not None and d is not None and d == e and a < b]
    assert sorted(tuple(r) for r in found.select("domain", "id_a", "x_a", "id_b", "x_b").collect()) == sorted(want)
    shares = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) > 8 and max(r["count"] for r in shares) < len(want) / 3
    assert registry.clause_pairs(clauses.limit(0), "id", "domain").count() == 0
