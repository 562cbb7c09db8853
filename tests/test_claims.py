"""Claims, support, attribution and assignments against hand-made and plain versions; nulls, ties and empty tables."""

import itertools
import random

from tidemark.operators import claims

PASSAGES = "answer_id long, place int, passage_id string, text string"


def test_claims_of_an_answer():
    text = "According to the circular, banks must hold 9% capital [ID:1]. - short. The document states that **fees** are waived for NBFCs! Insufficient evidence for the rest of it."
    assert list(claims.claims_of(text)) == ["banks must hold 9% capital .", "fees are waived for NBFCs!"]
    long = "Every commercial bank shall report its exposure to the supervisor once a month, and small banks shall report their own exposure every quarter; tiny"
    assert list(claims.claims_of(long)) == ["Every commercial bank shall report its exposure to the supervisor once a month", "small banks shall report their own exposure every quarter"]
    assert list(claims.claims_of("  ")) == []


def test_support_of_a_claim():
    s = claims.Statement.of
    passage = s("Scheduled commercial banks shall not lend more than 9 percent to any single borrower within 30 days.")
    assert claims.support(s("lend more than 9 percent"), passage) == (1.0, "exact_substring")
    assert claims.support(s("Banks lend 12 percent to borrowers"), passage)[1] == "numerical_conflict_missing"
    assert claims.support(s("Banks may lend to any single borrower"), passage) == (0.05, "negation_polarity_inversion")
    assert claims.support(s("An NBFC is not covered"), passage)[1] == "unsupported_entity_introduced"
    assert claims.support(s("it is not to be"), passage)[1] == "token_semantic_overlap"
    found, why = claims.support(s("The borrower is not known within 30 days"), passage)
    assert why == "token_semantic_overlap" and found == 1.0
    assert claims.support(s("not less than before"), s("no"))[1] == "token_semantic_overlap"


def test_faithfulness(spark):
    answers = spark.createDataFrame([(1, "Banks hold capital always. Fees are waived for all."), (2, None), (3, "Short."), (4, "Nobody supports this claim here.")], "answer_id long, text string")
    passages = spark.createDataFrame([(1, 2, "b", "banks hold capital always. indeed"), (1, 1, "a", "Banks hold capital always."), (1, 0, "z", None), (4, 1, "c", ""), (9, 1, "x", "other")], PASSAGES)
    found = claims.supported_claims(answers, passages)
    got = {(r.answer_id, r.ordinal): (r.score, r.passage_id, r.supported) for r in found.collect()}
    assert got == {(1, 0): (1.0, "a", True), (1, 1): (0.0, None, False), (4, 0): (0.0, None, False)}
    rows = {r.answer_id: (r.score, r.total, r.supported, r.faithful) for r in claims.faithfulness(answers, found).collect()}
    assert rows == {1: (0.5, 2, 1, False), 2: (1.0, 0, 0, True), 3: (1.0, 0, 0, True), 4: (0.0, 1, 0, False)}
    assert claims.supported_claims(answers.limit(0), passages).count() == 0


def test_attribution(spark):
    rows = [
        (1, "Yes [p1].", "stop", False, None), (2, "Yes [p9].", "stop", False, None), (3, "Yes.", "end_turn", None, []), (4, None, "length", True, ["p1"]),
        (5, "No.", "stop", True, None), (6, "Yes", "completed", False, ["p1"]), (7, "Yes [p1]", "stop", False, ["p1"]), (8, "x", None, False, ["p1"]),
    ]
    answers = spark.createDataFrame(rows, "answer_id long, text string, finish_reason string, abstained boolean, citations array<string>")
    passages = spark.createDataFrame([(i, "p1", "the rule holds") for i in range(1, 8)] + [(1, "p2", None)], "answer_id long, passage_id string, text string")
    quotes = spark.createDataFrame([(1, "p1", "rule holds"), (6, "p1", "Rule"), (7, "p3", "rule"), (5, "p8", "x")], "answer_id long, passage_id string, quote string")
    found = {r.answer_id: r.state for r in claims.attribution(answers, passages, quotes).collect()}
    assert found == {1: "grounded", 2: "fabricated", 3: "uncited", 4: "truncated", 5: "abstained", 6: "misquoted", 7: "fabricated", 8: "truncated"}


def test_assignment_is_greedy_and_at_least_half(spark):
    rng = random.Random(11)
    for n in (6, 7):
        scores = [(a, b, rng.choice([1.0, 2.0, 3.0, 5.0])) for a in range(n) for b in range(n) if rng.random() < 0.6]
        df = spark.createDataFrame([*scores, (0, 99, 0.0), (None, 1, 9.0), (*scores[0][:2], 0.5)], "left long, right long, score double")
        found = sorted((r.left, r.right, r.score) for r in claims.assigned(df).collect())
        left, right, want = set(), set(), []
        for a, b, s in sorted(scores, key=lambda x: (-x[2], x[0], x[1])):
            if a not in left and b not in right:
                want.append((a, b, s))
                left.add(a)
                right.add(b)
        assert found == sorted(want)
        value = {(a, b): s for a, b, s in scores}
        largest = max(sum(value.get((a, b), 0) for a, b in enumerate(p)) for p in itertools.permutations(range(n)))
        assert 2 * sum(s for *_, s in found) >= largest
    assert claims.assigned(df.limit(0)).count() == 0
