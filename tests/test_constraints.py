"""Rules of a gold set: each is broken once, nulls and empty sets are judged."""

from tidemark.operators import constraints

ITEM = "item_id string, question string, answer_type string, difficulty string, stable boolean, canary boolean, unanswerable_reason string, source_docs array<string>, evidence_quotes array<string>, required_citation_chunk_ids array<string>, expected_answer_key_points array<string>, forbidden_strings array<string>"
GOOD = "6ba7b811-9dad-51d1-80b4-00c04fd430c8"


def item(key, **other):
    row = {"question": "Q?", "answer_type": "numeric", "difficulty": "easy", "stable": True, "canary": False, "unanswerable_reason": None, "source_docs": ["d"], "evidence_quotes": ["q"], "required_citation_chunk_ids": [GOOD], "expected_answer_key_points": ["p"], "forbidden_strings": None} | other
    return (key, *row.values())


def test_each_rule(spark):
    empty = {"source_docs": [], "evidence_quotes": None, "required_citation_chunk_ids": [], "expected_answer_key_points": []}
    rows = [item("good"), item("q", question=" "), item("t", answer_type=None), item("d", difficulty="odd"), item("s", stable=None), item("c", canary=True), item("u", answer_type="unanswerable"), item("o", **empty)]
    rows += [item("i", required_citation_chunk_ids=[GOOD, "x", None]), item("twice"), item("twice"), item(None, canary=True, forbidden_strings=["f"]), item("fine", answer_type="unanswerable", unanswerable_reason="why", **empty)]
    found = sorted((str(r.item_id), r.problem) for r in constraints.lint_goldset(spark.createDataFrame(rows, ITEM)).collect())
    assert found == sorted(
        [("q", "empty question"), ("t", "unknown answer_type"), ("d", "unknown difficulty"), ("s", "stable is not a boolean"), ("c", "no forbidden_strings"), ("u", "no unanswerable_reason"), ("i", "citation is no version-5 UUID"), ("twice", "repeated item_id"), ("None", "fewer than 120 items")]
        + [("u", f"unanswerable with {x}") for x in ("source_docs", "evidence_quotes", "required_citation_chunk_ids", "expected_answer_key_points")]
        + [("o", x) for x in ("empty source_docs", "empty evidence_quotes", "empty expected_answer_key_points", "no required_citation_chunk_ids")]
    )


def test_an_empty_set(spark):
    found = constraints.lint_goldset(spark.createDataFrame([], ITEM)).collect()
    assert [(r.item_id, r.problem) for r in found] == [(None, "fewer than 120 items"), (None, "unanswerable share below 0.1"), (None, "fewer than 1 canaries")]


def test_rules_are_judged_without_a_shuffle(spark):
    rows = spark.createDataFrame([item("a")], ITEM)
    plan = constraints.violations(rows, "item_id", constraints.goldset_rules())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
