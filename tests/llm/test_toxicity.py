"""Compression toxicity: held-out accuracy on made texts, and nulls, empty texts, copies, no labels, no rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import toxicity

SCHEMA = "doc_id long, text string, score string, predicted string, extra int"
BAD = ["vlothead", "grumbel", "snarkwit", "Doltish"]


def made(n, seed):
    """(text, toxic): invented prose, of which a third holds a few bad words, some only with endings of their own."""
    rng = random.Random(seed)
    parts = ["an", "ti", "on", "re", "es", "th", "ou", "be", "li", "ma", "ro", "ke"]
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(20, 90))]
        toxic = i % 3 == 0
        for _ in range(rng.randrange(3, 7) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "", ",", "an", "ou"]))
        yield " ".join(words), int(toxic)


@pytest.fixture(scope="module")
def model(spark):
    rows = list(made(600, 1))
    return toxicity.fit(spark.createDataFrame([*rows, *rows[:2] * 40], "text string, toxic int").repartition(3))


def test_held_out_accuracy(spark, model):
    rows = list(made(300, 2))
    docs = spark.createDataFrame([(i, t, "clash", "clash", 1) for i, (t, _) in enumerate(rows)], SCHEMA).repartition(4)
    found = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    assert len(found) == 300 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    assert sum(found[i].predicted == y for i, (_, y) in enumerate(rows)) >= 294


def test_awkward_texts(spark, model):
    long = next(t for t, y in made(3, 9) if not y) + " and on" * 200_000
    rows = [(1, None), (2, ""), (3, " .,\n"), (4, "you grumbel vlothead snarkwit"), (4, "you grumbel vlothead snarkwit"), (None, "x" * 500_000), (6, "é 漢字 \x00"), (7, long)]
    found = toxicity.classify(spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], SCHEMA), model)
    assert sorted(found.columns) == ["doc_id", "extra", "predicted", "score", "text"]
    got = [(r.doc_id, r.predicted, r.score) for r in found.collect()]
    assert [p for i, p, _ in got] == [0, 0, 0, 1, 1, 0, 0, 0]
    assert len({s for i, _, s in got if i in (1, 2, 3)}) == 1 and len({s for i, _, s in got if i == 4}) == 1
    assert toxicity.classify(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_without_labels_all_texts_score_alike(spark):
    none = spark.createDataFrame([], "text string, toxic int")
    one = spark.createDataFrame([("only one text", 1), (None, 0)], "text string, toxic int")
    docs = spark.createDataFrame([(1, "a b", "", "", 1), (2, None, "", "", 1)], SCHEMA)
    for labelled in (none, one):
        assert len({r.score for r in toxicity.classify(docs, toxicity.fit(labelled)).collect()}) == 1


def test_sample_of_labels(spark):
    rows = [(i, i % 2) for i in range(4000)] + [(None, 1), (5, None), (6, 1), (6, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    assert 300 < toxicity.sample(labels, 400).count() < 500
    kept = {r.doc_id: r.toxic for r in toxicity.sample(labels, 10**6).collect()}
    assert len(kept) == 4000 and kept[6] == 1 and kept[5] == 1
    docs = spark.createDataFrame([(i, f"t{i}", "", "", 1) for i in range(50)] + [(None, "x", "", "", 1)], SCHEMA)
    assert {r.text for r in toxicity.labelled_texts(docs, labels).collect()} == {f"t{r.doc_id}" for r in docs.filter(~toxicity.held_out(docs.doc_id) & docs.doc_id.isNotNull()).collect()}


def test_rising_chances():
    toxic, n = np.array([1, 3, 0, 0, 4, 5]), np.array([100, 10, 0, 10, 5, 5])
    found = toxicity.rising(toxic, n)
    assert (np.diff(found) >= 0).all() and found[1] == found[3] == 3.5 / 21 and found[0] == 1.5 / 101
    assert toxicity.rising(np.zeros(3, int), np.zeros(3, int)).tolist() == [0.5] * 3


def test_windows_are_whole_words():
    raw, start, length, doc, _ = toxicity._words(pa.array(["Ab-c é1", None, "d"]))
    assert [raw[s : s + n + 2] for s, n in zip(start, length, strict=True)] == [b" ab ", b" c ", " é1 ".encode(), b" d "] and doc.tolist() == [0, 0, 0, 2]
