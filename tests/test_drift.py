"""Hashed vectors and drift against plain versions; equal texts, ties, nulls and no rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.operators import drift

SCHEMA = "term string, at int, doc_id int, text string"


def plain_vector(text):
    found = Counter()
    for w in re.findall(r"\b[a-zA-Z0-9_-]+\b", text.strip().lower()):
        found[zlib.crc32(w.encode()) % 384] += 1.0
        for i in range(len(w) - 2):
            found[zlib.crc32(w[i : i + 3].encode()) % 384] += 0.5
    norm = sum(v * v for v in found.values()) ** 0.5
    return [found[i] / norm if norm else float(i == 0) for i in range(384)]


def test_vectors():
    for text in ("Critical IT systems of a bank", "", " .. ", "a b-c x_1 漢字"):
        assert drift.hashed_vector(text) == pytest.approx(plain_vector(text), abs=1e-6)


def test_signed_sketch_keeps_inner_products():
    rng = random.Random(1)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('klmnp')}{i}" for i in range(400)]
    off = []
    for _ in range(60):
        shared = rng.sample(words, 20)
        a, b = (" ".join(shared + rng.sample(words, 20)) for _ in range(2))
        exact = []
        for t in (a, b):
            c = Counter()
            for w in t.split():
                c[w] += 1.0
                for i in range(len(w) - 2):
                    c[w[i : i + 3]] += 0.5
            exact.append(c)
        x, y = exact
        cosine = sum(x[k] * y[k] for k in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        off.append(float(drift.hashed_vector(a, signed=True) @ drift.hashed_vector(b, signed=True)) - cosine)
    # standard error of a count sketch of unit vectors: about 1 / sqrt(384)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 1.5 / 384**0.5


def test_drift(spark):
    rows = [("Term A", 1, 1, "a bank must report"), ("term a ", 3, 1, "a lender shall disclose quarterly lender"), ("TERM A", 2, 5, "between"), ("b", 1, 1, "same "), ("b", 2, 1, " same"), ("c", 1, 1, "alone")]
    rows += [("d", 1, 2, "later id"), ("d", 1, 1, "first id"), ("d", 1, 1, "a lesser text"), (None, 1, 1, "x"), ("e", None, 1, "x"), ("e", 1, 1, None), ("f", 1, 1, ""), ("f", 2, 1, "filled now")]
    found = {r.term: r for r in drift.drift(spark.createDataFrame(rows, SCHEMA), alert=0.3).collect()}
    assert set(found) == {"term a", "b", "c", "d", "f"}
    a = found["term a"]
    assert a.versions == 3 and a.drifted and a.new_words == ["lender", "shall", "disclose", "quarterly"]
    assert a.distance == round(1 - float(np.dot(plain_vector(rows[0][3]), plain_vector(rows[1][3]))), 4)
    assert all((found[t].distance, found[t].new_words, found[t].drifted) == (0.0, [], False) for t in "bc")
    assert found["d"].new_words == ["later"] and found["f"].new_words == ["filled"]
    assert drift.drift(spark.createDataFrame([], SCHEMA)).count() == 0
