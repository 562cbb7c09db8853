"""Dictionary hits, entities and references against plain versions, on nulls, ties, repeated rows and empty tables."""

import random
import re

import pytest

from tidemark.operators import dictionary

TEXTS = "id long, text string, phrase string"
PHRASES = "entity_id long, phrase string, confidence double"


def plain_hits(text, names, overlaps):
    words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[\w-]+", text or "")]
    hits = []
    for i in range(len(words)):
        for n in range(1, 7):
            run = words[i : i + n]
            if len(run) == n and " ".join(w for *_, w in run) in names:
                hits.append((run[0][0], run[-1][1], " ".join(w for *_, w in run)))
    if overlaps == "all":
        return hits
    kept = []
    while hits:
        best = min(hits, key=lambda h: (h[0], -h[1]))
        kept.append(best)
        hits = [h for h in hits if h[0] >= best[1]]
    return kept


@pytest.mark.parametrize("overlaps", ["longest", "all"])
@pytest.mark.parametrize("most", [0, 1000])
def test_hits_equal_plain_ones(spark, overlaps, most):
    rng = random.Random(2)
    vocabulary = ["Ab", "b", "é-x", "c1", "漢字", "d_e"]
    texts = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "  (", ". "]) for _ in range(rng.randrange(30)))) for i in range(60)]
    texts += [(1, "Ab b Ab b"), (1, "Ab b Ab b"), (None, "ab"), (7, None), (8, ""), (9, "b " * 20_000)]
    phrases = [(5, "AB  b", 0.9), (4, "ab b", 0.9), (6, "ab b c1", 0.5), (7, "b", 0.2), (8, "c1 d_e", None), (9, "漢字 é-x", 1.0), (10, None, 1.0), (None, "c1", 1.0), (11, " ", 1.0), (12, "b b b b b b b", 1.0), (13, "B ab", 0.3)]
    names = {"ab b": 4, "ab b c1": 6, "b": 7, "c1 d_e": 8, "漢字 é-x": 9, "b ab": 13}
    found = dictionary.phrase_hits(spark.createDataFrame([(*t, "clash") for t in texts], TEXTS).drop("phrase"), spark.createDataFrame(phrases, PHRASES), overlaps=overlaps, most_in_trie=most)
    got = sorted((str(r.id), r.char_start, r.char_end, r.phrase, r.entity_id) for r in found.collect())
    assert got == sorted((str(i), s, e, p, names[p]) for i, t in texts for s, e, p in plain_hits(t, names, overlaps)) and got


def test_nothing_to_find(spark):
    none, texts = spark.createDataFrame([], PHRASES), spark.createDataFrame([(1, "a b", "")], TEXTS).drop("phrase")
    assert dictionary.phrase_hits(texts, none).count() == 0
    assert dictionary.phrase_hits(texts.limit(0), spark.createDataFrame([(1, "a", 1.0)], PHRASES)).count() == 0
    with pytest.raises(ValueError):
        dictionary.phrase_hits(texts, none, overlaps="some")


def test_entities_take_their_best_phrase(spark):
    hits = spark.createDataFrame([(1, 5, 0.5, 9), (1, 5, 0.9, 30), (1, 6, 0.1, 0), (None, 5, 0.9, 2)], "id long, entity_id long, confidence double, char_start int")
    got = {(r.id, r.entity_id): (r.confidence, r.mentions, r.first_start) for r in dictionary.linked_entities(hits, "id", least=0.2).collect()}
    assert got == {(1, 5): (0.9, 2, 9), (None, 5): (0.9, 1, 2)}


def test_descendants_in_a_cycle(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("x", "y"), ("d", "b"), (None, "a"), ("e", None)], "entity_id string, parent_id string")
    assert {r.entity_id for r in dictionary.descendants(edges.filter("entity_id is not null"), "a").collect()} == {"a", "b", "c", "d"}
    assert [r.entity_id for r in dictionary.descendants(edges.limit(0), "a").collect()] == ["a"]


def test_references_and_targets(spark):
    tail = " and further text that goes on until the letter has its hundred characters or somewhat more than that."
    rows = [
        (1, "See RBI/2024-25/111, rbi/2024-25/111; DOR.STR.REC.5/21.04.048/2024-25." + tail),
        (2, "As per DBOD.No.BP.BC 12/08 dated 3 May and Master Direction - KYC/2016.1" + tail),
        (3, "RBI/2024-25/111 but short"), (4, None), (5, "CIR/IMD/9, FEMA.1" + tail), (None, "SEBI/HO/A/1" + tail),
    ]
    found = dictionary.references(spark.createDataFrame(rows, "id long, text string"), "id")
    text = dict(rows)
    assert all(r.reference in text[r.id][r.char_start : r.char_end] for r in found.collect())
    manifest = [(3, "RBI/2024-25/111", "late"), (1, "rbi/2024-25/111", "early"), (2, "STR.REC.5", "part"), (9, "x CIR/IMD/9 y", "whole"), (0, "", "none"), (8, "R", "letter")]
    got = {(r.id, r.reference): r.target for r in dictionary.resolved(found, spark.createDataFrame(manifest, "place int, name string, target string")).collect()}
    assert got[1, "RBI/2024-25/111"] == got[1, "rbi/2024-25/111"] == "late" and got[1, "DOR.STR.REC.5/21.04.048/2024-25"] == "part"
    assert got[5, "CIR/IMD/9"] == "letter" and got[5, "FEMA.1"] is None and got[None, "SEBI/HO/A/1"] is None and got[2, "KYC/2016.1"] is None
    assert (2, "DBOD.No.BP.BC 12/08") in got and not [k for k in got if k[0] in (3, 4)]
    empty = dictionary.resolved(found, spark.createDataFrame([], "place int, name string, target string"))
    assert {r.target for r in empty.collect()} == {None}


def test_containments_equal_all_pairs(spark):
    rng = random.Random(4)
    words = lambda n, size: sorted({"RBI/20" + "".join(rng.choice("abc") for _ in range(rng.randrange(size))) for _ in range(n)})
    inner, outer = [*words(30, 4), "b", "20a"], words(60, 9)
    found = dictionary.containments(spark.createDataFrame([(x,) for x in inner], "inner string"), spark.createDataFrame([(x,) for x in outer], "outer string"))
    assert sorted(map(tuple, found.collect())) == sorted((a, b) for a in inner for b in outer if a in b)


def test_containments_of_names_that_begin_alike(spark):
    """What is compared grows with the names' length, not with how many share any five characters."""
    inner, outer = {f"RBI/2024-25/{i}" for i in range(0, 6000, 5)}, {f"RBI/2024-25/{i}" for i in range(6000)}
    a, b = spark.createDataFrame([(x,) for x in inner], "inner string"), spark.createDataFrame([(x,) for x in outer], "outer string")
    assert dictionary._like_inner(b, "outer", a).count() <= 4 * len(outer)
    assert {tuple(r) for r in dictionary.containments(a, b).collect()} == {(y[:n], y) for y in outer for n in range(13, 17) if y[:n] in inner and n <= len(y)}
    assert dictionary.containments(a.limit(0), b).count() == dictionary.containments(a, b.limit(0)).count() == 0


def test_references_where_they_may_begin():
    rng = random.Random(8)
    bits = ["RBI/2024-25/12", "rbi/2020-21/7", "DOR.", "dor.a", "vendor.", "DBOD.No.12(a) dated", "FIDD.CO.Plan.No.4/5 January", "FMD.No.7 \n", "SEBI/", "CIR/x", "HO/(12)AB/c", "Master", "Direction", "-", "–", ": ", "A.1/2", "ſebi/x", "maſter", "İ", "₹", "\n", ".", "/", "No."]
    for _ in range(3000):
        text = "".join(rng.choice(bits) + rng.choice([" ", "", "  "]) for _ in range(rng.randrange(2, 14)))
        low = None if dictionary._ODD.search(text) else text.lower()
        for pattern, (beginnings, inside) in zip(dictionary.REFERENCES, dictionary.BEGINNINGS, strict=True):
            form = re.compile(pattern, re.IGNORECASE)
            found = [m.span() for m in dictionary._matches(form, beginnings, text, low)]
            assert found == [m.span() for m in form.finditer(text)] and not (found and low is not None and inside not in low)
