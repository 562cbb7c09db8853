"""The Merkle manifest against a plain version, on nulls, repeated rows, one leaf and no rows."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    i, text, lang, source, n = row[:5]
    values = (i, source, lang, None if n is None else n + add, text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([digest(*found[-1][i : i + 2]) for i in range(0, len(found[-1]), 2)])
    return found


def proof(tree, i):
    for level in tree[:-1]:
        yield (i ^ 1) < i, level[i ^ 1] if i ^ 1 < len(level) else ""
        i //= 2


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    held = {x: sorted(by[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: levels([leaf(r) for r in held[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    found = []
    for k, x in enumerate(langs):
        for i, r in enumerate(held[x]):
            path = [*proof(trees[x], i), *proof(top, k)]
            node = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for left, other in path:
                node = digest(other, node) if left else digest(node, other)
            found.append((r[0], trees[x][0][i], trees[x][-1][0], top[-1][0], digest(*(o for _, o in path)), node, node == top[-1][0]))
    return sorted(found, key=str)


def awkward():
    rng = random.Random(3)
    rows = [(i if i % 50 else None, f"é {i}" if i % 7 else None, rng.choice(["en"] * 6 + ["de", None, "é", "", f"z{i % 5}"]), "s" if i % 3 else None, i if i % 5 else None, "x", "x") for i in range(700)]
    return rows + [(7, "same", "en", "s", 1, "x", "x")] * 30 + [(3, "long " * 20000, "en", "s", 2**63 - 1, "x", "x")]


@pytest.mark.parametrize("step", [2, 5, 8])
def test_equals_plain_version(spark, step):
    rows = awkward()
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), step)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_one_leaf_and_none(spark):
    for rows in ([(1, None, None, None, None, "x", "x")], []):
        assert [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()] == plain(rows)


def test_tampering_is_found(spark):
    found = merkle.manifest(spark.createDataFrame(awkward(), SCHEMA)).collect()
    assert {r.verified for r in found} == {True, False} and len({r.root for r in found}) == 1


def test_places_over_partition_borders():
    a, b, c = ("a", 4), ("b", 3), ("b", 9)
    places, trees, largest = merkle._places([(2, 9, c, c, 1, 0), (0, 7, a, b, 2, 0), (5, 6, ("b", 1), ("d", 2), 3, 3)])
    assert places == {0: (0, 0, 4, 13), 2: (1, 3, 13, 13), 5: (1, 12, 13, 2)} and (trees, largest) == (4, 13)


def test_incomplete_vertex_is_refused():
    with pytest.raises(ValueError):
        merkle._complete(3, 0, 4, 8)
