"""A Merkle manifest of a dataset: leaf digests, subroots by language, one root,
and for every leaf a proof that is checked by folding it up again.

The trees are built by Pregel-style supersteps over RDDs. A vertex is a run of
``2 ** levels`` nodes of one tree level. Children message their digest to their
parent vertex; a parent is complete once all children that its tree has there
have reported; it then hashes the levels that lie in its run and forwards the
result. The reverse supersteps hand each vertex the siblings above it, it adds
its own levels and messages its children, down to the leaves, which fold their
proof. Each upward superstep's vertices are a table in the shared folder, so a
lost executor costs a part of one superstep.

The driver holds a few numbers a partition (how many rows, where its first and
last language begin), never digests or languages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Tree levels that one superstep climbs: a vertex holds 256 nodes.
LEVELS = 8
#: Vertices that one task holds.
PER_TASK = 4096
#: The tree over the subroots.
TOP = -1

VERTEX = "tree long, block long, size long, ids binary, nulls binary, nodes binary, tampered binary, heights binary, top binary"
OUTPUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(col: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(n_chars: Column) -> Column:
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang")), field(n_chars), field(F.col("text"))), 256)


def is_tampered() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))


def hash_level(nodes: list[str]) -> list[str]:
    """The parents of a level's nodes: the digest of each two, or of a last one alone."""
    return [hashlib.sha256((nodes[i] + nodes[i + 1] if i + 1 < len(nodes) else nodes[i]).encode()).hexdigest() for i in range(0, len(nodes), 2)]


def levels_of(size: int, levels: int) -> int:
    """How many levels a vertex climbs: all that are left of a tree of ``size`` nodes, ``levels`` at most."""
    return min(levels, max(0, size - 1).bit_length())


def climb(nodes: list[str], size: int, levels: int) -> list[list[str]]:
    """A vertex's nodes and the levels above them, to its single top node."""
    found = [nodes]
    for _ in range(levels_of(size, levels)):
        found.append(hash_level(found[-1]))
    return found


def siblings(tree: list[list[str]], i: int) -> list[tuple[bool, str]]:
    """Per level with a sibling or a lone node: (the sibling stands left, its digest or nothing)."""
    found = []
    for level in tree[:-1]:
        j = i ^ 1
        found.append((j < i, level[j] if j < len(level) else ""))
        i >>= 1
    return found


def fold(node: str, path: Iterable[tuple[bool, str]]) -> str:
    for left, other in path:
        node = hashlib.sha256((other + node if left else node + other).encode()).hexdigest()
    return node


def _hex(raw: bytes) -> list[str]:
    text = bytes(raw).hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _runs(rows: Iterable) -> Iterator[tuple[object, int]]:
    """(language, number of rows) of neighbouring rows."""
    last, n = None, 0
    for row in rows:
        if n and row.lang != last:
            yield last, n
            n = 0
        last, n = row.lang, n + 1
    if n:
        yield last, n


def _summary(index: int, rows: Iterable) -> Iterator[tuple]:
    """What the driver learns of a partition: its rows, first and last run, how many runs, and the longest between them."""
    first = last = None
    runs = longest = n = 0
    for run in _runs(rows):
        if first is None:
            first = run
        elif runs > 1:
            longest = max(longest, last[1])
        last, runs, n = run, runs + 1, n + run[1]
    if first is not None:
        yield index, n, first, last, runs, longest


def _places(summaries: list[tuple]) -> tuple[dict, int, int]:
    """Per partition: (tree and place of its first row, sizes of its first and last tree); the number of trees and the largest."""
    at, totals, largest = {}, {}, 0
    tree, lang, held = -1, None, 0
    for index, _, first, last, runs, longest in sorted(summaries, key=lambda s: s[0]):
        if tree < 0 or first[0] != lang:
            tree, held = tree + 1, 0
        at[index] = (tree, held, tree + runs - 1)
        totals[tree] = totals.get(tree, 0) + first[1]
        if runs > 1:
            totals[tree + runs - 1] = last[1]
        held = held + first[1] if runs == 1 else last[1]
        tree, lang, largest = tree + runs - 1, last[0], max(largest, longest)
    return {i: (t, p, totals[t], totals[z]) for i, (t, p, z) in at.items()}, tree + 1, max([largest, *totals.values()])


def _leaf_chunks(places: dict, levels: int):
    """Neighbouring leaves of a vertex as one message: ((tree, block), (place, size, ids, nulls, leaves, tampered))."""

    def cut(index: int, rows: Iterable) -> Iterator[tuple]:
        if index not in places:
            return
        tree, place, first_size, last_size = places[index]
        done, waiting, lang, n, at = [], [], None, 0, place
        own_size = first_size
        for row in rows:
            if n and row.lang != lang:
                done.append(((tree, at - len(waiting)), waiting))
                yield from _sized(done, own_size or at, levels)
                tree, done, waiting, at, own_size = tree + 1, [], [], 0, 0
            elif waiting and not at & (1 << levels) - 1:
                done.append(((tree, at - len(waiting)), waiting))
                waiting = []
                if own_size:
                    yield from _sized(done, own_size, levels)
                    done = []
            waiting.append((row.doc_id, bytes(row.leaf), row.tampered and bytes(row.tampered)))
            lang, n, at = row.lang, n + 1, at + 1
        done.append(((tree, at - len(waiting)), waiting))
        yield from _sized(done, last_size, levels)

    return cut


def _sized(chunks: list, size: int, levels: int) -> Iterator[tuple]:
    for (tree, first), rows in chunks:
        yield (tree, first >> levels), _packed(rows, first, size)


def _packed(rows: list, first: int, size: int) -> tuple:
    ids = np.array([r[0] or 0 for r in rows], "<i8").tobytes()
    return first, size, ids, bytes(r[0] is None for r in rows), b"".join(r[1] for r in rows), b"".join(r[2] or r[1] for r in rows)


def _complete(n: int, block: int, size: int, levels: int) -> None:
    if n != min(1 << levels, size - (block << levels)):
        raise ValueError(f"a vertex waits for children: {n} of {min(1 << levels, size - (block << levels))}")


def _tasks(sc, vertices: int) -> int:
    return max(1, min(vertices, sc.defaultParallelism), vertices // PER_TASK)


def _leaves_done(levels: int):
    def done(message: tuple) -> tuple:
        (tree, block), chunks = message
        chunks = sorted(chunks)
        size = chunks[0][1]
        ids, nulls, nodes, tampered = (b"".join(c[k] for c in chunks) for k in (2, 3, 4, 5))
        _complete(len(nulls), block, size, levels)
        return tree, block, size, ids, nulls, nodes, tampered, None, bytes.fromhex(climb(_hex(nodes), size, levels)[-1][0])

    return done


def _parents_done(levels: int):
    def done(message: tuple) -> tuple:
        (tree, block), children = message
        children = sorted(children)
        size = children[0][1]
        _complete(len(children), block, size, levels)
        nodes = b"".join(c[2] for c in children)
        heights = bytes(c[3] for c in children)
        return tree, block, size, None, None, nodes, None, heights, bytes.fromhex(climb(_hex(nodes), size, levels)[-1][0])

    return done


def _upward(vertices: DataFrame, size: int, levels: int) -> list[DataFrame]:
    """Supersteps from the lowest vertices of trees, of which the largest has ``size`` nodes: a table of vertices each."""
    steps, sc = [vertices], vertices.sparkSession.sparkContext
    count = vertices.count()
    while size > 1 << levels:
        size, count = -(-size >> levels), max(1, count >> (levels - 1))
        waiting = steps[-1].filter(F.col("size") > 1 << levels).select("tree", "block", "size", "top").rdd
        messages = waiting.map(lambda r: ((r.tree, r.block >> levels), (r.block, -(-r.size >> levels), bytes(r.top), 0)))
        done = messages.groupByKey(_tasks(sc, count)).map(_parents_done(levels))
        steps.append(materialise(vertices.sparkSession.createDataFrame(done, VERTEX, verifySchema=False), f"merkle-step{len(steps)}"))
    return steps


def _to_children(levels: int):
    """A parent's paths for its children: ((tree, block), (path, subroot, root)); of the lowest top vertices, to the trees' own tops."""

    def send(joined: tuple) -> Iterator[tuple]:
        (tree, block), (state, (path, subroot, root)) = joined
        size, nodes, heights, lowest_top = state
        own = climb(_hex(nodes), size, levels)
        for i, node in enumerate(own[0]):
            below = siblings(own, i) + path
            if lowest_top:
                yield ((block << levels) + i, 0), (heights[i], below, node, root)
            else:
                yield (tree, (block << levels) + i), (below, subroot, root)

    return send


def _to_rows(levels: int):
    """The lowest vertices fold the proofs of their leaves."""

    def rows(joined: tuple) -> Iterator[tuple]:
        _, ((size, ids, nulls, nodes, tampered), (path, subroot, root)) = joined
        own = climb(_hex(nodes), size, levels)
        above = "".join(other for _, other in path)
        held = _hex(tampered)
        for i, (doc_id, null) in enumerate(zip(np.frombuffer(ids, "<i8").tolist(), nulls, strict=True)):
            below = siblings(own, i)
            proof = hashlib.sha256(("".join(other for _, other in below) + above).encode()).hexdigest()
            folded = fold(fold(held[i], below), path)
            yield None if null else doc_id, own[0][i], subroot, root, proof, folded, folded == root

    return rows


def _downward(steps: list[DataFrame], enter: RDD, levels: int, lowest_top: bool) -> RDD:
    """Reverse supersteps: ``enter`` holds ((tree, 0), (step, path, subroot, root)) for the top vertex of each tree.

    Returns what reaches the lowest vertices, or of the top tree what its lowest vertices send to the trees.
    """
    sc = steps[0].sparkSession.sparkContext
    messages = None
    for s in range(len(steps) - 1, -1, -1):
        own = enter.filter(lambda m, s=s: m[1][0] == s).mapValues(lambda v: v[1:])
        messages = own if messages is None else messages.union(own)
        if s == 0 and not lowest_top:
            return messages
        last = s == 0
        state = steps[s].select("tree", "block", "size", "nodes", "heights").rdd.map(lambda r, last=last: ((r.tree, r.block), (r["size"], bytes(r.nodes), r.heights and bytes(r.heights), last)))
        messages = state.join(messages, _tasks(sc, steps[s].count())).flatMap(_to_children(levels))
    return messages


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text; further columns are left out).

    A leaf is the SHA-256 of its five fields. Per language leaves ascend by
    doc_id (null first), then by digest, so repeated rows and ids have a fixed
    place; parents are digests of each two nodes, or of a last one alone, and
    subroots in the order of their language (null first) lead to the root in
    the same way. ``folded_root`` folds a leaf (of every seventh row by its
    hash, one whose n_chars is one too high) with the siblings of the
    untampered tree; ``verified`` says whether that gives the root. Rows whose
    doc_id is null aren't tampered with. A dataset of one leaf has that leaf as
    its root and an empty proof; an empty one gives no rows.

    ``levels`` is the number of tree levels of a superstep; the result doesn't depend on it.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    changed = F.when(is_tampered() & F.col("n_chars").isNotNull(), F.unhex(leaf_digest(F.col("n_chars").cast("decimal(20,0)") + 1)))
    leaves = docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf_digest(F.col("n_chars"))).alias("leaf"), changed.alias("tampered"), F.monotonically_increasing_id().alias("tie"))
    order = ["lang", "doc_id", "leaf", "tie"]
    ordered = materialise(leaves, "merkle-leaves").repartitionByRange(*order).sortWithinPartitions(*order).rdd
    summaries = ordered.mapPartitionsWithIndex(_summary).collect()
    if not summaries:
        return spark.createDataFrame([], OUTPUT)
    places, trees, largest = _places(summaries)
    vertices = (sum(s[1] for s in summaries) >> levels) + trees
    messages = ordered.mapPartitionsWithIndex(_leaf_chunks(places, levels))
    lowest = messages.groupByKey(_tasks(sc, vertices)).map(_leaves_done(levels))
    steps = _upward(materialise(spark.createDataFrame(lowest, VERTEX, verifySchema=False), "merkle-step0"), largest, levels)

    subroots = None
    for s, step in enumerate(steps):
        found = step.filter(F.col("size") <= 1 << levels).select("tree", "top").rdd.map(lambda r, s=s: ((TOP, r.tree >> levels), (r.tree, trees, bytes(r.top), s)))
        subroots = found if subroots is None else subroots.union(found)
    lowest_top = subroots.groupByKey(_tasks(sc, -(-trees >> levels))).map(_parents_done(levels))
    top_steps = _upward(materialise(spark.createDataFrame(lowest_top, VERTEX, verifySchema=False), "merkle-top0"), trees, levels)

    last = len(top_steps) - 1
    root = top_steps[-1].select("top").rdd.map(lambda r: ((TOP, 0), (last, [], "", bytes(r.top).hex())))
    entering = _downward(top_steps, root, levels, True)
    paths = _downward(steps, entering, levels, False)
    state = steps[0].select("tree", "block", "size", "ids", "nulls", "nodes", "tampered").rdd
    held = state.map(lambda r: ((r.tree, r.block), (r["size"], bytes(r.ids), bytes(r.nulls), bytes(r.nodes), bytes(r.tampered))))
    rows = held.join(paths, _tasks(sc, steps[0].count())).flatMap(_to_rows(levels))
    return spark.createDataFrame(rows, OUTPUT, verifySchema=False)
