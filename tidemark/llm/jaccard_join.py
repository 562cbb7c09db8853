"""N-gram Jaccard self-join of texts and the groups that its links make.

A text's set is its distinct word 5-grams; two texts link when the Jaccard
similarity of their sets is at least 3/4.  The join is size-aware: below a size
boundary the sets are *light* and enumerate all 2-subsets of their prefix, above
it they are *heavy* and are found by scanning inverted lists of single prefix
elements.  The boundary is where the two cost the same (`boundary`), at most 400 elements.

How the work is laid out:

* Texts with equal sets are one class, named by a 64-bit digest of the set; only
  classes are joined, so exact copies cost nothing.
* Elements have one global order, in which frequent ones come last, the most
  frequent at the very end.  In it, two
  sets that share ``k`` elements more than needed share ``k`` in their prefixes,
  whatever the order is; the order only keeps the lists short.  The frequent
  elements are counted over all texts and kept in a table of bounded size.
* Postings travel as packed arrays, a row for each (batch of texts, bucket of
  keys), so that Spark shuffles megabytes and not hundreds of millions of rows.
* How many prefix elements two heavy sets share bounds their overlap from above
  (`plausible`), so the sets themselves are fetched for few pairs only.
* Links only have to connect groups.  Each class is first compared with the
  class of its lists that is in most lists; what is linked then is one
  component, and only pairs of different components are compared further, all
  of them.  No pairs are made inside a component.

Defined cases: null, empty and blank texts have an empty set, link with nothing
and are their own component; fewer than five words make one shingle; repeated
rows are copies of each other; a null ``doc_id`` is never a component's name
unless all its members have none; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, groups_for, materialise
from tidemark.llm.words import Words, mix, slices, word_hashes, words_of_texts

SHINGLE = 5
#: Similarity from which texts link, as a fraction.
ABOVE, BELOW = 3, 4
#: An element of at least so many sets (or more, to keep the table small) comes last in the order.
FREQUENT = 32
FREQUENT_ELEMENTS = 1_000_000
#: Bits of the filter for classes whose sets are needed.
FILTER_BITS = 1 << 26
#: Elements that meet in one task.
PER_BUCKET = 500_000
#: Bytes kept of an element's hash for comparing two sets.
KEPT = 5
#: Postings are made of runs of texts of about so many bytes.
BLOCK_BYTES = 8_000_000
#: A shared list of a subset of elements counts as so many keys: it is always worth a comparison.
SUBSET = 1 << 40
_SUBSET_BIT = 1 << 31
_U = np.uint64


class Sets:
    """Distinct sets of a batch: ``values[bounds[i] : bounds[i + 1]]``, ascending."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes = values, sizes
        self.bounds = np.append(0, np.cumsum(sizes))
        self.owner = np.repeat(np.arange(len(sizes)), sizes)

    def digests(self) -> np.ndarray:
        """A 64-bit name of each set as a signed integer (of an empty set: 0)."""
        full = np.flatnonzero(self.sizes)
        out = np.zeros(len(self.sizes), np.uint64)
        if full.size:
            total = np.add.reduceat(mix(self.values ^ _U(0x5851F42D4C957F2D)), self.bounds[:-1][full])
            out[full] = mix(total + self.sizes[full].astype(np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
        return out.view(np.int64)

    def only(self, rows: np.ndarray) -> Sets:
        chosen = np.zeros(len(self.sizes), bool)
        chosen[rows] = True
        return Sets(self.values[chosen[self.owner]], self.sizes[chosen])


def _shingles(words: Words) -> Sets:
    h = word_hashes(words) if len(words.start) else np.empty(0, np.uint64)
    n = words.per_doc()
    ends = np.cumsum(n)
    starts = ends - n
    made = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    first = np.cumsum(made) - made
    owner = np.repeat(np.arange(len(n)), made)
    at = np.arange(int(made.sum())) - first[owner] + starts[owner]
    size = np.minimum(n, SHINGLE)[owner]
    acc = mix(size.astype(np.uint64))
    for j in range(SHINGLE):
        more = size > j
        step = mix(acc * _U(0xD1342543DE82EF95) + h[np.where(more, at + j, 0)]) if len(h) else acc
        acc = np.where(more, step, acc)
    for a, m in zip(first[made > 1].tolist(), made[made > 1].tolist(), strict=True):
        acc[a : a + m].sort()
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    return Sets(acc[new], np.bincount(owner[new], minlength=len(n)))


def sets_of(texts: pa.Array) -> Sets:
    """The sets of a batch of texts, by slices of bounded size."""
    parts = [_shingles(words_of_texts(part)) for _, part in slices(texts)]
    if not parts:
        return Sets(np.empty(0, np.uint64), np.empty(0, np.int64))
    return Sets(np.concatenate([p.values for p in parts]), np.concatenate([p.sizes for p in parts]))


def _classes_of(texts: pa.Array) -> tuple[Sets, np.ndarray]:
    """The different non-empty sets of a batch and their names."""
    sets = sets_of(texts)
    names, first = np.unique(sets.digests(), return_index=True)
    rows = np.sort(first[names != 0])
    different = sets.only(rows)
    return different, different.digests()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("string"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, class) of each document; an empty set has no class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_of(batch["text"])
            names = sets.digests()
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sets.sizes), pa.array(names, mask=names == 0)], names=["doc_id", "n_shingles", "class"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, class long")


def _by_bucket(buckets: np.ndarray, columns: list[np.ndarray], n: int) -> pa.RecordBatch:
    """One row per bucket that occurs: the bucket and each column's values as bytes."""
    order = np.argsort(buckets.astype(np.int16 if n < 1 << 15 else np.int64), kind="stable")
    bounds = np.searchsorted(buckets[order], np.arange(n + 1))
    there = np.flatnonzero(np.diff(bounds))
    packed = []
    for column in columns:
        data = column[order]
        packed.append(pa.array([data[bounds[b] : bounds[b + 1]].tobytes() for b in there.tolist()], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), *packed], names=["bucket", *(f"c{i}" for i in range(len(columns)))])


def _unpack(group: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(group[name].to_pylist()), kind)


class Frequent:
    """The most frequent elements (modulo ``modulus``, ascending) and the power of two in each one's count."""

    def __init__(self, elements: np.ndarray, powers: np.ndarray, modulus: int):
        order = np.argsort(elements)
        self.elements, self.powers, self.modulus = elements[order].astype(np.uint64), powers[order].astype(np.uint8), modulus

    def levels(self, v: np.ndarray) -> np.ndarray:
        """0 for an element that isn't frequent, else its power of two."""
        if not len(self.elements):
            return np.zeros(len(v), np.uint8)
        reduced = v % _U(self.modulus)
        at = np.minimum(np.searchsorted(self.elements, reduced), len(self.elements) - 1)
        return np.where(self.elements[at] == reduced, self.powers[at], 0).astype(np.uint8)


def frequent_elements(docs: DataFrame, buckets: int) -> tuple[Frequent, float]:
    """The most frequent elements, counted over all texts, and the mean length of
    the list that an occurrence of another element stands in."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch["text"], BLOCK_BYTES):
                sets, _ = _classes_of(texts)
                v = sets.values
                yield _by_bucket((v % _U(buckets)).astype(np.int64), [((v // _U(buckets)) & _U(0xFFFFFFFF)).astype(np.uint32)], buckets)

    def count(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        found = np.sort(_unpack(group, "c0", np.uint32))
        edges = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        n = np.diff(np.append(edges, len(found)))
        often = n >= FREQUENT
        ids = np.append(found[edges[often]].astype(np.int64) * buckets + key[0].as_py(), -1)
        rest = n[~often].astype(np.int64)
        return pa.table([pa.array(ids), pa.array(np.append(n[often], rest.sum())), pa.array(np.append(n[often] * 0, (rest**2).sum()))], names=["element", "n", "squares"])

    counted = materialise(
        _texts(docs).mapInArrow(spread, "bucket long, c0 binary").groupBy("bucket").applyInArrow(count, "element long, n long, squares long"),
        "jaccard-frequent",
    )
    rest = counted.filter("element < 0").agg(F.sum("n"), F.sum("squares")).first()
    often = counted.filter("element >= 0")
    steps = often.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy("power", ascending=False).collect()
    least, kept = FREQUENT, 0
    for row in steps:  # at most 64 rows
        kept += row["count"]
        if kept > FREQUENT_ELEMENTS:
            least = 2 ** (row["power"] + 1)
            break
    kept = often.filter(F.col("n") >= least).select("element", F.floor(F.log2("n")).alias("power")).toArrow()  # at most FREQUENT_ELEMENTS rows
    return Frequent(kept["element"].to_numpy(), kept["power"].to_numpy(), buckets << 32), (rest[1] or 0) / max(1, rest[0] or 0)


def prefix(size, k: int):
    """Elements of which sets that link share at least ``k``."""
    return size - -(-ABOVE * size // BELOW) + k


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The largest size of a light set: subsets up to there cost less than scanning lists.

    A light set costs its 2-subsets, and one near the boundary its list elements
    too, for the heavy sets to find it; a heavy set costs its elements and the
    entries that stand in their lists.
    """

    def cost(b: int) -> float:
        total = 0.0
        for s, n in sizes.items():
            lists = prefix(s, 1) * (1 + list_length)
            total += n * (comb(prefix(s, 2), 2) if s <= b else lists)
            total += n * prefix(s, 1) * (ABOVE * b < BELOW * s and s <= b)
        return total

    return min(range(max(sizes, default=0) + 1), key=cost)


@functools.cache
def _pairs_of(p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(p, 1)


def _keys(sets: Sets, frequent: Frequent, light: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, is it a subset's key, rank of the element) of each posting; a subset's rank is 0."""
    v, owner, sizes = sets.values, sets.owner, sets.sizes
    levels = frequent.levels(v)
    often = levels > 0
    seen = np.cumsum(often)
    start = sets.bounds[:-1]
    before = np.append(0, seen)[start][owner]
    rank_often = seen - before - 1
    n_often = (np.append(0, seen)[sets.bounds[1:]] - np.append(0, seen)[start])[owner]
    place = np.arange(len(v)) - start[owner]
    last = np.flatnonzero(often)
    ordered = last[np.lexsort((levels[last], owner[last]))]  # the rarer of them first
    rank_of = np.zeros(len(v), np.int64)
    rank_of[ordered] = rank_often[last]
    rank = np.where(often, sizes[owner] - n_often + rank_of, place - (seen - before))
    listed = ABOVE * light < BELOW * sizes
    at = np.flatnonzero(listed[owner] & (rank < prefix(sizes, 1)[owner]))
    rows, keys = [owner[at]], [v[at]]
    few = sizes <= light
    for p in np.unique(prefix(sizes[few], 2)).tolist():
        own = np.flatnonzero(few & (prefix(sizes, 2) == p) & (sizes >= 2))
        if not own.size:
            continue
        chosen = np.flatnonzero(np.isin(owner, own) & (rank < p))
        chosen = chosen[np.lexsort((rank[chosen], owner[chosen]))]
        first = np.sort(v[chosen].reshape(len(own), p), axis=1)
        i, j = _pairs_of(p)
        keys.append(mix(first[:, i] * _U(0xD1342543DE82EF95) + first[:, j]).ravel())
        rows.append(np.repeat(own, len(i)))
    row = np.concatenate(rows)
    ranks = np.zeros(len(row), np.int64)
    ranks[: len(at)] = rank[at]
    return row, np.concatenate(keys), np.arange(len(row)) >= len(at), ranks


def shared_lists(docs: DataFrame, frequent: Frequent, light: int, buckets: int) -> DataFrame:
    """(list, class, size, keys, rank): the classes that stand in one list, for lists of two or more.

    Lists of the same classes are one list of as many ``keys``, with the lowest
    rank that an element has in each set; a list of a subset of elements counts
    as ``SUBSET`` keys.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch["text"], BLOCK_BYTES):
                sets, names = _classes_of(texts)
                rows, keys, subset, ranks = _keys(sets, known.value, light)
                low = ((keys // _U(buckets)) & _U(0xFFFFFFFF)).astype(np.uint32)
                yield _by_bucket((keys % _U(buckets)).astype(np.int64), [low, names[rows], sets.sizes[rows].astype(np.uint32) | np.where(subset, _SUBSET_BIT, 0).astype(np.uint32), ranks.astype(np.uint32)], buckets)

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        low, name, size, rank = (_unpack(group, f"c{i}", kind) for i, kind in enumerate((np.uint32, np.int64, np.uint32, np.uint32)))
        order = np.argsort(low, kind="stable")
        s = low[order]
        run = np.cumsum(np.append(False, s[1:] != s[:-1]))
        more = order[np.bincount(run)[run] > 1]  # keys that occur once are most of them
        more = more[np.lexsort((name[more], low[more]))]
        low, name, size, rank = low[more], name[more], size[more], rank[more]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (name[1:] != name[:-1])
        low, name, size, rank = low[new], name[new], size[new], rank[new]
        edges = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.empty(0, np.int64)
        n = np.diff(np.append(edges, len(low)))
        subset = np.logical_or.reduceat(size >= _SUBSET_BIT, edges) if len(edges) else np.empty(0, bool)
        label = mix(np.add.reduceat(mix(name.view(np.uint64)), edges) + subset.astype(np.uint64)) if len(edges) else np.empty(0, np.uint64)
        big = np.repeat(n > 1, n)
        label, subset, name, size, rank = np.repeat(label, n)[big], np.repeat(subset, n)[big], name[big], size[big] & (_SUBSET_BIT - 1), rank[big]
        order = np.lexsort((rank, name, label))
        label, name = label[order], name[order]
        at = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (name[1:] != name[:-1]))) if len(label) else np.empty(0, np.int64)
        times = np.where(subset[order][at], SUBSET, np.diff(np.append(at, len(label))))
        columns = [label[at].view(np.int64), name[at], size[order][at].astype(np.int64), times, rank[order][at].astype(np.int64)]
        return pa.table([pa.array(c) for c in columns], names=["list", "class", "size", "keys", "rank"])

    packed = _texts(docs).mapInArrow(spread, "bucket long, c0 binary, c1 binary, c2 binary, c3 binary")
    lists = packed.groupBy("bucket").applyInArrow(meet, "list long, class long, size long, keys long, rank long")
    return lists.groupBy("list", "class").agg(F.max("size").alias("size"), F.sum("keys").alias("keys"), F.min("rank").alias("rank"))


def sets_of_classes(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class, elements, is_a, is_b) of the classes in ``pairs``; elements are packed, ascending, ``KEPT`` bytes each.

    A filter of fixed size, set from all wanted classes, keeps most other texts'
    sets from being shuffled; those that slip through are dropped by the join.
    """
    spark = docs.sparkSession
    sides = pairs.select(F.col("a").alias("class"), F.lit(True).alias("is_a")).unionAll(pairs.select("b", F.lit(False)))
    wanted = materialise(sides.groupBy("class").agg(F.bool_or("is_a").alias("is_a"), F.bool_or(~F.col("is_a")).alias("is_b")), "jaccard-wanted")
    bit = F.pmod(F.col("class"), F.lit(FILTER_BITS))
    marks = wanted.groupBy((bit / 64).cast("int").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(pmod(class, {FILTER_BITS}), 64) as int)))").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[marks["word"].to_numpy()] = marks["bits"].to_numpy()
    filled = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, names = _classes_of(batch["text"])
            at = names % FILTER_BITS
            rows = np.flatnonzero(filled.value[at >> 6] >> (at & 63) & 1)
            few = sets.only(rows)
            cut = _sorted_low(few).view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()
            packed = [cut[KEPT * a : KEPT * b] for a, b in zip(few.bounds[:-1].tolist(), few.bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names[rows]), pa.array(packed, pa.binary())], names=["class", "elements"])

    found = _texts(docs).mapInArrow(run, "class long, elements binary")
    return found.join(wanted, "class").groupBy("class", "is_a", "is_b").agg(F.first("elements").alias("elements"))


def _sorted_low(sets: Sets) -> np.ndarray:
    low = sets.values & _U((1 << 8 * KEPT) - 1)
    for a, b in zip(sets.bounds[:-1].tolist(), sets.bounds[1:].tolist(), strict=True):
        low[a:b].sort()
    return low


def _elements(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // KEPT, 8), np.uint8)
    wide[:, :KEPT] = np.frombuffer(packed, np.uint8).reshape(-1, KEPT)
    return wide.view(np.uint64).ravel()


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                p, q = _elements(x.as_py()), _elements(y.as_py())
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(BELOW * common >= ABOVE * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(sets.filter("is_b").select(F.col("class").alias("b"), F.col("elements").alias("y")), "b")
    both = one.join(sets.filter("is_a").select(F.col("class").alias("a"), F.col("elements").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches.

    Labels fall to the smallest of the neighbours' and then to the label's own
    label, so chains shorten by half in each round.
    """
    both = materialise(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "jaccard-labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "component": "other"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        low = labels.join(near, "node").select("node", F.least("component", "other").alias("to"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("to"), F.col("component").alias("top"))
        now = materialise(low.join(up, "to").select("node", F.least("to", "top").alias("component"), (F.least("to", "top") != F.col("was")).alias("moved")), "jaccard-labels")
        labels = now.select("node", "component")
        if now.filter("moved").isEmpty():
            return labels


def _with_components(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Lists with the component of each class, without lists of one component."""
    if labels is None:
        return lists.withColumn("component", F.col("class"))
    own = lists.drop("component").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    mixed = own.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("list")
    return own.join(mixed, "list", "left_semi")


def _star_pairs(lists: DataFrame) -> DataFrame:
    """Each class with a class that is in most lists: of those in its lists, the one it shares most keys with."""
    degree = lists.groupBy("class").agg(F.count("*").alias("degree"))
    ranked = lists.join(degree, "class")
    hubs = ranked.groupBy("list").agg(F.max(F.struct("degree", "class", "size", "component")).alias("hub"))
    near = ranked.join(hubs, "list").filter((F.col("hub.component") != F.col("component")) & _fits("size", "hub.size"))
    met = near.groupBy("class", "size", F.col("hub.class").alias("a"), F.col("hub.size").alias("m")).agg(F.sum("keys").alias("keys"))
    best = met.filter(plausible("size", "m")).groupBy("class").agg(F.max(F.struct("keys", "a")).alias("best"))
    return best.select("best.a", F.col("class").alias("b"))


def _fits(x: str, y: str):
    return BELOW * F.least(x, y) >= ABOVE * F.greatest(x, y)


def plausible(x: str, y: str):
    """Can sets of sizes ``x`` and ``y`` that share ``keys`` prefix elements link?

    Of the set whose prefix ends first all shared elements in the prefix are
    known, so the overlap is at most ``keys`` and the rest of that set.
    """
    rest = F.ceil(F.greatest(x, y) * (ABOVE / BELOW)) - 1
    return (ABOVE + BELOW) * (F.col("keys") + rest) >= ABOVE * (F.col(x) + F.col(y))


def _reach(own: str, other: str):
    """Ranks below this hold an element that a set of size ``own`` shares with one of size ``other`` if they link."""
    return F.col(own) - F.ceil((F.col(own) + F.col(other)) * ABOVE / (ABOVE + BELOW) - F.lit(1e-9)) + 1


def _cross_pairs(lists: DataFrame) -> DataFrame:
    """All pairs of classes of different components that can link.

    They share an element in the part of each prefix that the sizes of both
    leave, the shorter set in the first seventh.  Components meet first, by the
    bounds of their members in a list, then members; at last all the keys that a
    pair shares are counted.
    """
    bounds = [F.min("rank").alias("rank"), F.min("size").alias("least"), F.max("size").alias("most")]
    groups = lists.groupBy("list", "component").agg(*bounds)
    shorter = groups.withColumnsRenamed({"component": "other", "rank": "rank2", "least": "least2", "most": "most2"}).filter(F.col("rank2") < _reach("most2", "most2"))
    met = groups.join(shorter, "list").filter(
        (F.col("component") != F.col("other"))
        & (F.col("most") >= F.col("least2"))
        & (BELOW * F.col("most2") >= ABOVE * F.col("least"))
        & (F.col("rank") < _reach("most", "least2"))
        & (F.col("rank2") < _reach("most2", "least"))
    )
    left = lists.select("list", "component", F.col("class").alias("x"), F.col("size").alias("n"), F.col("rank").alias("i"))
    right = lists.select("list", F.col("component").alias("other"), F.col("class").alias("y"), F.col("size").alias("m"), F.col("rank").alias("j"))
    own = met.select("list", "component", "other").join(left, ["list", "component"]).join(right, ["list", "other"])
    near = own.filter((F.col("n") >= F.col("m")) & _fits("n", "m") & (F.col("i") < _reach("n", "m")) & (F.col("j") < _reach("m", "n")))
    pairs = materialise(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "jaccard-near")
    one = lists.select("list", F.col("class").alias("a"), F.col("size").alias("n"), "keys")
    two = lists.select("list", F.col("class").alias("b"), F.col("size").alias("m"))
    shared = pairs.join(one, "a").join(two, ["list", "b"]).groupBy("a", "b", "n", "m").agg(F.sum("keys").alias("keys"))
    return shared.filter(plausible("n", "m")).select("a", "b")


def similar_classes(docs: DataFrame, known: DataFrame, *, buckets: int, rounds: int = 2) -> DataFrame | None:
    """(node, component) of the classes that link with others, or None if none do."""
    frequent, list_length = frequent_elements(docs, buckets)
    sizes = known.filter("class is not null").groupBy("n_shingles").agg(F.count_distinct("class").alias("n")).filter("n_shingles <= 400").collect()  # at most 400 rows: larger sets are heavy, whatever the cost
    light = boundary({r["n_shingles"]: r["n"] for r in sizes}, list_length)
    lists = materialise(shared_lists(docs, frequent, light, buckets), "jaccard-lists")
    if lists.isEmpty():
        return None
    labels, links, tested = None, [], []
    for turn in range(rounds + 1):
        if labels is not None:
            shorter = materialise(_with_components(lists, labels), f"jaccard-lists{turn}")
            discard(lists)
            lists = shorter
            if lists.isEmpty():
                break
        own = lists if labels is not None else _with_components(lists, None)
        pairs = _star_pairs(own) if turn < rounds else _cross_pairs(own)
        for done in tested:
            pairs = pairs.join(done, ["a", "b"], "left_anti").join(done.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        pairs = materialise(pairs, f"jaccard-pairs{turn}")
        if pairs.isEmpty():
            continue
        tested.append(pairs)
        sets = materialise(sets_of_classes(docs, pairs), f"jaccard-sets{turn}")
        links.append(materialise(linked(pairs, sets), f"jaccard-links{turn}"))
        discard(sets)
        if not links[-1].isEmpty():
            labels = components(functools.reduce(DataFrame.unionAll, links))
    discard(lists)
    return labels


def buckets_for(known: DataFrame) -> int:
    """So many buckets that each holds about ``PER_BUCKET`` elements, however large the table is."""
    return groups_for(known.agg(F.sum("n_shingles")).first()[0] or 0, PER_BUCKET)


def similar_groups(docs: DataFrame, *, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document."""
    known = materialise(classes(docs), "jaccard-classes")
    labels = similar_classes(docs, known, buckets=buckets or buckets_for(known))
    named = known if labels is None else known.join(labels.withColumnRenamed("node", "class"), "class", "left")
    component = F.col("class") if labels is None else F.coalesce("component", "class")
    named = materialise(named.select("doc_id", "n_shingles", component.alias("component")), "jaccard-named")
    discard(known)
    names = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    return named.join(names, "component", "left").select("doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, with one row of each group of rows that link, directly or not.

    The row with the smallest ``doc_id`` stays (a null one comes last); of rows
    that repeat an id any one, and rows that only share an id are no group.
    """
    number = next(c for c in map("row_number_{}".format, range(len(docs.columns) + 1)) if c not in docs.columns)
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "jaccard-rows")
    groups = similar_groups(rows.select(F.col(number).alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    several = groups.groupBy("group").count().filter("count > 1").select("group")
    members = groups.join(several, "group").join(rows.select(F.col(number).alias("row"), F.col("doc_id").alias("named")), "row")
    first = members.groupBy("group").agg(F.min(F.struct(F.col("named").isNull(), "named", "row")).alias("first"))
    gone = materialise(members.join(first, "group").filter("row <> first.row").select(F.col("row").alias(number)), "jaccard-gone")
    return rows.join(gone, number, "left_anti").select(*docs.columns)
