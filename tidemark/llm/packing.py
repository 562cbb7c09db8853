"""Best-fit packing of tokenised documents into sequences of a fixed length.

Hierarchical residual packing: documents are dealt into nodes by a hash, each
node packs its pieces best-fit, emits the bins that are nearly full, and hands
the underfull ones up a tree, where they are items for the next best-fit round.
A level has so many nodes that each gets about ``per_node`` items, so the work of
every task stays bounded however large the corpus is, and every underfull bin
takes part in every round.  The root emits what is left.  A round that merges
less than a twentieth of its items ends the tree too: bins that more than half
fill a sequence can't be merged by anybody, and dealing them anew gains nothing.

Defined cases: a null text is the empty text and packs its end token alone; a
null ``doc_id`` stays null; repeated rows are packed once each; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import groups_for, materialise

#: Split pattern of the byte-level vocabulary (fixed value of its tokenizer).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
ITEM = T.StructType([*PIECE_SCHEMA.fields, T.StructField("offset", T.LongType())])
BIN_SCHEMA = T.StructType(
    [
        T.StructField("node", T.LongType()),
        T.StructField("bin", T.LongType()),
        T.StructField("fill", T.LongType()),
        T.StructField("done", T.BooleanType()),
        T.StructField("items", T.ArrayType(ITEM)),
    ]
)
_ITEM_ARROW = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def encoder(vocabulary: str):
    """The tokenizer of a byte-level BPE file, one per Python worker.

    The file's vocabulary (a JSON of the ``tokenizers`` library) is loaded into
    the faster ``tiktoken`` engine: in this vocabulary an id is the rank of its
    merge, so both give the same ids (a test compares them).  The file's added
    tokens are found in a text before it is split, as ``tokenizers`` does.
    """
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, vocabulary: str, end_id: int) -> np.ndarray:
    """The ids of a text and the end id, as little-endian unsigned 32-bit integers."""
    ids = encoder(vocabulary).encode_to_numpy(text, allowed_special="all") if text else np.empty(0, "<u4")
    return np.append(ids, end_id).astype("<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; the first may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def tokenise(docs: DataFrame, *, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of each document; pieces are at most ``capacity`` ids long."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in enumerate(batch["text"]):
                ids = token_ids(text.as_py(), path, end_id)
                rows += [(i, p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(cut(len(ids), capacity))]
            at = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(at[:, 0])), pa.array(at[:, 1].astype(np.int32)), *(pa.array(at[:, k]) for k in (2, 3, 4))],
                names=PIECE_SCHEMA.names,
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE_SCHEMA)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest first, each to the fullest bin that has room.

    ``free`` has bit r set while a bin with r places left exists, so that the
    tightest fit is the lowest set bit at or above an item's size.
    """
    into = np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, bins = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := free >> size:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                free &= ~(1 << left)
        else:
            left, b = capacity, bins
            bins += 1
        into[i] = b
        if left > size:
            room[left - size].append(b)
            free |= 1 << (left - size)
    return into


def _merge(node: int, items: pa.StructArray, sizes: np.ndarray, starts: np.ndarray, capacity: int, slack: int) -> pa.Table:
    """Pack units (bins of the round before, as runs of ``items``) into new bins."""
    into = best_fit(sizes, capacity)
    order = np.argsort(into, kind="stable")
    counts = np.diff(np.append(starts, len(items)))
    units = counts[order]
    first = np.cumsum(units) - units
    take = np.repeat(starts[order] - first, units) + np.arange(units.sum())
    taken = items.take(pa.array(take))
    length = taken.field("length").to_numpy(zero_copy_only=False)
    bin_of = np.repeat(into[order], units)
    n = int(into.max()) + 1
    fill = np.bincount(into, sizes, n).astype(np.int64)
    bounds = np.searchsorted(bin_of, np.arange(n + 1))
    running = np.cumsum(length) - length
    offset = running - running[bounds[:-1]][bin_of]
    fields = [taken.field(k) for k in range(taken.type.num_fields - 1)]
    merged = pa.StructArray.from_arrays([*fields, pa.array(offset)], fields=list(_ITEM_ARROW))
    done = fill >= capacity - slack
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), merged)
    return pa.table([pa.array(np.full(n, node)), pa.array(np.arange(n)), pa.array(fill), pa.array(done), lists], names=BIN_SCHEMA.names)


def _round(capacity: int, slack: int):
    """Packs the underfull bins of several nodes as items of their parent."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        lists = group["items"].combine_chunks()
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        return _merge(key[0].as_py(), lists.flatten(), group["fill"].to_numpy(), starts, capacity, slack)

    return run


def pack(pieces: DataFrame, *, capacity: int = 2048, per_node: int = 20_000, slack: int = 4) -> DataFrame:
    """Assign every piece a ``sequence_id`` and an ``offset`` in that sequence.

    ``per_node`` items are packed together; bins with at most ``slack`` free
    places are emitted before the root.  ``pieces`` must be cheap to read twice
    (a written table).
    """
    waiting = pieces.count()
    nodes = groups_for(waiting, per_node)
    deal = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(nodes))
    names = PIECE_SCHEMA.names

    def leaf(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        flat = [group[c].combine_chunks() for c in names] + [pa.array(np.zeros(len(group), np.int64))]
        items = pa.StructArray.from_arrays(flat, fields=list(_ITEM_ARROW))
        sizes = group["length"].to_numpy()
        return _merge(key[0].as_py(), items, sizes, np.arange(len(sizes)), capacity, slack if nodes > 1 else capacity)

    bins = pieces.select(*names, deal.alias("node")).groupBy("node").applyInArrow(leaf, BIN_SCHEMA)
    level, ready, stuck = 0, [], False
    while True:
        bins = materialise(bins, f"packing-level{level}")
        number = F.shiftleft(F.lit(level).cast("long"), 58) + F.shiftleft(F.col("node"), 28) + F.col("bin")
        if nodes > 1:
            before, waiting = waiting, bins.filter("not done").count()
            stuck = level > 0 and 20 * waiting > 19 * before
        ready.append((bins if stuck else bins.filter("done")).select(number.alias("sequence_id"), "items"))
        if nodes == 1 or stuck or not waiting:
            break
        nodes, level = groups_for(waiting, per_node), level + 1
        anew = F.pmod(F.xxhash64("node", "bin", F.lit(level)), F.lit(nodes)) if nodes > 1 else F.lit(0).cast("long")
        up = bins.filter("not done").select(anew.alias("node"), "fill", "items")
        bins = up.groupBy("node").applyInArrow(_round(capacity, capacity if nodes == 1 else slack), BIN_SCHEMA)
    packed = functools.reduce(DataFrame.unionAll, ready)
    return packed.select("sequence_id", F.inline("items")).select(*names, "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, *, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None, **options) -> DataFrame:
    """Tokenise, cut and pack ``docs``; one row per piece with its place."""
    pieces = materialise(tokenise(docs, capacity=capacity, end_id=end_id, vocabulary=vocabulary), "packing-pieces")
    return pack(pieces, capacity=capacity, **options)
