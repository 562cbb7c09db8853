"""SentencePiece encoding and decoding by a relational lattice.

A text is escaped as SentencePiece does (a space in front, spaces as U+2581) and
cut into words at places that no piece crosses: between letters, digits and other
characters, and before U+2581 (``WORD``; a table whose pieces don't keep to that is
cut before U+2581 alone).  Each word can then be encoded by itself:

* the different words of all texts are exploded into substrings of bounded length
  (the longest piece's),
* the substrings are equi-joined to the piece table, which is fixed and small
  enough to be broadcast (``MOST_PIECES``), and
* the edges found are folded by word: a Viterbi pass over the ends of many words'
  edges at once finds the segmentation of the largest total score.

The edges of a word are made where the word is and come one behind the other, so
grouping them needs neither a shuffle nor a sort; the fold raises an error if they
don't.  A character without a piece is an edge of its bytes' pieces.  Texts are
dealt into blocks of about ``BLOCK_BYTES``; each block numbers its different words,
gets them back encoded, by number, and puts them into its texts.  So what is
shuffled is each text once (packed) and each word once for a block, not for each
place where it stands.

``docs`` is read twice and must give the same rows in the same partitions, as a
table or written files do; words that a block then lacks, or whose lengths differ,
raise an error.

Defined cases: a null text has null ids, an empty one no pieces; decoding gives
back the text that was encoded, whatever it holds (U+2581 itself comes back as
a space); ties go to the longer last piece; repeated rows are encoded alike; an
empty table gives no rows; further columns are kept; a clash with the output
column raises ValueError.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, materialise
from tidemark.llm.words import gather, slices

SPACE = "▁"
WORD = r"▁*\p{L}+|▁*[^\p{L}\p{Nd}▁]+|\p{Nd}|▁+"
_LETTER, _DIGIT, _OTHER, _SPACE = range(4)
#: Kinds of a character and the next one that stay in a word, as ``WORD`` says.
_STAYS = np.zeros((4, 4), bool)
_STAYS[[_LETTER, _OTHER, _SPACE, _SPACE, _SPACE], [_LETTER, _OTHER, _LETTER, _OTHER, _SPACE]] = True
#: Texts of about so many bytes share their words, and are cut into words together.
BLOCK_BYTES, CUT_BYTES = 12_000_000, 1_000_000
#: A block's number has room for so many bits of a word's place in it, and so many of its place in the partition.
WORD_BITS, BLOCK_BITS = 28, 14
#: Edges that are folded together.
EDGES_AT_ONCE = 200_000
#: Texts of about so many pieces are decoded together.
PIECES_AT_ONCE = 500_000
#: What a byte piece costs below the lowest score.
BYTE_PENALTY = 10.0
MOST_PIECES = 1_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Pieces:
    #: The text of each piece that stands for characters, by id.
    plain: dict[int, str]
    scores: np.ndarray
    byte_ids: np.ndarray
    byte_score: float
    #: The bytes of each piece, one behind the other.
    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    #: Of each code point whether it is a letter, a digit, something else or U+2581.
    kinds: np.ndarray


@functools.cache
def pieces_of(model: str) -> Pieces:
    """The piece table of a model file, one for each Python worker."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    if n > MOST_PIECES:
        raise ValueError(f"{n} pieces are too many to be sent to every task")
    scores = np.array([sp.get_score(i) for i in range(n)])
    plain = {i: sp.id_to_piece(i) for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))}
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    texts = [plain.get(i, "").encode() for i in range(n)]
    for b, i in enumerate(byte_ids.tolist()):
        texts[i] = bytes([b])
    length = np.array([len(t) for t in texts], np.int64)
    fine = regex.compile(WORD)
    kinds = kinds_of(all(fine.fullmatch(p) for p in plain.values()))
    return Pieces(plain, scores, byte_ids, float(scores.min()) - BYTE_PENALTY, np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length) - length, length, kinds)


def kinds_of(fine: bool) -> np.ndarray:
    """The kind of each code point; not ``fine``: U+2581 or not."""
    kinds = np.full(0x110000, _OTHER, np.uint8)
    if fine:
        points = "".join(map(chr, range(0x110000)))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{Nd}+")):
            for found in regex.finditer(pattern, points):
                kinds[found.start() : found.end()] = kind
    kinds[ord(SPACE)] = _SPACE
    return kinds


def _utf8_length(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)


def words_of(texts: pa.Array, kinds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one behind the other, and how many each text has."""
    escaped = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts.to_pylist()]
    whole = "".join(escaped)
    bounds = np.cumsum([0, *map(len, escaped)])
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kind = kinds[codes]
    cut = np.ones(len(codes) + 1, bool)
    cut[1:-1] = ~_STAYS[kind[:-1], kind[1:]]
    cut[bounds] = True
    start = np.flatnonzero(cut)
    at = np.append(0, np.cumsum(_utf8_length(codes)))[start].astype(np.int32)
    words = pa.StringArray.from_buffers(len(start) - 1, pa.py_buffer(at), pa.py_buffer(whole.encode()))
    return words, np.diff(np.searchsorted(start, bounds))


def _blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows): the rows of this task in their order, about BLOCK_BYTES of text to a block, whatever the batches."""
    first, done = TaskContext.get().partitionId() << BLOCK_BITS, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = done + np.cumsum(sizes) - sizes
        done += int(sizes.sum())
        cuts = np.flatnonzero(np.diff(before // CUT_BYTES, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(batch)], strict=True):
            yield first + int(before[a]) // BLOCK_BYTES, batch.slice(a, b - a)


def words_of_blocks(docs: DataFrame, text: str, model: str) -> DataFrame:
    """(code, word): the different words of each block, in the order in which they come up; a code is block and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pieces_of(model).kinds
        for block, runs in groupby(_blocks(batches, text), itemgetter(0)):
            found = pa.chunked_array([words_of(rows[text], kinds)[0].unique() for _, rows in runs], pa.string()).unique()
            yield pa.RecordBatch.from_arrays([pa.array((block << WORD_BITS) + np.arange(len(found))), found], names=["code", "word"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "code long, word string")


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """(piece, id, score) of the pieces that stand for characters."""
    pieces = pieces_of(model)
    return spark.createDataFrame([(p, i, float(pieces.scores[i])) for i, p in pieces.plain.items()], "piece string, id int, score double")


def lattice(words: DataFrame, model: str) -> DataFrame:
    """(word, codes, start, size, id): the edges of each ``word``; ``id`` -1 stands for the bytes of a character.

    A word and its ``codes`` stand with its first edge only.
    """
    longest = max(map(len, pieces_of(model).plain.values()))
    at = words.select("word", "codes", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    begins = F.col("start") == 0
    rest = F.substring("word", F.col("start") + 1, F.lit(longest)).alias("rest")
    at = at.select(F.when(begins, F.col("word")).alias("word"), F.when(begins, F.col("codes")).alias("codes"), "start", rest)
    cut = at.select("*", F.explode(F.sequence(F.lit(1), F.length("rest"))).alias("size"))
    parts = cut.withColumn("piece", F.substring("rest", F.lit(1), F.col("size")))
    joined = parts.join(F.broadcast(piece_table(words.sparkSession, model)), "piece", "left").filter("id is not null or size = 1")
    one = F.col("size") == 1
    return joined.select(F.when(one, F.col("word")).alias("word"), F.when(one, F.col("codes")).alias("codes"), "start", "size", F.coalesce("id", F.lit(-1)).alias("id"))


def _best(first: np.ndarray, end: np.ndarray, back: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Of each place the last edge of the best way to it, or -1.

    Words lie one behind the other, ``first`` is where an edge's word begins; its
    ``end`` (1 at least) and ``back`` (its length) are within the word.
    """
    place = first + end
    order = np.lexsort((-back, place, end))
    at, reach = place[order], np.zeros(int(place.max()) + 1)
    chosen = np.full(len(reach), -1, np.int64)
    from_, gain = at - back[order], score[order]
    levels = np.flatnonzero(np.diff(end[order], prepend=-1))
    for a, b in zip(levels.tolist(), [*levels[1:].tolist(), len(order)], strict=True):
        way = reach[from_[a:b]] + gain[a:b]
        heads = np.flatnonzero(np.diff(at[a:b], prepend=-1))
        most = np.maximum.reduceat(way, heads)
        best = np.flatnonzero(way == np.repeat(most, np.diff(np.append(heads, b - a))))[::-1]
        reach[at[a:b][heads]] = most
        chosen[at[a:b][best]] = order[a:b][best]  # the longest of equal ones is written last
    return chosen


def fold(edges: pa.Table, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many each word has): the best segmentation of each word of a table of whole words' edges."""
    column = {c: edges[c].to_numpy().astype(np.int64) for c in ("start", "size", "id")}
    start, size, ids = column.values()
    word = np.cumsum(np.array(edges["word"].is_valid())) - 1
    texts = edges["word"].drop_null().to_pylist()
    length = np.array([len(t) for t in texts], np.int64)
    if word[0] or (start + size > length[word]).any() or (np.bincount(word, size == 1, len(texts)) != length).any():
        raise ValueError("the edges of a word don't lie one behind the other")
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    first = np.cumsum(length + 1) - (length + 1)  # a place before each character and one at the end
    code = codes[(np.cumsum(length) - length)[word] + start]
    score = np.where(ids >= 0, pieces.scores[ids], pieces.byte_score * _utf8_length(code))
    chosen = _best(first[word], start + size, size, score)
    own, at, path = np.arange(len(texts)), first + length, []
    while len(own):
        path.append(chosen[at])
        at = at - size[path[-1]]
        left = at > first[own]
        own, at = own[left], at[left]
    path = np.concatenate(path)[::-1]
    path = path[np.lexsort((start[path], word[path]))]
    spelled = ids[path] < 0
    n = np.where(spelled, _utf8_length(code[path]), 1)
    found = np.repeat(ids[path], n)
    data = "".join(map(chr, code[path[spelled]].tolist())).encode()
    found[np.repeat(spelled, n)] = pieces.byte_ids[np.frombuffer(data, np.uint8)]
    return found.astype(np.int32), np.bincount(word[path], n, len(texts)).astype(np.int64)


def encode_words(words: DataFrame, model: str) -> DataFrame:
    """(block, place, n, ids): packed arrays of places of words in a block, of how many pieces they have, and of those."""
    kind = np.uint16 if len(pieces_of(model).scores) <= 1 << 16 else np.uint32

    def encoded(edges: pa.Table) -> pa.RecordBatch:
        ids, n = fold(edges, pieces_of(model))
        lists = edges["codes"].filter(edges["word"].is_valid()).combine_chunks()
        codes = lists.flatten().to_numpy()
        order = np.argsort(codes)
        codes, of = codes[order], np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[order]
        flat = gather(ids, (np.cumsum(n) - n)[of], n[of]).astype(kind)
        block, heads = np.unique(codes >> WORD_BITS, return_index=True)
        ends = np.append(0, np.cumsum(n[of]))
        columns = [(codes & ((1 << WORD_BITS) - 1)).astype(np.uint32), n[of].astype(np.uint32)]
        heads = np.append(heads, len(codes)).tolist()
        cuts = [[c[a:b].tobytes() for a, b in pairwise(heads)] for c in columns] + [[flat[ends[a] : ends[b]].tobytes() for a, b in pairwise(heads)]]
        return pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(c, pa.binary()) for c in cuts)], names=["block", "place", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            heads = np.flatnonzero(np.array(batch["word"].is_valid()))
            if held and len(heads) and rows >= EDGES_AT_ONCE:
                yield encoded(pa.Table.from_batches([*held, batch.slice(0, heads[-1])]))
                held, rows, batch = [], 0, batch.slice(heads[-1])
            held.append(batch)
            rows += len(batch)
        if rows:
            yield encoded(pa.Table.from_batches(held))

    return lattice(words, model).mapInArrow(run, "block long, place binary, n binary, ids binary")


def _words_back(words: pa.Table, different: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first, n): the ids of a block's words, and where those of each of its ``different`` words lie."""
    kind = np.uint16 if len(pieces.scores) <= 1 << 16 else np.uint32
    place, n, ids = (np.frombuffer(b"".join(words[c].to_pylist()), k) for c, k in (("place", np.uint32), ("n", np.uint32), ("ids", kind)))
    n, order = n.astype(np.int64), np.argsort(place)
    first = (np.cumsum(n) - n)[order]
    bytes_of = np.bincount(np.repeat(place, n), pieces.length[ids], len(different)).astype(np.int64)
    if not np.array_equal(place[order], np.arange(len(different))) or not np.array_equal(bytes_of, pc.binary_length(different).to_numpy()):
        raise ValueError("a block has other words than before; its texts must be the same when they are read again")
    return ids.astype(np.int32), first, n[order]


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input already has a column {name}")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, *, text: str = "text", ids: str = "ids", model: str | None = None) -> DataFrame:
    """Add the piece ids of a column of texts."""
    path = model or default_model()
    schema = _with(docs, ids, T.ArrayType(T.IntegerType()))
    needed = materialise(words_of_blocks(docs, text, path), "pieces-words")
    words = needed.groupBy("word").agg(F.collect_list("code").alias("codes"))
    known = materialise(encode_words(words, path), "pieces-known")
    discard(needed)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for part, (number, rows) in enumerate(_blocks(batches, text)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                writer.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "part", "rows"])

    def put(key: tuple[pa.Scalar, ...], packed: pa.Table, words: pa.Table) -> pa.Table:
        pieces = pieces_of(path)
        parts = [pa.ipc.open_stream(p).read_all() for p in packed.sort_by("part")["rows"].to_pylist()]
        rows = pa.concat_tables(parts).combine_chunks()
        texts = rows[text].cast(pa.string())
        cut = [words_of(part, pieces.kinds) for chunk in texts.chunks for _, part in slices(chunk, CUT_BYTES)]
        per_text = np.concatenate([n for _, n in cut])
        tokens = pa.chunked_array([w for w, _ in cut], pa.string())
        different = tokens.unique()
        flat, first, n = _words_back(words, different, pieces)
        found, sizes = [np.empty(0, np.int32)], []
        for chunk in tokens.chunks:
            own = pc.index_in(chunk, value_set=different).to_numpy()
            found.append(gather(flat, first[own], n[own]))
            sizes.append(n[own])
        sizes = np.bincount(np.repeat(np.arange(len(rows)), per_text), np.concatenate(sizes), len(rows))
        bounds = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        null = pa.array(np.array(texts.is_null()))
        return rows.append_column(ids, pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(found)), mask=null))

    packed = docs.mapInArrow(dealt, "block long, part long, rows binary")
    return packed.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(put, schema)


def decode(df: DataFrame, *, ids: str = "ids", decoded: str = "decoded", model: str | None = None) -> DataFrame:
    """Add the text of a column of ids; ids that aren't in the model raise an error."""
    path = model or default_model()
    schema = _with(df, decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            sizes = batch[ids].value_lengths().fill_null(0).to_numpy().astype(np.int64)
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PIECES_AT_ONCE, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(batch)], strict=True):
                part = batch.slice(a, b - a)
                flat = part[ids].flatten().to_numpy()
                data = gather(pieces.data, pieces.start[flat], pieces.length[flat]).tobytes()
                ends = np.append(0, np.cumsum(pieces.length[flat]))[np.cumsum(sizes[a:b])]
                texts, at = [], 0
                for e, null in zip(ends.tolist(), part[ids].is_null().to_pylist(), strict=True):
                    text = data[at:e].decode("utf-8", "replace").replace(SPACE, " ")
                    texts.append(None if null else text[1:])
                    at = e
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
