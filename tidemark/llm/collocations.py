"""Phrases whose words stand together more often than their parts would suggest.

Two passes over the texts. The first makes a count-min sketch of all n-grams:
each task sends the counters that it has raised, which are few beside all of
them, and they are added up by parts; no counter is too low. The second pass
sends on only n-grams that a bit table of the counters that reach the least
count, and those of their own parts, let through, and counts them exactly.
Nothing frequent is lost; what collides in the sketch or the table is dropped
by its exact count. Scores and subsumption are joins over the frequent n-grams.

The sketch grows with the texts, as no task holds more than a part of it. The
table grows with the counters that pass, up to ``MOST_WIDTH`` bits a row.
Beyond that it lets more n-grams through to the exact count, which costs time
and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of, materialise
from tidemark.llm.words import Words, gather, mix, slices, word_hashes

#: Words of a phrase at most, and of a candidate at least.
LONGEST, SHORTEST = 4, 2
#: Bits of a row of the table of what the sketch lets through, at least and at most, and for each counter that passes.
LEAST_WIDTH, MOST_WIDTH = 1 << 16, 1 << 29
BITS_A_COUNTER = 16
ROWS = 2
#: Bytes of text for each counter of the sketch.
BYTES_A_COUNTER = 8
#: Counters that are added up together, at least, and parts at most.
PART, MOST_PARTS = 1 << 22, 1 << 10
#: N-grams that a task counts before it sends their counters.
SENT = 1 << 23
#: Bytes of a batch of texts; somewhat less than a run of ``slices``, so that a batch is one run.
BATCH_BYTES = 3_800_000
#: Words or phrases that are cut out at once.
CUT = 1 << 17
#: Frequent single words are parts of many phrases: their counts are dealt to so many groups.
SALTS = 16
#: A language's phrases are first ranked in so many groups.
RANK_GROUPS = 16

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2


@dataclass
class Pieces:
    """Words joined by single spaces: word i is ``data[start[i] : start[i] + length[i]]`` and stands in piece ``piece[i]`` of text ``doc[i]``."""

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    piece: np.ndarray
    doc: np.ndarray


def cut(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What ``gather`` returns, with little memory besides it: ``gather`` takes some 24 bytes for each byte."""
    out, at = np.empty(int(length.sum()), np.uint8), 0
    for i in range(0, len(start), CUT):
        part = gather(data, start[i : i + CUT], length[i : i + CUT])
        out[at : at + len(part)] = part
        at += len(part)
    return out


def pieces_of_texts(texts: pa.Array, kinds: np.ndarray = _KIND) -> Pieces:
    """The words of each text, lower-cased in ASCII; a null text has none. ``kinds`` says of each byte what it is."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    data = np.zeros(n + 8, np.uint8)
    if n:
        data[:n] = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[first : first + n]]
    bounds = offsets - first
    kind = kinds[data[:n]]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    word = np.zeros(n + 2, bool)
    word[1 : n + 1] = kind == 0
    starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    length = np.flatnonzero(word[:-1] & (~word[1:] | edge)) - starts
    breaks = np.cumsum((kind == 2) | edge[:n], dtype=np.int32)
    piece = breaks[starts] if n else np.zeros(0, np.int32)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    joined = np.concatenate([cut(data, starts, length + 1), np.zeros(8, np.uint8)])
    at = np.cumsum(length + 1) - length - 1
    joined[at + length] = 0x20
    return Pieces(joined, at, length, piece, doc)


def gram_hashes(words: Pieces, langs: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, place of the first word, hash of language and words) of the n-grams within pieces; ``langs``: a hash for each text."""
    one = mix(word_hashes(Words(words.data, words.start, words.length, words.doc, len(langs))) ^ langs[words.doc])
    at, h = np.arange(len(one)), one
    yield 1, at, h
    for n in range(2, LONGEST + 1):
        at = at[: np.searchsorted(at, len(one) - n + 1)]
        within = words.piece[at] == words.piece[at + n - 1]
        h = mix(h[: len(at)][within] * _U(0x9E3779B97F4A7C15) + one[at[within] + n - 1])
        at = at[within]
        yield n, at, h


def places(counters: np.ndarray, row: int, width: int) -> np.ndarray:
    """The bit of each counter in a row of the table."""
    return ((mix(counters) if row else counters) & _U(width - 1)).astype(np.int64)


def _power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def counters_for(n_bytes: int) -> int:
    """Counters of the sketch for so much text."""
    return max(LEAST_WIDTH, _power_of_two(n_bytes // BYTES_A_COUNTER))


def width_for(n_counters: int) -> int:
    """Bits of a row of the table for so many counters that pass."""
    return min(MOST_WIDTH, max(LEAST_WIDTH, _power_of_two(BITS_A_COUNTER * n_counters)))


def part_of(counters: int) -> int:
    """Counters of a part of the sketch."""
    return min(counters, max(PART, counters // MOST_PARTS))


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    names = Words(*_as_bytes(coded.dictionary))
    return mix(word_hashes(names) + _U(1))[coded.indices.to_numpy(zero_copy_only=False)]


def _as_bytes(names: pa.Array) -> tuple:
    raw = [x.encode() for x in names.to_pylist()]
    length = np.array([len(x) for x in raw], np.int64)
    return np.frombuffer(b"".join(raw) + bytes(8), np.uint8), np.cumsum(length) - length, length, np.arange(len(raw)), len(raw)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(texts, their languages) in runs of bounded size."""
    for batch in batches:
        text, lang = batch.column(0), batch.column(1)
        for first, part in slices(text):
            yield part, lang.slice(first, len(part))


def count_up(row: np.ndarray, b: np.ndarray, least: int, times: np.ndarray | None = None) -> None:
    """Add one, or ``times[i]`` if each ``b[i]`` differs, to counter ``b[i]`` of the row for each i; a counter stays at ``least``, so that it may be narrow."""
    if times is None:
        b = np.sort(b)
        first = np.flatnonzero(np.diff(b, prepend=-1))
        b, times = b[first], np.diff(first, append=len(b))
    row[b] = np.minimum(row[b].astype(np.int64) + times, least)


def _raised(held: list[np.ndarray], counters: int, least: int) -> Iterator[pa.RecordBatch]:
    """The counters of n-grams by part: gaps between raised ones, byte by byte, then how often each was raised, up to ``least``."""
    b, part, pack = np.concatenate(held), part_of(counters), zstandard.ZstdCompressor(level=1)
    held.clear()
    b.sort()
    bounds = np.searchsorted(b, np.arange(0, counters, part, dtype=np.uint64).astype(b.dtype))
    for k, (i, j) in enumerate(zip(bounds, [*bounds[1:], len(b)], strict=True)):
        if i == j:
            continue
        own = (b[i:j] - b.dtype.type(k * part)).astype(np.int64)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        gaps = np.diff(own[first], prepend=0)
        size = 2 if gaps.max() < 1 << 16 else 4
        times = np.minimum(np.diff(first, append=j - i), least).astype(np.min_scalar_type(least))
        raw = gaps.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes() + times.tobytes()
        yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "n": pa.array([len(gaps)], pa.int32()), "size": pa.array([size], pa.int32()), "counts": pa.array([pack.compress(raw)], pa.binary())})


def _sketch(counters: int, least: int):
    """What a task adds to the sketch: the counters that its n-grams raise."""
    kind = np.uint32 if counters <= 1 << 32 else np.uint64

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for text, lang in _texts(batches):
            for _, _, h in gram_hashes(pieces_of_texts(text), _lang_hashes(lang)):
                held.append((h & _U(counters - 1)).astype(kind))
            if sum(map(len, held)) >= SENT:
                yield from _raised(held, counters, least)
        if held:
            yield from _raised(held, counters, least)

    return build


def _merged(counters: int, least: int):
    """Add up the counters of one part; which of them reach ``least``, as gaps between them."""

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        narrow, unpack, pack = np.min_scalar_type(least), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        row = np.zeros(part_of(counters), narrow)
        for batch in batches:
            for n, size, raw in zip(batch.column("n").to_pylist(), batch.column("size").to_pylist(), batch.column("counts"), strict=True):
                raw = np.frombuffer(unpack.decompress(raw.as_py()), np.uint8)
                gaps = np.ascontiguousarray(raw[: n * size].reshape(size, n).T).view(f"<u{size}").ravel()
                count_up(row, np.cumsum(gaps, dtype=np.int64), least, raw[n * size :].view(narrow))
        passed = np.flatnonzero(row >= least).astype("<u4")
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(passed)], pa.int64()), "passed": pa.array([pack.compress(np.diff(passed, prepend=np.uint32(0)).tobytes())], pa.binary())})

    return merge


def _table(merged: DataFrame, counters: int) -> np.ndarray:
    """The bits of the counters that pass, in ``ROWS`` rows; two bytes and the table's own size for each of them in the driver."""
    width = width_for(merged.agg(F.sum("n")).first()[0] or 0)
    bits, unpack = np.zeros((ROWS, width // 8), np.uint8), zstandard.ZstdDecompressor()
    for r in merged.toLocalIterator():
        at = np.cumsum(np.frombuffer(unpack.decompress(bytes(r["passed"])), "<u4"), dtype=np.uint64) + _U(r["part"] * part_of(counters))
        for i in range(ROWS):
            p = places(at, i, width)
            np.bitwise_or.at(bits[i], p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
    return bits


def _let_through(table: np.ndarray, h: np.ndarray, counters: int, width: int) -> np.ndarray:
    """The places in ``h`` that every row of the table lets through."""
    at, b = np.arange(len(h)), h & _U(counters - 1)
    for i, row in enumerate(table):
        p = places(b[at], i, width)
        at = at[(row[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)]
    return at


def _survivors(bits, width: int, counters: int | None = None):
    """Counts of the n-grams that the table lets through, by run of texts and n; a row without a phrase counts all words."""
    counters = counters or width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for text, lang in _texts(batches):
            words = pieces_of_texts(text)
            names = lang.dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False).astype(np.int32)
            passed = np.zeros(len(words.start) + 1, bool)
            for n, at, h in gram_hashes(words, _lang_hashes(lang)):
                if n > 1:
                    within = np.flatnonzero(passed[at] & passed[at + 1])
                    at, h = at[within], h[within]
                at = at[_let_through(table, h, counters, width)]
                passed = np.zeros(len(words.start) + 1, bool)
                passed[at] = True
                start, end = words.start[at], words.start[at + n - 1] + words.length[at + n - 1]
                ends = np.concatenate([[0], np.cumsum(end - start)])
                phrases = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(cut(words.data, start, end - start))])
                found = pa.table({"lang": codes[words.doc[at]], "phrase": phrases}).group_by(["lang", "phrase"], use_threads=False).aggregate([([], "count_all")])
                yield _batch(names.dictionary, found["lang"].combine_chunks(), found["phrase"].combine_chunks().cast(pa.large_string()).cast(pa.string()), found["count_all"].combine_chunks())
            total = np.bincount(codes[words.doc], minlength=len(names.dictionary))
            yield _batch(names.dictionary, pa.array(np.arange(len(total))), pa.nulls(len(total), pa.string()), pa.array(total.astype(np.int64)))

    return count


def _batch(langs: pa.Array, codes: pa.Array, phrases: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs.take(codes), phrases, counts.cast(pa.int64())], ["lang", "phrase", "c"])


def frequent(docs: DataFrame, least: int = 30) -> DataFrame:
    """All phrases of up to four words with a count of at least ``least`` in their language: (lang, phrase, c).

    ``docs`` has text and lang (null: ``und``). A row with a null phrase holds the language's number of words.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    counters = counters_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    sketches = texts.mapInArrow(_sketch(counters, least), "part int, n int, size int, counts binary")
    merged = sketches.groupBy("part").applyInArrow(_merged(counters, least), "part int, n long, passed binary")
    with batches_of(spark, BATCH_BYTES):
        merged = materialise(merged, "collocations-sketch")
    bits = _table(merged, counters)
    counted = texts.mapInArrow(_survivors(spark.sparkContext.broadcast(bits), 8 * bits.shape[1], counters), "lang string, phrase string, c long")
    exact = counted.groupBy("lang", "phrase").agg(F.sum("c").alias("c")).filter((F.col("c") >= least) | F.col("phrase").isNull())
    with batches_of(spark, BATCH_BYTES):
        return materialise(exact, "collocations-frequent")


def n_words(phrase: str) -> Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1


def _exact(x: str) -> Column:
    return F.col(x).cast("decimal(20,0)")


def subsumed(candidates: DataFrame, percent: int) -> DataFrame:
    """Drop candidates (lang, phrase, a, m) that lie inside a longer one with at least ``percent`` of their count."""
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(SHORTEST), F.col("m") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("m") - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))))
    held = candidates.filter(F.col("m") > SHORTEST).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * _exact("longer") < percent * _exact("a"))).drop("longer")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Add l, r and score of the lowest-scoring cut, ties to the smallest."""
    first = lambda k: F.substring_index("phrase", " ", k)
    cuts = [(k, side) for k in range(1, LONGEST) for side in ("l", "r")]
    part = lambda k, side: first(k) if side == "l" else F.substring(F.col("phrase"), F.length(first(k)) + 2, F.length("phrase"))
    salt = lambda p, by: F.when(F.instr(p, " ") == 0, by).otherwise(0)
    asked = candidates.select("*", F.explode(F.filter(F.array(*(F.when(F.col("m") > k, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part(k, side).alias("part"))) for k, side in cuts)), lambda x: x.isNotNull())).alias("cut"))
    asked = asked.select("lang", "phrase", "a", "cut.*").withColumn("salt", salt(F.col("part"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")))
    known = counts.filter("phrase is not null").select("lang", F.col("phrase").alias("part"), "c", F.explode(F.when(F.instr("phrase", " ") == 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    found = asked.join(known, ["lang", "part", "salt"])
    wide = found.groupBy("lang", "phrase", "a").agg(*(F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("c"))).alias(f"{side}{k}") for k, side in cuts))
    score = lambda k: F.expr(f"cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    best = F.array_min(F.filter(F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST))), lambda x: x.isNotNull()))
    return wide.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, most: int = 2000) -> DataFrame:
    """Each language's ``most`` best phrases of two to four words: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has text and lang; other columns are left out. Null languages count as ``und``, null and empty texts
    as texts without words; repeated rows count each time. Ties are ordered by count, then by the phrase's bytes.
    No rows, or no phrase as frequent as ``least``, give no rows. Texts are taken whole, in runs of some megabytes.
    """
    counts = frequent(docs, least)
    candidates = counts.filter(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("c").alias("a"), n_words("phrase").alias("m"))
    found = scored(subsumed(candidates, percent), counts)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", group).orderBy(*order))).filter(F.col("rank") <= most)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    total = counts.filter("phrase is null").select("lang", F.col("c").alias("n"))
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
