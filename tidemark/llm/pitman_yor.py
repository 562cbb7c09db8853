"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are words; a text ends with one end token (the empty word).  The model is
one hierarchy of restaurants:

* ``G_u``: one for each context, which is the preceding token itself, whatever it
  is (before a text's first word, the end token); all of them share the parent
* ``G``: the restaurant of words without context, whose parent spells the word
* ``H_u``: letter restaurants, one for each context ``u`` of up to ``ORDER``
  bytes in a word; the parent of ``H_u`` is ``H`` of ``u`` without its first
  byte, shared by all contexts that end alike; the root's base is uniform.

Customers are seated by Gibbs sampling, level by level: all customers of a dish
leave a restaurant and sit down one after the other, at a new table with weight
(strength + discount * tables) * parent's probability, else with weight
(customers - discount * tables of the dish); each table is a customer of the
parent.  Dishes of a sweep are seated at the same time, given the tables that
the sweep before has left, which is what lets a sweep run on many machines.
Beyond 16 customers of a dish they sit down in groups of an eighth of those that
are seated (a test holds the mean number of tables against seating one by one).
The discount of words is estimated anew in each sweep from the customers that are
seated once and twice, n1 / (n1 + 2 n2).  A text's score is the sum of log10 of
the predictive probabilities averaged over the kept sweeps.

Words are dealt to buckets by a hash, contexts of a word stay with it; blocks of
texts send each bucket their different (word, context) pairs as packed arrays, and
get back sums for each text.  The number of buckets follows the bytes of the texts;
they are dealt with in ``ROUNDS``, so that a part of the pairs is on disk at a time.
A pair with one customer has one table, so sweeps carry only pairs with more.  The
totals of contexts are added up by ranges of their hashes, as many as there are
buckets, and sent back to the buckets that asked for them; those of kept sweeps are
added up once, for all rounds.  What is broadcast is
bounded: letter probabilities of at most ``LETTER_ROWS`` events; more of them are
joined by key instead, to the same result.

Defined cases: a null or empty text is its end token; repeated rows count and
are scored once each; a null ``doc_id`` is kept, its text is learned from;
without training texts all probability comes from the uniform base; further
columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, groups_for, large_rows, materialise
from tidemark.llm.words import gather, mix, slices, word_hashes, words_of_texts

#: Parts of the buckets that are counted, and scored, one after the other.
COUNT_ROUNDS, ROUNDS = 2, 3
#: Bytes of text for each bucket of words.
PER_BUCKET = 8_000_000
ORDER = 4
LETTER_ROWS = 1_500_000
#: Strengths of word restaurants with context and without, discount and strength of letter restaurants.
S1, S0 = 1.0, 1.0
DL, SL = 0.6, 1.0
SWEEPS, SAMPLES = 4, 3
BLOCK_BYTES = 10_000_000
#: Texts are cut into words in parts of about so many bytes, whose arrays fit a core's cache.
PART_BYTES = 500_000
#: Groups of letter contexts; contexts that share their last two bytes are in one group.
LETTER_GROUPS = 256
#: For tables whose rows are packed arrays: values never repeat, and most bytes don't compress.
PACKED = {"parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1"}
#: For those of which a round reads its buckets only: each row can be left out.
ROWS_APART = PACKED | {"parquet.block.row.count.limit": "1"}
END = 0x20
_U = np.uint64


def seat(c: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float, s: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its ``c`` customers have sat down anew.

    ``others``: tables of other dishes in the restaurant; ``parent``: the dish's
    probability in the parent.
    """
    t = (c > 0).astype(np.int64)
    i, step = 1, 1
    at = np.flatnonzero(c > i)
    while at.size:
        new = (s + d * (others[at] + t[at])) * parent[at]
        p = new / (new + i - d * t[at])
        if i < 16:
            t[at] += rng.random(at.size) < p
        else:
            step = i // 8
            t[at] += rng.binomial(np.minimum(c[at] - i, step), p)
        i += step
        at = at[c[at] > i]
    return t


def _lines(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of words with a line feed behind each, and where each word begins and how long it is."""
    data = np.frombuffer(joined + b"\n", np.uint8)
    ends = np.flatnonzero(data == ord("\n"))
    starts = np.append(0, ends[:-1] + 1)
    return data, starts, ends - starts


def _letters(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, byte) of each letter event of each word (joined by line feeds), and the word's index."""
    flat, _, length = _lines(joined)
    word = np.repeat(np.arange(len(length)), length + 1)
    # each word, with its end, has ORDER zeros before it
    at = np.arange(len(flat)) + ORDER * (word + 1)
    data = np.zeros(len(flat) + ORDER * len(length), np.uint8)
    data[at] = np.where(flat == ord("\n"), np.uint8(END), flat)
    code = np.zeros(len(data), np.int64)
    for j in range(ORDER + 1):
        code[ORDER:] = code[ORDER:] << 8 | data[j : len(data) - ORDER + j]
    return code[at], word


def _spell(joined: bytes, keys: np.ndarray, logs: list[np.ndarray]) -> np.ndarray:
    """[word, sample] log probabilities, from those of each sample by ascending ``keys`` that hold all letter events of the words."""
    code, word = _letters(joined)
    order = np.argsort(code)
    at = np.empty(len(code), np.int64)
    at[order] = np.searchsorted(keys, code[order])
    if (keys[np.minimum(at, len(keys) - 1)] != code).any():
        raise ValueError("a letter event is missing")
    heads = _heads(word)
    return np.stack([np.add.reduceat(x[at], heads) for x in logs], axis=1)


def _sums(values: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(by, values, n)


class _Level:
    """The restaurants of one context length in a group: dishes sorted by context."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.contexts, self.of = np.unique(keys >> 8, return_inverse=True)
        self.c = self.t = np.ones(len(keys), np.int64)

    def begin(self, c: np.ndarray) -> None:
        self.c, self.t = c, (c > 0).astype(np.int64)

    def probs(self, parent: np.ndarray) -> np.ndarray:
        n = len(self.contexts)
        tables, customers = _sums(self.t, self.of, n), _sums(self.c, self.of, n)
        return (self.c - DL * self.t + (SL + DL * tables[self.of]) * parent) / (SL + customers[self.of])

    def left(self) -> np.ndarray:
        n = len(self.contexts)
        return (SL + DL * _sums(self.t, self.of, n)) / (SL + _sums(self.c, self.of, n))

    def sit(self, parent: np.ndarray, rng: np.random.Generator) -> None:
        tables = _sums(self.t, self.of, len(self.contexts))
        self.t = seat(self.c, tables[self.of] - self.t, parent, DL, SL, rng)


def _top(customers: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """[context byte, byte] probabilities of the two upper levels (at most 65,536 dishes)."""
    keys = np.flatnonzero(customers.ravel())
    one = _Level(keys)
    one.c = customers.ravel()[keys].astype(np.int64)
    zero_p = np.full(256, 1 / 256)
    for _ in range(SWEEPS):
        one.sit(zero_p[keys & 0xFF], rng)
        zero = _Level(np.unique(keys & 0xFF))
        zero.c = np.bincount(keys & 0xFF, one.t, 256)[zero.keys].astype(np.int64)
        zero.sit(np.full(len(zero.keys), 1 / 256), rng)
        left = zero.left()[0] if len(keys) else 1.0
        zero_p = np.full(256, left / 256)
        zero_p[zero.keys] = zero.probs(np.full(len(zero.keys), 1 / 256))
    table = np.repeat(zero_p[None], 256, axis=0)
    table[one.contexts] *= one.left()[:, None]
    table.ravel()[keys] = one.probs(zero_p[keys & 0xFF])
    return table


def _seating(top: np.ndarray, seed: list[int]):
    """Seats the restaurants of a group of contexts, with all that share their last two bytes; events without customers get probabilities too."""

    def group(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rng = np.random.default_rng([*seed, key[0].as_py()])
        order_of = np.argsort(rows["key"].to_numpy())
        keys, n = rows["key"].to_numpy()[order_of], rows["n"].to_numpy()[order_of]
        levels = [_Level(np.unique(keys & ((1 << 8 * (o + 1)) - 1))) for o in range(2, ORDER + 1)]
        levels[-1].begin(n)
        up = [None, *(np.searchsorted(a.keys, b.keys & ((1 << 8 * (i + 3)) - 1)) for i, (a, b) in enumerate(zip(levels, levels[1:], strict=False)))]
        for i in range(len(levels) - 1, 0, -1):
            levels[i - 1].begin(_sums(levels[i].t, up[i], len(levels[i - 1].keys)).astype(np.int64))
        base = top[levels[0].keys >> 8 & 0xFF, levels[0].keys & 0xFF]
        kept = []
        for sweep in range(SWEEPS):
            parents = [base]
            for i, level in enumerate(levels[:-1]):
                parents.append(level.probs(parents[i])[up[i + 1]])
            for i in range(len(levels) - 1, -1, -1):
                levels[i].sit(parents[i], rng)
                if i:
                    levels[i - 1].c = _sums(levels[i].t, up[i], len(levels[i - 1].keys)).astype(np.int64)
            if sweep >= SWEEPS - SAMPLES:
                p = levels[0].probs(base)
                for i, level in enumerate(levels[1:], 1):
                    p = level.probs(p[up[i]])
                kept.append(p)
        values = [k.astype(np.float32) for k in kept]
        none = np.zeros(len(levels[0].keys), np.float32)
        return pa.table(
            [
                pa.array(np.append(levels[0].keys, keys)),
                pa.array(np.append(levels[0].t, np.full(len(keys), -1))),
                *(pa.array(np.append(none, v)) for v in values),
            ],
            names=["key", "t", *(f"v{j}" for j in range(SAMPLES))],
        )

    return group


def letter_probs(vocabulary: DataFrame, seed: int) -> DataFrame:
    """(key, v0, v1, ...) of every letter event: its probability in each sample, learned from the words of training texts (a customer for each word)."""

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch["words"], batch["counts"], strict=True):
                known = np.frombuffer(counts.as_py(), np.int64) > 0
                code, word = _letters(words.as_py())
                event = code << 1 | known[word]
                event.sort()
                head = _heads(event >> 1)
                yield pa.RecordBatch.from_arrays([pa.array(event[head] >> 1), pa.array(np.add.reduceat(event & 1, head))], names=["key", "n"])

    counted = vocabulary.select("words", "counts").mapInArrow(events, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    last_two = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    leaves = materialise(counted.withColumn("group", F.pmod(F.hash(last_two), F.lit(LETTER_GROUPS)).cast("long")), "pitman-yor-leaves")
    pair = F.col("key").bitwiseAND(0xFFFF).alias("pair")  # at most 65,536 of them go to the driver
    tables = leaves.filter("n > 0").select(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).distinct().groupBy(pair).agg(F.count("*").alias("t"))
    schema = "key long, t long, " + ", ".join(f"v{j} float" for j in range(SAMPLES))
    seated = None
    for turn in range(2):
        found = tables.toArrow()
        customers = np.zeros(1 << 16)
        customers[found["pair"].to_numpy()] = found["t"].to_numpy()
        top = _top(customers.reshape(256, 256), np.random.default_rng(seed + turn))
        if seated is not None:
            discard(seated)
        seated = materialise(leaves.groupBy("group").applyInArrow(_seating(top, [seed, turn]), schema), f"pitman-yor-seated{turn}")
        tables = seated.filter("t >= 0").groupBy(pair).agg(F.sum("t").alias("t"))
    discard(leaves)
    return seated.filter("t < 0").drop("t")


_SPELLED = "bucket long, hashes binary, counts binary, word binary, kind binary, n binary, contexts binary, spelled binary"


def _log_columns(letters: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The keys of letter events, ascending, and the log probabilities of each sample."""
    order = np.argsort(letters["key"].to_numpy())
    return letters["key"].to_numpy()[order], [np.log(letters[f"v{j}"].to_numpy()[order]) for j in range(SAMPLES)]


def _with_spelling(row: dict, keys: np.ndarray, logs: list[np.ndarray]) -> dict:
    spelled = _spell(row["words"], keys, logs).astype(np.float32).tobytes()
    return {c: row[c] for c in ("bucket", "hashes", "counts", "word", "kind", "n", "contexts")} | {"spelled": spelled}


_SPELLED_ARROW = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("hashes", "counts", "word", "kind", "n", "contexts", "spelled"))])


def spelled_words(vocabulary: DataFrame, letters: DataFrame, *, most: int = LETTER_ROWS) -> DataFrame:
    """The vocabulary with the log probability of spelling each word instead of the words.

    Up to ``most`` letter events are broadcast; more are joined by key.
    """
    if letters.count() <= most:
        sent = vocabulary.sparkSession.sparkContext.broadcast(_log_columns(letters.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    yield pa.RecordBatch.from_pylist([_with_spelling(batch.slice(i, 1).to_pylist()[0], *sent.value)], schema=_SPELLED_ARROW)

        return vocabulary.mapInArrow(run, _SPELLED)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, words in zip(batch["bucket"].to_pylist(), batch["words"], strict=True):
                keys = np.unique(_letters(words.as_py())[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), bucket)), pa.array(keys)], names=["bucket", "key"])

    def meet(key: tuple[pa.Scalar, ...], rows: pa.Table, found: pa.Table) -> pa.Table:
        known = _log_columns(found)
        return pa.Table.from_pylist([_with_spelling(r, *known) for r in rows.to_pylist()], schema=_SPELLED_ARROW)

    found = vocabulary.select("bucket", "words").mapInArrow(asked, "bucket long, key long").join(letters, "key")
    return vocabulary.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(meet, _SPELLED)


@dataclass
class _Block:
    """Tokens of a run of texts: the hash of each with the token before it, its text, its bucket and on demand both hashes and its bytes."""

    pairs: np.ndarray
    doc: np.ndarray
    bucket: np.ndarray
    hashes: np.ndarray | None
    before: np.ndarray | None
    start: np.ndarray | None  # in data; ends have no bytes
    length: np.ndarray | None
    data: np.ndarray | None


END_HASH = int(mix(np.array([0x454E44], np.uint64))[0])


def _blocks(batch: pa.RecordBatch, buckets: int, only: np.ndarray | None, *, keep_words: bool) -> Iterator[tuple[int, np.ndarray, _Block]]:
    """(first text, tokens of each text, its tokens in the buckets of ``only``) of each block; no ``only``: in all."""
    wanted = np.full(buckets, only is None or not len(only))
    wanted[[] if only is None else only] = True
    small = np.uint16 if buckets <= 1 << 16 else np.int64
    for a, texts in slices(batch["text"], BLOCK_BYTES):
        parts, sizes, from_byte = [], [], 0
        for b, some in slices(texts, PART_BYTES):
            words = words_of_texts(some)
            h = word_hashes(words) if len(words.start) else np.empty(0, np.uint64)
            n = words.per_doc()
            sizes.append(n + 1)
            # each text has its words and then the end, which is also what stands before the next text
            place = np.arange(len(h)) + words.doc
            hashes = np.full(len(h) + len(n) + 1, END_HASH, np.uint64)
            hashes[place + 1] = h  # the first one stands before the first token
            bucket = (hashes[1:] % _U(buckets)).astype(small)
            at = np.flatnonzero(wanted[bucket])
            own, before = hashes[1:][at], hashes[at]
            part = [_pair(own, before), np.repeat(np.arange(b, b + len(n), dtype=np.int32), n + 1)[at], bucket[at]]
            if keep_words:
                start, length = np.zeros((2, len(hashes) - 1), np.int64)
                start[place], length[place] = words.start, words.length
                part += [own, before, start[at] + from_byte, length[at], words.data]
                from_byte += len(words.data)
            parts.append(part)
            del words, h, place, hashes, bucket, at
        yield a, np.concatenate(sizes), _Block(*(np.concatenate(x) for x in zip(*parts, strict=True)), *[None] * (0 if keep_words else 5))


def _pair(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(hashes + mix(before) * _U(0x9E3779B97F4A7C15))


def _heads(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])


def _narrow(values: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds them all."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _wide(packed: bytes, n: int) -> np.ndarray:
    """The ``n`` counts of ``_narrow``."""
    return np.frombuffer(packed, f"u{len(packed) // n}" if n else np.uint8)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values in order, a place of each, and which one each value is."""
    order = np.argsort(values)
    head = _heads(values[order])
    of = np.empty(len(values), np.int64)
    of[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(values))))
    first = order[head]
    return values[first], first, of


def _cut(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [values[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def vocabulary_of(docs: DataFrame, buckets: int, only: np.ndarray | None = None) -> DataFrame:
    """A row for each bucket of words (of ``only``, if it names some): its words and how often training texts have each in each context.

    ``hashes``, ``counts`` (by word), ``words`` (joined by line feeds), ``contexts``
    (hashes of preceding tokens, ascending), and by pair of word and context ``word``
    and ``kind`` (their places) and ``n``.  Words of texts that are held out are there
    too, with a count of 0.
    """

    room = _U(64 - buckets.bit_length())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = ~np.array(batch["held_out"].to_pylist(), bool)
            for a, _, block in _blocks(batch, buckets, only, keep_words=True):
                if not len(block.pairs):
                    continue
                order = np.argsort(block.pairs)
                head = _heads(block.pairs[order])
                learned = np.append(0, np.cumsum(train[a:][block.doc][order]))
                n = np.diff(learned[np.append(head, len(order))])
                first = order[head]
                del order, head, learned
                h = block.hashes[first]
                # by bucket, then by as many bits of the hash as there is room for; a word that others break up is sent in parts
                order = np.argsort(block.bucket[first].astype(np.uint64) << room | h >> (_U(64) - room))
                first, n, h = first[order], n[order], h[order]
                new = _heads(h)
                bucket, starts, length = block.bucket[first], block.start[first[new]], block.length[first[new]]
                # words with a line feed behind each
                text = gather(block.data, starts, length + 1)
                ends = np.cumsum(length + 1)
                text[ends - 1] = ord("\n")
                cuts, word_cuts = _heads(bucket), _heads(bucket[new])
                there = bucket[cuts].astype(np.int64)
                pairs_of = np.diff(np.append(new, len(h)))
                cuts, word_cuts = np.append(cuts, len(h)), np.append(word_cuts, len(new))
                text_cuts = np.append(0, ends)[word_cuts].tolist()
                columns = [
                    _cut(h[new], word_cuts),
                    [text[x : y - 1].tobytes() for x, y in zip(text_cuts, text_cuts[1:], strict=False)],
                    _cut(_narrow(pairs_of), word_cuts),
                    _cut(block.before[first], cuts),
                    _cut(_narrow(n), cuts),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(there), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "hashes", "words", "pairs", "kind", "n"])

    def merge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        columns = {name: group[name].to_pylist() for name in ("hashes", "words", "pairs", "kind", "n")}
        h, kinds = ([np.frombuffer(x, np.uint64) for x in columns[c]] for c in ("hashes", "kind"))
        text, starts, length = _lines(b"\n".join(columns["words"]))
        hashes, first, of = _distinct(np.concatenate(h))
        word = np.repeat(of, np.concatenate([_wide(x, len(y)) for x, y in zip(columns["pairs"], h, strict=True)]))
        contexts, _, kind = _distinct(np.concatenate(kinds))
        n = np.concatenate([_wide(x, len(y)) for x, y in zip(columns["n"], kinds, strict=True)])
        code = word * len(contexts) + kind
        order = np.argsort(code)
        code = code[order]
        head = _heads(code)
        total, code = np.add.reduceat(n[order], head, dtype=np.int64), code[head]
        word, kind = np.divmod(code, len(contexts))
        counts = np.bincount(word, total, len(hashes)).astype(np.int64)
        values = [hashes.tobytes(), gather(text, starts[first], length[first] + 1)[:-1].tobytes(), counts.tobytes(), word.astype(np.int32).tobytes(), kind.astype(np.int32).tobytes(), total.astype(np.uint32).tobytes(), contexts.tobytes()]
        return pa.table([pa.array([key[0].as_py()]), *(pa.array([v], pa.binary()) for v in values)], names=["bucket", "hashes", "words", "counts", "word", "kind", "n", "contexts"])

    sent = docs.mapInArrow(spread, "bucket long, hashes binary, words binary, pairs binary, kind binary, n binary")
    return sent.groupBy("bucket").applyInArrow(merge, "bucket long, hashes binary, words binary, counts binary, word binary, kind binary, n binary, contexts binary")


@dataclass
class _Totals:
    """What all buckets have together after a sweep: tokens, words, tables in contexts, tables of ``G``, and discounts."""

    tokens: int
    words: int
    served: float
    dishes: float
    d1: float
    d0: float


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``np.logaddexp`` by functions that numpy works out for several numbers at once; not both may be -inf."""
    top = np.maximum(a, b)
    return top + np.log1p(np.exp(np.minimum(a, b) - top))


def discount(once: float, twice: float) -> float:
    """The discount under which so many dishes have one and two customers, kept away from 0 and 1."""
    return min(0.95, max(0.05, once / max(1.0, once + 2 * twice)))


_KINDS = {"hashes": np.uint64, "counts": np.int64, "word": np.int32, "kind": np.int32, "n": np.uint32, "contexts": np.uint64, "spelled": np.float32, "singles": np.int32, "t1": np.int32, "t0": np.int32}


def _numbers(row: dict) -> dict:
    found = row | {name: np.frombuffer(row[name], kind) for name, kind in _KINDS.items() if row.get(name) is not None}
    if "n" in found:
        found["n"] = found["n"].astype(np.int64)
    if "spelled" in found:
        found["spelled"] = found["spelled"].reshape(-1, SAMPLES).astype(np.float64)
    return found


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(len(batch)):  # one by one: a row holds a whole bucket
        yield _numbers(batch.slice(i, 1).to_pylist()[0])


def _served(row: dict, t1: np.ndarray) -> np.ndarray:
    """Customers of each word in ``G``: a table of each pair with one customer, and those of the others."""
    return row["singles"] + np.bincount(row["word"], t1, len(row["singles"])).astype(np.int64)


_KEPT = pa.list_(pa.struct([("t1", pa.binary()), ("t0", pa.binary())]))
_STATE = "bucket long, singles binary, word binary, kind binary, n binary, contexts binary, spelled binary, t1 binary, t0 binary, kept array<struct<t1: binary, t0: binary>>, seen array<bigint>"
_STATE_ARROW = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("singles", "word", "kind", "n", "contexts", "spelled", "t1", "t0")), ("kept", _KEPT), ("seen", pa.list_(pa.int64()))])


def _seen(row: dict, t1: np.ndarray, t0: np.ndarray) -> list[int]:
    """What a bucket adds to ``_totals``."""
    served, once = _served(row, t1), row["singles"].sum(dtype=np.int64)
    n = row["n"].astype(np.int64)
    return [int(x) for x in (once + n.sum(), (t0 > 0).sum(), served.sum(), t0.sum(dtype=np.int64), once, (n == 2).sum(), (served == 1).sum(), (served == 2).sum())]


def _begin(words: DataFrame) -> DataFrame:
    """The pairs with more than one customer, all customers of a dish at one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                more = row["n"] > 1
                here, kind = np.unique(row["kind"][more], return_inverse=True)
                arrays = {
                    "singles": np.bincount(row["word"], row["n"] == 1, len(row["counts"])).astype(np.int32),
                    "word": row["word"][more],
                    "kind": kind.astype(np.int32),
                    "n": row["n"][more].astype(np.uint32),
                    "contexts": row["contexts"][here],
                    "spelled": row["spelled"].astype(np.float32),
                    "t1": np.ones(len(kind), np.int32),
                    "t0": (row["counts"] > 0).astype(np.int32),
                }
                out = {"bucket": row["bucket"], "kept": [], "seen": _seen(arrays, arrays["t1"], arrays["t0"]), **{c: x.tobytes() for c, x in arrays.items()}}
                yield pa.RecordBatch.from_pylist([out], schema=_STATE_ARROW)

    return words.drop("hashes").mapInArrow(run, _STATE)


_ASKED = "c long, bucket long, hashes binary, sums array<binary>"
_ASKED_ARROW = pa.schema([("c", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("sums", pa.list_(pa.binary()))])


def _group_of(contexts: np.ndarray, groups: int) -> np.ndarray:
    """The group of each context, by ranges of hashes: ascending contexts have ascending groups."""
    return ((contexts >> _U(32)) * _U(groups) >> _U(32)).astype(np.int64)


def _by_context(rows: DataFrame, groups: int, sums_of, *, back: bool) -> DataFrame:
    """What each bucket adds to sums of its contexts, by group of contexts; ``back``: it asks for all buckets' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                sums, contexts = sums_of(row), row["contexts"]
                c = _group_of(contexts, groups)
                heads = _heads(c)
                there, heads = c[heads], np.append(heads, len(c))
                cuts = [_cut(x, heads) for x in (contexts, *(x.astype(np.uint32) for x in sums))]
                out = [{"c": g, "bucket": row["bucket"] if back else -1, "hashes": h, "sums": list(x)} for g, h, *x in zip(there.tolist(), *cuts, strict=True)]
                yield pa.RecordBatch.from_pylist(out, schema=_ASKED_ARROW)

    return rows.mapInArrow(run, _ASKED)


def _added(sent: DataFrame, n_sums: int, *, answers: bool) -> DataFrame:
    """``n_sums`` sums by context, 0 where no bucket adds to one: ``answers`` to the buckets that asked, in the order in which they asked, or a row for each group of contexts."""

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        contexts, of = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = []
        for j in range(n_sums):
            given = [np.frombuffer(r["sums"][j], np.uint32) if j < len(r["sums"]) else np.zeros(len(h), np.uint32) for r, h in zip(rows, hashes, strict=True)]
            sums.append(np.bincount(of, np.concatenate(given), len(contexts)).astype(np.uint32))
        if not answers:
            return pa.Table.from_pylist([{"c": key[0].as_py(), "bucket": -1, "hashes": contexts.tobytes(), "sums": [x.tobytes() for x in sums]}], schema=_ASKED_ARROW)
        ends = np.cumsum([0, *map(len, hashes)]).tolist()
        out = [{"c": r["c"], "bucket": r["bucket"], "sums": [x[of[a:b]].tobytes() for x in sums]} for r, a, b in zip(rows, ends, ends[1:], strict=False) if r["bucket"] >= 0]
        return pa.Table.from_pylist(out, schema=_ASKED_ARROW)

    return sent.groupBy("c").applyInArrow(add, _ASKED)


def _answered(answers: list[dict], sums: int) -> list[np.ndarray]:
    """The sums of each of a bucket's contexts, which ascend as their groups do, put together from the groups' answers."""
    answers = sorted(answers, key=lambda r: r["c"])
    return [np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(r["sums"][j], np.uint32) for r in answers)]).astype(np.float64) for j in range(sums)]


def contexts_of(words: DataFrame, groups: int) -> DataFrame:
    """Of all contexts, by group: (customers, tables of pairs with one customer)."""

    def sums(row: dict) -> list[np.ndarray]:
        return [np.bincount(row["kind"], x, len(row["contexts"])) for x in (row["n"], row["n"] == 1)]

    return _added(_by_context(words.select("bucket", "kind", "n", "contexts"), groups, sums, back=False), 2, answers=False)


def _sweep(state: DataFrame, contexts: DataFrame, total: _Totals, sweep: int, seed: int, groups: int) -> DataFrame:
    """Seat every bucket's words once more, given what all buckets had after the sweep before."""
    sample = max(0, sweep - (SWEEPS - SAMPLES))
    asked = _by_context(state.select("bucket", "kind", "contexts", "t1"), groups, lambda row: [np.bincount(row["kind"], row["t1"], len(row["contexts"]))], back=True)
    tables = _added(asked.unionByName(contexts.withColumn("sums", F.slice("sums", 2, 1))), 1, answers=True)

    def sit(key: tuple[pa.Scalar, ...], group: pa.Table, answers: pa.Table) -> pa.Table:
        given = group.to_pylist()[0]
        row = _numbers(given)
        in_context = _answered(answers.to_pylist(), 1)[0][row["kind"]]
        rng = np.random.default_rng([seed, sweep, row["bucket"]])
        served = _served(row, row["t1"])
        # a long word's may underflow to 0, which is exact enough here: those seated have at least 1 - d0 beside it
        p0 = np.exp(row["spelled"][:, sample])
        g = (served - total.d0 * row["t0"] + (S0 + total.d0 * total.dishes) * p0) / (S0 + total.served)
        t1 = seat(row["n"], np.maximum(in_context - row["t1"], 0), g[row["word"]], total.d1, S1, rng)
        t0 = seat(_served(row, t1), np.maximum(total.dishes - row["t0"], 0), p0, total.d0, S0, rng)
        new = {"t1": t1.astype(np.int32).tobytes(), "t0": t0.astype(np.int32).tobytes()}
        kept = [*given["kept"], new] if sweep >= SWEEPS - SAMPLES else []
        return pa.Table.from_pylist([given | new | {"kept": kept, "seen": _seen(row, t1, t0)}], schema=_STATE_ARROW)

    return state.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(sit, _STATE)


def _totals(state: DataFrame) -> _Totals:
    sent = state.agg(*(F.sum(F.col("seen")[i]) for i in range(8))).first()
    tokens, words, served, dishes, *seated = (v or 0 for v in sent)
    return _Totals(tokens, words, served, dishes, discount(*seated[:2]), discount(*seated[2:]))


def word_model(words: DataFrame, contexts: DataFrame, seed: int, groups: int) -> tuple[DataFrame, list[_Totals]]:
    """The seating of all buckets after the last sweep, with the kept ones, and the totals before each sweep and after the last."""
    state = materialise(_begin(words), "pitman-yor-seating", **ROWS_APART)
    totals = [_totals(state)]
    for sweep in range(SWEEPS):
        new = materialise(_sweep(state, contexts, totals[-1], sweep, seed, groups), "pitman-yor-seating", **ROWS_APART)
        discard(state)
        state = new
        totals.append(_totals(state))
    return state, totals


def kept_contexts(contexts: DataFrame, state: DataFrame, groups: int) -> DataFrame:
    """Of all contexts, by group: what ``contexts_of`` has, and the tables of pairs with more customers in each kept sweep."""

    def tables(row: dict) -> list[np.ndarray]:
        none = np.zeros(len(row["contexts"]))
        return [none, none, *(np.bincount(row["kind"], np.frombuffer(k["t1"], np.int32), len(none)) for k in row["kept"])]

    seated = _by_context(state.select("bucket", "kind", "contexts", "kept"), groups, tables, back=False)
    return _added(contexts.unionByName(seated), 2 + SAMPLES, answers=False)


def _values(words: DataFrame, state: DataFrame, contexts: DataFrame, totals: list[_Totals], groups: int, only: np.ndarray) -> DataFrame:
    """Of each bucket of ``only``, a range, the log10 probability of each pair and the count of its word; ``contexts``: those of ``kept_contexts``."""
    mine = F.col("bucket").between(int(only[0]), int(only[-1]))
    asked = _by_context(words.filter(mine).select("bucket", "contexts"), groups, lambda row: [], back=True)
    answers = _added(asked.unionByName(contexts), 2 + SAMPLES, answers=True)
    right = answers.drop("hashes").unionByName(state.filter(mine).select("bucket", "kept"), allowMissingColumns=True)

    def run(key: tuple[pa.Scalar, ...], group: pa.Table, found: pa.Table) -> pa.Table:
        row, found = _numbers(group.to_pylist()[0]), found.to_pylist()
        kept_of = next(r["kept"] for r in found if r["c"] is None)
        customers, singles, *more = _answered([r for r in found if r["c"] is not None], 2 + SAMPLES)
        words, kind, several = len(row["counts"]), row["kind"], row["n"] > 1
        p, all_of = np.full(len(row["n"]), -np.inf), np.log(S1 + customers)[kind]
        for j, kept in enumerate(kept_of):
            at, after = totals[SWEEPS - SAMPLES + j], totals[SWEEPS - SAMPLES + j + 1]
            t1, t0 = (row["n"] == 1).astype(np.int64), np.frombuffer(kept["t0"], np.int32)
            t1[several] = np.frombuffer(kept["t1"], np.int32)
            served = np.bincount(row["word"], t1, words)
            with np.errstate(divide="ignore"):  # no customers: the log is -inf and only the parent counts
                seated_g, seated_own = np.log(served - at.d0 * t0), np.log(row["n"] - at.d1 * t1)
            g = _log_add(seated_g, np.log(S0 + at.d0 * after.dishes) + row["spelled"][:, j]) - np.log(S0 + after.served)
            own = _log_add(seated_own, np.log(S1 + at.d1 * (singles + more[j]))[kind] + g[row["word"]])
            own = own - all_of - np.log(SAMPLES)
            p = _log_add(p, own) if j else own
        pair = _pair(row["hashes"][row["word"]], row["contexts"][kind])
        order = np.argsort(pair)
        columns = [pair[order], (p[order] / np.log(10)).astype(np.float32), row["counts"][row["word"]][order].astype(np.uint32), np.empty(0)]
        return pa.table([pa.array([row["bucket"]]), pa.array([0]), pa.array([0]), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=_SENT)

    return words.filter(mine).groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(run, _SENT_SCHEMA)


_SENT = ["bucket", "block", "kind", "a", "b", "c", "d"]
_SENT_SCHEMA = "bucket long, block long, kind long, a binary, b binary, c binary, d binary"


def score(docs: DataFrame, *, buckets: int | None = None, seed: int = 11) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text, held_out) not held out, and score all.

    (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity).
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    buckets = buckets or max(8, groups_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, PER_BUCKET))
    counted = [materialise(vocabulary_of(docs, buckets, np.arange(r, buckets, COUNT_ROUNDS)), "pitman-yor-vocabulary", **PACKED) for r in range(min(COUNT_ROUNDS, buckets))]
    vocabulary = functools.reduce(DataFrame.unionAll, counted)
    spelled = spelled_words(vocabulary, letter_probs(vocabulary, seed))
    with large_rows(docs.sparkSession):
        words = materialise(spelled, "pitman-yor-words", **ROWS_APART)
        discard(*counted)
        contexts = materialise(contexts_of(words, buckets), "pitman-yor-contexts", **PACKED)
        state, totals = word_model(words, contexts, seed, buckets)
        kept = materialise(kept_contexts(contexts, state, buckets), "pitman-yor-kept", **PACKED)
        discard(contexts)
    tokens, different = totals[0].tokens, totals[0].words
    parts = []
    for only in np.array_split(np.arange(buckets), min(ROUNDS, buckets)):
        with large_rows(docs.sparkSession):
            values = materialise(_values(words, state, kept, totals, buckets, only), "pitman-yor-values", **PACKED)
        parts.append(_sums_of(docs, values, buckets, only))
        discard(values)
    discard(words, state, kept)

    def whole(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        ids, null, n, held = (np.frombuffer(rows[0][c], k) for c, k in (("a", np.int64), ("b", np.uint8), ("c", np.uint32), ("d", np.uint8)))
        total = np.sum([np.frombuffer(r["sums"], np.float64).reshape(3, -1) for r in rows], axis=0)
        return pa.table(
            [pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(n.astype(np.int64)), pa.array(total[2].astype(np.int64)), pa.array(total[1]), pa.array(total[0])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score"],
        )

    found = functools.reduce(DataFrame.unionAll, parts).groupBy("block").applyInArrow(whole, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    norm = float(np.log10(tokens + different + 1))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * norm).alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _sums_of(docs: DataFrame, values: DataFrame, buckets: int, only: np.ndarray) -> DataFrame:
    """(block, a, b, c, d, sums): of each block its texts, and for each what its words in the buckets of ``only`` add to its sums."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            for a, n, tokens in _blocks(batch, buckets, only, keep_words=False):
                size, n = len(n), n.astype(np.uint32)
                order = np.argsort(tokens.pairs)
                pairs, doc = tokens.pairs[order], tokens.doc[order]
                head = _heads(pairs)
                pairs, bucket = pairs[head], tokens.bucket[order[head]]
                by_bucket = np.argsort(bucket, kind="stable")
                rank = np.empty(len(head), np.int64)
                rank[by_bucket] = np.arange(len(head))
                entry = np.repeat(rank, np.diff(np.append(head, len(doc)))) << 32 | doc
                del tokens, order, doc, rank, head
                entry.sort()
                pairs, bucket = pairs[by_bucket], bucket[by_bucket]
                new = _heads(entry)
                times = np.diff(np.append(new, len(entry)))
                entry = entry[new]
                if len(times) and times.max() > 255:  # an entry counts up to 255 times, more take several
                    several = -(-times // 255)
                    runs_of = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
                    entry, times = np.repeat(entry, several), np.minimum(np.repeat(times, several) - 255 * runs_of, 255)
                runs = np.bincount(entry >> 32, minlength=len(pairs))
                heads = _heads(bucket)
                there, heads = bucket[heads], np.append(heads, len(bucket))
                cuts = np.append(0, np.cumsum(runs, dtype=np.int64))[heads]
                columns = [_cut(pairs, heads), _cut(_narrow(runs), heads), _cut((entry & 0xFFFFFFFF).astype(np.uint16), cuts), _cut(times.astype(np.uint8), cuts)]
                ones = np.ones(len(there), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), pa.array(ones * block), pa.array(ones), *(pa.array(c, pa.binary()) for c in columns)], names=_SENT)
                ids = batch["doc_id"].slice(a, size)
                held = np.array(batch["held_out"].slice(a, size).to_pylist(), np.uint8)
                header = [ids.fill_null(0).to_numpy().astype(np.int64), np.array(ids.is_null().to_pylist(), np.uint8), n, held]
                yield pa.RecordBatch.from_arrays([pa.array([-1 - block % buckets]), pa.array([block]), pa.array([2]), *(pa.array([c.tobytes()], pa.binary()) for c in header)], names=_SENT)
                block += 1

    def meet(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        known = next((r for r in rows if r["kind"] == 0), None)
        out = [{"block": r["block"], "kind": 2, **{c: r[c] for c in "abcd"}} for r in rows if r["kind"] == 2]
        if known:
            keys, lp = np.frombuffer(known["a"], np.uint64), np.frombuffer(known["b"], np.float32).astype(np.float64)
            count = np.frombuffer(known["c"], np.uint32).astype(np.float64)
            l1, seen = np.log10(count + 1), (count > 0).astype(np.float64)
            for r in rows:
                if r["kind"] == 1:
                    asked = np.frombuffer(r["a"], np.uint64)
                    at = np.repeat(np.searchsorted(keys, asked), _wide(r["b"], len(asked)))
                    doc, n = np.frombuffer(r["c"], np.uint16).astype(np.int64), np.frombuffer(r["d"], np.uint8)
                    sums = [np.bincount(doc, x[at] * n) for x in (lp, l1, seen)]
                    own = np.flatnonzero(np.bincount(doc)).astype(np.uint16)
                    out.append({"block": r["block"], "kind": 1, "a": own.tobytes(), "b": sums[0][own].astype(np.float32).tobytes(), "c": sums[1][own].tobytes(), "d": sums[2][own].astype(np.uint32).tobytes()})
        return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("kind", pa.int64()), *((c, pa.binary()) for c in "abcd")]))

    def gather_block(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        head = next(r for r in rows if r["kind"] == 2)
        total = np.zeros((3, len(head["b"])))
        for r in rows:
            if r["kind"] == 1:
                own = np.frombuffer(r["a"], np.uint16)
                for i, (c, kind) in enumerate((("b", np.float32), ("c", np.float64), ("d", np.uint32))):
                    total[i, own] += np.frombuffer(r[c], kind)
        return pa.Table.from_pylist([{"block": head["block"], **{c: head[c] for c in "abcd"}, "sums": total.tobytes()}], schema=pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in [*"abcd", "sums"])]))

    sent = docs.mapInArrow(spread, _SENT_SCHEMA).unionAll(values)
    sums = sent.groupBy("bucket").applyInArrow(meet, "block long, kind long, a binary, b binary, c binary, d binary")
    return materialise(sums.groupBy("block").applyInArrow(gather_block, "block long, a binary, b binary, c binary, d binary, sums binary"), "pitman-yor-part")
