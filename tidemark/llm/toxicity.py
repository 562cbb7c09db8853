"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic text.
A window (a word between spaces) is compressed with both. A window that only the
toxic dictionary shortens speaks for toxicity; how much each pair of lengths
speaks for it, and at which sum a text counts as toxic, is calibrated on
labelled texts.

Toxic texts consist mostly of ordinary words, so a dictionary of all of their
text would learn the same as the ordinary one. The toxic one is therefore
trained on those words, and beginnings of words, that occur in more toxic texts
than chance allows. A text
counts for a word if it is the first one to hold it between two neighbours, so
copies of a text, or many uses in one text, count once. Both dictionaries end in the same ordinary background and
are of one size, so that lengths differ only where their own part matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.collocations import pieces_of_texts
from tidemark.llm.common import materialise
from tidemark.llm.words import Words, mix, slices, word_hashes

#: Labelled rows that a model is fitted on at most (about; by a hash of their id).
TRAIN_ROWS = 20_000
#: Words and their beginnings that the dictionaries are trained on at most, by evidence and by frequency.
TOXIC_UNITS, ORDINARY_WORDS = 2_000, 20_000
#: Characters of a beginning.
SHORTEST_STEM, LONGEST_STEM = 4, 8
#: Bytes of the background of both dictionaries, and of the parts that differ (at least).
BACKGROUND, OWN_PART = 32_768, 1024
#: A word or beginning is toxic text with at least this log-likelihood ratio and lift.
LEAST_EVIDENCE, LEAST_LIFT = 25.0, 8.0
#: zstandard finds no match in a window's last bytes, so something follows it.
PADDING = b"\n" * 16
#: Compressed lengths from here on count as one.
LONGEST = 255
#: Pairs of lengths count if they stand in so many toxic texts and speak for toxicity by so much (a natural logarithm).
LEAST_TEXTS, LEAST_WEIGHT = 3, 1.0
#: Texts of up to so many windows are summed as they are.
FEW_WINDOWS = 30
#: Sums of weights are calibrated in steps of 1 / STEPS, up to MOST_STEPS.
STEPS, MOST_STEPS = 4, 400

#: Letters, digits and all characters beyond ASCII make words.
_KIND = np.ones(256, np.uint8)
_KIND[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = 0


@dataclass
class Model:
    """The two dictionaries, a weight for each pair of lengths, and the probability of each sum of weights."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    chances: np.ndarray


def _texts(batches: Iterator[pa.RecordBatch], text: int = 0) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        for first, part in slices(batch.column(text)):
            yield batch.slice(first, len(part)), part


def _words(texts: pa.Array):
    """(bytes, start, length, text of each word, hash of each word); a space stands before and after each word."""
    words = pieces_of_texts(texts, _KIND)
    hashes = word_hashes(Words(words.data, words.start, words.length, words.doc, len(texts)))
    return b" " + words.data.tobytes(), words.start, words.length, words.doc, hashes


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of labelled texts with a hash of their neighbours, once per run of texts."""
    for batch, text in _texts(batches):
        raw, start, length, doc, h = _words(text)
        if not len(h):
            continue
        edge = np.diff(doc) != 0
        before, after = np.concatenate([[0], h[:-1]]), np.concatenate([h[1:], [0]])
        before[1:][edge] = 0
        after[:-1][edge] = 0
        context = mix(mix(before.astype(np.uint64)) + after.astype(np.uint64))
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        _, once = np.unique(mix(h ^ context) + label.astype(np.uint64), return_index=True)
        word = [raw[a + 1 : a + 1 + n] for a, n in zip(start[once].tolist(), length[once].tolist(), strict=True)]
        owner = batch.column(2).take(pa.array(doc[once]))
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()).cast(pa.string()), pa.array(label[once].astype(np.int32)), pa.array(context[once].view(np.int64)), owner], ["word", "toxic", "context", "owner"])


def evidence(labelled: DataFrame) -> DataFrame:
    """(word, a, b): how many toxic and how many other texts hold a word in a context of their own."""
    seen = labelled.select("text", F.col("toxic").cast("int"), F.xxhash64("text").alias("owner")).mapInArrow(_contexts, "word string, toxic int, context long, owner long")
    first = seen.groupBy("word", "toxic", "context").agg(F.min("owner").alias("owner"))
    by = first.groupBy("word", "toxic").agg(F.count_distinct("owner").alias("c")).groupBy("word")
    return by.agg(F.sum(F.when(F.col("toxic") == 1, F.col("c")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("c"))).alias("b"))


def ratio(a: Column, b: Column, n1: Column, n0: Column) -> tuple[Column, Column]:
    """The log-likelihood ratio of ``a`` of ``n1`` against ``b`` of ``n0`` (0 unless a is the larger share), and the lift."""
    p, q = n1 / (n1 + n0), a / (a + b)
    llr = 2 * (a * F.log(q / p) + F.when(b > 0, b * F.log((1 - q) / (1 - p))).otherwise(0.0))
    return F.when((a > 0) & (q > p), llr).otherwise(0.0), (a / n1) / ((b + 1) / F.greatest(n0, F.lit(1)))


def telling(found: DataFrame, totals: DataFrame) -> DataFrame:
    """The units (unit, a, b) that pass, with their llr, at most ``TOXIC_UNITS``; ``totals`` holds n1 and n0."""
    llr, lift = ratio(F.col("a"), F.col("b"), F.col("n1"), F.col("n0"))
    passed = found.filter("a > 0").join(F.broadcast(totals)).select("unit", "a", "b", llr.alias("llr"), lift.alias("lift"))
    return passed.filter((F.col("llr") >= LEAST_EVIDENCE) & (F.col("lift") >= LEAST_LIFT)).orderBy(F.desc("llr"), F.asc("unit")).limit(TOXIC_UNITS)


def stems(counts: DataFrame) -> DataFrame:
    """(unit, a, b) of whole words (a space at both ends) and of their beginnings (a space in front)."""
    starts = F.transform(F.sequence(F.lit(SHORTEST_STEM), F.least(F.lit(LONGEST_STEM), F.length("word") - 1)), lambda n: F.concat(F.lit(" "), F.col("word").substr(F.lit(1), n)))
    units = F.concat(F.array(F.concat(F.lit(" "), "word", F.lit(" "))), F.when(F.length("word") > SHORTEST_STEM, starts).otherwise(F.array().cast("array<string>")))
    return counts.select(F.explode(units).alias("unit"), "a", "b").groupBy("unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _holders(units: set[str]):
    """How many texts of each label hold each unit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(units)
        at = {u.encode(): i for i, u in enumerate(names)}
        for batch, text in _texts(batches):
            raw, start, length, doc, h = _words(text)
            if not len(h):
                continue
            _, first, which = np.unique(h, return_index=True, return_inverse=True)
            order = np.argsort(which, kind="stable")
            ends = np.cumsum(np.bincount(which))
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            held = []
            for k, i in enumerate(first.tolist()):
                word = raw[start[i] : start[i] + length[i] + 2].decode()
                for u in {word, *(word[: n + 1] for n in range(SHORTEST_STEM, min(LONGEST_STEM, len(word) - 3) + 1))}:
                    if (j := at.get(u.encode())) is not None:
                        held.append(doc[order[ends[k - 1] if k else 0 : ends[k]]].astype(np.int64) * len(names) + j)
            once = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            key, n = np.unique(label[once // len(names)] * len(names) + once % len(names), return_counts=True)
            yield pa.RecordBatch.from_pydict({"toxic": pa.array((key // len(names)).astype(np.int32)), "unit": pa.array([names[i] for i in key % len(names)], pa.string()), "n": pa.array(n.astype(np.int64))})

    return count


def toxic_units(labelled: DataFrame, counts: DataFrame) -> list:
    """Units that tell toxic texts by contexts of their own, and again by the number of texts that hold them: many words of one long text with one beginning are one text."""
    known = {r.unit: r.a for r in telling(stems(counts), counts.agg(F.sum("a").alias("n1"), F.sum("b").alias("n0"))).collect()}
    if not known:
        return []
    spark = labelled.sparkSession
    held = labelled.select("text", "toxic").mapInArrow(_holders(set(known)), "toxic int, unit string, n long").groupBy("unit")
    held = held.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("b"))
    own = F.broadcast(spark.createDataFrame(list(known.items()), "unit string, c long"))
    texts = labelled.agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
    return telling(held.join(own, "unit").select("unit", F.least("t", "c").alias("a"), "b"), texts).collect()


def chosen_stems(found: list) -> list[tuple[str, int]]:
    """Of units that begin alike, the longest that holds nine tenths of the texts of a shorter one, and else the shorter."""
    a, llr = {r.unit: r.a for r in found}, {r.unit: r.llr for r in found}
    shorter = lambda u: [u[:n] for n in range(1, len(u)) if u[:n] in a]
    replaced = {s for u in a for s in shorter(u) if 10 * a[u] >= 9 * a[s]}
    kept = [u for u in a if u not in replaced]
    return [(u, a[u]) for u in kept if not any(s not in replaced and llr[s] >= llr[u] for s in shorter(u))]


def _trained(units: list[tuple[str, int]], size: int) -> bytes:
    """A dictionary trained on lines in which each unit occurs in proportion to its count; of too little text, the text itself."""
    if not units:
        return b""
    most = max(c for _, c in units)
    repeated = [u for u, c in units for _ in range(1 + 99 * c // most)]
    order = np.random.default_rng(0).permutation(len(repeated))
    lines = ["".join(repeated[i] for i in order[k : k + 16]).encode() for k in range(0, len(order), 16)]
    try:
        return zstandard.train_dictionary(size, lines, d=6, k=16, level=3).as_bytes()[-size:]
    except zstandard.ZstdError:
        return "".join(u for u, _ in reversed(units)).encode()[-size:]


def dictionaries(labelled: DataFrame) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary of labelled texts."""
    counts = materialise(evidence(labelled), "toxicity-words")
    toxic = chosen_stems(toxic_units(labelled, counts))
    ordinary = [(f" {r.word} ", r.b) for r in counts.filter("b > 0").orderBy(F.desc("b"), F.asc("word")).limit(ORDINARY_WORDS).collect()]
    own = _trained(toxic, max(OWN_PART, 2 * sum(len(u.encode()) for u, _ in toxic)))
    own = b"".join(u.encode() for u, _ in toxic if u.encode() not in own) + own  # what the trainer has cut
    background = _trained(ordinary, BACKGROUND)
    other = _trained(ordinary, max(256, len(own)))
    size = max(len(own), len(other))
    return other.rjust(size) + background, own.rjust(size) + background


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=17, hash_log=14, chain_log=14, search_log=3, min_match=4, strategy=zstandard.STRATEGY_BTOPT)
    if content:
        held.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how)


def lengths(compress: zstandard.ZstdCompressor, windows: list[bytes]) -> np.ndarray:
    found = [len(x) for k in range(0, len(windows), 20_000) for x in compress.multi_compress_to_buffer(windows[k : k + 20_000])]
    return np.minimum(np.array(found, np.int64), LONGEST)


def _pairs(text: pa.Array, ordinary, toxic) -> tuple[np.ndarray, np.ndarray]:
    """(text, pair of lengths) of the different windows of each text."""
    raw, start, length, doc, h = _words(text)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    windows = [raw[a : a + n + 2] + PADDING for a, n in zip(start[first].tolist(), length[first].tolist(), strict=True)]
    pair = lengths(ordinary, windows) * (LONGEST + 1) + lengths(toxic, windows)
    once = np.unique(doc.astype(np.int64) * len(first) + which)
    return once // len(first), pair[once % len(first)]


def _pair_counts(ordinary: bytes, toxic: bytes):
    """How many texts of each label hold a window with each pair of lengths."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, bad = compressor(ordinary), compressor(toxic)
        for batch, text in _texts(batches):
            doc, pair = _pairs(text, plain, bad)
            once = np.unique(doc * (LONGEST + 1) ** 2 + pair)
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[once // (LONGEST + 1) ** 2]
            key, n = np.unique(label * (LONGEST + 1) ** 2 + once % (LONGEST + 1) ** 2, return_counts=True)
            yield pa.RecordBatch.from_pydict({"toxic": pa.array((key // (LONGEST + 1) ** 2).astype(np.int32)), "pair": pa.array((key % (LONGEST + 1) ** 2).astype(np.int32)), "n": pa.array(n.astype(np.int64))})

    return count


def _sums(texts: pa.Array, model: Model, plain, bad) -> np.ndarray:
    """The sum of weights of each text's windows, by the root of their number: chance alone adds up that way in long texts."""
    doc, pair = _pairs(texts, plain, bad)
    windows = np.bincount(doc, minlength=len(texts))
    return np.bincount(doc, model.weights[pair], len(texts)) / np.sqrt(np.maximum(1, windows / FEW_WINDOWS))


def _steps(sums: np.ndarray) -> np.ndarray:
    return np.minimum(sums * STEPS, MOST_STEPS).astype(np.int64)


def _step_counts(model: Model):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, bad = compressor(model.ordinary), compressor(model.toxic)
        for batch, text in _texts(batches):
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            key, n = np.unique(label * (MOST_STEPS + 1) + _steps(_sums(text, model, plain, bad)), return_counts=True)
            yield pa.RecordBatch.from_pydict({"toxic": pa.array((key // (MOST_STEPS + 1)).astype(np.int32)), "step": pa.array((key % (MOST_STEPS + 1)).astype(np.int32)), "n": pa.array(n.astype(np.int64))})

    return count


def rising(toxic: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """The chance of each step that never falls and fits best (pool adjacent violators), each pool smoothed by half a text of either kind."""
    pools: list[list] = []
    for i, (t, n) in enumerate(zip(toxic.tolist(), all_.tolist(), strict=True)):
        if not n and pools:
            pools[-1][2] = i
            continue
        pools.append([t, n, i])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t2, n2, last = pools.pop()
            pools[-1] = [pools[-1][0] + t2, pools[-1][1] + n2, last]
    found, first = np.zeros(len(all_)), 0
    for t, n, last in pools:
        found[first : last + 1] = (t + 0.5) / (n + 1)
        first = last + 1
    return np.maximum.accumulate(found)


def fit(labelled: DataFrame) -> Model:
    """A model of ``labelled`` (text, toxic 0 or 1). The driver receives at most 22,000 words, 65,536 pairs of lengths and 401 steps of each label."""
    labelled = labelled.select("text", F.col("toxic").cast("int").alias("toxic"))
    ordinary, toxic = dictionaries(labelled)
    counted = labelled.mapInArrow(_pair_counts(ordinary, toxic), "toxic int, pair int, n long").groupBy("toxic", "pair").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, (LONGEST + 1) ** 2))
    for r in counted.collect():
        counts[r.toxic, r.pair] = r.n
    totals = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weights = np.log((counts[1] + 0.5) / (totals.get(1, 0) + 1)) - np.log((counts[0] + 0.5) / (totals.get(0, 0) + 1))
    weights[(counts[1] < LEAST_TEXTS) | (weights < LEAST_WEIGHT)] = 0
    model = Model(ordinary, toxic, weights, np.zeros(MOST_STEPS + 1))
    steps = np.zeros((2, MOST_STEPS + 1), np.int64)
    for r in labelled.mapInArrow(_step_counts(model), "toxic int, step int, n long").groupBy("toxic", "step").agg(F.sum("n").alias("n")).collect():
        steps[r.toxic, r.step] = r.n
    model.chances = rising(steps[1], steps.sum(0))
    return model


def sample(labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """About ``train_rows`` labels (doc_id, toxic) at most, by a hash of doc_id; of several labels of an id the largest counts, null ones don't."""
    known = labels.filter("toxic is not null and doc_id is not null")
    share = min(1.0, train_rows / max(1, known.count()))
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def classify(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from ``threshold`` on) to ``docs``; only text is looked at.

    A null, empty or wordless text gets the score of texts without telling windows. Equal texts get equal scores.
    Whole texts are read, in runs of some megabytes; columns named score and predicted are replaced.
    """
    kept = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, bad = compressor(model.ordinary), compressor(model.toxic)
        for batch, text in _texts(batches, at):
            score = model.chances[_steps(_sums(text, model, plain, bad))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    at = kept.columns.index("text")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The texts of a bounded sample of the labels that may be learned from; the sample's size bounds what is broadcast."""
    chosen = sample(labels.select("doc_id", "toxic").filter(~held_out(F.col("doc_id"))), train_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
